"""DuckDB SQL for the operators that SQL can express.

Contracts give all columns but the verdict of operator 10 (kept, kept_chars), the class size of operator 5 (n_texts) and the URL key, timestamp and position of
operator 7: those follow the rules that the operators state.
Operators 1 (marginal compressed bytes), 2 (placement of aligned windows), 3 (ridge regression), 6 and 8 (byte-pair merges) and 9 (hash draws
and CRC-32, which DuckDB lacks) have none. Word and phrase lists are those of the operator, as parameters.
"""

from __future__ import annotations

from genoloom.llm import rules

#: Code points that end a word by contract, and those at which rules on lines cut words (Unicode white space).
CUT = r"\x20\x09-\x0D"
UNICODE_CUT = r"\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _texts(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: Strings of 100 bytes are 200 hexadecimal digits. Starts of repeats merge into runs where they touch.
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS g FROM places),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM repeats),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM runs),
cut AS (
  SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{CUT}]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
),
members AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
sizes AS (
  SELECT component_id, count(DISTINCT list_sort(s)) AS n_texts FROM classes JOIN sets ON sets.doc_id = classes.doc_id WHERE len(s) > 0 GROUP BY component_id
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, classes.component_id, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
FROM sets JOIN classes ON classes.doc_id = sets.doc_id LEFT JOIN sizes ON sizes.component_id = classes.component_id
"""

OP7 = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS response FROM p),
u AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM r
),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
    strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
  FROM u
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to, url_key, ts, CAST(row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS BIGINT) AS position
FROM k
"""

_SYMBOLS = r"[^#*$%&|<>]"
_TERMINAL = "'" + rules.TERMINAL.replace("'", "''") + "'"
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{CUT}]+') AS w FROM documents),
triples AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i : w[i:i + 2])) AS t FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS k FROM triples) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id),
cut AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, i, line, bare, regexp_extract_all(bare, '[^{UNICODE_CUT}]+') AS w, lower(bare) AS low, length(regexp_replace(bare, '[{CUT}]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) AS nth, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth_line
  FROM (SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM cut) WHERE bare <> ''
),
ends AS (
  SELECT *, contains({_TERMINAL}, right(bare, 1)) AS ended, left(lead(bare) OVER (PARTITION BY doc_id ORDER BY i), 1) AS after,
    length(regexp_replace(bare, '[^{rules.SEPARATORS}]', '', 'g')) AS cuts
  FROM lines
),
rows_of AS (SELECT *, NOT ended AND len(w) <= {rules.ITEM_WORDS} AS short, sum(CASE WHEN NOT ended AND len(w) <= {rules.ITEM_WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS row_no FROM ends),
menus AS (SELECT *, short AND sum(CASE WHEN short THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row_no) >= {rules.MENU_LINES} AS in_menu FROM rows_of),
judged AS (
  SELECT doc_id, chars, nth_line,
    in_menu OR cuts >= 2 AND len(w) <= {rules.ITEM_WORDS} * (cuts + 1)
    OR len(w) >= {rules.LONG_LINE} AND NOT ended AND NOT coalesce(lower(after) = after AND upper(after) <> after, FALSE) AND regexp_replace(bare, '[^{rules.SENTENCE_ENDS}]', '', 'g') = ''
    OR (contains(bare, '://') OR contains(bare, 'www.')) AND 2 * len(list_filter(w, lambda x : contains(x, '://') OR starts_with(x, 'www.'))) >= len(w)
    OR contains(bare, '©') OR
    len(w) > 3 AND nth > 1
    OR len(w) >= 3 AND (length(regexp_replace(bare, '{_SYMBOLS}', '', 'g')) * 5 >= len(w) * 2 OR length(regexp_replace(bare, '[^!]', '', 'g')) * 2 >= len(w))
    OR len(w) >= 4 AND len(list_filter(w, lambda x : upper(x) = x AND lower(x) <> x)) * 10 >= len(w) * 7
    OR len(w) >= 8 AND len(list_distinct(w)) * 10 <= len(w) * 7 AND list_max(map_values(list_aggregate(w, 'histogram'))) * 10 >= len(w) * 4
    OR len(w) <= {rules.ITEM_WORDS} AND rtrim(low, ' >»|.') IN ({_texts(rules.NAVIGATION)})
    OR len(list_filter([{_texts(rules.BOILERPLATE)}], lambda x : contains(low, x))) > 0 AS fails
  FROM menus
),
left_over AS (SELECT doc_id, sum(CASE WHEN nth_line > 1 THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE chars END) AS kept_chars FROM judged GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x : length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM d LEFT JOIN repeats ON repeats.doc_id = d.doc_id LEFT JOIN left_over ON left_over.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept, kept_chars
FROM counts
"""

ORACLES = {"op4_suffix_dedup": OP4, "op5_jaccard_join": OP5, "op7_warc": OP7, "op10_quality_rules": OP10}
