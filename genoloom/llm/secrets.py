"""Operator 1: secret scans by dictionary-primed zstandard novelty.

A candidate is a long run of key characters around a sensitive term, before or behind it and on any line. Its novelty is the number of
bytes that it adds to a zstandard stream primed with an identifier dictionary and the text around it, without other copies of the candidate.
The dictionary holds the words that the corpus makes its identifiers of: the most frequent ones, counted over all documents, up to DICTIONARY_BYTES. Strings
that stay incompressible there, measured against min_ratio or the entropy bound of their alphabet, whichever is less, are
reported as kind ``novel`` wherever the text has them, beside the three fixed patterns ``assign``, ``access`` and ``hex``. Candidates have at least
min_length characters of two classes among digits, lower and upper case (words and numbers have one); shorter last lines of wrapped keys stay.

Nulls and empty texts have no spans. Offsets are code points, end exclusive. Repeated rows give repeated results; an empty
table gives an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import map_texts, small_batches, table

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of one or more, of which the short ones are dropped
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Terms that make the text around them a sensitive context.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api[ _-]?key|credential|bearer|authorization|private[ _-]?key|access[ _-]?key|signing[ _-]?key|auth[ _-]?key", re.I | re.A)
SENSITIVE_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")

#: A value in a run of key characters: = only ends it.
VALUE = re.compile(r"[^=]+=*")
#: Code points of context on either side of a candidate that may hold the sensitive term and that prime the compressor.
SURROUNDING = 512
#: Code points between the lines of a wrapped key.
WRAP = 16
#: Share of entropy_bound() that a novel string reaches: zstandard finds a few short matches in random strings by chance.
BOUND_SHARE = 0.95

LOWER_HEX, UPPER_HEX = frozenset("0123456789abcdef"), frozenset("0123456789ABCDEF")
CLASSES = (frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
ALNUM = frozenset().union(*CLASSES)

#: Words that the dictionary of any corpus has.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key private_key credential credentials authorization bearer
username user_name user_id client_id client_secret session_id request response header content_type application json
http https localhost example com org net www index html config configuration settings environment default value
public static void return function class import from def self this true false null none string integer boolean
username@example.com get_value set_value to_string from_string base64 sha256 md5 hash encode decode encrypt decrypt
service account database connection host port timeout retry logger debug info warning error exception
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 placeholder changeme your_token_here xxxxxxxxxxxxxxxx
"""


#: Bytes of the dictionary; letters of a word in it; different words that a task counts before it hands them on.
DICTIONARY_BYTES, WORD_LETTERS, HELD_WORDS = 16 << 10, (5, 16), 200_000
#: The words of identifiers: runs of letters that case, digits and signs cut. Random keys fall to pieces too short to enter, however often they are repeated.
_PARTS = re.compile(rb"[A-Za-z][a-z]{%d,%d}(?![a-z])|[A-Z]{%d,%d}(?![A-Za-z])" % (WORD_LETTERS[0] - 1, WORD_LETTERS[1] - 1, *WORD_LETTERS))


def identifier_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The dictionary of a corpus: IDENTIFIERS and the most frequent words of identifiers in all texts, each in lower case and capitalized, the most frequent last.

    Counts cover all documents; only the DICTIONARY_BYTES of the result reach the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            for t in b["text"].to_pylist():
                if t:
                    held.update(w.lower().decode() for w in _PARTS.findall(t.encode()))
            if len(held) >= HELD_WORDS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    most = DICTIONARY_BYTES // (2 * (WORD_LETTERS[0] + 1))
    words, size = [], 0
    for r in counts.orderBy(F.desc("n"), "word").limit(most).collect():  # bounded: the dictionary's bytes
        size += 2 * len(r.word) + 2
        if size > DICTIONARY_BYTES:
            break
        words.append(f"{r.word} {r.word.capitalize()}")
    return IDENTIFIERS.encode() + " ".join(reversed(words)).encode() + b"\n"


def novelty(candidate: str, before: str, after: str, dictionary: bytes = IDENTIFIERS.encode()) -> int:
    """Bytes that candidate adds to a stream primed with the identifier dictionary and the text on both sides."""
    primed = zstandard.ZstdCompressionDict(dictionary + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: start, end, kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy_bound(candidate: str) -> float:
    """Bytes a character that no entropy code saves on random strings of the candidate's alphabet: 0.5 for hex of one case, 0.74 or more for base64."""
    found = set(candidate)
    if found <= UPPER_HEX or found <= LOWER_HEX:
        size = 16
    elif found <= UPPER_HEX | LOWER_HEX:
        size = 22
    else:
        size = sum(len(c) for c in CLASSES if found & c) + len(found - ALNUM)
    return log2(max(size, 1)) / 8


class Scanner:
    """What decides on candidates: the least length, the novelty in bytes a character, the reach of a term in code points and the dictionary."""

    def __init__(self, min_length: int = 16, min_ratio: float = 0.75, reach: int = SURROUNDING, dictionary: bytes = IDENTIFIERS.encode()):
        self.min_length, self.min_ratio, self.reach, self.dictionary = min_length, min_ratio, reach, dictionary

    def measure(self, text: str, start: int, end: int) -> int | None:
        """The novelty of text[start:end] if it is a novel candidate. Other occurrences of it in the surrounding text do not prime the compressor."""
        s = text[start:end]
        if len(s) < self.min_length or sum(bool(c & set(s)) for c in CLASSES) < 2:
            return None
        blank, reach = " " * len(s), SURROUNDING + len(s)
        before = text[max(0, start - reach) : start].replace(s, blank)[-SURROUNDING:]
        after = text[end : end + reach].replace(s, blank)[:SURROUNDING]
        n = novelty(s, before, after, self.dictionary)
        return n if n >= min(self.min_ratio, BOUND_SHARE * entropy_bound(s)) * len(s) else None

    def parts(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """Novel strings of a run of key characters: its values between inner =, or else the run, or else what stands between terms in it."""
        whole = text[start:end]
        values = [(start + m.start(), start + m.end()) for m in VALUE.finditer(whole)]
        cuts = [start, *(start + m.end() for m in SENSITIVE.finditer(whole)), end]
        for tries in (values, [(start, end)], list(zip(cuts, cuts[1:])) if len(cuts) > 2 else []):
            found = [(a, b, n) for a, b in tries if (n := self.measure(text, a, b)) is not None]
            if found:
                return found
        return []


def _outside(spans: list[tuple[int, int, str]]):
    """Whether a span has no character in common with the given ones, which are in order of their starts."""
    starts, ends = [], []
    for a, b, _ in spans:
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda a, b: not (i := bisect_left(starts, b)) or ends[i - 1] <= a


def novel_spans(text: str, taken: list[tuple[int, int, str]], by: Scanner) -> list[tuple[int, int, str, int]]:
    """Incompressible strings around a sensitive term, outside the taken spans, and all their occurrences in the text: start, end, kind, novelty in bytes.

    A run of key characters is measured if a term is at most by.reach code points in front of it or behind it, on any line, or if
    nothing but other than letters and digits, at most WRAP of them, separates it from a run that was found: the lines of a wrapped key.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE_STEMS):
        return []
    terms = [m.span() for m in SENSITIVE.finditer(text)]
    if not terms:
        return []
    free, min_length = _outside(taken), by.min_length
    runs = [m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= min_length]
    got: list[list | None] = [None] * len(runs)
    t = 0
    measure = lambda i: by.parts(text, *runs[i]) if free(*runs[i]) else []
    joined = lambda i: runs[i + 1][0] - runs[i][1] <= WRAP and not any(map(str.isalnum, text[runs[i][1] : runs[i + 1][0]]))
    for i, (a, b) in enumerate(runs):
        while t < len(terms) and terms[t][1] + by.reach < a:
            t += 1
        if t < len(terms) and terms[t][0] <= b + by.reach or i and got[i - 1] and joined(i - 1):
            got[i] = measure(i)
    for i in range(len(runs) - 2, -1, -1):
        if got[i] is None and got[i + 1] and joined(i):
            got[i] = measure(i)

    values: dict[str, dict[str, int]] = {}
    for a, b, n in (x for g in got if g for x in g):
        values.setdefault(text[a : a + min_length], {}).setdefault(text[a:b], n)
    if not values:
        return []
    found = []
    for (a, b), mine in zip(runs, got):
        spans = list(mine or ())
        for at in range(a, b - min_length + 1):
            for v, n in values.get(text[at : at + min_length], {}).items():
                if text.startswith(v, at) and at + len(v) <= b and free(at, at + len(v)):
                    spans.append((at, at + len(v), n))
        last = a
        for x, y, n in sorted(spans, key=lambda s: (s[0], -s[1])):
            if y > last:  # not inside one that is there
                found.append((x, y, "novel", n))
                last = y
    return found


def scan(text: str | None, by: Scanner | None = None) -> list[dict]:
    """All spans of one text by start, then kind as in KINDS."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(*s, None) for s in base] + novel_spans(text, base, by or Scanner())
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return [{"kind": k, "start": a, "end": b, "value": text[a:b], "novelty": n} for a, b, k, n in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id and secrets, an array of (kind, start, end, value, novelty). options are those of Scanner.

    One pass counts the dictionary's words if none is given; the scan is one narrow stage without a shuffle.
    """
    by = Scanner(**{"dictionary": None, **options})
    if by.dictionary is None:
        by.dictionary = identifier_dictionary(docs, text_col)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, secrets array<struct<kind:string,start:bigint,end:bigint,value:string,novelty:bigint>>"
    return map_texts(docs, {"doc_id": id_col, "text": text_col}, schema, lambda x: {"doc_id": x["doc_id"], "secrets": [scan(t, by) for t in x["text"]]})


def mask(text: str | None, mark: str = "[SECRET]", by: Scanner | None = None) -> str | None:
    """text with every reported span, overlapping ones merged, replaced by mark."""
    spans = scan(text, by)
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """docs with every secret in text_col replaced by mark; all columns stay, length_col follows the text if it is there."""
    import pyarrow.compute as pc
    from pyspark.sql.types import StructType

    shape = StructType(docs.schema.fields)
    by = Scanner(**{"dictionary": None, **options})
    if by.dictionary is None:
        by.dictionary = identifier_dictionary(docs, text_col)

    def run(batches):
        for b in batches:
            t = pa.array([mask(x.as_py(), mark, by) for x in b[text_col]], pa.string())
            b = b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col), t.cast(b.schema.field(text_col).type))
            if length_col in b.schema.names:
                f = b.schema.field(length_col)
                b = b.set_column(b.schema.get_field_index(length_col), f, pc.utf8_length(t).cast(f.type))
            yield b

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, shape)


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of find_secrets() rows."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[kind(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", line), ",").alias("spans"),
        kind("novel").alias("n_novel"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))
