"""Operator 8: edit-aware token counting.

Each document keeps its pre-tokens in leaf blocks of bounded size under a segment tree of character and token sums. An edit finds its blocks by
descending the character sums, re-splits and re-encodes from the last pre-token that the edit cannot reach up to the first old boundary
that the new text meets again, and updates the sums above.

The split pattern never looks behind and looks at most two characters past a match, so pre-tokens that end two
characters before an edit stay, and once a new boundary falls on an old one behind the edit the rest stays.

A null text counts as empty; null edits count as none, null members of an edit as 0 or an empty string; an edit beyond the text's end is moved to
its end. Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import fresh, map_texts, table

#: Pre-tokens of a leaf block; entries of the count cache. A full cache stays until eight times as many pieces were missed, and is then emptied.
BLOCK, CACHE = 128, 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split = self.pattern.findall
        self.cache: dict[str, int] = {}
        self.missed = 0

    def count(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.cache) < CACHE:
                if len(piece) <= 64:
                    self.cache[piece] = n
            else:
                self.missed += 1
                if self.missed > 8 * CACHE:
                    self.cache, self.missed = {}, 0
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """The pre-tokens of one text in blocks, with sums of characters and tokens above them."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.text = counter, text
        pieces = counter.split(text)
        self.encoded = 0
        self._build([(x, *self._sums(x)) for x in (pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK))])

    def _sums(self, block: list[str]) -> tuple[int, int]:
        return sum(map(len, block)), sum(map(self.counter.count, block))

    def _build(self, leaves: list[tuple[list[str], int, int]]) -> None:
        """The tree over blocks with their characters and tokens."""
        leaves = leaves or [([], 0, 0)]
        self.blocks = [x[0] for x in leaves]
        self.size = 1 << (len(leaves) - 1).bit_length()
        none = [0] * (self.size - len(leaves))
        self.chars, self.tokens = [0] * self.size + [x[1] for x in leaves] + none, [0] * self.size + [x[2] for x in leaves] + none
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _put(self, i: int, block: list[str]) -> None:
        self.blocks[i] = block
        i += self.size
        self.chars[i], self.tokens[i] = self._sums(block)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character at (the last one with characters for the end), and its start."""
        i, start = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(start + max(deleted, 0), n)
        self.text = self.text[:start] + inserted + self.text[end:]
        shift = len(inserted) - (end - start)
        first, at = self._find(max(start - 2, 0))
        bounds = [at, *accumulate(map(len, self.blocks[first]), initial=at)][1:]
        keep = max(bisect_right(bounds, start - 2) - 1, 0)  # pre-tokens of the first block that stay
        head, begin = self.blocks[first][:keep], bounds[keep] if keep < len(bounds) else at
        # old boundaries from the edit's end on, read block by block as the new text asks for them
        last, ahead = first, at
        old: dict[int, tuple[int, int]] = {}
        reached = -1

        def read_to(where: int) -> None:
            nonlocal last, ahead, reached
            while reached < where and last < len(self.blocks):
                for k, p in enumerate(self.blocks[last]):
                    old[ahead] = (last, k)
                    ahead += len(p)
                reached = ahead - 1
                last += 1

        new, here = [], begin
        meet = None
        for m in self.counter.pattern.finditer(self.text, begin):
            if m.start() - shift >= end:
                read_to(m.start() - shift)
                if (meet := old.get(m.start() - shift)) is not None:
                    break
            new.append(m[0])
            here = m.end()
        self.encoded += len(new)
        if meet is None:
            tail, upto = [], len(self.blocks)
        else:
            tail, upto = self.blocks[meet[0]][meet[1] :], meet[0] + 1
        for i in range(first + 1, upto):
            if self.blocks[i]:
                self._put(i, [])
        block = head + new + tail
        if len(block) <= 2 * BLOCK:
            self._put(first, block)
            if not self.chars[1]:
                self._build([])
            return
        # a long insertion: its blocks get places of their own, and the tree is built over the sums that are there
        parts = [block[i : i + BLOCK] for i in range(0, len(block), BLOCK)]
        old = [(x, self.chars[self.size + i], self.tokens[self.size + i]) for i, x in enumerate(self.blocks)]
        self._build([x for x in [*old[:first], *((p, *self._sums(p)) for p in parts), *old[first + 1 :]] if x[0]])


def recount(text: str | None, edits: list[dict] | None, counter: Counter) -> tuple[int, int, int, int, int]:
    """Characters and tokens before, the same after the edits, and the pre-tokens encoded again for them."""
    tree = TokenTree(text or "", counter)
    before = len(tree.text), tree.n_tokens
    for e in edits or []:
        if e is not None:
            tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
    return (*before, len(tree.text), tree.n_tokens, tree.encoded)


def count_tokens(docs: DataFrame, edits_col: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Counts of each row of docs before and after the edits of its edits_col: array<struct<start,deleted,inserted>>, applied in turn. No shuffle."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(x: dict) -> dict:
        counter = load(path)
        got = [recount(t, e, counter) for t, e in zip(x["text"], x["edits"])]
        return {"doc_id": x["doc_id"], **{k: [g[i] for g in got] for i, k in enumerate(("n_chars", "n_tokens", "edited_chars", "edited_tokens", "n_reencoded"))}}

    return map_texts(docs, {"doc_id": id_col, "text": text_col, "edits": edits_col}, f"doc_id {kind}, n_chars bigint, n_tokens bigint, edited_chars bigint, edited_tokens bigint, n_reencoded bigint", rows)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """docs with a column edits_col gathered from an edits table (doc_id, seq, start, deleted, inserted), in the order of seq; docs must not have that column."""
    if edits_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {edits_col}")
    key = fresh(docs, "edit_id")
    per = edits.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias(edits_col))
    per = per.withColumn(edits_col, F.transform(edits_col, lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted"))))
    return docs.join(per, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)


def rule_edits(text: F.Column) -> F.Column:
    """The edits of the query: a replacement at a third, an insertion at two thirds, a deletion at the end, by the text's length."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    return F.array(one(F.floor(n / 3), 7, " revised text"), one(F.floor(n * 2 / 3), 0, "x"), one(F.greatest(n - 5, F.lit(0)), 5, ""))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs.select("doc_id", "text", rule_edits(F.col("text")).alias("edits")), "edits")
