"""Operator 2: benchmark decontamination by spaced seeds.

Fixed masks pick some words of a window and ignore the others, so a substituted word in an ignored place does not hide a match. Hashes
of all masked windows of the benchmark are joined with those of the training texts; around each hit, text and item are aligned
and compared word by word, by 64-bit hashes of the words. An alignment counts if some window of ``window`` aligned words (the whole item if it is shorter) agrees in
at least ``share`` of its words.

Items of five to seven words also have masks that ignore one of their words, and shorter ones are looked up as phrases, so items of all lengths are
found with as many substitutions as ``share`` of the default leaves.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Nulls and empty texts on either side match nothing. Ties go to the earliest place. Repeated rows
of one doc_id give one row per item. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.common import fresh, small_batches, stored, table

#: Places of a window that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 4, 6, 8))
#: By the words of a short item, the places that its masks look at: all below five words, all but one from there on.
SHORT_MASKS = {n: [tuple(range(n))] if n < 5 else [tuple(p for p in range(n) if p != left_out) for left_out in range(n)] for n in range(1, 8)}
#: Bits of the filter of benchmark hashes: 256 a hash within these powers of two. Beyond, it lets more through, and nothing is lost.
FILTER_BITS = (16, 24)
#: Places in the filter that each hash sets and needs.
PROBES = 3
#: Copies of the benchmark's hashes, so that a passage that many documents hold is joined by as many tasks.
SALTS = 16

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    data, offsets = W.raw_bytes(pc.utf8_lower(texts))
    return W.words(data, offsets, IS_WORD, W.byte_values(True, 11)), offsets


def _seeds(w: W.Words, lengths):
    """(exact, word index, hash, n) of all masked windows; of the masks for items of n words those of the given lengths, else n is 0. exact: it looks at all n words."""
    masks = [(mask, mask[-1] + 1, 0) for mask in MASKS] + [(mask, n, n) for n, some in SHORT_MASKS.items() for mask in some]
    for m, (mask, span, n) in enumerate(masks):
        if n and n not in lengths:
            continue
        at, h = W.windows(w, mask, span)
        with np.errstate(over="ignore"):
            yield len(mask) == n, at, W.mix(h + np.uint64(m + 1)), n


def _parts(texts: pa.Array):
    """Slices of a column that one pass takes."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    yield from W.slices(lengths)


def _as_lists(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]


def benchmark_seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of the benchmark: seeds (hash, item, at) and items (item, words), both written to the shared folder."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi in _parts(b["text"]):
                w, _ = _words(b["text"][lo:hi])
                ids, text = b["id"].to_pylist()[lo:hi], w.text
                per: list[list] = [[] for _ in ids]
                sizes = np.diff(w.first)
                for _, at, h, n in _seeds(w, set(sizes.tolist())):
                    t = text[at] if len(at) else at
                    for i in np.unique(t):
                        if n and sizes[i] != n:
                            continue
                        per[i] += [(int(x), int(y)) for x, y in zip(h[t == i].view(np.int64), at[t == i] - w.first[i])]
                yield pa.RecordBatch.from_pydict({"item": pa.array(ids, b.schema.field("id").type), "words": _as_lists(w.hash, w.first), "seeds": [[{"hash": x, "at": y} for x, y in p] for p in per]}, schema=pa.schema([("item", b.schema.field("id").type), ("words", pa.binary()), ("seeds", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())])))]))

    whole = stored(items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"item {kind}, words binary, seeds array<struct<hash:bigint,at:bigint>>"), "benchmark")
    return whole.select("item", F.explode("seeds").alias("s")).select("s.hash", "item", "s.at"), whole.select("item", "words")


def _places(h: np.ndarray, power: int) -> list[np.ndarray]:
    """The places of hashes in a filter of 2^power bits."""
    out, h = [], h.copy()
    for _ in range(PROBES):
        out.append((h >> np.uint64(64 - power)).astype(np.int64))
        W.mix(h)
    return out


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seeds' hashes, at most 2^24 bits, and its power of two. Tasks fill bitmaps; at most 8 reach the driver."""
    n = seeds.count()
    power = min(max(int(n * 256).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches):
        bits = np.zeros(1 << power, bool)
        for b in batches:
            for at in _places(b["hash"].to_numpy().view(np.uint64), power):
                bits[at] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << (power - 3), np.uint8)
    for r in seeds.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out).astype(bool), power


def _hits(bits, reach: int, lengths: frozenset):
    """Rows (uid, doc_id, hits, stretches) of documents with masked windows that pass the filter.

    A stretch is the word hashes from reach words before a hit to reach words behind it, overlapping ones merged.
    """

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        passed, power = bits.value
        for b in batches:
            out: dict[str, list] = {"uid": [], "doc_id": [], "hits": [], "stretches": []}
            ids = b["doc_id"]
            for lo, hi in _parts(b["text"]):
                w, _ = _words(b["text"][lo:hi])
                found = []
                for exact, at, h, _ in _seeds(w, lengths):
                    ok = np.flatnonzero(passed[(h >> np.uint64(64 - power)).astype(np.int64)])
                    ok = ok[np.logical_and.reduce([passed[p] for p in _places(h[ok], power)])]
                    if exact and len(ok):  # the first place of a phrase in a text is the best: all are equal
                        one = np.stack([np.searchsorted(w.first, at[ok], "right").astype(np.int64), h[ok].view(np.int64)])
                        ok = ok[np.sort(np.unique(one, axis=1, return_index=True)[1])]
                    found.append(np.stack([at[ok], h[ok].view(np.int64)]))
                hits = np.concatenate(found, axis=1)
                if not hits.shape[1]:
                    continue
                hits = hits[:, np.argsort(hits[0], kind="stable")]
                text = np.searchsorted(w.first, hits[0], "right") - 1
                for i in np.unique(text):
                    mine, (first, last) = hits[:, text == i], w.first[i : i + 2]
                    a = np.maximum(mine[0] - reach, first)
                    z = np.minimum(mine[0] + reach, last)
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    begin, end = a[new], z[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(z) - 1]])]
                    uid += 1
                    out["uid"].append(uid)
                    out["doc_id"].append(ids[lo + int(i)].as_py())
                    out["hits"].append([{"hash": int(h), "at": int(p - first)} for p, h in mine.T])
                    out["stretches"].append([{"from": int(p - first), "words": w.hash[p:q].tobytes()} for p, q in zip(begin, end)])
            if out["uid"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("uid", pa.int64()), ("doc_id", b.schema.field("doc_id").type), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))), ("stretches", pa.list_(pa.struct([("from", pa.int64()), ("words", pa.binary())])))]))

    return run


def align(stretches: list[tuple[int, np.ndarray]], item: np.ndarray, diagonal: int, window: int) -> tuple[float, int, int, int]:
    """The best window on a diagonal (text place minus item place): share of equal words, equal words, its words, its place in the text."""
    n = min(window, len(item))
    best = (0.0, 0, n, 0)
    for begin, text in stretches:
        lo, hi = max(begin, diagonal), min(begin + len(text), diagonal + len(item))
        if hi - lo < n:
            continue
        same = np.concatenate([[0], np.cumsum(text[lo - begin : hi - begin] == item[lo - diagonal : hi - diagonal])])
        sums = same[n:] - same[:-n]
        k = int(np.argmax(sums))
        if sums[k] / n > best[0]:
            best = (float(sums[k] / n), int(sums[k]), n, lo + k)
    return best


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: float = 0.8) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, similarity, n_same, n_words, at_word.

    Texts are read once and never shuffled; only windows that pass the filter leave the first stage.
    """
    spark = docs.sparkSession
    small_batches(spark)
    seeds, wanted = benchmark_seeds(items, item_id, item_text)
    bits = spark.sparkContext.broadcast(seed_filter(seeds))
    short = wanted.select((F.octet_length("words") / 8).cast("int").alias("n")).filter(F.col("n").between(1, max(SHORT_MASKS))).distinct()
    lengths = frozenset(r.n for r in short.collect())
    kind = docs.schema[id_col].dataType.simpleString()
    reach = window + MASKS[-1][-1] + 1
    marked = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_hits(bits, reach, lengths), f"uid bigint, doc_id {kind}, hits array<struct<hash:bigint,at:bigint>>, stretches array<struct<`from`:bigint,words:binary>>"),
        "hits",
    )
    hits = marked.select("uid", F.explode("hits").alias("h")).select("uid", "h.hash", F.col("h.at").alias("text_at"), F.pmod("uid", F.lit(SALTS)).alias("salt"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    pairs = hits.join(seeds.select("hash", "item", "at", copies), ["hash", "salt"]).select("uid", "salt", "item", (F.col("text_at") - F.col("at")).alias("diagonal")).distinct()
    pairs = pairs.join(wanted.select("item", "words", copies), ["item", "salt"]).join(marked.select("uid", "doc_id", "stretches"), "uid")

    def verify(batches):
        for b in batches:
            got = []
            for s, words, d in zip(b["stretches"].to_pylist(), b["words"].to_pylist(), b["diagonal"].to_pylist()):
                got.append(align([(x["from"], np.frombuffer(x["words"], np.uint64)) for x in s], np.frombuffer(words, np.uint64), d, window))
            cols = list(zip(*got)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["item"], pa.array(cols[0], pa.float64()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "item_id", "similarity", "n_same", "n_words", "at_word"])

    item_kind = items.schema[item_id].dataType.simpleString()
    checked = pairs.select("doc_id", "item", "words", "diagonal", "stretches").mapInArrow(verify, f"doc_id {kind}, item_id {item_kind}, similarity double, n_same bigint, n_words bigint, at_word bigint")
    best = F.max_by(F.struct("similarity", "n_same", "n_words", "at_word"), F.struct("similarity", (-F.col("at_word")).alias("early")))
    return checked.filter(F.col("n_same") >= share * F.col("n_words")).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id holds no benchmark item; null ids are kept."""
    name = fresh(docs, "leaked")
    leaked = find_leaks(docs, items, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, F.col(options.get("id_col", "doc_id")) == F.col(name), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
