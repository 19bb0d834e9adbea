"""Operator 4: exact removal of repeated byte strings by a distributed merge sort of sampled suffixes.

A string of ``length`` bytes is a repeat if it also starts earlier (smaller doc_id, or earlier in the same document). Every such string contains
an anchor, the place in it whose GRAM-byte gram hashes lowest; equal strings have theirs at the same offset, so it is
enough to sort the suffixes at anchors, about one in 35 bytes.

1. Anchors. Each task makes sorted runs of its anchors (gram hash, hash of the whole stretch of bytes that the strings of the anchor cover, place).
   Stretches of a run that are equal, byte by byte, settle all but the earliest of them there and then; the earliest are exchanged by gram, and those
   whose gram no other has are done.
2. Suffixes. Of the rest each task sorts the suffixes and writes
   runs in front coding: the length of the prefix shared with the suffix before, and the remaining bytes. Runs are exchanged by gram and
   merged by a loser tree that keeps the common prefix with the last winner and never compares it again. The
   common prefixes to the right and those of the reversed left contexts give, for every offset, classes of equal strings;
   all but the earliest of a class are repeats.
3. Removal. A document's repeated starts come together with its text once more.

Strings that two documents share are judged on the input. Null and empty texts have no bytes. Rows with equal doc_id and text are one
document and return equal rows; rows with equal doc_id and other texts are documents in the order of their text's hash. A null
doc_id comes after all others. An empty table gives an empty result. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.common import small_batches, stored, table
from genoloom.llm.packing import planes, unplanes

#: Bytes of a gram.
GRAM = 32
#: Bytes of text of one run, and of packed anchors that one task of the exchange should get; tasks of an exchange at least.
RUN_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 4 << 20, 32
#: Bits of the fixed-size filter of documents in need of their text again. It only saves shuffling; joins decide.
FILTER_BITS = 24
NULL_ID = (1 << 63) - 1
#: Stretches of one gram that one task compares; more are compared string by string with a shuffle on each string's hash.
GROUP = 200_000


def range_hash(total: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of data[a:z] from running totals."""
    with np.errstate(over="ignore"):
        return W.mix((total[z] - total[a]) * W.powers(W.INVERSE, len(total))[a])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of texts data[offsets[i]:offsets[i+1]]: text, at, first and last start of its strings (places in data), gram and stretch hashes."""
    n, span = len(data), length - GRAM + 1
    none = {k: np.zeros(0, np.int64) for k in ("text", "at", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("gram", "stretch")}
    if n < length:
        return none
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(W.byte_values(False, 3)[data] * W.powers(W.BASE, n), out=total[1:])
    places = np.arange(n - GRAM + 1)
    gram = range_hash(total, places, places + GRAM)
    bits = max(int(n).bit_length(), 1)
    key = (gram >> np.uint64(bits) << np.uint64(bits)) | places.astype(np.uint64)
    # least key of span places: doubling, then two overlapping halves
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    at = (key & np.uint64((1 << bits) - 1)).astype(np.int64)  # of the string that starts at each place
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    if not len(text):
        return none
    start = np.arange(len(text)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = at[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    i = np.flatnonzero(new)
    first, last, at, text = start[i], start[np.concatenate([i[1:] - 1, [len(start) - 1]])], at[i], text[i]
    stretch = range_hash(total, first, last + length)
    with np.errstate(over="ignore"):
        stretch = W.mix(stretch + ((at - first) * 256 + (at - last)).astype(np.uint64))
        spread = W.mix(gram[at] + np.uint64(1))  # the least hashes of their windows are small; buckets need them even
    return {"text": text, "at": at, "first": first, "last": last, "gram": spread, "stretch": stretch}


_RUN = "bucket int, gram binary, stretch binary, doc binary, part binary, at binary, before binary, upto binary, settled boolean"
_FOUND = "doc bigint, part int, settled boolean, gram bigint, at bigint, first bigint, last bigint, crowd boolean"
_KINDS = {"gram": np.uint64, "stretch": np.uint64, "doc": np.int64, "part": np.uint32, "at": np.uint32, "before": np.uint8, "upto": np.uint8}
#: The bit of a part that marks a null doc_id.
NO_ID = np.uint32(1 << 31)


def _part(texts: pa.Array, ids: pa.Array) -> np.ndarray:
    """A 31-bit hash of each text, which tells documents of one doc_id apart, under the bit that marks a null doc_id."""
    h = np.array([int.from_bytes(blake2b((t or "").encode(), digest_size=4).digest(), "little") for t in texts.to_pylist()], np.uint32) & ~NO_ID
    return h | np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, np.uint32(0))


def _runs(buckets: int, length: int):
    """Sorted runs of anchors, cut by gram into buckets. Anchors that the run itself settles, and copies of a text that the task saw under a smaller
    doc_id, are dealt out evenly, whatever their grams."""

    def packed(v: dict[str, np.ndarray], bucket: int, settled: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), **{k: [planes(v[k])] for k in _KINDS}, "settled": [settled]})

    def dealt(v: dict[str, np.ndarray]):
        n = len(v["doc"])
        for a in range(0, n, 1 << 15):
            some = {k: x[a : a + (1 << 15)] for k, x in v.items()}
            yield packed(some, int(int(some["gram"][0]) % buckets), True)

    def flush(held: list[dict[str, np.ndarray]], copies: list[dict[str, np.ndarray]], raw: bytes):
        if any(len(h["doc"]) for h in held):
            v = {k: np.concatenate([h[k] for h in held]) for k in (*_KINDS, "place")}
            order = np.lexsort((v["at"], v["part"], v["doc"], v["stretch"], v["gram"]))
            v = {k: x[order] for k, x in v.items()}
            same = np.concatenate([[False], (v["gram"][1:] == v["gram"][:-1]) & (v["stretch"][1:] == v["stretch"][:-1])])
            start, size = v["place"] - v["before"], v["before"].astype(np.int64) - v["upto"] + length
            for i in np.flatnonzero(same).tolist():
                a, b, n = start[i], start[i - 1], size[i]
                if raw[a : a + n] != raw[b : b + n]:
                    same[i] = False
            twice = same & np.concatenate([[False], (v["doc"][1:] == v["doc"][:-1]) & (v["part"][1:] == v["part"][:-1]) & (v["at"][1:] == v["at"][:-1])])  # rows that repeat a document
            yield from dealt({k: v[k][same & ~twice] for k in _KINDS})
            v = {k: v[k][~same] for k in _KINDS}
            bucket = (v["gram"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(ends)).tolist():
                yield packed({k: x[ends[i] : ends[i + 1]] for k, x in v.items()}, i, False)
        if copies:
            yield from dealt({k: np.concatenate([h[k] for h in copies]) for k in _KINDS})

    def run(batches):
        held, copies, raw, seen = [], [], bytearray(), {}
        for b in batches:
            ids = pc.fill_null(b["doc"], NULL_ID).to_numpy()
            lengths = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False)
            for lo, hi in W.slices(lengths):
                texts = b["text"][lo:hi]
                data, offsets = W.raw_bytes(texts)
                part = _part(texts, b["doc"][lo:hi])
                order = [(int(i), int(p & NO_ID)) for i, p in zip(ids[lo:hi], part)]
                use, again = [], []
                for i in range(hi - lo):
                    n = offsets[i + 1] - offsets[i]
                    if n < length:
                        continue
                    key = blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                    least = seen.get(key)
                    if least is None or order[i] < least:
                        seen[key] = order[i]
                        use.append(i)
                    elif order[i] > least:
                        again.append(i)
                found = anchors(data, offsets, length)
                take = np.isin(found["text"], use)
                t = found["text"][take]
                at, first, last = (found[k][take] for k in ("at", "first", "last"))
                held.append({"gram": found["gram"][take], "stretch": found["stretch"][take], "doc": ids[lo + t], "part": part[t], "at": (at - offsets[t]).astype(np.uint32), "before": (at - first).astype(np.uint8), "upto": (at - last).astype(np.uint8), "place": at + len(raw)})
                if again:
                    # one row a copy: its anchor is its first byte, its strings are those up to the last start, which is in stretch
                    t = np.array(again)
                    none = np.zeros(len(t), np.int64)
                    copies.append({"gram": ids[lo + t].view(np.uint64), "stretch": (offsets[t + 1] - offsets[t] - length).astype(np.uint64), "doc": ids[lo + t], "part": part[t], "at": none.astype(np.uint32), "before": none.astype(np.uint8), "upto": np.full(len(t), 255, np.uint8)})
                raw += data.tobytes()
            if len(raw) >= RUN_BYTES:
                yield from flush(held, copies, bytes(raw))
                held, copies, raw = [], [], bytearray()
        yield from flush(held, copies, bytes(raw))

    return run


def _settle(t: pa.Table) -> pa.Table:
    """The anchors of one bucket: settled ones, and those that share a gram."""

    def columns(rows: pa.Table) -> dict[str, np.ndarray]:
        return {k: np.concatenate([np.zeros(0, kind), *(unplanes(x, kind) for x in rows[k].to_pylist())]) for k, kind in _KINDS.items()}

    flag = t["settled"].to_numpy()
    done, v = columns(t.filter(pa.array(flag))), columns(t.filter(pa.array(~flag)))
    order = np.lexsort((v["at"], v["part"], v["doc"], v["gram"]))
    v = {k: x[order] for k, x in v.items()}
    new = {k: np.concatenate([[True], v[k][1:] != v[k][:-1]]) if len(order) else np.zeros(0, bool) for k in ("gram", "doc", "part", "at")}
    once = new["gram"] | new["doc"] | new["part"] | new["at"]  # rows that repeat a document have the same places
    v, first = {k: x[once] for k, x in v.items()}, new["gram"][once]
    group = np.cumsum(first) - 1
    size = np.bincount(group)[group] if len(group) else group
    v = {k: x[size > 1] for k, x in v.items()}
    crowd = size[size > 1] > GROUP
    whole = done["upto"] == 255
    at, end = done["at"].astype(np.int64), v["at"].astype(np.int64)
    cols = {
        "doc": np.concatenate([v["doc"], done["doc"]]), "part": np.concatenate([v["part"], done["part"]]).view(np.int32), "settled": np.concatenate([np.zeros(len(end), bool), np.ones(len(at), bool)]),
        "gram": np.concatenate([v["gram"], done["gram"]]).view(np.int64), "at": np.concatenate([end, at]),
        "first": np.concatenate([end - v["before"], at - done["before"]]), "last": np.concatenate([end - v["upto"], np.where(whole, done["stretch"].view(np.int64), at - done["upto"])]),
        "crowd": np.concatenate([crowd, np.zeros(len(at), bool)]),
    }
    return pa.table({k: pa.array(x) for k, x in cols.items()})


# suffix runs


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: the prefix shared with the one before, the number of remaining bytes, and those bytes."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = common(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return np.array(shared, np.uint8), np.array(list(map(len, rest)), np.uint8), b"".join(rest)


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of which known bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo = known
    step = 8
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    while a[lo] == b[lo]:
        lo += 1
    return lo


def merge_runs(runs: list[list[tuple[bytes, int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of (suffix, prefix shared with the one before in its run) by a loser tree.

    Each contender carries the prefix that it shares with the last winner. Of two, the one that shares more is smaller; only
    equal ones are compared, and only past that prefix. Returns (run, place) in order and the prefix each shares with its predecessor.
    """
    k = len(runs)
    size = 1 << max(k - 1, 0).bit_length()
    head = [0] * size
    text: list = [runs[i][0][0] if i < k and runs[i] else None for i in range(size)]
    share = [0] * size  # with the last winner

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's share becomes that with the winner."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common(x, y, share[a])
        if n < len(x) and (n == len(y) or x[n] > y[n]):
            a, b = b, a
        share[b] = n
        return a, b

    losers = [0] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size
        win, losers[node] = duel(play(2 * node), play(2 * node + 1))
        return win

    order, shared = [], []
    win = play(1)
    while text[win] is not None:
        order.append((win, head[win]))
        shared.append(share[win])
        head[win] = i = head[win] + 1
        run = runs[win]
        if i < len(run):
            text[win], share[win] = run[i]
        else:
            text[win] = None
        node = (win + size) // 2
        while node:
            win, losers[node] = duel(win, losers[node])
            node //= 2
    if shared:
        shared[0] = 0
    return order, shared


_SUFFIX = "bucket int, shared binary, rest binary, bytes binary, lefts binary, left binary, doc binary, part binary, at binary, before binary, upto binary"
_META = {"doc": np.int64, "part": np.uint32, "at": np.uint32, "before": np.uint8, "upto": np.uint8}


def _suffix_runs(buckets: int, length: int):
    """Front-coded sorted suffix runs of the open anchors of documents, cut by gram into buckets."""

    def flush(held: list[tuple]):
        per: dict[int, list[tuple]] = {}
        for x in held:
            per.setdefault((x[0] & (1 << 64) - 1) * buckets >> 64, []).append(x)
        for bucket, rows in per.items():
            rows.sort(key=lambda x: x[1])
            shared, rest, tail = front_code([x[1] for x in rows])
            meta = {k: planes(np.array([x[3 + i] for x in rows], kind)) for i, (k, kind) in enumerate(_META.items())}
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "shared": [shared.tobytes()], "rest": [rest.tobytes()], "bytes": [tail], "lefts": [np.array([len(x[2]) for x in rows], np.uint8).tobytes()], "left": [b"".join([x[2] for x in rows])], **{k: [x] for k, x in meta.items()}})

    def run(batches):
        held, size = [], 0
        for b in batches:
            for doc, part, text, marks in zip(b["doc"].to_pylist(), b["part"].to_pylist(), b["text"].to_pylist(), b["open"].to_pylist()):
                raw = text.encode()
                for m in marks:
                    at, first, last = m["at"], m["first"], m["last"]
                    held.append((m["gram"], raw[at : last + length], raw[first:at][::-1], doc, part & 0xFFFFFFFF, at, at - first, at - last))
                    size += length + at - first
            if size >= RUN_BYTES // 2:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(length: int):
    """The repeated starts among the suffixes of one bucket."""

    def merge(t: pa.Table) -> pa.Table:
        runs, left, meta = [], [], {k: [] for k in _META}
        for r in t.to_pylist():
            shared, rest, tail = np.frombuffer(r["shared"], np.uint8).tolist(), np.frombuffer(r["rest"], np.uint8).tolist(), r["bytes"]
            run, last, at = [], b"", 0
            for n, m in zip(shared, rest):
                last = last[:n] + tail[at : at + m]
                at += m
                run.append((last, n))
            runs.append(run)
            sizes = np.frombuffer(r["lefts"], np.uint8).astype(np.int64)
            block = np.zeros((len(sizes), length - GRAM + 1), np.uint8)
            block[np.arange(block.shape[1]) < sizes[:, None]] = np.frombuffer(r["left"], np.uint8)
            left.append(block)
            for k, kind in _META.items():
                meta[k].append(unplanes(r[k], kind))
        first_of = np.concatenate([[0], np.cumsum(list(map(len, runs)))])
        order, shared = merge_runs(runs)
        row = np.array([first_of[r] + i for r, i in order], np.int64)
        shared = np.array(shared, np.int64)
        left = np.concatenate(left)[row]
        meta = {k: np.concatenate(x)[row] for k, x in meta.items()}
        # from here in the order of places; right-hand classes come from the sorted order
        by_place = np.lexsort((meta["at"], meta["part"], meta["doc"]))
        before, upto = meta["before"][by_place], meta["upto"][by_place]
        left = left[by_place]
        n = len(row)
        repeated = np.zeros((n, length - GRAM + 1), bool)
        left_class = np.zeros(n, np.int64)
        for o in range(length - GRAM + 1):
            if o:
                left_class = np.unique(left_class * 256 + left[:, o - 1], return_inverse=True)[1]
            valid = np.flatnonzero((o >= upto) & (o <= before))
            if not len(valid):
                continue
            right_class = np.cumsum(shared < length - o)[by_place]
            key = right_class[valid] * (n + 1) + left_class[valid]
            _, earliest = np.unique(key, return_index=True)
            again = np.ones(len(valid), bool)
            again[earliest] = False
            repeated[valid[again], o] = True
        # ranges of offsets to ranges of starts
        edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        at = meta["at"][by_place].astype(np.int64)
        return pa.table({"doc": meta["doc"][by_place][i], "part": meta["part"][by_place][i].view(np.int32), "first": at[i] - hi + 1, "last": at[i] - lo})

    return merge


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """Repeated starts of crowded grams: every string by its 128-bit hash, the earliest of each spared."""

    def strings(batches):
        for b in batches:
            out: dict[str, list] = {"h": [], "doc": [], "part": [], "at": []}
            for doc, part, text, marks in zip(b["doc"].to_pylist(), b["part"].to_pylist(), b["text"].to_pylist(), b["open"].to_pylist()):
                raw = text.encode()
                for m in marks:
                    for p in range(m["first"], m["last"] + 1):
                        for k, x in zip(out, (blake2b(raw[p : p + length], digest_size=16).digest(), doc, part, p)):
                            out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.binary()), ("doc", pa.int64()), ("part", pa.int32()), ("at", pa.int64())]))

    s = rows.mapInArrow(strings, "h binary, doc bigint, part int, at bigint").withColumn("order", F.struct("doc", F.col("part").cast("long").bitwiseAND(0xFFFFFFFF).alias("p"), "at"))
    earliest = s.groupBy("h").agg(F.min("order").alias("earliest"))
    return s.join(earliest, "h").filter(F.col("order") > F.col("earliest")).select("doc", "part", F.col("at").alias("first"), F.col("at").alias("last"))


def _doc_filter(keys: DataFrame) -> np.ndarray:
    def run(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[_bit(b["doc"].to_numpy())] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in keys.select("doc").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _bit(ids: np.ndarray) -> np.ndarray:
    return (W.mix(ids.view(np.uint64).copy()) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _pick(b: pa.RecordBatch, bits, inside: bool):
    """The rows (doc, text) of a batch that the filter lets through, or the others."""
    at = _bit(pc.fill_null(b["doc"], NULL_ID).to_numpy())
    hit = (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    yield b.select(["doc", "text"]).filter(pa.array(hit == inside))


def _marked(docs: DataFrame, bits, inside: bool) -> DataFrame:
    """Documents (doc, part, text) that the filter lets through, or the others."""

    def run(batches):
        for b in batches:
            for some in _pick(b, bits, inside):
                yield pa.RecordBatch.from_arrays([pc.fill_null(some["doc"], NULL_ID), pa.array(_part(some["text"], some["doc"]).view(np.int32)), some["text"]], names=["doc", "part", "text"])

    return docs.mapInArrow(run, "doc bigint, part int, text string")


_OUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def cut(text: str | None, starts: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes left of a text, and the maximal removed runs, given ranges of repeated starts."""
    raw = (text or "").encode()
    spans: list[list[int]] = []
    for first, last in sorted(starts):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]), [tuple(s) for s in spans]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, the removed byte ranges."""
    if not GRAM <= length <= 255:
        raise ValueError(f"length must be from {GRAM} to 255")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, total * 34 // 35 // BUCKET_BYTES + 1))
    found = docs.mapInArrow(_runs(buckets, length), _RUN).groupBy("bucket").applyInArrow(_settle, _FOUND)
    found = stored(found, "anchors")

    unsettled = found.filter("not settled")
    bits = spark.sparkContext.broadcast(_doc_filter(unsettled))
    marks = unsettled.groupBy("doc", "part", "crowd").agg(F.collect_list(F.struct("gram", "at", "first", "last")).alias("open"))
    rows = _marked(docs, bits, True).dropDuplicates(["doc", "part"]).join(marks, ["doc", "part"])
    n_open = unsettled.count()
    buckets = int(max(LEAST_BUCKETS, n_open * 160 // (2 * BUCKET_BYTES) + 1))
    merged = rows.filter("not crowd").mapInArrow(_suffix_runs(buckets, length), _SUFFIX).groupBy("bucket").applyInArrow(_merge(length), "doc bigint, part int, first bigint, last bigint")
    merged = stored(merged, "repeats")
    starts = found.filter("settled").select("doc", "part", "first", "last").unionByName(merged)
    if not unsettled.filter("crowd").isEmpty():
        starts = starts.unionByName(stored(_crowded(rows.filter("crowd").select("doc", "part", "text", "open"), length), "crowded"))

    bits = spark.sparkContext.broadcast(_doc_filter(starts))
    starts = starts.groupBy("doc", "part").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    kind = "doc bigint, " + _OUT

    def finish(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            marks = b["starts"].to_pylist() if "starts" in b.schema.names else [None] * b.num_rows
            for doc, text, m in zip(b["doc"].to_pylist(), b["text"].to_pylist(), marks):
                left, spans = cut(text, [(x["first"], x["last"]) for x in m or ()], length)
                n = len((text or "").encode())
                for k, x in zip(out, (doc, n, n - len(left), len(spans), sha256(left).hexdigest(), [{"start": a, "end": z} for a, z in spans])):
                    out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    def finish_rest(batches):
        for b in batches:
            yield from finish([pa.RecordBatch.from_arrays([x["doc"], x["text"]], names=["doc", "text"]) for x in _pick(b, bits, False)])

    with_marks = _marked(docs, bits, True).join(starts, ["doc", "part"], "left").select(F.when(F.col("part") >= 0, F.col("doc")).alias("doc"), "text", "starts").mapInArrow(finish, kind)
    without = docs.mapInArrow(finish_rest, kind)
    return with_marks.unionByName(without).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
