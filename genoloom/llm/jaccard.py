"""Operator 5: n-gram Jaccard join.

Every document becomes the set of its word shingles; equal sets become one node. Two sets at the threshold share one of the first
few members of each in any common order (rare members first here), so nodes meet by those members. Where they meet, size bands form
tiles: only sets of compatible sizes share a tile, and bitmap signatures bound their overlap from above, because each bit of the
xor of two signatures stands for at least one member that they don't share. Larger sets have wider signatures; a wide one folds to a narrow one. What passes is intersected exactly on sorted arrays.

Near copies are linked to two nodes of their group before that, and tiles then compare only nodes that are not in one class yet; so groups
of copies cost in proportion to their size. What the tiles join is compared by whole signatures before any members are gathered. No pair is left out but those that the bounds exclude or that are in one class already.

Words are runs of bytes outside \\x20 and \\x09-\\x0D, A-Z lower-cased. Texts with fewer words than a shingle have their whole sequence as one;
null texts and those without words have an empty set, linked with nothing. Repeated rows share a class; a null doc_id is
in a class of its own rows' ids, null last. An empty table gives an empty result. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.common import discard, fresh, small_batches, stored, table
from genoloom.llm.components import components
from genoloom.llm.packing import planes, unplanes

#: Members whose share of the documents of a pass reaches this are ordered last; at most so many, the most frequent ones.
HOT_SHARE, HOT_MEMBERS = 0.001, 1 << 17
#: Members of least hash by which near copies meet two nodes of their group.
STAR_MEMBERS = 4
#: Nodes of a class in a group of candidates from which on it has blocks of its own; nodes and members of a block of candidates.
PURE, BLOCK_NODES, BLOCK_MEMBERS = 64, (512, 2048), 1 << 20
#: Nodes of one tile; larger meetings are cut into blocks, each pair of blocks a tile.
TILE = 2048
#: Powers of two between which the filters of nodes and members stay, 16 bits an entry. They only save shuffling; joins decide.
FILTER_BITS = (20, 27)
#: Members that one task of the exchange of prefixes should get.
BUCKET_MEMBERS = 1 << 19
#: Bits of the least signature; a set of more members has as many bits, rounded up to a power of two.
SIGNATURE_BITS = 512
#: Set members that are counted together for HOT_SHARE.
PASS_MEMBERS = 1 << 21

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for lo, hi in W.slices(lengths):
        data, offsets = W.raw_bytes(texts[lo:hi])
        w = W.words(data, offsets, IS_WORD, W.byte_values(True, 5))
        n = np.diff(w.first)
        _, h = W.windows(w, tuple(range(k)), k)
        with np.errstate(over="ignore"):
            h = W.mix(h + np.uint64(k))
        ends = np.cumsum(np.maximum(n - k + 1, 0))
        got = [np.unique(h[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)]
        for i in np.flatnonzero((n > 0) & (n < k)):
            m = int(n[i])
            one = W.Words(w.start, w.end, w.hash, w.first[i : i + 2])
            _, x = W.windows(one, tuple(range(m)), m)
            with np.errstate(over="ignore"):
                got[i] = W.mix(x + np.uint64(m))
        out += got
    return out


def signature(members: np.ndarray) -> bytes:
    """Bit i is the parity of the members that hash to i."""
    bits = max(SIGNATURE_BITS, 1 << (len(members) - 1).bit_length()) if len(members) else SIGNATURE_BITS
    return np.packbits((np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """A signature of fewer bytes: halves laid over each other by xor."""
    while len(sig) > size:
        sig = sig[: len(sig) // 2] ^ sig[len(sig) // 2 :]
    return sig


def first_length(n, percent: int):
    """Members of which two sets at the threshold share one."""
    return n - -(-percent * n // 100) + 1


def spare(n, percent: int):
    """Further members of the prefix: with them, two sets share one more than this."""
    return np.maximum(first_length(n, percent) // 2, 1) - 1


def needed(n, percent: int):
    """Members of its prefix that a set shares with any partner: what the smallest partner's prefix guarantees."""
    return spare(-(-percent * n // 100), percent) + 1


def prefix(members: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first members in the common order: members that are not hot by hash, then hot ones by rank.

    Two sets at the threshold share one of their first_length() first members, and needed() of them with spare() more.
    """
    n = len(members)
    p = first_length(n, percent) + int(spare(n, percent))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, members), len(hot) - 1)
        is_hot = hot[at] == members
        if is_hot.any():
            warm = members[is_hot]
            members = np.concatenate([members[~is_hot], warm[np.argsort(rank[at[is_hot]], kind="stable")]])
    return members[:p]


def _hot_members(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent members, sorted, and their rank from rare to frequent. All documents are counted, pass by pass."""

    def run(batches):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(4, HOT_SHARE * len(held))
            return pa.RecordBatch.from_pydict({"member": v[often].view(np.int64), "n": c[often].astype(np.int64)})

        for b in batches:
            for s in shingles(b["text"], k):
                held.append(s)
                size += len(s)
                if size >= PASS_MEMBERS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    often = docs.select("text").mapInArrow(run, "member bigint, n bigint").groupBy("member").agg(F.sum("n").alias("n"))
    got = often.orderBy(F.desc("n"), "member").limit(HOT_MEMBERS).toPandas()
    members, n = got["member"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy()
    order = np.argsort(members)
    rank = np.empty(len(members), np.int64)
    rank[np.lexsort((members, n))] = np.arange(len(members))
    return members[order], rank[order]


def _filter_of(column: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap over the one int64 column and its power of two: at most 16 MB, from at most 4 tasks."""
    name = column.columns[0]
    power = min(max((column.count() * 16).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])

    def run(batches):
        bits = np.zeros(1 << power, bool)
        for b in batches:
            bits[_bit(b[name].to_numpy(), power)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << (power - 3), np.uint8)
    for r in column.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out, power


def _bit(v: np.ndarray, power: int) -> np.ndarray:
    return (W.mix(v.view(np.uint64).copy()) >> np.uint64(64 - power)).astype(np.int64)


def _in_filter(found: tuple[np.ndarray, int], v: np.ndarray) -> np.ndarray:
    bits, power = found
    at = _bit(v, power)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


_KEY = "key bigint, key2 bigint"


def _key(members: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(blake2b(members.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _sets(docs: DataFrame, k: int, percent: int, hot) -> DataFrame:
    """Per row: doc_id, n, key, key2, signature, prefix, star (the members of least hash) and n_hot, the number of hot members."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        h, rank = hot.value
        for b in batches:
            sets = shingles(b["text"], k)
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([prefix(s, h, rank, percent).tobytes() if len(s) else b"" for s in sets], pa.binary()), pa.array([s[:STAR_MEMBERS].tobytes() for s in sets], pa.binary()), pa.array([int(np.isin(s, h, assume_unique=True).sum()) if len(h) else 0 for s in sets], pa.int64())],
                names=["doc_id", "n", "key", "key2", "signature", "prefix", "star", "n_hot"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, {_KEY}, signature binary, prefix binary, star binary, n_hot bigint")


def _members_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, members) of the wanted nodes, from the texts again: a filter of their keys keeps the rest out of the shuffle."""
    keys = nodes.join(wanted.select(F.col("node")).distinct(), "node").select("key", "key2", "node")
    keys = stored(keys, "keys")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(keys.select("key")))

    def run(batches):
        seen: set = set()
        for b in batches:
            sets = [(s, *_key(s)) for s in shingles(b["text"], k) if len(s)]
            if not sets:
                continue
            ok = _in_filter(bits.value, np.array([x[1] for x in sets], np.int64))
            out = []
            for keep, x in zip(ok, sets):
                if keep and x[1:] not in seen:  # one copy a task is enough
                    seen.add(x[1:])
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[0].tobytes() for x in out], pa.binary())], names=["key", "key2", "members"])

    got = docs.mapInArrow(run, f"{_KEY}, members binary").join(keys, ["key", "key2"])
    members = stored(got.groupBy("node").agg(F.first("members").alias("members")), "members")
    discard(keys)
    bits.unpersist()
    return members


def _linked(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact intersection reaches the threshold."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["ma"], b["mb"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(members.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b").join(members.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a bigint, b bigint")


def narrow(signatures: list[bytes]) -> np.ndarray:
    """Signatures folded to the least width, as rows of uint64."""
    return np.stack([fold(np.frombuffer(x, np.uint8), SIGNATURE_BITS // 8) for x in signatures]).view(np.uint64) if signatures else np.zeros((0, SIGNATURE_BITS // 64), np.uint64)


def may_link(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, percent: int, wide=None) -> np.ndarray:
    """Whether sizes and signatures leave room for the threshold.

    sa, sb: narrow() rows; wide(i): the pair's whole signatures, asked for only if the narrow ones leave room.
    """
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    ok = 100 * small >= percent * large
    at = np.flatnonzero(ok)
    if len(at):
        room = lambda total, apart: 100 * ((total - apart) // 2) >= percent * (total - (total - apart) // 2)
        ok[at] = room(na[at] + nb[at], np.bitwise_count(sa[at] ^ sb[at]).sum(1).astype(np.int64))
        for i in np.flatnonzero(ok & (large > SIGNATURE_BITS)) if wide else ():
            x, y = (np.frombuffer(v, np.uint8) for v in wide(i))
            size = min(len(x), len(y))
            ok[i] = room(int(na[i] + nb[i]), int(np.bitwise_count((fold(x, size) ^ fold(y, size)).view(np.uint64)).sum()))
    return ok


def _star_pairs(nodes: DataFrame) -> DataFrame:
    """Each node with two nodes of its groups by its members of least hash and its size, within a twentieth.

    The first is the one with the most hot members: of near copies, the least edited, which is close to all of them. The other is the last.
    Members of a passage that many documents hold lead those of one size to each other, not all to one.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05))).alias("size")
    first = nodes.select("node", "n_hot", size, F.explode("star").alias("member"))
    ends = first.groupBy("member", "size").agg(F.max(F.struct("n_hot", (-F.col("node")).alias("m"))).alias("a"), F.max("node").alias("z"), F.min("node").alias("low"))
    ends = ends.filter("low < z").select("member", "size", (-F.col("a.m")).alias("a"), "z")
    met = first.join(ends, ["member", "size"]).select("node", F.explode(F.array("a", "z")).alias("end")).filter("node <> end")
    return met.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and whole signatures leave room for a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))

    def run(batches):
        for b in batches:
            sa, sb = b["sa"].to_pylist(), b["sb"].to_pylist()
            yield b.select(["a", "b"]).filter(pa.array(may_link(b["na"].to_numpy(), b["nb"].to_numpy(), narrow(sa), narrow(sb), percent, lambda i: (sa[i], sb[i])), pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


_PACKED = "bucket int, member binary, least binary, most binary, rows binary"
_PACKED_KINDS = {"member": np.uint64, "least": np.int64, "most": np.int64, "rows": np.int64}


def _by_member(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row per member, in its order: its least and greatest component and its rows."""
    order = np.argsort(v["member"], kind="stable")
    m = v["member"][order]
    start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
    if not len(start):
        return v
    return {"member": m[start], "least": np.minimum.reduceat(v["least"][order], start), "most": np.maximum.reduceat(v["most"][order], start), "rows": np.add.reduceat(v["rows"][order], start)}


def _shared(nodes: DataFrame, buckets: int) -> DataFrame:
    """(member, rows) of prefix members that nodes of two components or more have.

    Members travel as packed runs, counted before: a member has one row per run, however many nodes hold it.
    """

    def pack(batches):
        held, size = [], 0

        def flush():
            m, c = (np.concatenate(x) for x in zip(*held))
            v = _by_member({"member": m, "least": c, "most": c, "rows": np.ones(len(m), np.int64)})
            ends = np.searchsorted((v["member"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24), np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(ends)):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(i)], pa.int32()), **{k: [planes(x[ends[i] : ends[i + 1]])] for k, x in v.items()}})

        for b in batches:
            lists = b["prefix"]
            m = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # the hashes of a prefix are the least of a set: spread them evenly over the buckets
            held.append((W.mix(m.copy()), np.repeat(b["component"].to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            size += len(m)
            if size >= PASS_MEMBERS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        v = _by_member({k: np.concatenate([unplanes(x, kind) for x in t[k].to_pylist()]) for k, kind in _PACKED_KINDS.items()})
        some = v["least"] != v["most"]
        return pa.table({"mixed": v["member"][some].view(np.int64), "rows": v["rows"][some]})

    return nodes.select("prefix", "component").mapInArrow(pack, _PACKED).groupBy("bucket").applyInArrow(meet, "mixed bigint, rows bigint")


def _meetings(nodes: DataFrame, percent: int) -> DataFrame:
    """Rows (tile, guest, node, component, n, signature) of nodes that share enough prefix members with other components, by member and size band."""
    spark = nodes.sparkSession
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = stored(_shared(nodes, int(max(4, total // BUCKET_MEMBERS + 1))), "shared")
    bits = spark.sparkContext.broadcast(_filter_of(shared.select("mixed")))

    def keep(batches):
        for b in batches:
            lists, n = b["prefix"], b["n"].to_numpy()
            flat = W.mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).copy()).view(np.int64)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(lists)), sizes)
            ok = _in_filter(bits.value, flat) if len(flat) else np.zeros(0, bool)
            enough = np.bincount(of[ok], minlength=len(lists)) >= needed(n, percent)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ok &= enough[of] & (place < first_length(n, percent)[of])
            rows = b.select(["node", "component", "n"]).take(pa.array(of[ok]))
            sig = narrow(b["signature"].to_pylist())
            yield rows.append_column("signature", pa.array([x.tobytes() for x in sig[of[ok]]], pa.binary())).append_column("mixed", pa.array(flat[ok], pa.int64()))

    rows = nodes.select("node", "component", "n", "signature", "prefix").mapInArrow(keep, "node bigint, component bigint, n bigint, signature binary, mixed bigint").join(shared, "mixed").withColumnRenamed("mixed", "member")
    # a set of size n is in band b with base^b <= n < base^(b+1), base = 100 / percent; partners are in the same band or the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = rows.withColumn("band", band).withColumn("blocks", F.ceil(F.col("rows") / TILE).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sides = F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(0).alias("guest")), F.struct((F.col("band") + 1).alias("band"), F.lit(1).alias("guest"))))
    rows = rows.select("member", "node", "component", "n", "signature", "block", "blocks", sides.alias("s"))
    # home rows meet home rows of all blocks, and guests of all blocks: tile (x, y) with x <= y holds homes of both blocks and guests of block y,
    # tile (x, y) with x > y the homes of block x once more, marked 2, and guests of block y
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("member", "node", "component", "n", "signature", "block", F.col("s.band").alias("band"), F.col("s.guest").alias("guest"), other.alias("other"))
    x = F.when(F.col("guest") == 1, F.col("other")).otherwise(F.least("block", "other"))
    y = F.when(F.col("guest") == 1, F.col("block")).otherwise(F.greatest("block", "other"))
    rows = rows.withColumn("x", x).withColumn("y", y)
    home_again = rows.filter("guest = 0 and block > other").withColumn("x2", F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("x2")).drop("x2").withColumn("guest", F.lit(2))
    rows = rows.unionByName(home_again)
    return rows.select(F.xxhash64("member", "band", "x", "y").alias("tile"), "member", "band", "guest", "node", "component", "n", "signature")


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label, the least row that each row is joined with, after joining rows u with rows v."""
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := label[label]).tobytes() != label.tobytes():
            label = up


def _tile_edges(meetings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join what meets in a tile, is of different classes and may link by sizes and signatures: at most one a row of the tile.

    Whatever pairs the bounds allow are joined by a path of edges, so each of them is inside one group of candidates.
    """

    def edges(key, comp, guest, node, n, sig):
        label, rows, d = np.arange(len(key)), np.arange(len(key)), 1
        while True:
            rows = rows[rows + d < len(key)]
            rows = rows[key[rows] == key[rows + d]]
            if not len(rows):
                break
            i, j = rows, rows + d
            # home and home, home and guest, repeated home and guest; guests meet each other in their own band
            use = (comp[i] != comp[j]) & (((guest[i] + guest[j]) & 1 == 1) | ((guest[i] == 0) & (guest[j] == 0))) & (label[i] != label[j])
            i, j = i[use], j[use]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = may_link(n[u], n[v], sig[u], sig[v], percent)
                if ok.any():
                    label = _unite(label, u[ok], v[ok])
            d += 1
        moved = np.flatnonzero(label != np.arange(len(key)))
        return np.unique(np.stack([node[label[moved]], node[moved]]), axis=1)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            last = b["tile"][-1].as_py()
            if size >= 1 << 14 and held[0]["tile"][0].as_py() != last:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = t.num_rows
                tiles = t["tile"].to_numpy()
                cut = int(np.flatnonzero(tiles != tiles[-1])[-1]) + 1
                yield solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                size = t.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    def solve(t: pa.Table) -> pa.RecordBatch:
        a, b = edges(t["tile"].to_numpy(), t["component"].to_numpy(), t["guest"].to_numpy(), t["node"].to_numpy(), t["n"].to_numpy(), narrow(t["signature"].to_pylist()))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    cols = ["tile", "guest", "node", "component", "n", "signature"]
    return meetings.select(*cols).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint").distinct()


def _blocks(rows: DataFrame, most: int = BLOCK_MEMBERS) -> DataFrame:
    """(tile, node, component, side): every two nodes of one group and of different classes meet in one tile.

    rows: (node, component, n, grp); most: members of a block. A class of more than PURE nodes in its group has blocks of its own, which never meet each other;
    the smaller classes of a group share mixed blocks, which meet all blocks of the group and themselves.
    """
    classes = rows.groupBy("grp", "component").agg(F.count("*").alias("cnt"), F.sum("n").alias("members"))
    classes = classes.withColumn("own", F.when(F.col("cnt") > PURE, F.col("component")).otherwise(F.lit(-1)))  # whose blocks: -1 is for the mixed ones
    # small groups go to many tasks, large ones are copied to few blocks
    nodes = F.greatest(F.lit(BLOCK_NODES[0]), F.least(F.lit(BLOCK_NODES[1]), F.col("cnt") / 8))
    parts = F.greatest(F.ceil(F.col("cnt") / nodes), F.ceil(F.col("members") / most), F.lit(1)).cast("int")
    spans = classes.groupBy("grp", "own").agg(F.sum("cnt").alias("cnt"), F.sum("members").alias("members")).withColumn("parts", parts)
    block = F.xxhash64("grp", "own", "part").alias("block")
    blocks = spans.select("grp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("grp", "own", block)
    x, y = (blocks.select("grp", F.col("own").alias(f"own_{v}"), F.col("block").alias(v)) for v in "xy")
    meet = x.join(y, "grp").filter("x <= y and (own_x = -1 or own_x <> own_y)").select("x", "y", F.xxhash64("grp", "x", "y").alias("tile"))
    end = lambda v, side: F.struct(F.col(v).alias("block"), F.lit(side).alias("side"))
    sides = F.when(F.col("x") == F.col("y"), F.array(end("x", 2))).otherwise(F.array(end("x", 0), end("y", 1)))
    meet = meet.select("tile", F.explode(sides).alias("s")).select("s.block", "tile", "s.side")
    own = rows.join(classes.select("grp", "component", "own"), ["grp", "component"]).join(spans.select("grp", "own", "parts"), ["grp", "own"])
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return own.select("node", "component", block).join(meet, "block").select("tile", "node", "component", "side")


class _Wide:
    """Signatures of some sets, by width, made with 8 to 16 bits a member; distances to them by xor."""

    def __init__(self, sets: list[np.ndarray]):
        def bits(s: np.ndarray) -> np.ndarray:
            w = max(SIGNATURE_BITS, 1 << (8 * len(s) - 1).bit_length())
            return np.packbits((np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).astype(np.uint8))

        self._hold([bits(s) for s in sets])

    @classmethod
    def given(cls, signatures: list[bytes]) -> _Wide:
        """The same of signatures that are there already, of whatever widths."""
        out = cls.__new__(cls)
        out._hold([np.frombuffer(x, np.uint8) for x in signatures])
        return out

    def _hold(self, signatures: list[np.ndarray]) -> None:
        self.width = np.array([8 * len(x) for x in signatures], np.int64)
        self.row = np.zeros(len(signatures), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            i = np.flatnonzero(self.width == w)
            self.row[i] = np.arange(len(i))
            self.of[w] = np.stack([signatures[k] for k in i]).view(np.uint64)

    def one(self, i: int) -> np.ndarray:
        return self.of[int(self.width[i])][self.row[i]]

    def apart(self, sig: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Bits in which sig differs from the signatures of the sets at which, folded to the narrower of the two: at most the members that they don't share."""
        out = np.zeros(len(which), np.int64)
        for w, bits in self.of.items():
            k = np.flatnonzero(self.width[which] == w)
            if len(k):
                mine, theirs = sig, bits[self.row[which[k]]]
                while len(mine) > theirs.shape[1]:
                    mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
                while theirs.shape[1] > len(mine):
                    theirs = theirs[:, : theirs.shape[1] // 2] ^ theirs[:, theirs.shape[1] // 2 :]
                out[k] = np.bitwise_count(theirs ^ mine).sum(1)
        return out


def spanning_links(node: list[int], component: list[int], side: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all classes that any link between two sides (0 and 1, or 2 and 2) joins.

    A pair is refuted by sizes, by wide signatures, or by the exact intersection of sorted arrays; or it links; or its classes are joined already.
    """
    side_, n = np.array(side), np.array([len(s) for s in sets], np.int64)
    wide = _Wide(sets)
    names = sorted(set(component))
    at = np.searchsorted(names, component)
    joined = np.arange(len(names))  # of each class: its root, brought up to date after each link
    links = []
    others = np.flatnonzero(side_ != 0)
    for i in np.flatnonzero(side_ != 1).tolist():
        cand = others[others > i] if side_[i] == 2 else others
        cand = cand[joined[at[cand]] != joined[at[i]]]
        cand = cand[100 * np.minimum(n[cand], n[i]) >= percent * np.maximum(n[cand], n[i])]
        if not len(cand):
            continue
        total = n[cand] + n[i]
        far = wide.apart(wide.one(i), cand)
        room = 100 * ((total - far) // 2) >= percent * (total - (total - far) // 2)
        cand, far = cand[room], far[room]
        for j in cand[np.argsort(far, kind="stable")].tolist():
            if joined[at[i]] == joined[at[j]]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                links.append((node[i], node[j]))
                a, b = joined[at[i]], joined[at[j]]
                joined[joined == max(a, b)] = min(a, b)
    return links


def candidate_edges(node: np.ndarray, component: np.ndarray, side: np.ndarray, n: np.ndarray, signatures: list[bytes], percent: int) -> list[np.ndarray]:
    """Edges (a, b) that join whatever is of two sides (0 and 1, or 2 and 2) and of different classes, and may link by sizes and whole signatures."""
    wide, label, others = _Wide.given(signatures), np.arange(len(node)), np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1).tolist():
        cand = others[others > i] if side[i] == 2 else others
        cand = cand[(component[cand] != component[i]) & (label[cand] != label[i])]
        cand = cand[100 * np.minimum(n[cand], n[i]) >= percent * np.maximum(n[cand], n[i])]
        if len(cand):
            total = n[cand] + n[i]
            both = (total - wide.apart(wide.one(i), cand)) // 2
            cand = cand[100 * both >= percent * (total - both)]
            if len(cand):
                label = _unite(label, np.full(len(cand), i), cand)
    moved = np.flatnonzero(label != np.arange(len(node)))
    return [node[label[moved]], node[moved]]


def _narrowed(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join, inside the groups of rows, what may link by whole signatures.

    The narrow signatures of the meetings refute no pair of sets of much over a thousand members, so large sets that share a few members
    make groups that grow with the square of the input. Here a set travels as n to 2n bits, and not as 64n bits of members.
    """

    def solve(t: pa.Table) -> pa.Table:
        a, b = candidate_edges(*[t[c].to_numpy() for c in ("node", "component", "side", "n")], t["signature"].to_pylist(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tiles = _blocks(rows, 64 * BLOCK_MEMBERS).join(nodes.select("node", "n", "signature"), "node")
    return tiles.select("tile", "node", "component", "side", "n", "signature").groupBy("tile").applyInArrow(solve, "a bigint, b bigint").distinct()


def _group_links(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of the nodes of a group, from tiles that hold whole member arrays: fewer than a tile's rows."""

    def solve(t: pa.Table) -> pa.Table:
        data, offsets = W.raw_bytes(t["members"])
        sets = [data[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
        found = spanning_links(t["node"].to_pylist(), t["component"].to_pylist(), t["side"].to_pylist(), sets, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return _blocks(rows).join(members, "node").groupBy("tile").applyInArrow(solve, "a bigint, b bigint")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and n_texts, the number of distinct sets in its class."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hot = spark.sparkContext.broadcast(_hot_members(docs, k))
    sets = stored(_sets(docs, k, percent, hot), "sets")
    hot.unpersist()
    nodes = sets.filter("n > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.struct("signature", "prefix", "star", "n_hot")).alias("x"))
    nodes = nodes.select("key", "key2", "doc_id", "n", "x.signature", "x.prefix", "x.star", "x.n_hot", F.monotonically_increasing_id().alias("node")).mapInArrow(_unpack, f"{_KEY}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, signature binary, node bigint, prefix array<bigint>, star array<bigint>, n_hot bigint")
    nodes = stored(nodes, "nodes")
    rows_of = stored(sets.select("doc_id", "n", "key", "key2"), "rows_of")  # what the result needs; prefixes and signatures are in nodes
    discard(sets)

    star = stored(_bounded(_star_pairs(nodes), nodes, percent), "star")
    members = _members_of(docs, star.select(F.col("a").alias("node")).union(star.select("b")), nodes, k)
    links = stored(_linked(star, members, percent), "links")
    discard(star, members)
    labels = components(links)
    marked = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    small_batches(spark, 8192)
    edges = stored(_tile_edges(_meetings(marked, percent), percent), "edges")
    small_batches(spark)
    names = stored(nodes.select("key", "key2", "node", "doc_id"), "names")
    if not edges.isEmpty():
        grouped = lambda e, name: stored(marked.select("node", "component", "n").join(components(e).withColumnRenamed("component", "grp"), "node"), name)
        wider = grouped(edges, "wider")
        narrowed = stored(_narrowed(wider, nodes, percent), "narrowed")
        rows = grouped(narrowed, "rows")
        discard(labels, wider, narrowed)
        members = _members_of(docs, rows, names, k)
        links = links.union(stored(_group_links(rows, members, percent), "more"))
        discard(rows, members)
        labels = components(links)
    discard(nodes, edges)
    classes = names.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_texts"))
    classes = classes.join(smallest, "component").select("key", "key2", "component_id", "n_texts")
    some = rows_of.filter("n > 0").select("doc_id", "n", "key", "key2").join(classes, ["key", "key2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_texts")
    none = rows_of.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_texts"))
    return some.unionByName(none)


def _unpack(batches):
    def lists(column: pa.Array) -> pa.Array:
        parts = [np.frombuffer(p.as_buffer(), np.int64) for p in column]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))

    for b in batches:
        yield pa.RecordBatch.from_arrays([b["key"], b["key2"], b["doc_id"], b["n"], b["signature"], b["node"], lists(b["prefix"]), lists(b["star"]), b["n_hot"]], names=["key", "key2", "doc_id", "n", "signature", "node", "prefix", "star", "n_hot"])


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of docs per class: the one with the smallest doc_id. Documents with an empty set all stay; of rows that repeat a doc_id and text, one stays."""
    found = join(docs, **options)
    copy = fresh(docs, "copy")
    drop = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct()
    kept = docs.join(drop, F.col("doc_id") == F.col(copy), "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=4, percent=85)
