"""Operator 9: shards by a hierarchical weighted hash tree.

The tree has regions, racks in them and slots in racks, each slot with room for a shard of a greatest weight. A key descends level by level: one
hash of key and node draws a child by the room below it, and at a slot the draw must fall within the weight of the shard there. A draw into room
that no shard fills starts again at the root with the next hashes. Room never changes, so a weight that changes only fills or frees room of its own
leaf: keys move only into that leaf, or only out of it, and all others stay, whatever regions and racks the leaf is in. A shard gets keys in
proportion to its weight, after room / filled room draws on average.

The law is ``key``: doc_id and the number of shards decide. A null doc_id is a key of its own; a null text has size 1 and the checksum of
the empty text. Repeated rows share a shard and take slots of their own. An empty table gives an empty result. Columns
other than the two named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm import words as W
from genoloom.llm.common import stored, table

#: Blocks of a shard among which its slots are dealt; bounds the table of offsets.
BLOCKS = 4096
#: Regions, racks of a region, and shards that a rack has room for, each of at most the greatest weight.
REGIONS, RACKS, ROOM, GREATEST = 2, 2, 16, 1.0


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    slot: int
    weight: float = 1.0


def topology(n: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """n shards dealt over the regions and racks; more shards only add leaves."""
    return [Leaf(i, f"region{i % REGIONS}", f"rack{i // REGIONS % RACKS}", i // (REGIONS * RACKS), (weights or {}).get(i, 1.0)) for i in range(n)]


def frame(room: int = ROOM) -> dict[str, dict[str, int]]:
    """Slots by region and rack."""
    return {f"region{i}": {f"rack{j}": room for j in range(RACKS)} for i in range(REGIONS)}


class Tree:
    """Room by region, rack and slot, and the shards that fill it."""

    def __init__(self, leaves: list[Leaf], slots: dict[str, dict[str, int]] | None = None, greatest: float = GREATEST):
        slots = slots or frame()
        self.greatest = greatest
        self.regions = [(self._seed(r), [(self._seed(r, k), n, np.full(n, -1), np.zeros(n)) for k, n in sorted(racks.items())]) for r, racks in sorted(slots.items())]
        at = {(r, k): self.regions[i][1][j] for i, r in enumerate(sorted(slots)) for j, k in enumerate(sorted(slots[r]))}
        for x in leaves:
            if not 0 <= x.weight <= greatest:
                raise ValueError(f"shard {x.shard}: the weight must be from 0 to {greatest}")
            _, room, shard, weight = at[x.region, x.rack]
            if x.slot >= room or shard[x.slot] != -1:
                raise ValueError(f"shard {x.shard}: {x.region}/{x.rack} has no free slot {x.slot}; a tree with more room deals all keys anew")
            shard[x.slot], weight[x.slot] = x.shard, x.weight
        if not any(x.weight > 0 for x in leaves):
            raise ValueError("no shard has a weight")
        self.root = self._seed()

    @staticmethod
    def _seed(*path: str) -> int:
        return int.from_bytes(blake2b("/".join(path).encode(), digest_size=8).digest(), "little")

    @staticmethod
    def _unit(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
        """A number from 0 to 1 for each key at a node."""
        with np.errstate(over="ignore"):
            h = W.mix(W.mix(keys ^ np.uint64(seed)) + np.uint64(turn))
        return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)

    @classmethod
    def _draw(cls, keys: np.ndarray, seed: int, turn: int, room: list[int]) -> np.ndarray:
        """The child that each key draws at a node, by room."""
        ends = np.cumsum(room)
        return np.searchsorted(ends, cls._unit(keys, seed, turn) * ends[-1], "right")

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The shards of keys (uint64)."""
        out, left, turn = np.full(len(keys), -1), np.arange(len(keys)), 0
        while len(left):
            region = self._draw(keys[left], self.root, turn, [sum(n for _, n, _, _ in racks) for _, racks in self.regions])
            for i, (seed, racks) in enumerate(self.regions):
                here = left[region == i]
                rack = self._draw(keys[here], seed, turn, [n for _, n, _, _ in racks])
                for j, (inner, n, shard, weight) in enumerate(racks):
                    mine = here[rack == j]
                    at = self._unit(keys[mine], inner, turn) * n
                    slot = at.astype(np.int64)
                    out[mine] = np.where((at - slot) * self.greatest < weight[slot], shard[slot], -1)
            left = left[out[left] < 0]
            turn += 1
        return out


def hashed(key: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null")))


def shard(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None, blocks: int = BLOCKS, room: int = ROOM) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes, checksums and shards are one narrow pass, written to the shared folder with a row number of their own. Slots are dealt from
    that small table: (shard, block) groups get offsets from a table of at most n * blocks counts.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        hashed(F.col(id_col)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    now, grown = Tree(topology(n, weights), frame(room)), Tree(topology(n + 1, weights), frame(room))

    def run(batches):
        for b in batches:
            keys = b["key"].to_numpy().view(np.uint64)
            yield b.append_column("shard", pa.array(now.place(keys), pa.int32())).append_column("grown_shard", pa.array(grown.place(keys), pa.int32()))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(rows.mapInArrow(run, f"doc_id {kind}, size bigint, text_crc32 bigint, key bigint, row bigint, shard int, grown_shard int"), "shards")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("row")
    dealt = rows.withColumn("place", F.row_number().over(within).cast("long") - 1)
    return dealt.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)
