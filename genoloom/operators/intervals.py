"""Range joins by hierarchical bins, and joins with the nearest interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.alleles import overlaps

#: Levels of bins, each 8 times as wide as the one below.
LEVELS = 6
#: Finest bins that a query may cover before it meets all regions of its chromosome instead.
WIDE = 64


def leaf_shift(regions: DataFrame) -> int:
    """The power of two of the finest bin: about the median length, found by one small aggregate."""
    typical = regions.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.5, 100)).first()[0]
    return max(6, min(24, int(max(typical or 1, 1)).bit_length() + 1))


def _level(start: Column, end: Column, shift: int) -> Column:
    """The level of the finest bin that holds a whole region; LEVELS for one that no bin holds."""
    last = F.greatest(end - 1, start)
    out = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        out = F.when(F.shiftright(start, shift + 3 * level) == F.shiftright(last, shift + 3 * level), F.lit(level)).otherwise(out)
    return out


def _home(start: Column, level: Column, shift: int) -> Column:
    """The bin of that level at start; -1 for the top."""
    at = F.coalesce(*[F.when(level == n, F.lit(n << 48).cast("long") + F.shiftright(start, shift + 3 * n)) for n in range(LEVELS)])
    return F.coalesce(at, F.lit(-1).cast("long"))


def overlap_join(queries: DataFrame, regions: DataFrame, pad: int = 0, shift: int | None = None) -> DataFrame:
    """All pairs of a query (chrom, start, end, ...) and a region (chrom, start, end, ...) where they overlap, regions widened by pad.

    Region columns come as ``r_<name>``. Each region lives in one bin and a query visits the bins that it covers at the levels that hold regions, as one
    small aggregate tells, so a pair meets once, by an equi-join on (chromosome, bin). Spark broadcasts the regions if they are small enough and
    shuffles on that key if not. Queries that cover many bins meet the regions by chromosome.
    """
    shift = leaf_shift(regions) if shift is None else shift
    low, high = F.greatest(F.col("start") - pad, F.lit(0)), F.col("end") + pad
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns], F.col("chrom").alias("__chrom"), low.cast("long").alias("__low"), high.cast("long").alias("__high"))
    r = r.withColumn("__level", _level(F.col("__low"), F.col("__high"), shift))
    held = sorted(r.agg(F.collect_set("__level")).first()[0])  # at most LEVELS + 1 numbers
    r = r.withColumn("__bin", _home(F.col("__low"), F.col("__level"), shift)).drop("__level")
    first, last = F.greatest(F.col("start") - 1, F.lit(0)), F.col("end") + 1
    wide = F.shiftright(last, shift) - F.shiftright(first, shift) > WIDE

    def visited(level: int) -> Column:
        mark = F.lit(level << 48).cast("long")
        return F.transform(F.sequence(F.shiftright(first, shift + 3 * level), F.shiftright(last, shift + 3 * level)), lambda b: b + mark)

    bins = [F.array(F.lit(-1).cast("long")) if level == LEVELS else visited(level) for level in held] or [F.array().cast("array<bigint>")]
    narrow = queries.filter(~wide).withColumn("__bin", F.explode(F.concat(*bins)))
    meets = overlaps(F.col("start"), F.col("end"), F.col("__low"), F.col("__high"))
    a = narrow.join(r, (F.col("chrom") == F.col("__chrom")) & (narrow["__bin"] == r["__bin"]) & meets).drop(narrow["__bin"]).drop(r["__bin"])
    b = queries.filter(wide).join(r.drop("__bin"), (F.col("chrom") == F.col("__chrom")) & meets)
    return a.unionByName(b).drop("__chrom", "__low", "__high")


def nearest(queries: DataFrame, intervals: DataFrame) -> DataFrame:
    """queries (row_id, chrom, start, end) with the interval that ends last at or before them and the one that starts first at or after their end.

    Adds left_end, left_name, right_start, right_name, null where there is none, and known, whether the chromosome has intervals at all. intervals:
    chrom, start, end, ord, name; of equal ends or starts the first by (start, ord) is meant. Both sides are merged in sorted windows cut
    into position blocks, with the last of the blocks before carried over, so a chromosome isn't one task.
    """
    block = 1 << 22

    def side(mark: Column, at: Column, forward: bool, prefix: str) -> DataFrame:
        best = F.min(F.struct("start", "ord", "name"))
        points = intervals.groupBy("chrom", mark.alias("pos")).agg(best.alias("b")).select("chrom", "pos", F.struct("pos", "b.name").alias("hit"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row_id"))
        asks = queries.select("chrom", at.alias("pos"), F.lit(None).cast(points.schema["hit"].dataType).alias("hit"), F.lit(1).alias("kind"), "row_id")
        both = points.unionByName(asks).withColumn("blk", F.floor(F.col("pos") / block))
        edge = both.filter("kind = 0").groupBy("chrom", "blk").agg((F.max if forward else F.min)("hit").alias("h"))
        blocks = both.select("chrom", "blk").distinct().join(edge, ["chrom", "blk"], "left")
        order = F.col("blk") if forward else F.col("blk").desc()
        carried = blocks.withColumn("carry", F.last("h", ignorenulls=True).over(Window.partitionBy("chrom").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).select("chrom", "blk", "carry")
        w = Window.partitionBy("chrom", "blk").orderBy(F.col("pos") if forward else F.col("pos").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("near", F.last("hit", ignorenulls=True).over(w)).filter("kind = 1").join(carried, ["chrom", "blk"]).withColumn("near", F.coalesce("near", "carry"))
        return found.select("row_id", F.col("near.pos").alias(f"{prefix}_pos"), F.col("near.name").alias(f"{prefix}_name"))

    left = side(F.col("end"), F.col("start"), True, "left").withColumnRenamed("left_pos", "left_end")
    right = side(F.col("start"), F.col("end"), False, "right").withColumnRenamed("right_pos", "right_start")
    known = intervals.select("chrom").distinct().withColumn("known", F.lit(True))
    return queries.join(left, "row_id", "left").join(right, "row_id", "left").join(known, "chrom", "left").withColumn("known", F.coalesce("known", F.lit(False)))
