"""Interval annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.strings import in_order, plain_number
from genoloom.operators.intervals import overlap_join


def region_join(variants: DataFrame, regions: DataFrame, names: list[str], gff3: bool = False, prefix: str = "r", missing: str = ".", min_overlap: float = 0.0, shift: int | None = None) -> DataFrame:
    """variants (row_id unique) with the regions' columns as <prefix>0, ...; missing where nothing overlaps.

    Hits are in the order of region start, then of the table. Values join by ``;``. A GFF3 table gives one column with the best score
    and the names of the regions that have it.
    """
    pairs = overlap_join(variants.select("row_id", "chrom", "start", "end"), regions, shift=shift)
    shared = F.greatest(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(1))
    pairs = pairs.filter(shared / F.greatest(F.col("end") - F.col("start"), F.lit(1)) >= min_overlap) if min_overlap else pairs
    order = F.struct(F.col("r_start").alias("a"), F.col("r_ord").alias("b"))
    if gff3:
        best = pairs.groupBy("row_id").agg(F.max("r_score").alias("best"), F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("r_score").alias("s"), F.col("r_name").alias("n")))).alias("hits"))
        wanted = F.filter("hits", lambda h: (F.col("best").isNull() | (h["s"] == F.col("best"))) & h["n"].isNotNull())
        named = F.array_join(F.transform(wanted, lambda h: h["n"]), ",")
        text = F.concat(F.coalesce(F.concat(F.lit("Score="), plain_number(F.col("best")), F.lit(";")), F.lit("")), F.when(named != "", F.concat(F.lit("Name="), named)).otherwise(""))
        got, n = best.select("row_id", text.alias(f"{prefix}0")), 1
    else:
        n = max(len(names), 1)
        got = pairs.groupBy("row_id").agg(*[F.array_join(in_order(order, F.get("r_values", F.lit(i))), ";").alias(f"{prefix}{i}") for i in range(n)])
    got = got.withColumnRenamed("row_id", "__row")
    joined = variants.join(got, F.col("row_id") == F.col("__row"), "left")
    return joined.select(*variants.columns, *[F.coalesce(f"{prefix}{i}", F.lit(missing)).alias(f"{prefix}{i}") for i in range(n)])
