"""Comparing tables: full outer diff, row by row, multisets; and the deterministic stratified sample."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.alleles import variant_type

#: Of 10,000, how many variants of a type the sample keeps (fixed values).
RATES = {"snv": 100, "indel": 300, "mnv": 1000, "multiallelic": 1000, "other": 1000}


def with_occurrence(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with occurrence, the number of earlier rows of the same key."""
    return table.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def _as_set(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(c, ",")), ",")


def diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """One row a field: exact, order_insensitive, different, only_left, only_right. Rows pair by keys and occurrence."""
    pick = lambda t, s: with_occurrence(t, keys, order).select(*keys, "occurrence", *[F.col(f).alias(f"{f}{s}") for f in fields], F.lit(True).alias(f"has{s}"))
    both = pick(left, "_l").join(pick(right, "_r"), [*keys, "occurrence"], "full_outer")
    paired = F.col("has_l") & F.col("has_r")
    cases = []
    for f in fields:
        a, b = F.col(f"{f}_l"), F.col(f"{f}_r")
        cases.append(F.struct(F.lit(f).alias("field"), F.when(paired, F.when(a.eqNullSafe(b), "exact").when(_as_set(a).eqNullSafe(_as_set(b)), "order_insensitive").otherwise("different")).when(F.col("has_l"), "only_left").otherwise("only_right").alias("case")))
    rows = both.select(F.explode(F.array(*cases)).alias("x")).select("x.*")
    count = lambda k: F.count(F.when(F.col("case") == k, 1)).alias(k)
    return rows.groupBy("field").agg(*[count(k) for k in ("exact", "order_insensitive", "different", "only_left", "only_right")])


def zip_compare(left: DataFrame, right: DataFrame, fields: list[str], as_lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose fields differ at the same row_id: row_id, field, left, right; lists compare without order."""
    a = left.select("row_id", *[F.col(f).alias(f"{f}_l") for f in fields])
    b = right.select("row_id", *[F.col(f).alias(f"{f}_r") for f in fields])
    pairs = a.join(b, "row_id", "full_outer").select("row_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_l").alias("left"), F.col(f"{f}_r").alias("right"), F.lit(f in as_lists).alias("l")) for f in fields])).alias("x")).select("row_id", "x.*")
    same = F.when(F.col("l"), _as_set(F.col("left")).eqNullSafe(_as_set(F.col("right")))).otherwise(F.col("left").eqNullSafe(F.col("right")))
    return pairs.filter(~same).drop("l")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def multiset_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersectAll(right)


def type_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy(variant_type(F.col("ref"), F.col("alt")).alias("variant_type")).agg(F.count("*").alias("n"))


def stratified_sample(variants: DataFrame, seed: str, rates: dict[str, int] | None = None) -> DataFrame:
    """Variants (chrom, pos, ref, alt as text) kept by a BLAKE2b draw per variant and the rate of its type, the same on every run.

    Spark has no BLAKE2b, so the draw is one vectorised Python function over the key column.
    """
    rates = rates or RATES

    @F.pandas_udf("int")
    def draw(key: pd.Series) -> pd.Series:
        return key.map(lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") % 10_000)

    kind = variant_type(F.col("ref"), F.col("alt"))
    rate = F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in rates.items()])
    key = F.concat_ws("\t", F.lit(seed), "chrom", F.col("pos").cast("string"), "ref", "alt")
    return variants.withColumn("variant_type", kind).withColumn("__draw", draw(key)).filter(F.col("__draw") < rate).drop("__draw")


def examples(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows of each value of by, in order: a report's examples, which is what the limit is for."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def timings(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Median, least and most of the timings of each group."""
    return rows.groupBy(*by).agg(F.percentile(seconds, 0.5).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
