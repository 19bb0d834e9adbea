"""Exact allele joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions.strings import in_order

KEY = ("chrom", "start", "end", "ref", "alt")


def collapse(db: DataFrame, names: list[str]) -> DataFrame:
    """One row per key: each value column joined by ``;`` over the key's rows in their order, rows that lack the column left out."""
    cells = [F.array_join(in_order(F.col("ord"), F.get("values", F.lit(i))), ";").alias(f"v{i}") for i in range(len(names))]
    return db.groupBy(*KEY).agg(*(cells or [F.lit("1").alias("v0")]))


def filter_join(variants: DataFrame, db: DataFrame, names: list[str], prefix: str = "v", missing: str = ".") -> DataFrame:
    """variants with the table's columns as <prefix>0, <prefix>1, ...; missing where no row has the allele.

    The table is collapsed to a row per key first, so rows never multiply. An empty value of a hit stays empty.
    """
    one = collapse(db, names)
    n = max(len(names), 1)
    right = one.select(*[F.col(k).alias(f"__{k}") for k in KEY], *[F.col(f"v{i}").alias(f"{prefix}{i}") for i in range(n)])
    on = [F.col(k) == F.col(f"__{k}") for k in KEY]
    joined = variants.join(right, on, "left")
    return joined.select(*variants.columns, *[F.coalesce(f"{prefix}{i}", F.lit(missing)).alias(f"{prefix}{i}") for i in range(n)])


def strict_check(variants: DataFrame) -> DataFrame:
    """variants of the strict mode: alleles are sequences, the reference spans its interval, insertions have an alternate."""
    bad: Column = (
        ~F.col("ref").rlike("^([ACGTN]*|0)$") | ~F.col("alt").rlike("^[ACGTN]*$") | ((F.col("ref") != "0") & (F.length("ref") != F.col("end") - F.col("start"))) | ((F.col("start") == F.col("end")) & (F.col("alt") == ""))
    )
    line = F.coalesce(F.col("source_line"), F.lit(0)) if "source_line" in variants.columns else F.col("row_id")
    return variants.withColumn("ref", F.when(bad, F.raise_error(F.concat(F.lit("invalid alleles at input line "), line.cast("string")))).otherwise(F.col("ref")))


def rows_equal(table: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of a table whose column is exactly value; an unknown column is an error, nulls never match."""
    if column not in table.columns:
        raise ValueError(f"no column {column}")
    return table.filter(F.col(f"`{column}`") == F.lit(value))
