"""Indexes: filter tables as Parquet sorted by key, with a manifest that tells when they are out of date."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("chrom", "start", "end", "ref", "alt")
VERSION = 2


def build(table: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write a filter table range-partitioned and sorted by key, so that lookups prune files and row groups by their statistics. Returns it read back."""
    by = [F.col(k) for k in ("chrom", "start")]
    ranged = table.repartitionByRange(partitions, *by) if partitions else table.repartitionByRange(*by)
    ranged.sortWithinPartitions(*KEY, "ord").write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def fingerprint(path: str, whole: bool = False) -> dict:
    """Size, time and hash of a source file: of its first MiB, and of all of it if asked."""
    s = os.stat(path)
    out = {"path": os.path.abspath(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}
    with open(path, "rb") as f:
        out["prefix_sha256"] = hashlib.sha256(f.read(1 << 20)).hexdigest()
    if whole:
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        out["sha256"] = h.hexdigest()
    return out


def digest_of(table: DataFrame, columns: list[str]) -> str:
    """A hash of a table's rows in any order: their count and the sum of their 64-bit hashes, by one aggregate."""
    r = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s or 0}"


def build_from_file(spark: SparkSession, source: str, path: str, reference=None) -> None:
    """Index a filter-table file; with a chunked reference, alleles are left-aligned first and the manifest says so, with the reference's hash."""
    from genoloom.operators.left_align import left_align
    from genoloom.sources.readers import lines, parse_filter_db

    table, names = parse_filter_db(lines(spark, source))
    if reference is not None:
        table = left_align(table.withColumn("row_id", F.col("ord")), reference).drop("row_id")
    rows = build(table, f"{path}/rows")
    manifest = {"version": VERSION, "source": fingerprint(source, True), "names": names, "normalization": "left-align" if reference is not None else "none", "rows": digest_of(rows, sorted(rows.columns))}
    if reference is not None:
        manifest["reference"] = digest_of(reference, ["chrom", "chunk", "seq"])
    temp = f"{path}/manifest.json.tmp"
    with open(temp, "w") as f:
        json.dump(manifest, f, indent=1)
    os.replace(temp, f"{path}/manifest.json")


def is_index(path: str) -> bool:
    return os.path.exists(f"{path}/manifest.json")


def open_index(spark: SparkSession, path: str, normalization: str = "none", full: bool = False, reference=None) -> tuple[DataFrame, list[str]]:
    """The rows and names of an index whose source is unchanged and whose normalization, and reference if one is given, are as asked.

    full: the whole source and the index's own rows are hashed too.
    """
    with open(f"{path}/manifest.json") as f:
        m = json.load(f)
    if m["version"] != VERSION:
        raise ValueError("the index has another version")
    if m["normalization"] != normalization:
        raise ValueError(f"the index was normalized by {m['normalization']}, not {normalization}")
    if reference is not None and digest_of(reference, ["chrom", "chunk", "seq"]) != m.get("reference"):
        raise ValueError("the index was normalized against another reference")
    now = fingerprint(m["source"]["path"], full)
    if any(m["source"][k] != v for k, v in now.items()):
        raise ValueError("the index is out of date")
    rows = spark.read.parquet(f"{path}/rows")
    if full and digest_of(rows, sorted(rows.columns)) != m["rows"]:
        raise ValueError("the index's rows are damaged")
    return rows, m["names"]


def statistics(table: DataFrame) -> dict:
    """Records and distinct chromosomes of a table, by one aggregate."""
    return table.agg(F.count("*").alias("records"), F.countDistinct("chrom").alias("contigs")).first().asDict()
