"""Score tables: native files with a version header, and import into a filter table."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.alleles import chrom
from genoloom.operators.scores import check_scores
from genoloom.sources.blocks import REMOTE, text_lines
from genoloom.storage import file_system

#: Column names of a native score file (fixed values), and the builds its version line names.
HEADER = "#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED"
BUILDS = {"GRCh37": "hg19", "GRCh38": "hg38"}


def metadata(head: list[str]) -> tuple[str, str]:
    """Build and version from the first lines of a native file."""
    if HEADER not in head:
        raise ValueError("not a native score file: its column header is missing")
    for line in head:
        if m := re.match(r"##CADD (GRCh3[78])-v(\S+)", line):
            return BUILDS[m[1]], m[2]
    raise ValueError("the score file names no build")


def read_scores(spark: SparkSession, path: str, build: str | None = None) -> tuple[DataFrame, str, str]:
    """Scores (chrom, pos, ref, alt, raw, phred) of a native file with its build and version. Block-gzipped and remote files are read in byte ranges."""
    raw, head = text_lines(spark, path)
    found, version = metadata(head)
    if build and build != found:
        raise ValueError(f"the score file is for {found}")
    rows = raw.filter(~F.col("value").startswith("#")).withColumn("p", F.split("value", "\t"))
    get = lambda i: F.get("p", F.lit(i))
    named = rows.select(get(0).alias("given"), chrom(get(0)).alias("chrom"), get(1).try_cast("long").alias("pos"), get(2).alias("ref"), get(3).alias("alt"), get(4).alias("raw"), get(5).alias("phred"))
    return check_scores(named.drop("given")), found, version


def store_scores(spark: SparkSession, source: str, path: str, build: str | None = None) -> None:
    """A native file as Parquet, ranged and sorted by chromosome and position, with a manifest of its build and version; written once, read by open_scores().

    Lookups prune files and row groups by their statistics. The manifest comes last, so an unfinished store is none.
    """
    scores, found, version = read_scores(spark, source, build)
    scores.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(f"{path}/rows")
    fs, p = file_system(spark, f"{path}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"build": found, "version": version, "source": source}).encode()))
    out.close()


def is_store(spark: SparkSession, path: str) -> bool:
    if path.startswith(REMOTE):
        return False
    fs, p = file_system(spark, f"{path}/manifest.json")
    return fs.exists(p)


def open_scores(spark: SparkSession, path: str, build: str | None = None) -> tuple[DataFrame, str, str]:
    """Scores, build and version of a store or a native file. A build that isn't the asked one is an error."""
    if not is_store(spark, path):
        return read_scores(spark, path, build)
    m = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    if build and build != m["build"]:
        raise ValueError(f"the score file is for {m['build']}")
    return spark.read.parquet(f"{path}/rows"), m["build"], m["version"]


def import_table(spark: SparkSession, path: str) -> DataFrame:
    """Filter-table rows of a score table whose columns are found by name; malformed scores and empty tables are errors."""
    raw = text_lines(spark, path)[0]
    head = raw.filter(F.col("value").startswith("#") & ~F.col("value").startswith("##")).orderBy("line_no").limit(1).collect()
    if not head:
        raise ValueError("the score table has no header")
    names = head[0].value.lstrip("#").split("\t")
    at = {n: names.index(n) for n in ("Chrom", "Pos", "Ref", "Alt", "RawScore", "PHRED")}
    rows = raw.filter(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("p", F.split("value", "\t"))
    get = lambda n: F.get("p", F.lit(at[n]))
    ok = check_scores(rows.select(chrom(get("Chrom")).alias("chrom"), get("Pos").try_cast("long").alias("pos"), get("Ref").alias("ref"), get("Alt").alias("alt"), get("RawScore").alias("raw"), get("PHRED").alias("phred")))
    if ok.isEmpty():
        raise ValueError("the score table has no rows")
    return ok.select(F.col("pos").alias("ord"), "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "ref", "alt", F.array("raw", "phred").alias("values"))
