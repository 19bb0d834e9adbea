"""Left alignment of alleles against a reference.

The shift is a loop whose length depends on the sequence, so each variant gets the bases before it from the chunk table, and a vectorised Python
function walks them. Variants that reach the start of their window take another turn with a window twice as long.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.sources.reference import CHUNK, extract
from genoloom.storage import stored


def walk(start: int, ref: str, alt: str, before: str) -> tuple[int, str, str, bool]:
    """Alleles moved left over the bases before them: start, ref, alt, and whether the bases ran out before the walk did."""
    r, a, left = list(ref), list(alt), len(before)
    while True:
        while r and a and r[-1] == a[-1]:
            r.pop()
            a.pop()
        if r and a or not (r or a) or start == 0:
            break
        if not left:
            return start, "".join(r), "".join(a), True
        left -= 1
        r.insert(0, before[left])
        a.insert(0, before[left])
        start -= 1
    same = 0
    while same < min(len(r), len(a)) and r[same] == a[same]:
        same += 1
    return start + same, "".join(r[same:]), "".join(a[same:]), False


def left_align(variants: DataFrame, chunks: DataFrame, window: int = 256, size: int = CHUNK) -> DataFrame:
    """variants (row_id, chrom, start, end, ref, alt) at their leftmost place. Alleles must be ACGTN and ref must equal the reference."""
    core = ["row_id", "chrom", "start", "end", "ref", "alt"]
    v = variants.select(*core)
    plain = F.col("ref").rlike("^[ACGTN]*$") & F.col("alt").rlike("^[ACGTN]*$")
    here = extract(v.select("row_id", "chrom", "start", "end"), chunks, size).select("row_id", "seq")
    v = v.join(here, "row_id")
    place = F.concat("chrom", F.lit(":"), (F.col("start") + 1).cast("string"))
    v = v.withColumn("ref", F.when(~plain, F.raise_error(F.concat(F.lit("explicit alleles are needed at "), place))).when(F.col("seq") != F.col("ref"), F.raise_error(F.concat(F.lit("reference allele mismatch at "), place))).otherwise(F.col("ref"))).drop("seq")

    @F.pandas_udf("start long, ref string, alt string, more boolean")
    def moved(start: pd.Series, ref: pd.Series, alt: pd.Series, before: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walk(*x) for x in zip(start, ref, alt, before)], columns=["start", "ref", "alt", "more"])

    done = None
    while True:
        back = extract(v.select("row_id", "chrom", F.greatest(F.col("start") - window, F.lit(0)).alias("start"), F.col("start").alias("end")), chunks, size).select("row_id", F.col("seq").alias("before"))
        step = stored(v.join(back, "row_id").withColumn("m", moved("start", "ref", "alt", "before")).select("row_id", "chrom", "m.*"), "aligned")  # each turn is planned and run once
        rest = step.filter("more")
        out = step.filter("not more").drop("more")
        done = out if done is None else done.unionByName(out)
        if rest.isEmpty():
            break
        v, window = rest.drop("more"), window * 2
    done = done.select(F.col("row_id").alias("__row"), F.col("start").alias("__start"), F.col("ref").alias("__ref"), F.col("alt").alias("__alt"))
    others = [c for c in variants.columns if c not in core]
    j = variants.join(done, F.col("row_id") == F.col("__row"))
    return j.select("row_id", "chrom", F.col("__start").alias("start"), (F.col("__start") + F.length("__ref")).alias("end"), F.col("__ref").alias("ref"), F.col("__alt").alias("alt"), *others)


def check_reference(variants: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """variants whose VCF reference alleles, as written, equal the reference; another one is an error. variants: parse_vcf() rows."""
    written = F.upper(F.get("fields", F.lit(3)))
    at = F.get("fields", F.lit(1)).cast("long") - 1
    here = extract(variants.select("row_id", "chrom", at.alias("start"), (at + F.length(written)).alias("end")), chunks, size).select(F.col("row_id").alias("__row"), F.col("seq").alias("__seq"))
    j = variants.join(here, F.col("row_id") == F.col("__row"))
    place = F.concat("chrom", F.lit(":"), F.get("fields", F.lit(1)))
    ok = F.when(F.col("__seq") == written, F.col("ref")).otherwise(F.raise_error(F.concat(F.lit("reference allele mismatch at "), place)))
    return j.withColumn("ref", ok).select(*variants.columns)


def normalize(variants: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """All variants, those with sequences as alleles at their leftmost place; VCF reference alleles are checked first. Unsupported alternates stay as they are."""
    if "fields" in variants.columns:
        variants = check_reference(variants, chunks, size)
    if "supported" not in variants.columns:
        return left_align(variants, chunks, size=size).select(*variants.columns)
    moved = left_align(variants.filter("supported"), chunks, size=size).select(*variants.columns)
    return moved.unionByName(variants.filter("not supported"))
