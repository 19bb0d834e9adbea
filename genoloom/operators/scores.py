"""Positional score lookup with coverage states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.alleles import is_snv, snv_shape

STATES = ("scored", "reference_mismatch", "score_not_found", "contig_not_covered", "not_snv", "unsupported_snv")


def check_scores(scores: DataFrame) -> DataFrame:
    """Score rows (chrom, pos, ref, alt, raw, phred as text); a malformed or repeated one is an error when the query runs."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) != float("inf"))
    good = finite("raw") & finite("phred") & (number("phred") >= 0) & F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$")
    what = F.concat_ws(" ", F.lit("malformed or repeated score at"), "chrom", F.col("pos").cast("string"))
    one = scores.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("phred").alias("phred"))
    return one.withColumn("raw", F.when(F.coalesce(good, F.lit(False)) & (F.col("n") == 1), F.col("raw")).otherwise(F.raise_error(what))).drop("n")


def score_join(variants: DataFrame, scores: DataFrame, prefix: str = "c", missing: str = ".", asked: DataFrame | None = None) -> DataFrame:
    """variants with <prefix>_raw, <prefix>_phred and <prefix>_status. Scores are (chrom, pos one-based, ref, alt, raw, phred).

    Only scores at positions of SNVs go on: a whole genome's table meets the variants' positions, which Spark broadcasts if they are few, before it is shuffled.
    All rows of a position then collapse into one, so one join by (chrom, pos) answers both the score and the mismatch. asked: a cheaper table of
    the same variants to take the positions from, such as the one that earlier joins began with.
    """
    asked = variants if asked is None else asked
    wanted = asked.filter(is_snv(*[F.col(c) for c in ("start", "end", "ref", "alt")])).select(F.col("chrom").alias("__c"), F.col("end").alias("__p"))
    near = scores.join(wanted, (F.col("chrom") == F.col("__c")) & (F.col("pos") == F.col("__p")), "left_semi")
    per = near.groupBy(F.col("chrom").alias("__c"), F.col("pos").alias("__p")).agg(F.collect_list(F.struct("ref", "alt", "raw", "phred")).alias("__rows"))
    covered = scores.select(F.col("chrom").alias("__covered")).distinct()
    core = [F.col(c) for c in ("start", "end", "ref", "alt")]
    j = variants.withColumn("__snv", is_snv(*core)).withColumn("__shape", snv_shape(*core))
    j = j.join(per, (F.col("chrom") == F.col("__c")) & (F.col("end") == F.col("__p")) & F.col("__snv"), "left").join(covered, F.col("chrom") == F.col("__covered"), "left")
    hit = F.get(F.filter("__rows", lambda r: (r["ref"] == F.col("ref")) & (r["alt"] == F.col("alt"))), F.lit(0))
    known = F.exists("__rows", lambda r: r["ref"] == F.col("ref"))
    status = (
        F.when(F.col("__shape") & ~F.col("__snv"), "unsupported_snv").when(~F.col("__snv"), "not_snv").when(F.col("__covered").isNull(), "contig_not_covered")
        .when(hit.isNotNull(), "scored").when(F.col("__rows").isNotNull() & ~known, "reference_mismatch").otherwise("score_not_found")
    )
    return j.select(*variants.columns, F.coalesce(hit["raw"], F.lit(missing)).alias(f"{prefix}_raw"), F.coalesce(hit["phred"], F.lit(missing)).alias(f"{prefix}_phred"), status.alias(f"{prefix}_status"))


def unscored(annotated: DataFrame, prefix: str = "c") -> DataFrame:
    """Rows that break the rule that every SNV-shaped allele must be scored."""
    return annotated.filter(snv_shape(*[F.col(c) for c in ("start", "end", "ref", "alt")]) & (F.col(f"{prefix}_status") != "scored"))
