"""Column functions on chromosomes, alleles and coordinates.

Inside the engine positions are zero-based and half-open, an empty allele is the empty string, and an insertion has start = end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chrom(c: Column) -> Column:
    """A chromosome without one leading, case-sensitive ``chr``."""
    return F.regexp_replace(c, "^chr", "")


def strict_chrom(c: Column) -> Column:
    """As chrom(), with M as MT; an empty one is an error."""
    bare = chrom(c)
    return F.when(bare == "", F.raise_error(F.lit("empty chromosome"))).when(bare.isin("M", "MT"), "MT").otherwise(bare)


def allele(c: Column) -> Column:
    """An allele as text to the engine's form: ``-`` is empty, ASCII letters upper-case."""
    return F.when(c == "-", F.lit("")).otherwise(F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def allele_text(c: Column) -> Column:
    return F.when(c == "", F.lit("-")).otherwise(c)


def supported_alt(c: Column) -> Column:
    return c.rlike("^[ACGTNacgtn]+$")


def shared_prefix(a: Column, b: Column, most: Column) -> Column:
    """Leading characters that a and b share, at most so many."""
    differs = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), F.lit(False))
    return F.when(most <= 0, F.lit(0)).when(differs == 0, most).otherwise((differs - 1).cast("int"))


def with_trim(df: DataFrame, start: str, ref: str, alt: str) -> DataFrame:
    """df with t, the minimal alleles without a reference: struct(start, end, ref, alt).

    The shared suffix goes while both sides keep a base, then the shared prefix likewise, then one shared anchor base if a side is that base
    alone. Steps are columns of their own, so that no expression is evaluated twice.
    """
    c = F.col
    room = lambda r, a: F.least(F.length(r), F.length(a)) - 1
    df = df.withColumn("__k", F.when((F.length(ref) > 1) & (F.length(alt) > 1), shared_prefix(F.reverse(ref), F.reverse(alt), room(ref, alt))).otherwise(0))
    df = df.withColumns({f"__{x}1": F.substr(c(y), F.lit(1), F.length(y) - c("__k")) for x, y in (("r", ref), ("a", alt))})
    df = df.withColumn("__p", F.when((F.length("__r1") > 1) & (F.length("__a1") > 1), shared_prefix(c("__r1"), c("__a1"), room("__r1", "__a1"))).otherwise(0))
    df = df.withColumns({f"__{x}2": F.substr(c(f"__{x}1"), c("__p") + 1) for x in "ra"})
    anchor = (F.left(c("__r2"), F.lit(1)) == F.left(c("__a2"), F.lit(1))) & ((F.length("__r2") == 1) != (F.length("__a2") == 1))
    df = df.withColumn("__one", anchor.cast("int"))
    df = df.withColumns({f"__{x}3": F.substr(c(f"__{x}2"), c("__one") + 1) for x in "ra"})
    df = df.withColumn("__s", (c(start) + c("__p") + c("__one")).cast("long"))
    t = F.struct(c("__s").alias("start"), (c("__s") + F.length("__r3")).cast("long").alias("end"), c("__r3").alias("ref"), c("__a3").alias("alt"))
    return df.withColumn("t", t).drop("__k", "__p", "__one", "__s", *[f"__{x}{i}" for x in "ra" for i in (1, 2, 3)])


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether [start, end) meets [low, high); an insertion touches both ends."""
    return F.when(start == end, (low <= start) & (start <= high)).otherwise((start < high) & (end > low))


def snv_shape(start: Column, end: Column, ref: Column, alt: Column, bases: str = "ACGTN") -> Column:
    one = f"^[{bases}]$"
    return (end == start + 1) & ref.rlike(one) & alt.rlike(one) & (ref != alt)


def is_snv(start: Column, end: Column, ref: Column, alt: Column) -> Column:
    return snv_shape(start, end, ref, alt, "ACGT")


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def oriented(c: Column, strand: Column) -> Column:
    return F.when(strand == "+", c).otherwise(reverse_complement(c))


def variant_type(ref: Column, alt: Column) -> Column:
    """snv, mnv, indel, multiallelic or other of VCF text alleles."""
    plain = "^[ACGTN]+$"
    return (
        F.when(alt.contains(","), "multiallelic")
        .when(~F.upper(ref).rlike(plain) | ~F.upper(alt).rlike(plain), "other")
        .when((F.length(ref) == 1) & (F.length(alt) == 1), "snv")
        .when(F.length(ref) == F.length(alt), "mnv")
        .otherwise("indel")
    )


def avinput_fields(chrom_: Column, start: Column, end: Column, ref: Column, alt: Column) -> list[Column]:
    """The five text columns of a variant: an insertion prints its position twice."""
    insertion = start == end
    return [
        chrom_.alias("Chr"),
        F.when(insertion, start).otherwise(start + 1).cast("string").alias("Start"),
        end.cast("string").alias("End"),
        allele_text(ref).alias("Ref"),
        allele_text(alt).alias("Alt"),
    ]
