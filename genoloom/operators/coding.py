"""Coding consequences of exonic variants, as column expressions on variant-transcript pairs with their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.functions.alleles import oriented
from genoloom.functions.codons import amino_acid, protein, shown


def _sub(text: Column, start: Column, length: Column) -> Column:
    """length characters from zero-based start."""
    return F.substr(text, (start + 1).cast("int"), length.cast("int"))


def consequences(pairs: DataFrame) -> DataFrame:
    """Exonic pairs with detail, exonic and change.

    The first rule that fails names the detail of an ``unknown`` one. Substitutions of one base are told by their codon, other changes by the
    mutated coding sequence.
    """
    from genoloom.operators.gene import cdna, exon_number

    c = F.col
    plus = c("strand") == "+"
    p = pairs.withColumn("r", oriented(c("ref"), c("strand"))).withColumn("a", oriented(c("alt"), c("strand")))
    exon = F.get("exons", c("exon"))
    insertion = c("start") == c("end")
    contained = (c("start") >= exon["s"]) & (c("end") <= exon["e"]) & (c("start") >= c("cds_start")) & (c("end") <= c("cds_end"))
    at_edge = insertion & ((c("start") == exon["s"]) | (c("end") == exon["e"]) | (c("start") == c("cds_start")) | (c("end") == c("cds_end")))
    p = p.withColumn("inside", contained & ~at_edge & (c("ref") != "0")).withColumn("single", (F.length("ref") == 1) & (F.length("alt") == 1))
    anchor = F.when(c("single") | plus, c("start")).when(insertion, c("start") - 1).otherwise(c("end") - 1)
    p = p.withColumn("at", cdna(anchor)).withColumn("exon_no", exon_number(c("exon")))
    cds_length = c("cds_hi") - c("cds_lo")
    bad_cds = F.coalesce((c("cds_hi") > F.length("seq")) | (cds_length <= 0) | (cds_length % 3 != 0), F.lit(True))
    offset = c("at") - c("cds_lo")
    codon_at = c("cds_lo") + F.floor(F.abs(offset) / 3) * 3
    p = p.withColumn("offset", offset).withColumn("codon", _sub(c("seq"), codon_at, F.lit(3)))
    single_fault = (
        F.when(c("seq").isNull(), "missing_transcript_sequence")
        .when(c("at").isNull(), ".")
        .when(bad_cds, "invalid_cds")
        .when(codon_at + 3 > F.length("seq"), ".")
        .when(_sub(c("seq"), c("at"), F.lit(1)) != c("r"), "reference_mismatch")
        .when(~c("codon").rlike("^[ACGT]{3}$") | ~c("alt").rlike("^[ACGT]$"), "ambiguous_sequence")
    )
    size = F.length("r")
    cds = _sub(c("seq"), c("cds_lo"), cds_length)
    small_fault = (
        F.when(c("seq").isNull(), "missing_transcript_sequence")
        .when(bad_cds, "invalid_cds")
        .when(c("at").isNull(), "unsupported_coding_boundary")
        .when((c("at") < c("cds_lo")) | (c("at") + size > c("cds_hi")) | (_sub(c("seq"), c("at"), size) != c("r")), "reference_mismatch")
        .when(~F.concat(cds, c("a")).rlike("^[ACGT]*$"), "ambiguous_sequence")
    )
    p = p.withColumn("fault", F.when(~c("inside"), F.lit("unsupported_coding_boundary")).when(c("single"), single_fault).otherwise(small_fault)).withColumn("ok", c("fault").isNull())
    return _small(_single(p))


def _single(p: DataFrame) -> DataFrame:
    c = F.col
    use = c("ok") & c("single")
    k = F.abs(c("offset")) % 3
    new = F.concat(_sub(c("codon"), F.lit(0), k), c("a"), _sub(c("codon"), k + 1, 2 - k))
    p = p.withColumn("old_aa", F.when(use, amino_acid(c("codon")))).withColumn("new_aa", F.when(use, amino_acid(new)))
    kind = F.when(c("old_aa") == c("new_aa"), "synonymous SNV").when(c("new_aa") == "*", "stopgain").when(c("old_aa") == "*", "stoploss").otherwise("nonsynonymous SNV")
    text = F.concat("gene", F.lit(":"), "tx_id", F.lit(":exon"), c("exon_no").cast("string"), F.lit(":c."), "r", (F.abs(c("offset")) + 1).cast("string"), "a", F.lit(":p."), shown(c("old_aa")), (F.floor(F.abs(c("offset")) / 3) + 1).cast("string"), shown(c("new_aa")))
    return p.withColumn("kind1", F.when(use, kind)).withColumn("text1", F.when(use, text))


def _small(p: DataFrame) -> DataFrame:
    c = F.col
    use = c("ok") & ~c("single")
    cds = _sub(c("seq"), c("cds_lo"), c("cds_hi") - c("cds_lo"))
    rlen, alen, off = F.length("r"), F.length("a"), c("offset")
    mutant = F.concat(_sub(cds, F.lit(0), off), c("a"), F.substr(cds, (off + rlen + 1).cast("int")))
    p = p.withColumn("old_p", F.when(use, protein(cds))).withColumn("new_p", F.when(use, protein(mutant)))
    o, n = c("old_p"), c("new_p")
    stop = lambda x: F.when(F.instr(x, "*") == 0, F.lit(1 << 30)).otherwise(F.instr(x, "*"))
    delta = alen - rlen
    same_length = F.when(o == n, "synonymous block substitution").when(stop(n) < stop(o), "stopgain").when(stop(o) < stop(n), "stoploss").otherwise("nonsynonymous block substitution")
    shape = F.when(rlen == 0, "insertion").when(alen == 0, "deletion").otherwise("substitution")
    kind = F.when(delta == 0, same_length).otherwise(F.concat(F.when(F.abs(delta) % 3 == 0, "nonframeshift ").otherwise("frameshift "), shape))
    s = lambda x: x.cast("string")
    change = (
        F.when(rlen == 0, F.concat(s(off), F.lit("_"), s(off + 1), F.lit("ins"), "a"))
        .when(alen == 0, F.concat(s(off + 1), F.lit("_"), s(off + rlen), F.lit("del")))
        .otherwise(F.concat(s(off + 1), F.lit("_"), s(off + rlen), F.lit("delins"), "a"))
    )
    # the first residue that differs, zero-based, and the ends behind the shared suffix
    short = F.least(F.length(o), F.length(n))
    first = _prefix(o, n, short)
    p = p.withColumn("first", F.when(use, first))
    f = c("first")
    suffix = _prefix(F.reverse(o), F.reverse(n), short - f)
    p = p.withColumn("suffix", F.when(use, suffix))
    end_old, end_new = F.length(o) - c("suffix"), F.length(n) - c("suffix")
    letter = lambda text, i: F.when((i >= 0) & (i < F.length(text)), shown(_sub(text, i, F.lit(1)))).otherwise("X")
    residue = lambda i: F.concat(letter(o, i), s(i + 1))
    added = _sub(n, f, end_new - f)
    span = F.when(end_old == f + 1, residue(f)).otherwise(F.concat(residue(f), F.lit("_"), residue(end_old - 1)))
    in_frame = (
        F.when(end_old == f, F.concat(residue(F.greatest(f - 1, F.lit(0))), F.lit("_"), residue(f), F.lit("ins"), added))
        .when(added == "", F.concat(span, F.lit("del")))
        .when((end_old == f + 1) & (F.length(added) == 1), F.concat(span, shown(added)))
        .otherwise(F.concat(span, F.lit("delins"), added))
    )
    text_p = F.when(o == n, "=").when(F.abs(delta) % 3 != 0, F.concat(residue(f), letter(n, f), F.lit("fs"))).otherwise(in_frame)
    text = F.concat("gene", F.lit(":"), "tx_id", F.lit(":exon"), s(c("exon_no")), F.lit(":c."), change, F.lit(":p."), text_p)
    p = p.withColumn("exonic", F.when(~c("ok"), "unknown").when(c("single"), c("kind1")).otherwise(kind))
    p = p.withColumn("change", F.when(~c("ok"), ".").when(c("single"), c("text1")).otherwise(text))
    return p.withColumn("detail", F.when(c("ok"), F.lit(".")).otherwise(c("fault")))


def _prefix(a: Column, b: Column, most: Column) -> Column:
    from genoloom.functions.alleles import shared_prefix

    return shared_prefix(a, b, most.cast("int"))
