"""Transcript annotation: where a variant falls in each transcript near it, what it does to the protein, and the best of it per variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.alleles import oriented, overlaps
from genoloom.operators import coding
from genoloom.operators.intervals import nearest, overlap_join
from genoloom.storage import stored

#: Ranks of function classes, best first (fixed values).
RANK = {"exonic": 0, "splicing": 1, "ncRNA_exonic": 2, "ncRNA_splicing": 3, "ncRNA_intronic": 4, "UTR5": 5, "UTR3": 5, "intronic": 6, "upstream": 7, "downstream": 7, "intergenic": 8}
SPLICE, FLANK = 2, 1000
#: Keys without a partner that hits which need no sequence get in the join with sequences.
SPREAD = 1 << 20


def prepare(transcripts: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Transcripts ready for annotation: genes with a coding isoform lose their others; exons get cDNA offsets; bounds of the coding part in cDNA; seq.

    Sequences join by transcript id; a missing one is null.
    """
    coding_gene = F.max(F.col("cds_start") < F.col("cds_end")).over(Window.partitionBy("gene"))
    t = transcripts.withColumn("__any", coding_gene).filter(~F.col("__any") | (F.col("cds_start") < F.col("cds_end"))).drop("__any")
    lengths = F.transform("exons", lambda x: x["e"] - x["s"])
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    before = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)
    t = t.withColumn("tx_len", total).withColumn("exons", F.transform("exons", lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(i == 0, F.lit(0).cast("long")).otherwise(before(i)).alias("before"), i.alias("i"))))
    plus = F.col("strand") == "+"
    lo = cdna(F.when(plus, F.col("cds_start")).otherwise(F.col("cds_end") - 1))
    hi = cdna(F.when(plus, F.col("cds_end") - 1).otherwise(F.col("cds_start"))) + 1
    both = lo.isNotNull() & hi.isNotNull()
    t = t.withColumn("cds_lo", F.when(both, lo)).withColumn("cds_hi", F.when(both, hi))
    if sequences is None:
        return t.withColumn("seq", F.lit(None).cast("string"))
    s = sequences.select(F.col("id").alias("__id"), "seq")
    return t.join(s, F.col("tx_id") == F.col("__id"), "left").drop("__id")


def cdna(position: Column) -> Column:
    """The zero-based place of a genomic position in the transcript, null outside its exons."""
    inside = F.filter("exons", lambda x: (position >= x["s"]) & (position < x["e"]))
    at = F.transform(inside, lambda x: F.when(F.col("strand") == "+", x["before"] + position - x["s"]).otherwise(F.col("tx_len") - 1 - (x["before"] + position - x["s"])))
    return F.get(at, F.lit(0))


def exon_number(i: Column) -> Column:
    return F.when(F.col("strand") == "+", i + 1).otherwise(F.size("exons") - i)


def _noncoding_detail(intron: bool) -> Column:
    """The c. text of a substitution outside the coding part, null where there is none."""
    v = F.col("start")
    r, a = oriented(F.col("ref"), F.col("strand")), oriented(F.col("alt"), F.col("strand"))
    applies = (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("cds_start") != F.col("cds_end")) & F.col("cds_lo").isNotNull()
    if not intron:
        at = cdna(v)
        c = F.when(at < F.col("cds_lo"), F.concat(F.lit("-"), (F.col("cds_lo") - at).cast("string"))).otherwise(F.concat(F.lit("*"), (at + 1 - F.col("cds_hi")).cast("string")))
        return F.when(applies & at.isNotNull(), F.concat("tx_id", F.lit(":c."), c, r, F.lit(">"), a))
    edges = F.flatten(F.transform("exons", lambda x: F.array(F.struct(F.abs(v - x["s"]).alias("d"), (x["i"] * 2).alias("k"), x["s"].alias("g"), x["i"].alias("i")), F.struct(F.abs(v - (x["e"] - 1)).alias("d"), (x["i"] * 2 + 1).alias("k"), (x["e"] - 1).alias("g"), x["i"].alias("i")))))
    edge = F.array_min(edges)  # the nearest, the first of equals
    at = cdna(edge["g"])
    head = F.concat("tx_id", F.lit(":exon"), exon_number(edge["i"]).cast("string"), F.lit(":"))
    sign = F.when((v > edge["g"]) == (F.col("strand") == "+"), "+").otherwise("-")
    inside = F.concat(head, F.lit("c."), (at - F.col("cds_lo") + 1).cast("string"), sign, edge["d"].cast("string"), r, F.lit(">"), a)
    return F.when(applies & at.isNotNull(), F.when(at < F.col("cds_lo"), F.concat(head, F.lit("UTR5"))).when(at >= F.col("cds_hi"), F.concat(head, F.lit("UTR3"))).otherwise(inside))


def classify(pairs: DataFrame, splice: int = SPLICE, flank: int = FLANK) -> DataFrame:
    """Variant-transcript pairs with function, detail, rank, exon (index of the first exon met) and needs_coding; pairs beyond the flank go."""
    v, e = F.col("start"), F.col("end")
    plus, coded = F.col("strand") == "+", F.col("cds_start") != F.col("cds_end")
    left, right = e <= F.col("tx_start"), v >= F.col("tx_end")
    distance = F.when(left, F.col("tx_start") - e + 1).when(right, v - F.col("tx_end") + (F.col("ref") != "").cast("int"))
    first = F.get(F.filter("exons", lambda x: overlaps(v, e, x["s"], x["e"])), F.lit(0))["i"]
    introns = F.sequence(F.lit(1), F.size("exons") - 1)
    ends = lambda i: F.get("exons", i - 1)["e"]
    starts = lambda i: F.get("exons", i)["s"]
    near = (F.size("exons") > 1) & F.exists(introns, lambda i: overlaps(v, e, ends(i), ends(i) + splice) | overlaps(v, e, F.greatest(starts(i) - splice, F.lit(0)), starts(i)))
    near = F.when(F.size("exons") > 1, near).otherwise(False)
    p = pairs.withColumn("distance", distance).filter(F.col("distance").isNull() | (F.col("distance") < flank)).withColumn("exon", first)
    outside = (e <= F.col("cds_start")) | (v >= F.col("cds_end"))
    function = (
        F.when(left, F.when(plus, "upstream").otherwise("downstream"))
        .when(right, F.when(plus, "downstream").otherwise("upstream"))
        .when(F.col("exon").isNull(), F.when(coded, F.when(near, "splicing").otherwise("intronic")).otherwise(F.when(near, "ncRNA_splicing").otherwise("ncRNA_intronic")))
        .when(~coded, "ncRNA_exonic")
        .when(outside, F.when((e <= F.col("cds_start")) == plus, "UTR5").otherwise("UTR3"))
        .otherwise("exonic")
    )
    p = p.withColumn("function", function)
    detail = (
        F.when(F.col("function").isin("upstream", "downstream"), F.concat(F.lit("dist="), F.col("distance").cast("string")))
        .when(F.col("function").isin("splicing", "ncRNA_splicing"), F.coalesce(_noncoding_detail(True), F.col("tx_id")))
        .when(F.col("function").isin("UTR5", "UTR3"), F.coalesce(_noncoding_detail(False), F.col("tx_id")))
        .otherwise(".")
    )
    rank = F.coalesce(*[F.when(F.col("function") == k, F.lit(r)) for k, r in RANK.items()])
    return p.withColumn("detail", detail).withColumn("rank", rank)


def hits(variants: DataFrame, transcripts: DataFrame, splice: int = SPLICE, flank: int = FLANK, shift: int | None = None) -> DataFrame:
    """One row per variant and transcript within reach: row_id, ref_len, tx order, gene, rank, function, detail, exonic, change.

    The range join is planned once and carries no sequences: hits are classified, then exonic ones join their transcript's sequence by a key that others
    have no partner for, spread out so that an exchange deals them evenly.
    """
    light = transcripts.select("chrom", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), *[c for c in transcripts.columns if c not in ("chrom", "seq", "start", "end")])
    names = [c for c in light.columns if c not in ("chrom", "start", "end")]
    pairs = overlap_join(variants.select("row_id", "chrom", "start", "end", "ref", "alt"), light, pad=flank, shift=shift)
    pairs = pairs.select("row_id", "start", "end", "ref", "alt", *[F.col(f"r_{c}").alias(c) for c in names])
    found = classify(pairs, splice, flank)
    is_exonic = F.col("function") == "exonic"
    seqs = transcripts.select(F.col("ord").alias("__ord"), "seq")
    key = F.when(is_exonic, F.col("ord")).otherwise(-1 - F.pmod(F.xxhash64("row_id"), F.lit(SPREAD)))
    read = coding.consequences(found.withColumn("__key", key).join(seqs, F.col("__key") == F.col("__ord"), "left").drop("__ord", "__key").withColumnRenamed("detail", "plain"))
    dot = F.lit(".")
    return read.select(
        "row_id", F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("span"), F.struct("tx_start", "ord").alias("o"), "gene", "rank", "function",
        F.when(is_exonic, F.col("detail")).otherwise(F.col("plain")).alias("detail"), F.when(is_exonic, F.col("exonic")).otherwise(dot).alias("exonic"), F.when(is_exonic, F.col("change")).otherwise(dot).alias("change"),
    )


def reduce_hits(found: DataFrame, splice: int = SPLICE) -> DataFrame:
    """The best of each variant's hits: row_id, func, gene, detail, exonic, change. One shuffle, by row_id.

    Hits of the least rank form groups by function in the order in which transcripts show them, UTR5 and upstream first; exonic and
    ncRNA_exonic variants no longer than the splice reach get a last group of all splicing hits.
    """
    h = F.struct("rank", "o", "function", "gene", "detail", "exonic", "change")
    per = found.groupBy("row_id").agg(F.max("span").alias("span"), F.array_sort(F.collect_list(h)).alias("h"))
    best = F.get("h", F.lit(0))["rank"]
    per = per.withColumn("best", F.filter("h", lambda x: x["rank"] == best))
    functions = F.array_distinct(F.transform("best", lambda x: x["function"]))
    early = lambda f: f.isin("UTR5", "upstream")
    ordered = F.concat(F.filter(functions, early), F.filter(functions, lambda f: ~early(f)))
    spliced = F.filter("h", lambda x: x["function"].isin("splicing", "ncRNA_splicing"))
    extra = best.isin(0, 2) & (F.col("span") <= splice) & (F.size(spliced) > 0)
    groups = F.transform(ordered, lambda f: F.struct(f.alias("f"), F.filter("best", lambda x: x["function"] == f).alias("g")))
    groups = F.when(extra, F.concat(groups, F.array(F.struct(F.lit("splicing").alias("f"), spliced.alias("g"))))).otherwise(groups)
    per = per.withColumn("groups", groups)
    unique = lambda a, k: F.array_join(F.array_distinct(F.transform(a, lambda x: x[k])), ",")
    return per.select(
        "row_id",
        F.array_join(F.transform("groups", lambda g: g["f"]), ";").alias("func"),
        F.array_join(F.transform("groups", lambda g: F.array_join(F.array_sort(F.array_distinct(F.transform(g["g"], lambda x: x["gene"]))), ",")), ";").alias("gene"),
        F.array_join(F.transform("groups", lambda g: unique(g["g"], "detail")), ";").alias("detail"),
        unique(F.col("best"), "exonic").alias("exonic"),
        unique(F.col("best"), "change").alias("change"),
    )


def intergenic(variants: DataFrame, transcripts: DataFrame) -> DataFrame:
    """row_id, func, gene, detail, exonic, change of variants away from all transcripts, by their nearest ones."""
    t = transcripts.select("chrom", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), "ord", F.col("gene").alias("name"))
    n = nearest(variants.select("row_id", "chrom", "start", "end", "ref"), t)
    left = F.when(F.col("left_name").isNull(), "dist=NONE").otherwise(F.concat(F.lit("dist="), (F.col("start") - F.col("left_end") + (F.col("ref") != "").cast("int")).cast("string")))
    right = F.when(F.col("right_name").isNull(), "dist=NONE").otherwise(F.concat(F.lit("dist="), (F.col("right_start") - F.col("end") + 1).cast("string")))
    names = F.concat(F.coalesce("left_name", F.lit("NONE")), F.lit(","), F.coalesce("right_name", F.lit("NONE")))
    dot = F.lit(".")
    return n.select("row_id", F.lit("intergenic").alias("func"), F.when(F.col("known"), names).otherwise(dot).alias("gene"), F.when(F.col("known"), F.concat(left, F.lit(";"), right)).otherwise(dot).alias("detail"), dot.alias("exonic"), dot.alias("change"))


COLUMNS = ("func", "gene", "detail", "exonic", "change")


def gene_join(variants: DataFrame, transcripts: DataFrame, prefix: str = "g", splice: int = SPLICE, flank: int = FLANK, shift: int | None = None) -> DataFrame:
    """variants with <prefix>_func, _gene, _detail, _exonic and _change. transcripts: from prepare().

    The best hits, one narrow row a variant, are written to the shared folder, because variants without one are asked for their neighbours
    and hits() would otherwise be planned once more.
    """
    best = stored(reduce_hits(hits(variants, transcripts, splice, flank, shift), splice), "gene")
    some = variants.join(best.withColumnRenamed("row_id", "__row"), F.col("row_id") == F.col("__row"), "left").drop("__row")
    near = intergenic(some.filter("func is null").select("row_id", "chrom", "start", "end", "ref"), transcripts)
    near = near.select(F.col("row_id").alias("__row"), *[F.col(c).alias(f"__{c}") for c in COLUMNS])
    out = some.join(near, F.col("row_id") == F.col("__row"), "left")
    return out.select(*variants.columns, *[F.coalesce(c, f"__{c}").alias(f"{prefix}_{c}") for c in COLUMNS])
