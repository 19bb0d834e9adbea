"""Readers of variant and annotation text files.

Every reader returns a DataFrame in file order of ``row_id``; malformed lines raise an error that names the line when the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import alleles as A

NUMBER = r"^\+?[0-9]{1,19}$"
#: Alleles that a VCF line has ids for; a line of 2^20 alternates is longer than Spark's strings are in practice.
ALLELES = 1 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text or gzip file: numbers follow the file over its splits, with one count per split and no sort."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("mid"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    blocks = raw.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    from pyspark.sql import Window

    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(F.broadcast(blocks), ["file", "block"]).select((F.col("offset") + F.col("mid") - F.col("first") + 1).alias("line_no"), "value")


def fail(message: str, line: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + " at input line "), line.cast("string")))


def number(c: Column, what: str, line: Column) -> Column:
    """Digits as a long; white space, signs other than + and overlong numbers are errors."""
    return F.when(c.rlike(NUMBER), c.try_cast("long")).otherwise(fail(f"invalid {what}", line).cast("long"))


def _content(raw: DataFrame) -> DataFrame:
    return raw.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))


def _five(parts: Column, line: Column) -> dict[str, Column]:
    """Core columns from five text fields in one-based closed form."""
    get = lambda i: F.get(parts, F.lit(i))
    start, end = number(get(1), "start", line), number(get(2), "end", line)
    ref = A.allele(get(3))
    insertion = get(3) == "-"
    zero = F.when(~insertion & (start == 0), fail("start 0", line).cast("long")).otherwise(start - 1)
    return {"chrom": A.chrom(get(0)), "output_chrom": get(0), "start": F.when(insertion, start).otherwise(zero), "end": F.when(insertion, start).otherwise(end), "ref": ref, "alt": A.allele(get(4)), "given_end": end, "given_start": start}


def parse_avinput(raw: DataFrame) -> DataFrame:
    """Variants of (line_no, value): row_id, chrom, output_chrom, start, end, ref, alt, extra, source_line.

    The first five fields are split at white space; of the rest, leading white space goes and TAB separates.
    """
    line = F.col("line_no")
    core = F.split(F.regexp_extract("value", r"^\s*(\S+\s+\S+\s+\S+\s+\S+\s+\S+)", 1), r"\s+")
    rest = F.regexp_extract("value", r"^\s*\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+(.*)$", 1)
    rows = _content(raw).withColumn("parts", F.when(F.size(core) >= 5, core).otherwise(fail("expected five columns", line).cast("array<string>")))
    c = _five(F.col("parts"), line)
    ok = F.when(c["given_end"] < c["given_start"], fail("end before start", line).cast("long")).otherwise(c["end"])
    return rows.select(
        (line - 1).alias("row_id"), c["chrom"].alias("chrom"), c["output_chrom"].alias("output_chrom"), c["start"].alias("start"), ok.alias("end"), c["ref"].alias("ref"), c["alt"].alias("alt"),
        F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "\t")).alias("extra"), line.alias("source_line"),
    )


def parse_strict_avinput(raw: DataFrame) -> DataFrame:
    """As parse_avinput() under the strict rules, with ``original``, the text of the core fields.

    Fields are cut at TABs if a line has one, else at white space. Chromosomes follow strict_chrom(); alleles must be sequences, a reference must span
    its interval, an insertion has start = end, which is 0 in front of the first base, and an alternate; every line has as many extra columns as the first.
    """
    line = F.col("line_no")
    rows = _content(raw).withColumn("p", F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+")))
    width = rows.agg(F.min_by(F.size("p"), "line_no").alias("w")).first().w or 5
    rows = rows.withColumn("p", F.when((F.size("p") == width) & (F.size("p") >= 5), F.col("p")).otherwise(fail("columns differ in number", line).cast("array<string>")))
    get = lambda i: F.get("p", F.lit(i))
    start, end = number(get(1), "start", line), number(get(2), "end", line)
    insertion = get(3) == "-"
    ref, alt = A.allele(get(3)), A.allele(get(4))
    good = get(3).rlike("^(-|0|[ACGTNacgtn]+)$") & get(4).rlike("^(-|[ACGTNacgtn]+)$")
    good &= F.when(insertion, (start == end) & (get(4) != "-")).otherwise((start >= 1) & (end >= start) & ((get(3) == "0") | (F.length(get(3)) == end - start + 1)))
    checked = F.when(good, ref).otherwise(fail("invalid variant", line))
    return rows.select(
        (line - 1).alias("row_id"), A.strict_chrom(get(0)).alias("chrom"), get(0).alias("output_chrom"), F.when(insertion, start).otherwise(start - 1).alias("start"), end.alias("end"),
        checked.alias("ref"), alt.alias("alt"), F.slice("p", 6, 1 << 20).alias("extra"), F.slice("p", 1, 5).alias("original"), line.alias("source_line"),
    )


def read_avinput(spark: SparkSession, path: str) -> DataFrame:
    return parse_avinput(lines(spark, path))


def parse_vcf(raw: DataFrame) -> DataFrame:
    """Variants of VCF lines, one row an allele: as parse_avinput(), with record, allele_index and fields, the line's columns."""
    line = F.col("line_no")
    rows = _content(raw).withColumn("fields", F.split("value", "\t"))
    get = lambda i: F.get("fields", F.lit(i))
    pos = F.when(F.size("fields") < 8, fail("expected eight columns", line).cast("long")).otherwise(number(get(1), "position", line))
    pos = F.when(pos < 1, fail("position 0", line).cast("long")).otherwise(pos)
    ref = F.upper(get(3))
    ref = F.when(ref.rlike("^[ACGTN]+$"), ref).otherwise(fail("invalid reference allele", line))
    rows = rows.select("line_no", "fields", A.chrom(get(0)).alias("chrom"), (pos - 1).alias("pos"), ref.alias("vref"), F.posexplode(F.split(get(4), ",")).alias("allele_index", "valt"))
    plain = A.supported_alt(F.col("valt"))
    rows = A.with_trim(rows.withColumn("__alt", F.upper("valt")), "pos", "vref", "__alt")
    as_is = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.length("vref")).cast("long").alias("end"), F.col("vref").alias("ref"), F.col("valt").alias("alt"))
    t = F.when(F.col("valt") == "", fail("empty alternate allele", line).cast("struct<start:bigint,end:bigint,ref:string,alt:string>")).when(plain, F.col("t")).otherwise(as_is)
    return rows.withColumn("t", t).select(
        ((F.col("line_no") - 1) * ALLELES + F.col("allele_index")).alias("row_id"), "chrom", F.col("chrom").alias("output_chrom"), "t.start", "t.end", "t.ref", "t.alt", F.array().cast("array<string>").alias("extra"),
        F.col("line_no").alias("source_line"), F.col("line_no").alias("record"), "allele_index", plain.alias("supported"), "fields",
    )


def vcf_headers(raw: DataFrame) -> list[str]:
    """Header lines of a VCF in order; checks that the #CHROM line comes before data, once, and that no annotation of ours is there yet."""
    head = raw.filter(F.col("value").startswith("#")).orderBy("line_no").collect()  # headers only: their number doesn't follow the records
    values = [r.value for r in head]
    names = [r for r in head if r.value.startswith("#CHROM\t")]
    if len(names) != 1:
        raise ValueError("a VCF needs one #CHROM header line")
    if any("##INFO=<ID=FA_" in v for v in values):
        raise ValueError("the VCF already has FA_ annotations")
    width = len(names[0].value.split("\t"))
    bad = _content(raw).filter((F.size(F.split("value", "\t")) != width) | (F.col("line_no") < names[0].line_no)).limit(1).collect()
    if bad or head[-1].line_no != names[0].line_no:
        raise ValueError(f"header and records disagree at input line {bad[0].line_no if bad else head[-1].line_no}")
    return values


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(lines(spark, path))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return read_vcf(spark, path) if path.removesuffix(".gz").endswith(".vcf") else read_avinput(spark, path)


def parse_filter_db(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, list[str]]:
    """A filter table of (line_no, value): (ord, chrom, start, end, ref, alt, values) and the names of its value columns.

    Names come from the first # line that isn't ##, behind its fifth column; without one they are ``value`` or ``value1``...; a table of five columns has
    ``match`` with value 1. strict: rows must be of one width, names unique, and a header may not come late.
    """
    line = F.col("line_no")
    head = raw.filter(F.col("value").startswith("#") & ~F.col("value").startswith("##")).orderBy("line_no").limit(2).collect()
    rows = _content(raw).withColumn("parts", F.split("value", "\t"))
    span = rows.agg(F.max(F.size("parts")).alias("most"), F.min(F.size("parts")).alias("least"), F.min("line_no").alias("first")).first()
    header = [h for h in head if span.first is None or h.line_no < span.first]
    if strict and len(head) > len(header):
        raise ValueError(f"header after data at database line {head[-1].line_no}")
    most = span.most or 5
    if span.least is not None and span.least < 5:
        raise ValueError("a filter table needs five columns")
    names = header[0].value.split("\t")[5:] if header else ["match"] if most == 5 else ["value"] if most == 6 else [f"value{i}" for i in range(1, most - 4)]
    if header and not names:
        names = ["match"]
    if most - 5 > len(names):
        raise ValueError("a row is wider than the header")
    if strict:
        if span.least != span.most or header and len(header[0].value.split("\t")) != most:
            raise ValueError("rows differ in width")
        if len(set(names)) != len(names) or "" in names or {"Chr", "Start", "End", "Ref", "Alt"} & set(names):
            raise ValueError("value column names must be unique, not empty, and not core names")
    c = _five(F.col("parts"), line)
    values = F.array(F.lit("1")) if names == ["match"] else F.slice("parts", 6, len(names))
    chrom = A.strict_chrom(F.get("parts", F.lit(0))) if strict else c["chrom"]
    return rows.select(line.alias("ord"), chrom.alias("chrom"), c["start"].alias("start"), c["end"].alias("end"), c["ref"].alias("ref"), c["alt"].alias("alt"), values.alias("values")), names


def parse_regions(raw: DataFrame, layout: str | None = None) -> tuple[DataFrame, list[str], bool]:
    """A region table of lines: (ord, chrom, start, end, values, score, name), names of the value columns, and whether it is GFF3.

    Each row tells its own layout: GFF3 (nine fields, numbers in the fourth and fifth, a strand in the seventh), a table with a leading bin, or BED.
    layout (``gff3``, ``bin``, ``bed``) overrides that. One GFF3 row makes the whole table GFF3.
    """
    line = F.col("line_no")
    rows = _content(raw).filter(~F.col("value").startswith("bin\t")).withColumn("p", F.split("value", "\t"))
    get = lambda i: F.get("p", F.lit(i))
    num = lambda i: F.coalesce(get(i).rlike(NUMBER), F.lit(False))
    told = F.when((F.size("p") >= 9) & num(3) & num(4) & get(6).isin("+", "-", ".", "?"), "gff3").when(num(0) & num(2) & num(3), "bin").when(num(1) & num(2), "bed").otherwise(fail("unknown region layout", line))
    rows = rows.withColumn("layout", F.lit(layout) if layout else told)
    at = lambda gff, binned, bed: F.when(F.col("layout") == "gff3", gff).when(F.col("layout") == "bin", binned).otherwise(bed)
    name = F.regexp_extract(get(8), r"(?:^|;)ID=([^;]*)", 1)
    out = rows.select(
        line.alias("ord"),
        A.chrom(at(get(0), get(1), get(0))).alias("chrom"),
        at(number(get(3), "start", line) - 1, number(get(2), "start", line), number(get(1), "start", line)).alias("start"),
        at(number(get(4), "end", line), number(get(3), "end", line), number(get(2), "end", line)).alias("end"),
        at(F.array().cast("array<string>"), F.slice("p", 5, 1 << 20), F.slice("p", 4, 1 << 20)).alias("values"),
        F.when(F.col("layout") == "gff3", get(5).try_cast("double")).alias("score"),
        F.when(F.col("layout") == "gff3", F.when(get(8).rlike(r"(^|;)ID="), name).otherwise("NA")).alias("name"),
        (F.col("layout") == "gff3").alias("is_gff3"),
    )
    seen = out.agg(F.max("is_gff3").alias("g"), F.max(F.size("values")).alias("w")).first()
    head = raw.filter((F.col("value").startswith("#") & ~F.col("value").startswith("#" * 2)) | F.col("value").startswith("bin\t")).orderBy("line_no").limit(1).collect()
    width = 1 if seen.g else (seen.w or 0)
    names = ["value"] if width <= 1 else [f"value{i}" for i in range(1, width + 1)]
    if head and not seen.g:
        cols = head[0].value.lstrip("#").split("\t")
        given = cols[4:] if cols[0] == "bin" else cols[3:]
        names = given or names
    return out.drop("is_gff3"), names, bool(seen.g)


def parse_gene_model(raw: DataFrame) -> DataFrame:
    """Transcripts of gene-model lines: ord, tx_id, gene, chrom, strand, tx_start, tx_end, cds_start, cds_end, exons (array of s, e)."""
    line = F.col("line_no")
    rows = _content(raw).withColumn("p0", F.split("value", "\t"))
    rows = rows.withColumn("p", F.when(F.get("p0", F.lit(0)).rlike(r"^[0-9]+$") & F.get("p0", F.lit(3)).isin("+", "-"), F.slice("p0", 2, 1 << 20)).otherwise(F.col("p0")))
    get = lambda i: F.get("p", F.lit(i))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    exons = F.transform(F.arrays_zip(numbers(get(8)).alias("s"), numbers(get(9)).alias("e")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    out = rows.select(
        line.alias("ord"), get(0).alias("tx_id"), F.coalesce(get(11), get(0)).alias("gene"), A.chrom(get(1)).alias("chrom"), get(2).alias("strand"),
        *[number(get(i), n, line).alias(n) for i, n in ((3, "tx_start"), (4, "tx_end"), (5, "cds_start"), (6, "cds_end"), (7, "exon_count"))], exons.alias("exons"),
    )
    sorted_apart = F.forall(F.sequence(F.lit(0), F.size("exons") - 1), lambda i: (i == 0) | (F.get("exons", i)["s"] >= F.get("exons", i - 1)["e"]))
    inside = F.forall("exons", lambda x: x["s"].isNotNull() & x["e"].isNotNull() & (x["s"] < x["e"]) & (x["s"] >= F.col("tx_start")) & (x["e"] <= F.col("tx_end")))
    ok = (F.col("exon_count") == F.size("exons")) & F.col("strand").isin("+", "-") & (F.col("tx_start") < F.col("tx_end")) & (F.col("cds_start") >= F.col("tx_start")) & (F.col("cds_end") <= F.col("tx_end")) & (F.col("cds_start") <= F.col("cds_end")) & (F.size("exons") > 0)
    checked = F.when(F.coalesce(ok, F.lit(False)), F.coalesce(inside & sorted_apart, F.lit(False))).otherwise(F.lit(False))
    return out.withColumn("tx_id", F.when(checked, F.col("tx_id")).otherwise(fail("invalid transcript", F.col("ord")))).drop("exon_count")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of FASTA records: the first word of each header and its upper-case letters; of repeated ids the last one holds."""
    from pyspark.sql import Window

    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace(F.regexp_replace("value", "^>", ""), r"\r", "")
    rows = raw.filter(F.trim("value") != "").select("ord", F.regexp_extract(body, r"^(\S+)", 1).alias("id"), F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s+", "")).alias("seq"))
    last = Window.partitionBy("id").orderBy(F.desc("ord"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("id", "seq")


def resolve(folder: str, build: str, protocol: str, exists) -> tuple[str, str | None]:
    """Paths of a protocol's table and transcript sequences in a database folder."""
    base = f"{folder}/{build}_{protocol}"
    table = next((p for p in (f"{base}.txt", f"{base}.txt.gz") if exists(p)), None)
    if table is None:
        raise FileNotFoundError(f"no table for protocol {protocol} and build {build}")
    mrna = f"{base}Mrna.fa"
    return table, mrna if exists(mrna) else None
