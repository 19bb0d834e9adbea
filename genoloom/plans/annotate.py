"""The annotation pipeline: variants joined with each protocol's table in turn, columns named and ordered as requested."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.alleles import avinput_fields
from genoloom.functions.strings import info_escape, info_id
from genoloom.operators import filters, gene, regions, scores

#: Operations and the names that ask for them.
OPERATIONS = {"f": "filter", "filter": "filter", "r": "region", "region": "region", "g": "gene", "gene": "gene", "gx": "gene", "cadd": "cadd", "c": "cadd"}
CORE = ("Chr", "Start", "End", "Ref", "Alt")


@dataclass
class Protocol:
    """A named annotation: its operation and the tables that it reads."""

    name: str
    operation: str
    table: DataFrame
    names: list[str] = field(default_factory=list)
    gff3: bool = False
    min_overlap: float = 0.0
    shift: int | None = None

    def __post_init__(self):
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation}")
        self.operation = OPERATIONS[self.operation]

    def headers(self) -> list[str]:
        if self.operation == "gene":
            return [f"{h}.{self.name}" for h in ("Func", "Gene", "GeneDetail", "ExonicFunc", "AAChange")]
        if self.operation == "cadd":
            return [f"{h}.{self.name}" for h in ("CADD_raw", "CADD_phred", "CADD_status")]
        names = ["value"] if self.gff3 or not self.names else self.names
        return [self.name if n == "value" else f"{n}.{self.name}" for n in names]


@dataclass
class Annotated:
    """A result: rows with safe internal names, the headers they get, and the protocols' column ranges.

    rows is a plan that runs when it is written; gene protocols have written the best hits of each variant to the shared folder by then, and
    interval protocols have looked at the lengths and levels of their regions.
    """

    rows: DataFrame
    columns: list[str]
    headers: list[str]
    ranges: list[tuple[Protocol, list[str]]]

    def table(self) -> DataFrame:
        """The result in input order with its public headers."""
        return self.rows.orderBy("row_id").select(*self.columns).toDF(*self.headers)


def bind(protocols: list[str], operations: list[str]) -> list[tuple[str, str]]:
    """Pairs of protocol and operation."""
    if len(protocols) != len(operations):
        raise ValueError("protocol and operation counts differ")
    return list(zip(protocols, operations))


def check_headers(headers: list[str], protocols: list[Protocol]) -> None:
    if len(set(headers)) != len(headers):
        raise ValueError("duplicate output columns")
    ids = [info_id(p.name) for p in protocols]
    if len(set(ids)) != len(ids) or "STATUS" in ids:
        raise ValueError("protocol names collide as INFO identifiers")


def status(rows: DataFrame, gene_columns: list[str]) -> Column:
    """ok, unsupported_alt (a VCF alternate that isn't a sequence) or coding_unknown (a gene protocol doesn't know the consequence)."""
    unsupported = ~F.col("supported") if "supported" in rows.columns else F.lit(False)
    unknown = F.lit(False)
    for c in gene_columns:
        unknown = unknown | F.array_contains(F.split(c, ","), "unknown")
    return F.when(unsupported, "unsupported_alt").when(unknown, "coding_unknown").otherwise("ok")


def annotate(variants: DataFrame, protocols: list[Protocol], missing: str = ".", with_status: bool = True, unsupported: str = "preserve", cadd_require_all: bool = False) -> Annotated:
    """One row per variant, in the order of row_id, with every protocol's columns.

    Each protocol is one left join against a side with at most a row per key, so rows never multiply. Unsupported alternates keep their row, their
    columns other than scores being missing; with unsupported=error they fail the query, as does an unscored SNV with cadd_require_all.
    """
    if cadd_require_all and not any(p.operation == "cadd" for p in protocols):
        raise ValueError("cadd_require_all needs a cadd protocol")
    rows, ranges, headers = variants, [], []
    for i, p in enumerate(protocols):
        k = f"p{i}_"
        if p.operation == "filter":
            rows = filters.filter_join(rows, p.table, p.names, k, missing)
        elif p.operation == "region":
            rows = regions.region_join(rows, p.table, p.names, p.gff3, k, missing, p.min_overlap, p.shift)
        elif p.operation == "gene":
            rows = gene.gene_join(rows, p.table, k, shift=p.shift)
        else:
            rows = scores.score_join(rows, p.table, k, missing, variants)
        ranges.append((p, [c for c in rows.columns if c.startswith(k)]))
        headers += p.headers()
    check_headers([*CORE, *headers, "AnnotationStatus"], protocols)
    state = status(rows, [f"p{i}__exonic" for i, p in enumerate(protocols) if p.operation == "gene"])
    if unsupported == "error":
        state = F.when(state == "unsupported_alt", F.raise_error(F.concat(F.lit("unsupported alternate allele in row "), F.col("row_id").cast("string")))).otherwise(state)
    rows = rows.withColumn("AnnotationStatus", state)
    for p, cols in ranges:
        for c in cols:
            if p.operation != "cadd":
                rows = rows.withColumn(c, F.when(F.col("AnnotationStatus") == "unsupported_alt", F.lit(missing)).otherwise(F.col(c)))
        if p.operation == "cadd" and cadd_require_all:
            from genoloom.functions.alleles import snv_shape

            bad = snv_shape(*[F.col(c) for c in ("start", "end", "ref", "alt")]) & (F.col(cols[2]) != "scored")
            rows = rows.withColumn(cols[2], F.when(bad, F.raise_error(F.concat(F.lit(f"{p.name}: unscored SNV in row "), F.col("row_id").cast("string")))).otherwise(F.col(cols[2])))
    rows = rows.withColumns({n: c for n, c in zip(CORE, avinput_fields(F.col("output_chrom") if "output_chrom" in variants.columns else F.col("chrom"), F.col("start"), F.col("end"), F.col("ref"), F.col("alt")))})
    columns = [*CORE, *[c for _, cols in ranges for c in cols]]
    out_headers = [*CORE, *headers]
    if with_status:
        columns.append("AnnotationStatus")
        out_headers.append("AnnotationStatus")
    if "extra" in variants.columns:
        width = variants.agg(F.max(F.size("extra"))).first()[0] or 0
        for i in range(width):
            rows = rows.withColumn(f"Otherinfo{i + 1}", F.coalesce(F.get("extra", F.lit(i)), F.lit(missing)))
            columns.append(f"Otherinfo{i + 1}")
            out_headers.append(f"Otherinfo{i + 1}")
    return Annotated(rows, columns, out_headers, ranges)


def vcf_info(result: Annotated) -> DataFrame:
    """(record, fields, info): the INFO text of each VCF record with a value per alternate allele for every protocol, and the statuses."""
    per = []
    for i, (p, cols) in enumerate(result.ranges):
        per.append(F.concat_ws("|", *[info_escape(F.col(c)) for c in cols]).alias(f"t{i}"))
    rows = result.rows.select("record", "allele_index", "fields", F.col("AnnotationStatus").alias("st"), *per)
    n = len(result.ranges)
    packed = rows.groupBy("record").agg(F.first("fields").alias("fields"), F.array_sort(F.collect_list(F.struct("allele_index", "st", *[f"t{i}" for i in range(n)]))).alias("x"))
    joined = lambda k: F.array_join(F.transform("x", lambda r: r[k]), ",")
    added = [F.concat(F.lit(f"FA_{info_id(p.name)}="), joined(f"t{i}")) for i, (p, _) in enumerate(result.ranges)]
    text = F.concat_ws(";", *added, F.concat(F.lit("FA_STATUS="), joined("st")))
    old = F.get("fields", F.lit(7))
    return packed.select("record", "fields", F.when(old == ".", text).otherwise(F.concat(old, F.lit(";"), text)).alias("info"))


def vcf_lines(result: Annotated) -> DataFrame:
    """(record, value): VCF record lines with their new INFO."""
    r = vcf_info(result)
    return r.select("record", F.concat_ws("\t", F.transform("fields", lambda f, i: F.when(i == 7, F.col("info")).otherwise(f))).alias("value"))


def report(result: Annotated) -> dict:
    """Counters of a run from one aggregate."""
    cadd = [(p.name, cols[2]) for p, cols in result.ranges if p.operation == "cadd"]
    record = F.col("record") if "record" in result.rows.columns else F.col("row_id")
    states = [F.count(F.when(F.col(c) == s, 1)).alias(f"{name}|{s}") for name, c in cadd for s in scores.STATES]
    got = result.rows.agg(F.countDistinct(record).alias("records"), F.count("*").alias("alleles"), F.count(F.when(F.col("AnnotationStatus") == "unsupported_alt", 1)).alias("unsupported"), *states).first().asDict()
    out = {k: got[k] for k in ("records", "alleles", "unsupported")}
    out["cadd_counts"] = {name: {s: got[f"{name}|{s}"] for s in scores.STATES if got[f"{name}|{s}"]} for name, _ in cadd}
    return out


def coding_change(variants: DataFrame, transcripts: DataFrame) -> Annotated:
    """Gene annotation alone."""
    return annotate(variants, [Protocol("annotation", "gene", transcripts)])


def open_protocol(spark: SparkSession, name: str, operation: str, path: str, mrna: str | None = None, build: str | None = None, reference: DataFrame | None = None) -> Protocol:
    """A protocol from its files. build: what a score file must be for. reference: the chunks that the variants are left-aligned against, if they are.

    A filter table is read from its index, ``<path>.index``, if there is one; left-aligned variants need one that was left-aligned against the same reference.
    """
    from genoloom.plans import index
    from genoloom.sources import readers
    from genoloom.sources.cadd import open_scores

    kind = OPERATIONS.get(operation)
    if kind == "cadd":
        return Protocol(name, operation, open_scores(spark, path, build)[0])
    if kind == "filter" and index.is_index(f"{path}.index"):
        table, names = index.open_index(spark, f"{path}.index", "none" if reference is None else "left-align", reference=reference)
        return Protocol(name, operation, table, names)
    if kind == "filter" and reference is not None:
        raise ValueError(f"{name}: left-aligned variants need a left-aligned index of the filter table")
    raw = readers.lines(spark, path)
    if kind == "filter":
        table, names = readers.parse_filter_db(raw)
        return Protocol(name, operation, table, names)
    if kind == "region":
        table, names, gff3 = readers.parse_regions(raw)
        return Protocol(name, operation, table, names, gff3)
    if kind == "gene":
        return Protocol(name, operation, gene.prepare(readers.parse_gene_model(raw), readers.read_fasta(spark, mrna) if mrna else None))
    raise ValueError(f"unknown operation {operation}")


def strict_filter(spark: SparkSession, variants: str, database: str) -> Annotated:
    """The strict exact filter of a five-column variant file against one table: see readers.parse_strict_avinput() and sinks.write_strict()."""
    from genoloom.sources import readers

    rows = readers.parse_strict_avinput(readers.lines(spark, variants))
    table, names = readers.parse_filter_db(readers.lines(spark, database), strict=True)
    out = annotate(rows, [Protocol("strict", "f", table, names)], with_status=False)
    given = {c: F.get("original", F.lit(i)) for i, c in enumerate(CORE)}
    out.rows = out.rows.withColumns(given)
    return out
