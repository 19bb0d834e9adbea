"""Registered queries that go through files: tables are written as text to the shared folder and read, annotated and published from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom import sinks
from genoloom.functions import alleles as A
from genoloom.operators import compare, gene, left_align
from genoloom.plans import annotate as plan
from genoloom.plans import demo, index
from genoloom.plans.queries import SHIFT, _VCF, _tx, query
from genoloom.sources import blocks, cadd, readers, reference
from genoloom.storage import file_system, publish_lines, qualified, scratch_folder
from genoloom.streaming.intake import annotate_stream

_TEXT = "CASE WHEN {0}='' THEN '-' ELSE {0} END"
_START = "CASE WHEN s=e THEN s ELSE s+1 END"
_FIVE = f"chrom||chr(9)||({_START})||chr(9)||e||chr(9)||({_TEXT.format('ref')})||chr(9)||({_TEXT.format('alt')})"


def _file(spark: SparkSession, rows: DataFrame, header: list[str] = [], name: str = "table.txt") -> str:  # noqa: B006
    """The path of a text file with a header and the rows (ord, value) in order."""
    path = f"{scratch_folder(spark, 'files')}/{name}"
    publish_lines(rows, path, header, "ord")
    return path


def _five(v: DataFrame) -> list:
    return A.avinput_fields(*[F.col(c) for c in ("chrom", "start", "end", "ref", "alt")])


def _tabbed(order: str, *cells):
    return F.col(order).alias("ord"), F.concat_ws("\t", *cells).alias("value")


def _variant_file(spark, sf, name="in.avinput", *more) -> str:
    v = demo.variants(spark, sf)
    return _file(spark, v.select(*_tabbed("row_id", *_five(v), *more)), ["# variants"], name)


def _filter_file(spark, sf, header="#Chr\tStart\tEnd\tRef\tAlt\tvalue") -> str:
    f = demo.filter_db(spark, sf)
    return _file(spark, f.select(*_tabbed("ord", *_five(f), F.get("values", F.lit(0)))), ["## a table", header])


def _vcf_file(spark, sf) -> str:
    return _file(spark, demo.vcf_lines(spark, sf).withColumnRenamed("line_no", "ord"), _HEAD, "in.vcf")


_HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]


# readers


@query(demo.sql("f", select="SELECT row_number() OVER (ORDER BY ord)+2 AS line_no, chrom, s AS vstart, e AS vend, ref, alt, v AS value FROM f"))
def read_filter_table(spark, sf):
    t, names = readers.parse_filter_db(readers.lines(spark, _filter_file(spark, sf)))
    return t.select(F.col("ord").alias("line_no"), "chrom", F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt", F.get("values", F.lit(names.index("value"))).alias("value"))


@query("SELECT row_id, 'chr'||chrom AS given, s AS vstart, e AS vend, ref, alt, array_to_string(CASE row_id%3 WHEN 0 THEN ['a b'] WHEN 1 THEN ['a b','', 'c'] ELSE [] END, '|') AS extra FROM (" + demo.sql("v", select="SELECT row_number() OVER (ORDER BY row_id) AS row_id, chrom, s, e, ref, alt, row_id AS k FROM v") + ")")
def read_variant_table(spark, sf):
    from pyspark.sql import Window

    v = demo.variants(spark, sf).withColumn("ord", F.row_number().over(Window.orderBy("row_id")))  # the test's own numbering of its small table
    extra = F.when(F.col("ord") % 3 == 0, "\ta b").when(F.col("ord") % 3 == 1, "\ta b\t\tc").otherwise("")
    path = _file(spark, v.select("ord", F.concat(F.lit("chr"), F.concat_ws(" ", *_five(v)), extra).alias("value")), ["#x"], "in.avinput")
    got = readers.read_avinput(spark, path)
    return got.select("row_id", F.col("output_chrom").alias("given"), F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt", F.array_join("extra", "|").alias("extra"))


@query(demo.sql("r", select="SELECT chrom, s AS rstart, e AS rend, v AS value FROM r").replace(",\nrp AS", ",\nv AS (SELECT 1 AS row_id, '' AS chrom, 0 AS s, 0 AS e), rp AS"))
def read_regions_bed(spark, sf):
    r = demo.regions(spark, sf)
    path = _file(spark, r.select(*_tabbed("ord", F.concat(F.lit("chr"), "chrom"), "start", "end", F.concat(F.lit("n"), F.get("values", F.lit(0))))), ["#chrom\tstart\tend\tname"])
    t, names, gff3 = readers.parse_regions(readers.lines(spark, path))
    assert names == ["name"] and not gff3
    return t.select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"), F.substr(F.get("values", F.lit(0)), F.lit(2)).alias("value"))


@query("SELECT CAST(p_partkey%5+1 AS VARCHAR) AS chrom, p_partkey*50+1 AS rstart, p_partkey*50+p_size+1 AS rend, CASE WHEN p_partkey%3=0 THEN '.' ELSE CAST(p_size%5 AS VARCHAR) END AS score, CASE WHEN p_partkey%2=0 THEN p_brand ELSE 'NA' END AS name FROM part")
def read_regions_gff3(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    about = F.when(p % 2 == 0, F.concat(F.lit("x=1;ID="), "p_brand")).otherwise("x=ID")
    rows = demo.read(spark, sf, "part").select(p.alias("ord"), F.concat_ws("\t", (p % 5 + 1).cast("string"), F.lit("s"), F.lit("k"), p * 50 + 2, p * 50 + size + 1, F.when(p % 3 == 0, ".").otherwise((size % 5).cast("string")), F.lit("+"), F.lit("."), about).alias("value"))
    t, _, gff3 = readers.parse_regions(readers.lines(spark, _file(spark, rows, ["##gff-version 3"])))
    assert gff3
    return t.select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"), F.coalesce(F.col("score").cast("long").cast("string"), F.lit(".")).alias("score"), "name")


@query("WITH " + demo._T.split(",\ntx AS")[0] + " SELECT tx_id, gene, chrom, strand, t AS tx_start, te AS tx_end, cs AS cds_start, ce AS cds_end, t||'-'||(t+150)||','||(t+250)||'-'||(t+400)||','||(t+450)||'-'||(t+600) AS exons FROM t1")
def read_gene_model(spark, sf):
    t = demo.transcripts(spark, sf)
    ends = lambda k: F.concat(F.array_join(F.transform("exons", lambda x: x[k].cast("string")), ","), F.lit(","))
    cells = [F.lit("585"), "tx_id", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", F.size("exons"), ends("s"), ends("e"), F.lit("0"), "gene"]
    got = readers.parse_gene_model(readers.lines(spark, _file(spark, t.select(*_tabbed("ord", *cells)))))
    return got.select("tx_id", "gene", "chrom", "strand", "tx_start", "tx_end", "cds_start", "cds_end", F.array_join(F.transform("exons", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",").alias("exons"))


@query("WITH " + demo._T.split(",\ntx AS")[0] + ", g AS (SELECT *, list_aggregate(list_transform([0,1,2,5,6,7,9,10,11], lambda j: repeat(substr('ACGT',CAST((ord+j)%4+1 AS INT),1),50)),'string_agg','') AS g FROM t1) SELECT tx_id AS id, CASE WHEN strand='+' THEN g ELSE reverse(translate(g,'ACGT','TGCA')) END AS seq FROM g")
def read_transcript_fasta(spark, sf):
    s = demo.sequences(spark, sf).withColumn("ord", F.col("id"))
    return readers.read_fasta(spark, _file(spark, s.select("ord", F.concat(F.lit(">"), "id", F.lit(" note\n"), F.lower(F.substr("seq", F.lit(1), F.lit(60))), F.lit("\n"), F.substr("seq", F.lit(61))).alias("value")), name="x.fa"))


_GENOME = "SELECT CAST(p_partkey//10 AS BIGINT) AS chunk, '1' AS chrom, string_agg(repeat(substr('ACGT',CAST(p_partkey%4+1 AS INT),1),50), '' ORDER BY p_partkey) AS seq, any_value(n) AS length FROM part, (SELECT count(*)*50 AS n FROM part) GROUP BY p_partkey//10"


@query(_GENOME)
def read_genome_fasta(spark, sf):
    rows = demo.genome(spark, sf).select(F.col("chunk").alias("ord"), F.col("seq").alias("value"))
    return reference.read_genome(spark, _file(spark, rows, [">chr1 made"], "g.fa"), 500).select("chunk", "chrom", "seq", "length")


@query(_GENOME)
def read_genome_index(spark, sf):
    g = demo.genome(spark, sf)
    path = _file(spark, g.select(F.col("chunk").alias("ord"), F.col("seq").alias("value")), [">chr1 made"], "g.fa")
    publish_lines(g.agg(F.concat_ws("\t", F.lit("chr1"), F.sum(F.length("seq")), F.lit(11), F.lit(500), F.lit(501)).alias("value"), F.lit(0).alias("ord")), f"{path}.fai", [], "ord")
    return reference.read_genome(spark, path, 500).select("chunk", "chrom", "seq", "length")


_NATIVE = ["##CADD GRCh38-v1.7 (c) none", cadd.HEADER]


def _score_file(spark, sf, header=None) -> str:
    c = demo.scores(spark, sf)
    return _file(spark, c.select(F.struct("chrom", "pos", "ref", "alt").alias("ord"), F.concat_ws("\t", "chrom", "pos", "ref", "alt", "raw", "phred").alias("value")), header or _NATIVE, "scores.tsv")


_SCORES = demo.sql("c", select="").split(",\ncj AS")[0]


@query(_SCORES + " SELECT chrom, pos, ref, alt, raw, phred, 'hg38' AS build, '1.7' AS version FROM c")
def read_native_scores(spark, sf):
    t, build, version = cadd.read_scores(spark, _score_file(spark, sf), "hg38")
    return t.select("chrom", "pos", "ref", "alt", "raw", "phred", F.lit(build).alias("build"), F.lit(version).alias("version"))


@query(_SCORES + " SELECT chrom, pos, ref, alt, raw, phred FROM c")
def read_blocked_scores(spark, sf):
    plain = _score_file(spark, sf)
    source, (fs, p) = blocks.FileRanges(qualified(spark, plain)), file_system(spark, f"{plain}.gz")
    out = fs.create(p, True)
    for a in range(0, source.size + 1, 60_000):  # the made file, block by block; the last one may be empty
        out.write(bytearray(blocks.block(source.read(a, a + 60_000))))
    out.close()
    return cadd.read_scores(spark, f"{plain}.gz", "hg38")[0].select("chrom", "pos", "ref", "alt", "raw", "phred")


@query(_SCORES + " SELECT chrom, pos, ref, alt, raw, phred FROM c")
def score_store(spark, sf):
    path = scratch_folder(spark, "scores")
    cadd.store_scores(spark, _score_file(spark, sf), path)
    return cadd.open_scores(spark, path, "hg38")[0].select("chrom", "pos", "ref", "alt", "raw", "phred")


@query(_SCORES + " SELECT chrom, pos-1 AS vstart, pos AS vend, ref, alt, raw||'|'||phred AS vals FROM c")
def import_scores(spark, sf):
    t = cadd.import_table(spark, _score_file(spark, sf, ["#" + cadd.HEADER.lstrip("#")]))
    return t.select("chrom", F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt", F.array_join("values", "|").alias("vals"))


@query("SELECT unnest(['##fileformat=VCFv4.2', '#CHROM'||chr(9)||'POS'||chr(9)||'ID'||chr(9)||'REF'||chr(9)||'ALT'||chr(9)||'QUAL'||chr(9)||'FILTER'||chr(9)||'INFO']) AS header")
def vcf_header_lines(spark, sf):
    return spark.createDataFrame([(h,) for h in readers.vcf_headers(readers.lines(spark, _vcf_file(spark, sf)))], "header string")


@query("SELECT unnest(['part', 'ref']) AS protocol, unnest(['hg38_part.txt', 'hg38_ref.txt.gz']) AS file, unnest([NULL, 'hg38_refMrna.fa']) AS sequences")
def resolve_protocols(spark, sf):
    there = {"db/hg38_part.txt", "db/hg38_ref.txt.gz", "db/hg38_refMrna.fa", "db/hg19_part.txt"}
    found = [(p, *readers.resolve("db", "hg38", p, there.__contains__)) for p in ("part", "ref")]
    return spark.createDataFrame([(p, t.removeprefix("db/"), m and m.removeprefix("db/")) for p, t, m in found], "protocol string, file string, sequences string")


# sinks


@query(demo.sql("v", "f", select=f"""SELECT 1 AS line_no, 'Chr'||chr(9)||'Start'||chr(9)||'End'||chr(9)||'Ref'||chr(9)||'Alt'||chr(9)||'part'||chr(9)||'AnnotationStatus' AS value
UNION ALL SELECT 1+row_number() OVER (ORDER BY row_id), {_FIVE.replace('chrom', 'v.chrom').replace('s=e', 'v.s=v.e').replace('THEN s ', 'THEN v.s ').replace('ELSE s+1', 'ELSE v.s+1').replace('||e||', '||v.e||').replace("ref", "v.ref").replace("alt", "v.alt")}||chr(9)||coalesce(fa.v,'.')||chr(9)||'ok'
FROM v LEFT JOIN fa ON v.chrom=fa.chrom AND v.s=fa.s AND v.e=fa.e AND v.ref=fa.ref AND v.alt=fa.alt"""))
def write_table_lines(spark, sf):
    out = f"{scratch_folder(spark, 'out')}/o.tsv"
    sinks.write_table(plan.annotate(demo.variants(spark, sf), [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])]), out)
    return readers.lines(spark, out)


@query(demo.sql("v", "f", select="SELECT 1 AS line_no, 'Chr'||chr(9)||'Start'||chr(9)||'End'||chr(9)||'Ref'||chr(9)||'Alt'||chr(9)||'value' AS value UNION ALL SELECT 1+row_number() OVER (ORDER BY row_id), w.five||chr(9)||coalesce(fa.v,'.') FROM (SELECT *, " + _FIVE + " AS five FROM v) w LEFT JOIN fa USING (chrom, s, e, ref, alt)"))
def strict_filter_lines(spark, sf):
    out = f"{scratch_folder(spark, 'out')}/o.tsv"
    sinks.write_strict(plan.strict_filter(spark, _variant_file(spark, sf), _filter_file(spark, sf)), out)
    return readers.lines(spark, out)


@query(demo.sql("v", select=f"SELECT row_number() OVER (ORDER BY row_id) AS line_no, {_FIVE} AS value FROM v"))
def write_avinput_lines(spark, sf):
    out = f"{scratch_folder(spark, 'out')}/o.avinput"
    sinks.write_avinput(demo.variants(spark, sf).withColumn("output_chrom", F.col("chrom")), out)
    return readers.lines(spark, out)


@query(_VCF + f"SELECT row_number() OVER (ORDER BY k, allele_index) AS line_no, {_FIVE} AS value FROM (SELECT *, CAST(p%5+1 AS VARCHAR) AS chrom FROM a)")
def convert_vcf(spark, sf):
    out = f"{scratch_folder(spark, 'out')}/o.avinput"
    sinks.write_avinput(readers.read_vcf(spark, _vcf_file(spark, sf)), out)
    return readers.lines(spark, out)


@query(demo.sql("v", select="SELECT row_id, '>variant_'||(row_id+1)||' 1:'||(s+1)||'-'||e||chr(10)||CASE WHEN s=e THEN '' ELSE repeat(substr('ACGT',CAST((s//50)%4+1 AS INT),1),CAST(e-s AS INT)) END AS record FROM v"))
def fasta_records(spark, sf):
    return reference.fasta_records(demo.variants(spark, sf).withColumn("chrom", F.lit("1")), demo.genome(spark, sf), 500).select("row_id", "record")


@query(_VCF + "SELECT 'records' AS counter, count(DISTINCT k) AS n FROM a UNION ALL SELECT 'alleles', count(*) FROM a UNION ALL SELECT 'unsupported', count(*) FROM a WHERE NOT ok")
def run_report(spark, sf):
    r = plan.annotate(readers.read_vcf(spark, _vcf_file(spark, sf)).drop("extra"), [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])])
    got = plan.report(r)
    return spark.createDataFrame([(k, got[k]) for k in ("records", "alleles", "unsupported")], "counter string, n long")


@query(demo.sql("f", select="").rstrip() + ", " + _VCF.removeprefix("WITH ").rstrip() + """,
lines AS (SELECT k, any_value(p) AS p, string_agg(CASE WHEN ok THEN replace(replace(coalesce(x.v,'.'),';','%3B'),' ','%20') ELSE '.' END, ',' ORDER BY allele_index) AS t, string_agg(CASE WHEN ok THEN 'ok' ELSE 'unsupported_alt' END, ',' ORDER BY allele_index) AS st
FROM a LEFT JOIN fa x ON x.chrom=CAST(a.p%5+1 AS VARCHAR) AND x.s=a.s AND x.e=a.e AND x.ref=a.ref AND x.alt=a.alt GROUP BY k)
SELECT 4+row_number() OVER (ORDER BY k) AS line_no, 'chr'||(p%5+1) AS chrom, CAST(p*50+1 AS VARCHAR) AS position, (CASE WHEN k%2=0 THEN 'DP=1;' ELSE '' END)||'FA_part='||t||';FA_STATUS='||st AS info FROM lines""")
def write_vcf_lines(spark, sf):
    path, out = _vcf_file(spark, sf), f"{scratch_folder(spark, 'out')}/o.vcf"
    r = plan.annotate(readers.read_vcf(spark, path).drop("extra"), [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])])
    sinks.write_vcf(r, readers.vcf_headers(readers.lines(spark, path)), out)
    cell = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    return readers.lines(spark, out).filter(~F.col("value").startswith("#")).select("line_no", cell(0).alias("chrom"), cell(1).alias("position"), cell(7).alias("info"))


# indexes, streams, normalization


@query(demo.sql("f", select="SELECT count(*) AS records, count(DISTINCT chrom) AS contigs, 'none' AS normalization FROM f"))
def index_manifest(spark, sf):
    import tempfile

    source = f"{tempfile.mkdtemp()}/t.txt"  # an index's manifest and source are files of the driver
    f = demo.filter_db(spark, sf)
    publish_lines(f.select(*_tabbed("ord", *_five(f), F.get("values", F.lit(0)))), f"file://{source}", ["#Chr\tStart\tEnd\tRef\tAlt\tvalue"], "ord")
    index.build_from_file(spark, source, f"{source}.index")
    rows, _ = index.open_index(spark, f"{source}.index", full=True)
    s = index.statistics(rows)
    return spark.createDataFrame([(s["records"], s["contigs"], "none")], "records long, contigs long, normalization string")


@query(demo.sql("v", "f", select="SELECT five, coalesce(fa.v,'.') AS value FROM (SELECT *, " + _FIVE + " AS five FROM v) w LEFT JOIN fa USING (chrom, s, e, ref, alt)"))
def stream_intake(spark, sf):
    where = scratch_folder(spark, "stream")
    v = demo.variants(spark, sf)
    v.repartition(4).select(F.concat_ws("\t", *_five(v)).alias("value")).write.text(f"{where}/in")
    p = [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])]
    annotate_stream(spark, f"{where}/in", p, lambda r, n: r.rows.select(F.concat_ws("\t", *plan.CORE).alias("five"), F.col("p0_0").alias("value")).write.mode("overwrite").parquet(f"{where}/out/batch={n}"), f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/out").select("five", "value")


@query("WITH m AS (SELECT max(p_partkey)+1 AS m FROM part), o AS (SELECT o_orderkey AS k, (o_orderkey*7)%m AS p FROM orders, m) SELECT k+2 AS record, p*50 AS vstart, p*50+2 AS vend, repeat(substr('ACGT',CAST(p%4+1 AS INT),1),2) AS ref, '' AS alt FROM o")
def vcf_left_aligned(spark, sf):
    """Deletions of two bases, written inside runs of 50 equal ones, move to the start of their run; reference alleles are checked."""
    m = demo.read(spark, sf, "part").agg((F.max("p_partkey") + 1).alias("m"))
    p, b = F.col("p"), demo.base(F.col("p"))
    o = demo.read(spark, sf, "orders").crossJoin(F.broadcast(m)).select((F.col("o_orderkey") + 2).alias("line_no"), ((F.col("o_orderkey") * 7) % F.col("m")).alias("p"), (F.col("o_orderkey") % 40).alias("k"))  # one row
    lines = o.select("line_no", F.concat_ws("\t", F.lit("chr1"), (p * 50 + F.col("k") + 1).cast("string"), F.lit("."), F.repeat(b, F.lit(3)), b, F.lit("."), F.lit("."), F.lit(".")).alias("value"))
    got = left_align.normalize(readers.parse_vcf(lines), demo.genome(spark, sf), 500)
    return got.select("record", F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt")


# transcripts

_EDGES = """,
d0 AS (SELECT h.*, list_sort([{'d': abs(s-a1), 'k': 0, 'g': a1, 'c': 0, 'i': 0}, {'d': abs(s-z1+1), 'k': 1, 'g': z1-1, 'c': 149, 'i': 0}, {'d': abs(s-a2), 'k': 2, 'g': a2, 'c': 150, 'i': 1},
  {'d': abs(s-z2+1), 'k': 3, 'g': z2-1, 'c': 299, 'i': 1}, {'d': abs(s-a3), 'k': 4, 'g': a3, 'c': 300, 'i': 2}, {'d': abs(s-z3+1), 'k': 5, 'g': z3-1, 'c': 449, 'i': 2}])[1] AS x,
  CASE WHEN strand='+' THEN 60 ELSE 69 END AS lo, CASE WHEN strand='+' THEN 381 ELSE 390 END AS hi,
  CASE WHEN strand='+' THEN ref ELSE translate(ref,'ACGT','TGCA') END AS r, CASE WHEN strand='+' THEN alt ELSE translate(alt,'ACGT','TGCA') END AS a FROM h),
d1 AS (SELECT *, CASE WHEN strand='+' THEN x.c ELSE 449-x.c END AS cat, tx_id||':exon'||(CASE WHEN strand='+' THEN x.i+1 ELSE 3-x.i END)||':' AS head,
  CASE WHEN strand='+' THEN CASE ex WHEN 1 THEN s-a1 WHEN 2 THEN 150+s-a2 ELSE 300+s-a3 END ELSE 449-CASE ex WHEN 1 THEN s-a1 WHEN 2 THEN 150+s-a2 ELSE 300+s-a3 END END AS ut,
  length(ref)=1 AND length(alt)=1 AND cs<ce AS told FROM d0)"""


@query(demo.sql("v", "t", select="").rstrip() + _EDGES + " SELECT row_id, tx_id, fn AS function, CASE WHEN NOT told THEN tx_id WHEN cat<lo THEN head||'UTR5' WHEN cat>=hi THEN head||'UTR3' ELSE head||'c.'||(cat-lo+1)||(CASE WHEN (s>x.g)=(strand='+') THEN '+' ELSE '-' END)||x.d||r||'>'||a END AS detail FROM d1 WHERE fn IN ('splicing','ncRNA_splicing')")
def gene_splice(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf), t, shift=SHIFT).filter(F.col("function").isin("splicing", "ncRNA_splicing"))
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "function", "detail")


@query(demo.sql("v", "t", select="").rstrip() + _EDGES + " SELECT row_id, tx_id, fn AS function, CASE WHEN NOT told THEN tx_id WHEN ut<lo THEN tx_id||':c.-'||(lo-ut)||r||'>'||a ELSE tx_id||':c.*'||(ut+1-hi)||r||'>'||a END AS detail FROM d1 WHERE fn IN ('UTR5','UTR3')")
def gene_utr(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf), t, shift=SHIFT).filter(F.col("function").isin("UTR5", "UTR3"))
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "function", "detail")


@query(demo.sql("v", "t", select="").rstrip() + """,
i0 AS (SELECT *, CASE WHEN strand='+' THEN s WHEN s=e THEN s-1 ELSE e-1 END AS anchor, s>=(CASE ex WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END) AND e<=(CASE ex WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END) AND s>=cs AND e<=ce AND NOT (s=e AND (s IN (a1,a2,a3,cs) OR e IN (z1,z2,z3,ce))) AS inside FROM h WHERE fn='exonic' AND NOT (length(ref)=1 AND length(alt)=1)),
i1 AS (SELECT *, CASE ex WHEN 1 THEN anchor-a1 WHEN 2 THEN 150+anchor-a2 ELSE 300+anchor-a3 END AS gp FROM i0),
i2 AS (SELECT *, CASE WHEN strand='+' THEN gp-60 ELSE 449-gp-69 END AS o, CASE WHEN strand='+' THEN alt ELSE reverse(translate(alt,'ACGT','TGCA')) END AS a FROM i1)
SELECT row_id, tx_id, CASE WHEN inside THEN gene||':'||tx_id||':exon'||(CASE WHEN strand='+' THEN ex ELSE 4-ex END)||':c.'||(CASE WHEN ref='' THEN o||'_'||(o+1)||'ins'||a ELSE (o+1)||'_'||(o+length(ref))||'del' END) ELSE '.' END AS change FROM i2""")
def gene_indel_coding(spark, sf):
    """The c. text of small insertions and deletions."""
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf).filter("not (length(ref) = 1 and length(alt) = 1)"), t, shift=SHIFT).filter("function = 'exonic'")
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", F.regexp_replace("change", "^(.*):p[.].*$", "$1").alias("change"))


@query(demo.sql("v", "t", select="SELECT row_id, func FROM gf UNION ALL SELECT row_id, 'intergenic' FROM ng"))
def coding_change(spark, sf):
    return plan.coding_change(demo.variants(spark, sf), _tx(spark, sf)).rows.select("row_id", F.col("p0__func").alias("func"))


# comparisons and reports


@query("SELECT o_orderkey AS row_id, f AS field, a AS \"left\", b AS \"right\" FROM (SELECT o_orderkey, 'status' AS f, o_orderstatus AS a, CASE WHEN o_orderkey%3=0 THEN 'x' ELSE o_orderstatus END AS b FROM orders UNION ALL SELECT o_orderkey, 'genes', 'a,b', CASE WHEN o_orderkey%5=0 THEN 'b,c' WHEN o_orderkey%2=0 THEN 'b,a' ELSE 'a,b' END FROM orders) WHERE a<>b AND NOT (f='genes' AND b='b,a')")
def zip_compare(spark, sf):
    k = F.col("row_id")
    left = demo.read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"), F.lit("a,b").alias("genes"))
    right = left.select("row_id", F.when(k % 3 == 0, "x").otherwise(F.col("status")).alias("status"), F.when(k % 5 == 0, "b,c").when(k % 2 == 0, "b,a").otherwise("a,b").alias("genes"))
    return compare.zip_compare(left, right, ["status", "genes"], ("genes",))


@query("SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n<=5")
def first_examples(spark, sf):
    return compare.examples(demo.read(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 5)


@query("SELECT l_returnflag, CAST(round(2*quantile_cont(l_quantity, 0.5)) AS BIGINT) AS twice_median, CAST(min(l_quantity) AS BIGINT) AS least, CAST(max(l_quantity) AS BIGINT) AS most FROM lineitem GROUP BY l_returnflag")
def timing_summary(spark, sf):
    t = compare.timings(demo.read(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")
    return t.select("l_returnflag", F.round(F.col("median") * 2).cast("long").alias("twice_median"), F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@query(demo.sql("v", select="SELECT row_number() OVER (ORDER BY row_id) AS line_no, CASE WHEN row_id%2=0 THEN 'x' ELSE '.' END AS first, CASE WHEN row_id%4=0 THEN 'y z' ELSE '.' END AS second FROM v"))
def extra_columns(spark, sf):
    k = F.col("row_id")
    path = _variant_file(spark, sf, "in.avinput", F.when(k % 2 == 0, "x"), F.when(k % 4 == 0, "y z"))
    r = plan.annotate(readers.read_avinput(spark, path), [])
    assert r.headers[-2:] == ["Otherinfo1", "Otherinfo2"]
    return r.rows.select(F.col("row_id").alias("line_no"), F.col("Otherinfo1").alias("first"), F.col("Otherinfo2").alias("second"))


@query("SELECT count(*) AS alleles FROM (" + _VCF + "SELECT * FROM a WHERE ok)")
def unsupported_is_an_error(spark, sf):
    """Records without symbolic alternates pass the policy ``error``; one with them fails it."""
    v = readers.read_vcf(spark, _vcf_file(spark, sf)).drop("extra")
    p = [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])]
    try:
        plan.annotate(v, p, unsupported="error").rows.agg(F.count("AnnotationStatus")).first()
    except Exception as e:  # noqa: BLE001
        if "unsupported alternate" not in str(e):
            raise
    else:
        raise AssertionError("the policy has no effect")
    return plan.annotate(v.filter("supported"), p, unsupported="error").rows.agg(F.count("AnnotationStatus").alias("alleles"))
