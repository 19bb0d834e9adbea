"""The registered queries of the annotation engine, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions import alleles as A
from genoloom.functions import codons, strings
from genoloom.operators import compare, filters, gene, left_align, regions, scores
from genoloom.plans import annotate as plan
from genoloom.plans import demo, index
from genoloom.sources import readers, reference
from genoloom.storage import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHIFT = 9


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return gene.prepare(demo.transcripts(spark, sf), demo.sequences(spark, sf))


# exact alleles


@query(demo.sql("v", "f", select="SELECT v.row_id, coalesce(fa.v,'.') AS value FROM v LEFT JOIN fa USING (chrom, s, e, ref, alt)"))
def filter_exact(spark, sf):
    return filters.filter_join(demo.variants(spark, sf), demo.filter_db(spark, sf), ["value"]).select("row_id", F.col("v0").alias("value"))


@query(demo.sql("v", "f", select="SELECT v.row_id, fa.v AS value FROM v JOIN fa USING (chrom, s, e, ref, alt) WHERE contains(fa.v, ';')"))
def filter_dup_join(spark, sf):
    return filters.filter_join(demo.variants(spark, sf), demo.filter_db(spark, sf), ["value"]).filter(F.col("v0").contains(";")).select("row_id", F.col("v0").alias("value"))


@query(demo.sql("v", "f", select="SELECT row_id, chrom, s AS vstart FROM v WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.chrom=v.chrom AND fa.s=v.s AND fa.e=v.e AND fa.ref=v.ref AND fa.alt=v.alt)"))
def filter_missing(spark, sf):
    return filters.filter_join(demo.variants(spark, sf), demo.filter_db(spark, sf), ["value"], missing="NA").filter("v0 = 'NA'").select("row_id", "chrom", F.col("start").alias("vstart"))


@query(demo.sql("v", "f", select="SELECT v.row_id, CASE WHEN fa.v IS NULL THEN '.' ELSE '1' END AS match FROM v LEFT JOIN fa USING (chrom, s, e, ref, alt)"))
def filter_strict_match(spark, sf):
    db = filters.collapse(demo.filter_db(spark, sf), []).withColumn("ord", F.lit(0)).withColumn("values", F.array(F.lit("1")))
    return filters.filter_join(filters.strict_check(demo.variants(spark, sf)), db, ["match"]).select("row_id", F.col("v0").alias("match"))


@query(ORACLES["filter_exact"])
def index_lookup(spark, sf):
    """The exact join over an index: the table sorted by key in Parquet."""
    table = index.build(demo.filter_db(spark, sf), scratch_folder(spark, "index"))
    return filters.filter_join(demo.variants(spark, sf), table, ["value"]).select("row_id", F.col("v0").alias("value"))


# intervals


@query(demo.sql("v", "r", select="SELECT v.row_id, coalesce(x.v,'.') AS value FROM v LEFT JOIN (SELECT row_id, string_agg(v, ';' ORDER BY s, ord) AS v FROM rp GROUP BY row_id) x USING (row_id)"))
def region_overlap(spark, sf):
    return regions.region_join(demo.variants(spark, sf), demo.regions(spark, sf), ["value"], shift=SHIFT).select("row_id", F.col("r0").alias("value"))


@query(demo.sql("v", "r", select="SELECT row_id, string_agg(v, ';' ORDER BY s, ord) AS value FROM rp WHERE vs=ve GROUP BY row_id"))
def region_insertion_inclusive(spark, sf):
    return regions.region_join(demo.variants(spark, sf).filter("start = end"), demo.regions(spark, sf), ["value"], shift=SHIFT).filter("r0 <> '.'").select("row_id", F.col("r0").alias("value"))


@query(demo.sql("v", "r", select="SELECT v.row_id, coalesce(x.v,'.') AS value FROM v LEFT JOIN (SELECT row_id, string_agg(v, ';' ORDER BY s, ord) AS v FROM rp WHERE greatest(least(ve,e)-greatest(vs,s),1) >= 0.9*greatest(ve-vs,1) GROUP BY row_id) x USING (row_id)"))
def region_min_overlap(spark, sf):
    return regions.region_join(demo.variants(spark, sf), demo.regions(spark, sf), ["value"], min_overlap=0.9, shift=SHIFT).select("row_id", F.col("r0").alias("value"))


@query(demo.sql("v", "r", select="SELECT v.row_id, coalesce(x.v,'.') AS value FROM v LEFT JOIN (SELECT row_id, 'Score='||max(best)||';Name='||string_agg(v, ',' ORDER BY s, ord) AS v FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS best FROM rp) WHERE score=best GROUP BY row_id) x USING (row_id)"))
def region_gff3_max(spark, sf):
    return regions.region_join(demo.variants(spark, sf), demo.regions(spark, sf), [], gff3=True, shift=SHIFT).select("row_id", F.col("r0").alias("value"))


# reading and writing variants

_VCF = """WITH m AS (SELECT max(p_partkey)+1 AS m FROM part), o AS (SELECT o_orderkey AS k, (o_orderkey*7)%m AS p FROM orders, m),
b AS (SELECT k, p, substr('ACGT',CAST(p%4+1 AS INT),1) AS b0, substr('ACGT',CAST((p+1)%4+1 AS INT),1) AS b1, substr('ACGT',CAST((p+2)%4+1 AS INT),1) AS b2 FROM o),
a AS (SELECT k, 0 AS allele_index, p, p*50+1 AS s, p*50+2 AS e, b1 AS ref, b2 AS alt, true AS ok FROM b
UNION ALL SELECT k, 1, p, CASE WHEN k%7=0 THEN p*50 ELSE p*50+1 END, CASE WHEN k%7=0 THEN p*50+3 ELSE p*50+1 END, CASE WHEN k%7=0 THEN b0||b1||b0 ELSE '' END, CASE WHEN k%7=0 THEN '<DEL>' ELSE b1 END, k%7<>0 FROM b)
"""


@query(_VCF + "SELECT k+1 AS source_line, allele_index, CAST(p%5+1 AS VARCHAR) AS chrom, s AS vstart, e AS vend, ref, alt FROM a")
def vcf_split_trim(spark, sf):
    v = readers.parse_vcf(demo.vcf_lines(spark, sf))
    return v.select("source_line", "allele_index", "chrom", F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt")


@query(demo.sql("v", select="SELECT row_id, chrom||' '||(CASE WHEN s=e THEN s ELSE s+1 END)||' '||e||' '||(CASE WHEN ref='' THEN '-' ELSE ref END)||' '||(CASE WHEN alt='' THEN '-' ELSE alt END) AS text FROM v"))
def avinput_roundtrip(spark, sf):
    text = demo.variants(spark, sf).select((F.col("row_id") + 1).alias("line_no"), F.concat_ws("\t", *A.avinput_fields(*[F.col(c) for c in ("chrom", "start", "end", "ref", "alt")])).alias("value"))
    again = readers.parse_avinput(text)
    return again.select("row_id", F.concat_ws(" ", *A.avinput_fields(*[F.col(c) for c in ("output_chrom", "start", "end", "ref", "alt")])).alias("text"))


@query("SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'M' WHEN 1 THEN 'MT' WHEN 2 THEN 'X' ELSE 'CHR1' END AS root, CASE c_custkey%4 WHEN 0 THEN 'MT' WHEN 1 THEN 'MT' WHEN 2 THEN 'X' ELSE 'CHR1' END AS strict FROM customer")
def chrom_alias(spark, sf):
    k = F.col("c_custkey") % 4
    given = F.when(k == 0, "chrM").when(k == 1, "MT").when(k == 2, "chrX").otherwise("CHR1")
    return demo.read(spark, sf, "customer").select("c_custkey", A.chrom(given).alias("root"), A.strict_chrom(given).alias("strict"))


@query("SELECT c_custkey, replace(replace(replace(c_name||';'||c_mktsegment||' =', ';', '%3B'), ' ', '%20'), '=', '%3D') AS text FROM customer")
def info_escape(spark, sf):
    return demo.read(spark, sf, "customer").select("c_custkey", strings.info_escape(F.concat("c_name", F.lit(";"), "c_mktsegment", F.lit(" ="))).alias("text"))


# transcripts


@query(demo.sql("v", "t", select="SELECT row_id, func, gene FROM gf UNION ALL SELECT row_id, 'intergenic', gene FROM ng"))
def gene_function(spark, sf):
    return gene.gene_join(demo.variants(spark, sf), _tx(spark, sf), shift=SHIFT).select("row_id", F.col("g_func").alias("func"), F.col("g_gene").alias("gene"))


@query(demo.sql("v", "t", select="SELECT row_id, tx_id, fn AS function, rnk AS rank FROM h"))
def gene_hits(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf), t, shift=SHIFT)
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "function", F.col("rank").cast("int").alias("rank"))


@query(demo.sql("v", "t", select="SELECT func, count(*) AS n FROM (SELECT row_id, func FROM gf UNION ALL SELECT row_id, 'intergenic' FROM ng) GROUP BY func"))
def gene_rank_reduce(spark, sf):
    return gene_function(spark, sf).groupBy("func").agg(F.count("*").alias("n"))


@query(demo.sql("v", "t", select="SELECT row_id, tx_id, fn AS function, dist AS distance FROM h WHERE dist IS NOT NULL"))
def gene_flank(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf), t, shift=SHIFT).filter("rank = 7")
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "function", F.regexp_extract("detail", "([0-9]+)", 1).cast("long").alias("distance"))


@query(demo.sql("v", "t", select="SELECT row_id, gene, detail FROM ng"))
def gene_nearest(spark, sf):
    return gene.gene_join(demo.variants(spark, sf), _tx(spark, sf), shift=SHIFT).filter("g_func = 'intergenic'").select("row_id", F.col("g_gene").alias("gene"), F.col("g_detail").alias("detail"))


@query("WITH " + demo._T.split("h0 AS")[0].rstrip().rstrip(",") + " SELECT tx_id, gene, CASE WHEN cs<ce THEN 'coding' ELSE 'noncoding' END AS kind FROM tx")
def gene_ncrna_exclusion(spark, sf):
    return _tx(spark, sf).select("tx_id", "gene", F.when(F.col("cds_start") < F.col("cds_end"), "coding").otherwise("noncoding").alias("kind"))


_AA = "CASE WHEN regexp_matches({0},'^[ACGT]{{3}}$') THEN substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',(instr('TCAG',substr({0},1,1))-1)*16+(instr('TCAG',substr({0},2,1))-1)*4+instr('TCAG',substr({0},3,1)),1) ELSE 'X' END"
_SNV = """,
sq AS (SELECT tx_id AS id, list_aggregate(list_transform([0,1,2,5,6,7,9,10,11], lambda j: repeat(substr('ACGT',CAST((ord+j)%4+1 AS INT),1),50)),'string_agg','') AS g FROM tx),
q0 AS (SELECT h.*, CASE WHEN strand='+' THEN g ELSE reverse(translate(g,'ACGT','TGCA')) END AS seq, CASE ex WHEN 1 THEN s-a1 WHEN 2 THEN 150+s-a2 ELSE 300+s-a3 END AS gp FROM h JOIN sq ON h.tx_id=sq.id WHERE fn='exonic' AND length(ref)=1 AND length(alt)=1),
q1 AS (SELECT *, CASE WHEN strand='+' THEN gp ELSE 449-gp END AS cpos, CASE WHEN strand='+' THEN 60 ELSE 69 END AS lo, CASE WHEN strand='+' THEN ref ELSE translate(ref,'ACGT','TGCA') END AS r, CASE WHEN strand='+' THEN alt ELSE translate(alt,'ACGT','TGCA') END AS a FROM q0),
q2 AS (SELECT *, cpos-lo AS o, substr(seq, lo+((cpos-lo)//3)*3+1, 3) AS codon FROM q1),
q3 AS (SELECT *, substr(codon,1,o%3)||a||substr(codon,o%3+2) AS mut FROM q2),
q4 AS (SELECT *, """ + _AA.format("codon") + " AS x, " + _AA.format("mut") + " AS y FROM q3)"


@query(demo.sql("v", "t", select="").rstrip() + _SNV + " SELECT row_id, tx_id, CASE WHEN x=y THEN 'synonymous SNV' WHEN y='*' THEN 'stopgain' WHEN x='*' THEN 'stoploss' ELSE 'nonsynonymous SNV' END AS exonic, gene||':'||tx_id||':exon'||(CASE WHEN strand='+' THEN ex ELSE 4-ex END)||':c.'||r||(o+1)||a||':p.'||replace(x,'*','X')||(o//3+1)||replace(y,'*','X') AS change FROM q4")
def gene_snv_coding(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf).filter("length(ref) = 1 and length(alt) = 1"), t, shift=SHIFT).filter("function = 'exonic'")
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "exonic", "change")


@query(demo.sql("v", "t", select="SELECT row_id, tx_id, CASE WHEN NOT (s>=(CASE ex WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a3 END) AND e<=(CASE ex WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END) AND s>=cs AND e<=ce AND NOT (s=e AND (s IN (a1,a2,a3,cs) OR e IN (z1,z2,z3,ce)))) THEN 'unknown' ELSE (CASE WHEN abs(length(alt)-length(ref))%3=0 THEN 'nonframeshift ' ELSE 'frameshift ' END)||(CASE WHEN ref='' THEN 'insertion' ELSE 'deletion' END) END AS exonic FROM h WHERE fn='exonic' AND NOT (length(ref)=1 AND length(alt)=1)"))
def gene_indel_class(spark, sf):
    t = _tx(spark, sf)
    found = gene.hits(demo.variants(spark, sf).filter("not (length(ref) = 1 and length(alt) = 1)"), t, shift=SHIFT).filter("function = 'exonic'")
    return found.join(t.select("ord", "tx_id"), found["o.ord"] == t["ord"]).select("row_id", "tx_id", "exonic")


@query()
def gene_indel_hgvs(spark, sf):
    return gene.gene_join(demo.variants(spark, sf), _tx(spark, sf), shift=SHIFT).filter("g_change <> '.'").select("row_id", F.col("g_detail").alias("detail"), F.col("g_exonic").alias("exonic"), F.col("g_change").alias("change"))


@query("SELECT a||b||c AS codon, " + _AA.format("(a||b||c)") + " AS amino_acid FROM (VALUES ('A'),('C'),('G'),('T'),('N')) AS p(a), (VALUES ('A'),('C'),('G'),('T')) AS q(b), (VALUES ('A'),('C'),('G'),('T')) AS s(c)")
def gene_codon_translate(spark, sf):
    letters = lambda n, s: spark.createDataFrame([(x,) for x in s], f"{n} string")
    all_ = letters("a", "ACGTN").crossJoin(letters("b", "ACGT")).crossJoin(letters("c", "ACGT")).select(F.concat("a", "b", "c").alias("codon"))
    return all_.select("codon", codons.amino_acid(F.col("codon")).alias("amino_acid"))


@query(demo.sql("v", select="SELECT row_id, reverse(translate(ref||alt,'ACGT','TGCA')) AS rc FROM v"))
def gene_revcomp(spark, sf):
    return demo.variants(spark, sf).select("row_id", A.reverse_complement(F.concat("ref", "alt")).alias("rc"))


# scores


@query(demo.sql("v", "c", select="SELECT row_id, CASE WHEN state='scored' THEN raw ELSE '.' END AS raw, CASE WHEN state='scored' THEN phred ELSE '.' END AS phred, state AS status FROM cj"))
def cadd_states(spark, sf):
    return scores.score_join(demo.variants(spark, sf), scores.check_scores(demo.scores(spark, sf))).select("row_id", F.col("c_raw").alias("raw"), F.col("c_phred").alias("phred"), F.col("c_status").alias("status"))


@query(demo.sql("v", "c", select="SELECT state AS status, count(*) AS n FROM cj GROUP BY state"))
def cadd_counts(spark, sf):
    return cadd_states(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(demo.sql("v", "c", select="SELECT row_id, state AS status FROM cj WHERE state NOT IN ('scored','not_snv')"))
def cadd_require_all_violations(spark, sf):
    return scores.unscored(scores.score_join(demo.variants(spark, sf), demo.scores(spark, sf))).select("row_id", F.col("c_status").alias("status"))


# several protocols


def _protocols(spark, sf):
    return [
        plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"]),
        plan.Protocol("band", "r", demo.regions(spark, sf), ["value"], shift=SHIFT),
        plan.Protocol("ref", "g", _tx(spark, sf), shift=SHIFT),
        plan.Protocol("score", "cadd", demo.scores(spark, sf)),
    ]


@query(
    demo.sql("v", "f", "r", "t", "c", select="""SELECT v.row_id, v.chrom AS "Chr", CAST(CASE WHEN v.s=v.e THEN v.s ELSE v.s+1 END AS VARCHAR) AS "Start", CAST(v.e AS VARCHAR) AS "End", CASE WHEN v.ref='' THEN '-' ELSE v.ref END AS "Ref", CASE WHEN v.alt='' THEN '-' ELSE v.alt END AS "Alt",
coalesce(fa.v,'.') AS part, coalesce(rr.v,'.') AS band, coalesce(gf.func,'intergenic') AS func, coalesce(gf.gene, ng.gene) AS gene, CASE WHEN cj.state='scored' THEN cj.phred ELSE '.' END AS phred, cj.state AS score_status
FROM v LEFT JOIN fa ON v.chrom=fa.chrom AND v.s=fa.s AND v.e=fa.e AND v.ref=fa.ref AND v.alt=fa.alt LEFT JOIN (SELECT row_id, string_agg(v, ';' ORDER BY s, ord) AS v FROM rp GROUP BY row_id) rr ON rr.row_id=v.row_id LEFT JOIN gf ON gf.row_id=v.row_id LEFT JOIN ng ON ng.row_id=v.row_id JOIN cj ON cj.row_id=v.row_id""")
)
def table_multi_protocol(spark, sf):
    r = plan.annotate(demo.variants(spark, sf), _protocols(spark, sf)).rows
    return r.select("row_id", *plan.CORE, F.col("p0_0").alias("part"), F.col("p1_0").alias("band"), F.col("p2__func").alias("func"), F.col("p2__gene").alias("gene"), F.col("p3__phred").alias("phred"), F.col("p3__status").alias("score_status"))


@query(_VCF + "SELECT k+1 AS source_line, allele_index, CASE WHEN ok THEN 'ok' ELSE 'unsupported_alt' END AS status FROM a")
def table_status(spark, sf):
    r = plan.annotate(readers.parse_vcf(demo.vcf_lines(spark, sf)).drop("extra"), [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])])
    return r.rows.select("source_line", "allele_index", F.col("AnnotationStatus").alias("status"))


_INFO = demo.sql("f", select="").rstrip() + ", " + _VCF.removeprefix("WITH ").rstrip() + """
SELECT k+1 AS record, (CASE WHEN k%2=0 THEN 'DP=1;' ELSE '' END)||'FA_part='||string_agg(CASE WHEN ok THEN replace(replace(coalesce(x.v,'.'),';','%3B'),' ','%20') ELSE '.' END, ',' ORDER BY allele_index)||';FA_STATUS='||string_agg(CASE WHEN ok THEN 'ok' ELSE 'unsupported_alt' END, ',' ORDER BY allele_index) AS info
FROM a LEFT JOIN fa x ON x.chrom=CAST(a.p%5+1 AS VARCHAR) AND x.s=a.s AND x.e=a.e AND x.ref=a.ref AND x.alt=a.alt GROUP BY k"""


@query(_INFO)
def vcf_info_merge(spark, sf):
    r = plan.annotate(readers.parse_vcf(demo.vcf_lines(spark, sf)).drop("extra"), [plan.Protocol("part", "f", demo.filter_db(spark, sf), ["value"])])
    return plan.vcf_info(r).select("record", "info")


# rows, sequences, comparisons


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority='1-URGENT'")
def reduce_equals(spark, sf):
    return filters.rows_equal(demo.read(spark, sf, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey", "o_orderstatus")


@query(demo.sql("v", select="SELECT row_id, CASE WHEN s=e THEN '' ELSE repeat(substr('ACGT',CAST((s//50)%4+1 AS INT),1),CAST(e-s AS INT)) END AS seq FROM v"))
def sequence_extract(spark, sf):
    v = demo.variants(spark, sf).withColumn("chrom", F.lit("1"))
    return reference.extract(v.select("row_id", "chrom", "start", "end"), demo.genome(spark, sf), 500).select("row_id", "seq")


@query(demo.sql("v", select="SELECT row_id, '1' AS chrom, CASE WHEN alt='' THEN s//50*50 ELSE s END AS vstart, CASE WHEN alt='' THEN s//50*50+3 ELSE e END AS vend, ref, alt FROM v"))
def left_aligned(spark, sf):
    v = demo.variants(spark, sf).withColumn("chrom", F.lit("1"))
    return left_align.left_align(v, demo.genome(spark, sf), size=500).select("row_id", "chrom", F.col("start").alias("vstart"), F.col("end").alias("vend"), "ref", "alt")


@query()
def sample_stratified(spark, sf):
    v = demo.variants(spark, sf).select("row_id", "chrom", (F.col("start") + 1).alias("pos"), F.concat(F.lit("A"), "ref").alias("ref"), F.concat(F.lit("A"), "alt").alias("alt"))
    return compare.stratified_sample(v, "1")


@query(demo.sql("v", select="SELECT CASE WHEN length(ref)=length(alt) THEN 'snv' ELSE 'indel' END AS variant_type, count(*) AS n FROM v GROUP BY 1"))
def variant_types(spark, sf):
    v = demo.variants(spark, sf)
    anchored = v.select(F.when(F.length("ref") == F.length("alt"), F.col("ref")).otherwise(F.concat(F.lit("A"), "ref")).alias("ref"), F.when(F.length("ref") == F.length("alt"), F.col("alt")).otherwise(F.concat(F.lit("A"), "alt")).alias("alt"))
    return compare.type_counts(anchored)


@query("SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_shipdate, l_partkey, l_suppkey)-1 AS occurrence FROM lineitem")
def occurrence_ordinal(spark, sf):
    li = demo.read(spark, sf, "lineitem").withColumn("ordering", F.struct("l_quantity", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey"))
    return compare.with_occurrence(li, ["l_orderkey", "l_linenumber"], "ordering").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS a, o_orderpriority AS b FROM orders), r AS (SELECT k+(CASE WHEN k%10=0 THEN 100000000 ELSE 0 END) AS k, CASE WHEN k%3=0 THEN 'x' ELSE a END AS a, b FROM l),
j AS (SELECT l.k AS lk, r.k AS rk, l.a=r.a AS sa, l.b=r.b AS sb FROM l FULL JOIN r ON l.k=r.k)
SELECT f AS field, count(*) FILTER (lk IS NOT NULL AND rk IS NOT NULL AND s) AS exact, CAST(0 AS BIGINT) AS order_insensitive, count(*) FILTER (lk IS NOT NULL AND rk IS NOT NULL AND NOT s) AS different, count(*) FILTER (rk IS NULL) AS only_left, count(*) FILTER (lk IS NULL) AS only_right FROM (SELECT 'a' AS f, lk, rk, sa AS s FROM j UNION ALL SELECT 'b', lk, rk, sb FROM j) GROUP BY f"""
)
def compare_tables(spark, sf):
    left = demo.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    right = left.select((F.col("k") + F.when(F.col("k") % 10 == 0, 100000000).otherwise(0)).alias("k"), F.when(F.col("k") % 3 == 0, "x").otherwise(F.col("a")).alias("a"), "b")
    return compare.diff(left, right, ["k"], ["a", "b"], "k")


@query("SELECT l_returnflag, l_linestatus FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber<4")
def multiset_except(spark, sf):
    a = demo.read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return compare.multiset_difference(a.drop("l_linenumber"), a.filter("l_linenumber < 4").drop("l_linenumber"))


@query("SELECT o_orderkey%100 AS k FROM orders INTERSECT ALL SELECT c_custkey%100 FROM customer")
def multiset_intersect(spark, sf):
    return compare.multiset_intersection(demo.read(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("k")), demo.read(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("k")))


from genoloom.plans import file_queries  # noqa: E402,F401  registers its queries
