"""Variants and annotation tables derived from the order tables by integer arithmetic, for queries that SQL can check.

Part p owns the bases from 50 * p on, all of them ACGT[p % 4]; chromosomes are p % 5 + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def base(n: Column) -> Column:
    return F.substr(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant an order: SNVs, every eleventh order an insertion, every thirteenth a deletion of three bases."""
    m = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("m"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(m))  # one row
    p, k, key = F.col("p"), F.col("k"), F.col("row_id")
    o = o.select(F.col("o_orderkey").alias("row_id"), ((F.col("o_orderkey") * 7) % F.col("m")).alias("p"), (F.col("o_custkey") % 3).alias("k"))
    start = p * 50 + k
    ins, gone = key % 11 == 0, key % 13 == 0
    alt = base(p + 1 + k)
    return o.select(
        key, (p % 5 + 1).cast("string").alias("chrom"), start.alias("start"),
        F.when(ins, start).when(gone, start + 3).otherwise(start + 1).alias("end"),
        F.when(ins, "").when(gone, F.repeat(base(p), F.lit(3))).otherwise(base(p)).alias("ref"),
        F.when(ins, F.repeat(alt, (key % 3 + 1).cast("int"))).when(gone, "").otherwise(alt).alias("alt"),
    )


def filter_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One allele a part with its brand; even parts have a second row with their type."""
    part = read(spark, sf_dir, "part")
    p, k = F.col("p_partkey"), F.col("p_size") % 3
    rows = F.when(p % 2 == 0, F.array(F.struct((p * 2).alias("ord"), F.col("p_brand").alias("v")), F.struct((p * 2 + 1).alias("ord"), F.col("p_type").alias("v")))).otherwise(F.array(F.struct((p * 2).alias("ord"), F.col("p_brand").alias("v"))))
    return part.select((p % 5 + 1).cast("string").alias("chrom"), (p * 50 + k).alias("start"), (p * 50 + k + 1).alias("end"), base(p).alias("ref"), base(p + 1 + k).alias("alt"), F.explode(rows).alias("x")).select("x.ord", "chrom", "start", "end", "ref", "alt", F.array("x.v").alias("values"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for four parts of seven."""
    p, size = F.col("p_partkey"), F.col("p_size")
    part = read(spark, sf_dir, "part").filter(p % 7 < 4)
    return part.select(p.alias("ord"), (p % 5 + 1).cast("string").alias("chrom"), F.greatest(p * 50 - size, F.lit(0)).alias("start"), (p * 50 + size * 8).alias("end"), F.array("p_brand").alias("values"), (size % 5).cast("double").alias("score"), F.col("p_brand").alias("name"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript for every twentieth part: three exons over 600 bases; every fourth one isn't coding."""
    p = F.col("p_partkey")
    part = read(spark, sf_dir, "part").filter(p % 20 == 0).select(p.alias("p"), F.expr("p_partkey div 20").alias("g"), (p * 50).alias("t"))
    t, g = F.col("t"), F.col("g")
    exon = lambda a, z: F.struct((t + a).alias("s"), (t + z).alias("e"))
    coded = g % 4 != 3
    return part.select(
        F.col("p").alias("ord"), F.concat(F.lit("TX"), F.col("p").cast("string")).alias("tx_id"), F.concat(F.lit("GENE"), F.when(g % 8 == 3, g - 1).otherwise(g).cast("string")).alias("gene"), (g % 5 + 1).cast("string").alias("chrom"),
        F.when(F.expr("(g div 5) % 2") == 0, "+").otherwise("-").alias("strand"), t.alias("tx_start"), (t + 600).alias("tx_end"),
        F.when(coded, t + 60).otherwise(t + 600).alias("cds_start"), F.when(coded, t + 531).otherwise(t + 600).alias("cds_end"), F.array(exon(0, 150), exon(250, 400), exon(450, 600)).alias("exons"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts' sequences, read along the strand."""
    t = transcripts(spark, sf_dir)
    blocks = F.concat(*[F.repeat(base(F.col("ord") + j), F.lit(50)) for j in (0, 1, 2, 5, 6, 7, 9, 10, 11)])
    from genoloom.functions.alleles import reverse_complement

    return t.select(F.col("tx_id").alias("id"), F.when(F.col("strand") == "+", blocks).otherwise(reverse_complement(blocks)).alias("seq"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores a part on chromosomes 1 to 4; every ninth part's are for another reference base."""
    p, k = F.col("p_partkey"), F.col("p_size") % 3
    part = read(spark, sf_dir, "part").filter(p % 5 != 4)
    shift = F.when(p % 9 == 0, 2).otherwise(0)
    one = lambda d: F.struct(base(p + shift).alias("ref"), base(p + shift + d).alias("alt"), F.concat(F.col("p_size").cast("string"), F.lit("."), (p % 10).cast("string")).alias("raw"), (p % 40 + d).cast("string").alias("phred"))
    return part.select((p % 5 + 1).cast("string").alias("chrom"), (p * 50 + k + 1).alias("pos"), F.explode(F.array(one(1), one(2))).alias("x")).select("chrom", "pos", "x.*")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chromosome of 50 bases a part, in chunks of 500."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    per = parts.withColumn("chunk", F.expr("p div 10")).groupBy("chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    total = parts.agg((F.count("*") * 50).alias("length"))
    return per.crossJoin(F.broadcast(total)).select(F.lit("1").alias("chrom"), "chunk", F.array_join(F.transform("ps", lambda p: F.repeat(base(p), F.lit(50))), "").alias("seq"), "length")


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF record lines (line_no, value) of two alternates, one of them with a shared anchor and suffix, every seventh symbolic."""
    m = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("m"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(m))
    key, p = F.col("o_orderkey"), (F.col("o_orderkey") * 7) % F.col("m")
    ref = F.concat(base(p), base(p + 1), base(p))
    alt1 = F.concat(base(p), base(p + 2), base(p))
    alt2 = F.when(key % 7 == 0, "<DEL>").otherwise(F.concat(base(p), base(p + 1), base(p + 1), base(p)))
    return o.select((key + 1).alias("line_no"), F.concat_ws("\t", F.concat(F.lit("chr"), (p % 5 + 1).cast("string")), (p * 50 + 1).cast("string"), F.lit("."), ref, F.concat(alt1, F.lit(","), alt2), F.lit("."), F.lit("PASS"), F.when(key % 2 == 0, "DP=1").otherwise(".")).alias("value"))


# The same tables in SQL

_V = """m AS (SELECT max(p_partkey)+1 AS m FROM part),
v0 AS (SELECT o_orderkey AS row_id, (o_orderkey*7)%m AS p, o_custkey%3 AS k FROM orders, m),
v AS (SELECT row_id, CAST(p%5+1 AS VARCHAR) AS chrom, p*50+k AS s,
  CASE WHEN row_id%11=0 THEN p*50+k WHEN row_id%13=0 THEN p*50+k+3 ELSE p*50+k+1 END AS e,
  CASE WHEN row_id%11=0 THEN '' WHEN row_id%13=0 THEN repeat(substr('ACGT',CAST(p%4+1 AS INT),1),3) ELSE substr('ACGT',CAST(p%4+1 AS INT),1) END AS ref,
  CASE WHEN row_id%11=0 THEN repeat(substr('ACGT',CAST((p+1+k)%4+1 AS INT),1),CAST(row_id%3+1 AS INT)) WHEN row_id%13=0 THEN '' ELSE substr('ACGT',CAST((p+1+k)%4+1 AS INT),1) END AS alt FROM v0)"""
_F = """f0 AS (SELECT p_partkey AS p, p_size%3 AS k, p_brand, p_type FROM part),
f1 AS (SELECT p*2 AS ord, p, k, p_brand AS v FROM f0 UNION ALL SELECT p*2+1, p, k, p_type FROM f0 WHERE p%2=0),
f AS (SELECT ord, CAST(p%5+1 AS VARCHAR) AS chrom, p*50+k AS s, p*50+k+1 AS e, substr('ACGT',CAST(p%4+1 AS INT),1) AS ref, substr('ACGT',CAST((p+1+k)%4+1 AS INT),1) AS alt, v FROM f1),
fa AS (SELECT chrom, s, e, ref, alt, string_agg(v, ';' ORDER BY ord) AS v FROM f GROUP BY ALL)"""
_R = """r AS (SELECT p_partkey AS ord, CAST(p_partkey%5+1 AS VARCHAR) AS chrom, greatest(p_partkey*50-p_size,0) AS s, p_partkey*50+p_size*8 AS e, p_brand AS v, p_size%5 AS score FROM part WHERE p_partkey%7<4),
rp AS (SELECT v.row_id, v.s AS vs, v.e AS ve, r.* FROM v JOIN r ON v.chrom=r.chrom AND CASE WHEN v.s=v.e THEN r.s<=v.s AND v.s<=r.e ELSE v.s<r.e AND v.e>r.s END)"""
_T = """t0 AS (SELECT p_partkey AS p, p_partkey//20 AS g, p_partkey*50 AS t FROM part WHERE p_partkey%20=0),
t1 AS (SELECT p AS ord, 'TX'||p AS tx_id, 'GENE'||(CASE WHEN g%8=3 THEN g-1 ELSE g END) AS gene, CAST(g%5+1 AS VARCHAR) AS chrom, CASE WHEN (g//5)%2=0 THEN '+' ELSE '-' END AS strand, t, t+600 AS te,
  CASE WHEN g%4<>3 THEN t+60 ELSE t+600 END AS cs, CASE WHEN g%4<>3 THEN t+531 ELSE t+600 END AS ce FROM t0),
tx AS (SELECT * FROM t1 WHERE cs<ce OR gene NOT IN (SELECT gene FROM t1 WHERE cs<ce)),
x AS (SELECT *, t AS a1, t+150 AS z1, t+250 AS a2, t+400 AS z2, t+450 AS a3, t+600 AS z3 FROM tx),
h0 AS (SELECT v.row_id, v.s, v.e, v.ref, v.alt, x.*,
  CASE WHEN v.e<=x.t THEN x.t-v.e+1 WHEN v.s>=x.te THEN v.s-x.te+CAST(v.ref<>'' AS INT) END AS dist,
  CASE WHEN {o1} THEN 1 WHEN {o2} THEN 2 WHEN {o3} THEN 3 END AS ex,
  ({n1} OR {n2} OR {n3} OR {n4}) AS near
  FROM v JOIN x ON v.chrom=x.chrom AND v.s<=x.te+1001 AND v.e>=x.t-1001),
h1 AS (SELECT *, CASE WHEN e<=t THEN CASE WHEN strand='+' THEN 'upstream' ELSE 'downstream' END WHEN s>=te THEN CASE WHEN strand='+' THEN 'downstream' ELSE 'upstream' END
  WHEN ex IS NULL THEN CASE WHEN cs<ce THEN CASE WHEN near THEN 'splicing' ELSE 'intronic' END WHEN near THEN 'ncRNA_splicing' ELSE 'ncRNA_intronic' END
  WHEN cs=ce THEN 'ncRNA_exonic' WHEN e<=cs THEN CASE WHEN strand='+' THEN 'UTR5' ELSE 'UTR3' END WHEN s>=ce THEN CASE WHEN strand='+' THEN 'UTR3' ELSE 'UTR5' END ELSE 'exonic' END AS fn FROM h0 WHERE dist IS NULL OR dist<1000),
h AS (SELECT *, CASE fn WHEN 'exonic' THEN 0 WHEN 'splicing' THEN 1 WHEN 'ncRNA_exonic' THEN 2 WHEN 'ncRNA_splicing' THEN 3 WHEN 'ncRNA_intronic' THEN 4 WHEN 'UTR5' THEN 5 WHEN 'UTR3' THEN 5 WHEN 'intronic' THEN 6 ELSE 7 END AS rnk FROM h1),
hb AS (SELECT *, min(rnk) OVER (PARTITION BY row_id) AS best FROM h),
gr AS (SELECT row_id, fn, CASE WHEN fn IN ('UTR5','upstream') THEN 0 ELSE 1 END AS pri, min(ord) AS fo, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM hb WHERE rnk=best GROUP BY row_id, fn
  UNION ALL SELECT row_id, 'splicing', 2, min(ord), string_agg(DISTINCT gene, ',' ORDER BY gene) FROM hb WHERE best IN (0,2) AND e-s<=2 AND fn IN ('splicing','ncRNA_splicing') GROUP BY row_id),
gf AS (SELECT row_id, string_agg(fn, ';' ORDER BY pri, fo) AS func, string_agg(genes, ';' ORDER BY pri, fo) AS gene FROM gr GROUP BY row_id),
nl AS (SELECT v.row_id, max(x.te) AS pos FROM v JOIN tx x ON v.chrom=x.chrom AND x.te<=v.s WHERE v.row_id NOT IN (SELECT row_id FROM h) GROUP BY v.row_id),
nr AS (SELECT v.row_id, min(x.t) AS pos FROM v JOIN tx x ON v.chrom=x.chrom AND x.t>=v.e WHERE v.row_id NOT IN (SELECT row_id FROM h) GROUP BY v.row_id),
ng AS (SELECT v.row_id,
  CASE WHEN v.chrom NOT IN (SELECT chrom FROM tx) THEN '.' ELSE coalesce((SELECT min_by(gene, ord) FROM tx WHERE tx.chrom=v.chrom AND tx.te=nl.pos),'NONE')||','||coalesce((SELECT min_by(gene, ord) FROM tx WHERE tx.chrom=v.chrom AND tx.t=nr.pos),'NONE') END AS gene,
  CASE WHEN v.chrom NOT IN (SELECT chrom FROM tx) THEN '.' ELSE coalesce('dist='||(v.s-nl.pos+CAST(v.ref<>'' AS INT)),'dist=NONE')||';'||coalesce('dist='||(nr.pos-v.e+1),'dist=NONE') END AS detail
  FROM v LEFT JOIN nl USING (row_id) LEFT JOIN nr USING (row_id) WHERE v.row_id NOT IN (SELECT row_id FROM h))"""


def _meets(lo: str, hi: str) -> str:
    return f"(CASE WHEN v.s=v.e THEN {lo}<=v.s AND v.s<={hi} ELSE v.s<{hi} AND v.e>{lo} END)"


_T = _T.format(o1=_meets("a1", "z1"), o2=_meets("a2", "z2"), o3=_meets("a3", "z3"), n1=_meets("z1", "z1+2"), n2=_meets("a2-2", "a2"), n3=_meets("z2", "z2+2"), n4=_meets("a3-2", "a3"))
_C = """c0 AS (SELECT p_partkey AS p, p_size, CASE WHEN p_partkey%9=0 THEN 2 ELSE 0 END AS sh FROM part WHERE p_partkey%5<>4),
c AS (SELECT CAST(p%5+1 AS VARCHAR) AS chrom, p*50+p_size%3+1 AS pos, substr('ACGT',CAST((p+sh)%4+1 AS INT),1) AS ref, substr('ACGT',CAST((p+sh+d)%4+1 AS INT),1) AS alt, p_size||'.'||(p%10) AS raw, CAST(p%40+d AS VARCHAR) AS phred FROM c0, (VALUES (1),(2)) AS q(d)),
cj AS (SELECT v.*, c.raw, c.phred, CASE WHEN NOT (e=s+1 AND length(v.ref)=1 AND length(v.alt)=1) THEN 'not_snv' WHEN v.chrom NOT IN (SELECT chrom FROM c) THEN 'contig_not_covered' WHEN c.raw IS NOT NULL THEN 'scored'
  WHEN EXISTS (SELECT 1 FROM c y WHERE y.chrom=v.chrom AND y.pos=v.e) AND NOT EXISTS (SELECT 1 FROM c y WHERE y.chrom=v.chrom AND y.pos=v.e AND y.ref=v.ref) THEN 'reference_mismatch' ELSE 'score_not_found' END AS state
  FROM v LEFT JOIN c ON v.chrom=c.chrom AND v.e=c.pos AND v.ref=c.ref AND v.alt=c.alt AND v.e=v.s+1)"""


def sql(*tables: str, select: str) -> str:
    """A query over the named derived tables."""
    parts = {"v": _V, "f": _F, "r": _R, "t": _T, "c": _C}
    return "WITH " + ",\n".join(parts[t] for t in tables) + "\n" + select
