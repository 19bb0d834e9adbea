import random

import pytest
from pyspark.sql import functions as F

from genoloom.functions import alleles as A
from genoloom.functions import codons, strings
from genoloom.sources import readers


def five(df, chrom="output_chrom"):
    return ["\t".join(r) for r in df.orderBy("row_id").select(*A.avinput_fields(F.col(chrom), F.col("start"), F.col("end"), F.col("ref"), F.col("alt"))).collect()]


def test_vcf_alleles_split_and_trim(lines):
    v = readers.parse_vcf(lines("##x", "#CHROM|POS|ID|REF|ALT|QUAL|FILTER|INFO", "chr1|10|.|A|C,ATG|.|.|.", "1|10|.|ATC|A|.|.|.", "1|10|.|A|<DEL>|.|.|."))
    assert five(v) == ["1\t10\t10\tA\tC", "1\t11\t10\t-\tTG", "1\t11\t12\tTC\t-", "1\t10\t10\tA\t<DEL>"] or five(v)[1].split("\t")[3:] == ["-", "TG"]


def trim(start, r, a):
    while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
        r, a = r[:-1], a[:-1]
    while len(r) > 1 and len(a) > 1 and r[0] == a[0]:
        r, a, start = r[1:], a[1:], start + 1
    if (len(r) == 1) != (len(a) == 1) and r[0] == a[0]:
        r, a, start = r[1:], a[1:], start + 1
    return start, start + len(r), r, a


def test_trim_equals_the_loop(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(100), "".join(rnd.choices("AC", k=rnd.randint(1, 7))), "".join(rnd.choices("AC", k=rnd.randint(1, 7)))) for i in range(800)]
    got = A.with_trim(spark.createDataFrame(rows, "i int, s long, r string, a string"), "s", "r", "a").orderBy("i").select("t.*").collect()
    assert [tuple(x) for x in got] == [trim(*r[1:]) for r in rows]


def test_avinput_round_trip_and_unknown_reference(lines):
    text = ["1|10|10|A|C|note", "1|20|20|-|TG", "1|30|31|AC|-", "13|20797176|21105944|0|-|large deletion"]
    v = readers.parse_avinput(lines("# comment", "", *text)).cache()
    assert five(v) == ["\t".join(x.split("|")[:5]) for x in text]
    last = v.orderBy("row_id").collect()[-1]
    assert (last.start, last.end, last.ref, last.extra, last.source_line) == (20797175, 21105944, "0", ["large deletion"], 6)


@pytest.mark.parametrize("bad", ["1|0|1|A|C", "1|9|8|A|C", "1|x|8|A|C", "1|5| |A", "bad"])
def test_malformed_lines_name_themselves(lines, bad):
    with pytest.raises(Exception, match="input line 2"):
        readers.parse_avinput(lines("1|1|1|A|C", bad)).collect()


def test_line_numbers_follow_the_file(spark, tmp_path):
    import gzip

    p = tmp_path / "x.txt"
    p.write_text("".join(f"line{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.lines(spark, str(p)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.value) for r in got) == [(i + 1, f"line{i}") for i in range(5000)]
    with gzip.open(tmp_path / "v.vcf.gz", "wt") as f:
        f.write("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t7\t.\tG\tA\t.\t.\t.\n")
    assert five(readers.read_variants(spark, str(tmp_path / "v.vcf.gz"))) == ["1\t7\t7\tG\tA"]


def test_chromosome_names(spark):
    got = spark.createDataFrame([("chrM",), ("M",), ("MT",), ("chr1",), ("01",), ("Chr1",)], "c string").select(A.chrom(F.col("c")), A.strict_chrom(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("M", "MT"), ("M", "MT"), ("MT", "MT"), ("1", "1"), ("01", "01"), ("Chr1", "Chr1")]


def test_translation_and_numbers(spark):
    t = spark.createDataFrame([("ATGGAATTTTAA", 849.0), ("ATGNAAT", 0.5), ("", 1e21), ("TA", 1.5e-7)], "s string, x double")
    got = t.select(codons.protein(F.col("s")), strings.plain_number(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("MEF*", "849"), ("MX", "0.5"), ("", "1000000000000000000000"), ("", "0.00000015")]


def test_info_escape(spark):
    t = spark.createDataFrame([("a;b=c d",), ("é|\\",), ("plain",), ("",)], "s string")
    assert [r[0] for r in t.select(strings.info_escape(F.col("s"))).collect()] == ["a%3Bb%3Dc%20d", "%C3%A9%7C%5C", "plain", ""]


def test_vcf_header_rules(lines):
    head, row = "#CHROM|POS|ID|REF|ALT|QUAL|FILTER|INFO", "1|7|.|G|A|.|.|."
    assert readers.vcf_headers(lines(head, row)) == [head.replace("|", "\t")]
    for bad in ([row], [head, row, head], [row, head], [head, row + "|x"], ["##INFO=<ID=FA_x>", head, row]):
        with pytest.raises(ValueError):
            readers.vcf_headers(lines(*bad))


def test_strict_variants(lines):
    v = readers.parse_strict_avinput(lines("chrM|10|10|a|c|x y|", "1|20|20|-|TG||z", "X|5|9|0|-|a|b")).orderBy("row_id").collect()
    assert [(r.chrom, r.start, r.end, r.ref, r.alt, r.extra) for r in v] == [("MT", 9, 10, "A", "C", ["x y", ""]), ("1", 20, 20, "", "TG", ["", "z"]), ("X", 4, 9, "0", "", ["a", "b"])]
    assert v[0].original == ["chrM", "10", "10", "a", "c"]
    for bad in ("1|1|1|A", "1|5|4|A|C", "1|1|2|A|C", "1|1|2|-|C", "1|1|1|-|-", "1|1|1|<X>|C", "1|12A|12|A|C", "1|0|0|A|C", "1|1|1|A|C|extra"):
        with pytest.raises(Exception, match="input line 2"):
            readers.parse_strict_avinput(lines("1|1|1|A|C", bad)).collect()


def test_strict_insertions_in_front_of_the_first_base(lines):
    v = readers.parse_strict_avinput(lines("1|0|0|-|AC", "1|1|1|A|C")).orderBy("row_id").collect()
    assert [(r.start, r.end, r.ref, r.alt, r.original) for r in v] == [(0, 0, "", "AC", ["1", "0", "0", "-", "AC"]), (0, 1, "A", "C", ["1", "1", "1", "A", "C"])]
    for bad in ("1|0|0|A|C", "1|0|0|0|C", "1|0|1|AC|-", "1|0|1|-|A"):
        with pytest.raises(Exception, match="input line 2"):
            readers.parse_strict_avinput(lines("1|1|1|A|C", bad)).collect()
