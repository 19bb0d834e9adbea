import pytest

from genoloom.operators import gene
from genoloom.sources import readers

MODEL = ["NM_1|chr1|+|0|12|0|12|1|0,|12,|0|GENE1", "NM_M|chr2|-|0|12|0|12|1|0,|12,|0|MINUS"]


@pytest.fixture(scope="module")
def small(spark):
    raw = spark.createDataFrame([(i + 1, x.replace("|", "\t")) for i, x in enumerate(MODEL)], "line_no long, value string")
    seqs = spark.createDataFrame([("NM_1", "ATGGAATTTTAA"), ("NM_M", "ATGGAATTTTAA")], "id string, seq string")
    return gene.prepare(readers.parse_gene_model(raw), seqs).cache()


def one(spark, t, chrom, start, end, ref, alt):
    v = spark.createDataFrame([(0, chrom, start, end, ref, alt)], "row_id long, chrom string, start long, end long, ref string, alt string")
    r = gene.gene_join(v, t, shift=6).first()
    return r.g_func, r.g_gene, r.g_detail, r.g_exonic, r.g_change


CASES = [
    (("1", 4, 5, "A", "G"), ("exonic", "GENE1", ".", "nonsynonymous SNV", "GENE1:NM_1:exon1:c.A5G:p.E2G")),
    (("1", 3, 6, "GAA", "GGC"), ("exonic", "GENE1", ".", "nonsynonymous block substitution", "GENE1:NM_1:exon1:c.4_6delinsGGC:p.E2G")),
    (("1", 3, 6, "GAA", ""), ("exonic", "GENE1", ".", "nonframeshift deletion", "GENE1:NM_1:exon1:c.4_6del:p.E2del")),
    (("1", 6, 6, "", "A"), ("exonic", "GENE1", ".", "frameshift insertion", "GENE1:NM_1:exon1:c.6_7insA:p.F3Ifs")),
    (("2", 6, 9, "TTC", ""), ("exonic", "MINUS", ".", "nonframeshift deletion", "MINUS:NM_M:exon1:c.4_6del:p.E2del")),
    (("1", 3, 6, "CCC", ""), ("exonic", "GENE1", "reference_mismatch", "unknown", ".")),
    (("1", 9, 10, "T", "G"), ("exonic", "GENE1", ".", "stoploss", "GENE1:NM_1:exon1:c.T10G:p.X4E")),
    (("1", 3, 4, "G", "T"), ("exonic", "GENE1", ".", "stopgain", "GENE1:NM_1:exon1:c.G4T:p.E2X")),
    (("1", 5, 6, "A", "G"), ("exonic", "GENE1", ".", "synonymous SNV", "GENE1:NM_1:exon1:c.A6G:p.E2E")),
    (("1", 0, 0, "", "A"), ("upstream", "GENE1", "dist=1", ".", ".")),
    (("1", 20, 21, "A", "C"), ("downstream", "GENE1", "dist=9", ".", ".")),
    (("3", 5, 6, "A", "C"), ("intergenic", ".", ".", ".", ".")),
    (("1", 5000, 5001, "A", "C"), ("intergenic", "GENE1,NONE", "dist=4989;dist=NONE", ".", ".")),
]


def test_known_consequences(spark, small):
    v = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], "row_id long, chrom string, start long, end long, ref string, alt string")
    got = gene.gene_join(v, small, shift=6).orderBy("row_id").collect()
    assert [(r.g_func, r.g_gene, r.g_detail, r.g_exonic, r.g_change) for r in got] == [c[1] for c in CASES]


def test_isoforms_and_splicing(spark, lines):
    rows = ["NM_TEST|1|+|0|100|0|100|2|0,80,|20,100,|0|CODING", "NR_TEST|1|+|0|100|100|100|1|0,|100,|0|CODING", "NR_INTRON|2|+|0|100|100|100|2|0,80,|20,100,|0|RNA_INTRON", "NR_EXON|2|+|30|60|60|60|1|30,|60,|0|RNA_EXON", "NM_UTR|3|-|0|100|0|9|2|0,80,|20,100,|0|U"]
    t = gene.prepare(readers.parse_gene_model(lines(*rows)))
    v = spark.createDataFrame([(0, "1", 40, 41, "A", "C"), (1, "2", 40, 41, "A", "C"), (2, "3", 78, 79, "A", "C"), (3, "1", 5, 6, "A", "C")], "row_id long, chrom string, start long, end long, ref string, alt string")
    got = gene.gene_join(v, t, shift=6).orderBy("row_id").collect()
    assert [(r.g_func, r.g_gene, r.g_detail) for r in got] == [("intronic", "CODING", "."), ("ncRNA_exonic", "RNA_EXON", "."), ("splicing", "U", "NM_UTR:exon1:UTR5"), ("exonic", "CODING", "missing_transcript_sequence")]


def test_bad_transcripts(lines):
    for bad in ("A|1|+|0|10|0|10|2|0,|10,|0|G", "A|1|x|0|10|0|10|1|0,|10,|0|G", "A|1|+|0|10|0|11|1|0,|10,|0|G", "A|1|+|0|10|0|10|2|0,4,|5,10,|0|G"):
        with pytest.raises(Exception, match="invalid transcript"):
            readers.parse_gene_model(lines(bad)).collect()
