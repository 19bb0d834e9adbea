import hashlib
import http.server
import io
import json
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from genoloom import cli, sinks
from genoloom.plans import annotate as plan
from genoloom.plans import index
from genoloom.sources import readers


@pytest.fixture
def demo(tmp_path):
    (tmp_path / "hg38_clinvar.txt").write_text("#Chr\tStart\tEnd\tRef\tAlt\tvalue\n1\t10\t10\tA\tC\tPathogenic\n")
    (tmp_path / "in.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\nchr1\t10\t.\tA\tC\t.\tPASS\tDP=20\tGT\t0/1\n")
    return tmp_path


def test_table_command(spark, demo):
    code = cli.main(["table", str(demo / "in.vcf"), str(demo), "--protocol", "clinvar", "--operation", "f", "--output", str(demo / "o.tsv"), "--vcf-output", str(demo / "o.vcf"), "--report", str(demo / "r.json")])
    assert code == 0
    assert (demo / "o.tsv").read_text() == "Chr\tStart\tEnd\tRef\tAlt\tclinvar\tAnnotationStatus\n1\t10\t10\tA\tC\tPathogenic\tok\n"
    out = (demo / "o.vcf").read_text().splitlines()
    assert out[-1] == "chr1\t10\t.\tA\tC\t.\tPASS\tDP=20;FA_clinvar=Pathogenic;FA_STATUS=ok\tGT\t0/1"
    assert out[-2].startswith("#CHROM") and out[1].startswith("##INFO=<ID=FA_clinvar,Number=A")


def test_failures_leave_the_target_alone(spark, demo):
    (demo / "o.tsv").write_text("old")
    (demo / "bad.avinput").write_text("1\t10\t10\tA\tC\nbad\n")
    assert cli.main(["annotate", str(demo / "bad.avinput"), str(demo / "hg38_clinvar.txt"), "--output", str(demo / "o.tsv")]) == 2
    assert (demo / "o.tsv").read_text() == "old" and not list(demo.glob("*.tmp"))
    assert cli.main(["table", str(demo / "in.vcf"), str(demo), "--protocol", "one,two", "--output", str(demo / "n.tsv")]) == 2
    assert not (demo / "n.tsv").exists()


def test_csv_quotes_only_where_it_must(spark, lines, demo):
    v = readers.parse_avinput(lines('1|10|10|A|C|a,b|say "x"'))
    sinks.write_table(plan.annotate(v, []), str(demo / "o.csv"), csv=True)
    assert (demo / "o.csv").read_text() == 'Chr,Start,End,Ref,Alt,AnnotationStatus,Otherinfo1,Otherinfo2\n1,10,10,A,C,ok,"a,b","say ""x"""\n'


def test_convert_and_sequence(spark, demo):
    assert cli.main(["convert", str(demo / "in.vcf"), str(demo / "o.avinput")]) == 0
    assert (demo / "o.avinput").read_text() == "1\t10\t10\tA\tC\n"
    (demo / "g.fa").write_text(">chr1 x\nacgtacgtac\nGT\n>2\nTTTT\n")
    assert cli.main(["sequence", str(demo / "o.avinput"), str(demo / "g.fa"), str(demo / "o.fa")]) == 0
    assert (demo / "o.fa").read_text() == ">variant_1 1:10-10\nC\n"


def test_index_goes_stale(spark, demo):
    source, folder = demo / "hg38_clinvar.txt", demo / "ix"
    assert cli.main(["db", "index", str(source), str(folder)]) == 0
    rows, names = index.open_index(spark, str(folder), full=True)
    assert names == ["value"] and rows.count() == 1
    with pytest.raises(ValueError, match="normalized"):
        index.open_index(spark, str(folder), "left-align")
    source.write_text(source.read_text() + "1\t11\t11\tA\tC\tx\n")
    with pytest.raises(ValueError, match="out of date"):
        index.open_index(spark, str(folder))


def test_streaming_intake(spark, demo):
    from genoloom.streaming.intake import annotate_stream

    (demo / "drop").mkdir()
    (demo / "drop" / "a.avinput").write_text("1\t10\t10\tA\tC\n1\t10\t10\tA\tG\n")
    p = plan.open_protocol(spark, "clinvar", "f", str(demo / "hg38_clinvar.txt"))
    got = []
    annotate_stream(spark, str(demo / "drop"), [p], lambda r, n: got.extend(x.p0_0 for x in r.rows.orderBy("row_id").collect()), str(demo / "cp")).awaitTermination()
    assert got == ["Pathogenic", "."]


def test_http_ranges(spark):
    from genoloom.sources.http_range import HttpRangeSource, RangeReader

    body = "".join(f"line {i}\n" for i in range(30_000)).encode()
    tag = ["a"]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, z = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            part = body[a : z + 1]
            self.send_response(206)
            self.send_header("ETag", tag[0])
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(body)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    spark.dataSource.register(HttpRangeSource)
    rows = spark.read.format("http_range").option("url", url).option("bytesPerPartition", "50000").load().orderBy("offset").collect()
    assert [r.value for r in rows] == body.decode().splitlines()
    reader = RangeReader(url)
    tag[0] = "b"
    with pytest.raises(OSError, match="changed"):
        reader.read(100_000, 100_010)
    server.shutdown()


def test_left_aligned_main_path(spark, demo):
    """A deletion written at the end of a repeat meets the index's row, which was left-aligned too."""
    (demo / "g.fa").write_text(">1\nGGCACACATT\n")
    (demo / "hg38_mine.txt").write_text("#Chr\tStart\tEnd\tRef\tAlt\tvalue\n1\t7\t8\tCA\t-\thit\n")
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    (demo / "shift.vcf").write_text(head + "1\t6\t.\tACA\tA,<DEL>\t.\t.\t.\n")
    ask = ["table", str(demo / "shift.vcf"), str(demo), "--protocol", "mine", "--operation", "f", "--output", str(demo / "o.tsv")]
    aligned = [*ask, "--normalize", "left-align", "--reference", str(demo / "g.fa")]
    assert cli.main(aligned) == 2  # no index
    index_folder = str(demo / "hg38_mine.txt.index")
    assert cli.main(["db", "index", str(demo / "hg38_mine.txt"), index_folder, "--reference", str(demo / "g.fa")]) == 0
    assert cli.main(aligned) == 0
    rows = [x.split("\t") for x in (demo / "o.tsv").read_text().splitlines()[1:]]
    assert [r[1:] for r in rows] == [["3", "4", "CA", "-", "hit", "ok"], ["6", "8", "ACA", "<DEL>", ".", "unsupported_alt"]]
    assert cli.main(ask) == 2  # the index isn't for alleles as written
    assert cli.main(["db", "validate", index_folder, "--reference", str(demo / "g.fa"), "--full"]) == 0
    (demo / "g2.fa").write_text(">1\nGGCACACATG\n")
    assert cli.main([*aligned[:-1], str(demo / "g2.fa")]) == 2  # another reference
    (demo / "shift.vcf").write_text(head + "1\t6\t.\tGCA\tG\t.\t.\t.\n")
    assert cli.main(aligned) == 2  # another reference allele


def test_damaged_index(spark, demo):
    folder = demo / "ix"
    assert cli.main(["db", "index", str(demo / "hg38_clinvar.txt"), str(folder)]) == 0
    spark.read.parquet(f"{folder}/rows").withColumn("alt", F.lit("T")).write.parquet(f"{folder}/other")
    shutil.rmtree(folder / "rows")
    (folder / "other").rename(folder / "rows")
    index.open_index(spark, str(folder))
    with pytest.raises(ValueError, match="damaged"):
        index.open_index(spark, str(folder), full=True)
    assert index.statistics(index.open_index(spark, str(folder))[0]) == {"records": 1, "contigs": 1}


def test_score_store(spark, demo):
    (demo / "s.tsv").write_text("##CADD GRCh38-v1.7 (c) x\n#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED\n1\t10\tA\tC\t0.5\t7.25\n")
    with pytest.raises(ValueError, match="hg38"):
        plan.open_protocol(spark, "s", "cadd", str(demo / "s.tsv"), build="hg19")
    assert cli.main(["db", "store-scores", str(demo / "s.tsv"), str(demo / "store"), "--build", "hg38"]) == 0
    assert cli.main(["db", "store-scores", str(demo / "s.tsv"), str(demo / "store")]) == 2
    with pytest.raises(ValueError, match="hg38"):
        plan.open_protocol(spark, "s", "cadd", str(demo / "store"), build="hg19")
    p = plan.open_protocol(spark, "s", "cadd", str(demo / "store"), build="hg38")
    assert [tuple(r) for r in p.table.collect()] == [("1", 10, "A", "C", "0.5", "7.25")]


def test_strict_command(spark, demo):
    (demo / "db.tsv").write_text("#Chr\tStart\tEnd\tRef\tAlt\tnote.a\tnote.b\n1\t10\t10\tA\tC\tx y\t\"q\"\nchrM\t5\t5\t-\tT\tm\tn\n")
    (demo / "v.tsv").write_text("chr1\t10\t10\ta\tC\tmine\nMT\t5\t5\t-\tT\tyours\n1\t11\t11\tA\tC\tnone\n")
    assert cli.main(["strict", str(demo / "v.tsv"), str(demo / "db.tsv"), str(demo / "o.tsv"), "--report", str(demo / "r.json")]) == 0
    assert (demo / "o.tsv").read_text().splitlines() == [
        "Chr\tStart\tEnd\tRef\tAlt\tnote.a\tnote.b\tOtherinfo1", 'chr1\t10\t10\ta\tC\tx y\t"""q"""\tmine', "MT\t5\t5\t-\tT\tm\tn\tyours", "1\t11\t11\tA\tC\t.\t.\tnone",
    ]
    assert cli.main(["strict", str(demo / "v.tsv"), str(demo / "db.tsv"), str(demo / "v.tsv")]) == 1
    (demo / "v.tsv").write_text("1\t10\t10\tA\n")
    assert cli.main(["strict", str(demo / "v.tsv"), str(demo / "db.tsv"), str(demo / "p.tsv")]) == 1 and not (demo / "p.tsv").exists()


def test_standard_input_and_output(spark, demo, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"1\t10\t10\tA\tC\n1\t11\t11\tA\tC\n")))
    assert cli.main(["annotate", "-", str(demo / "hg38_clinvar.txt"), "--protocol", "clinvar", "--output", "-"]) == 0
    assert capsys.readouterr().out.splitlines() == ["Chr\tStart\tEnd\tRef\tAlt\tclinvar\tAnnotationStatus", "1\t10\t10\tA\tC\tPathogenic\tok", "1\t11\t11\tA\tC\t.\tok"]
    assert cli.main(["annotate", str(demo / "in.vcf"), str(demo / "hg38_clinvar.txt"), "--output", f"{demo}/parts/"]) == 0
    assert sorted(p.suffix for p in (demo / "parts").iterdir() if not p.name.startswith((".", "_"))) == [".txt", ".txt"]


def test_lists_and_imports(spark, demo, capsys):
    (demo / "hg19_x.txt").write_text("")
    assert cli.main(["db", "list", str(demo)]) == 0 and capsys.readouterr().out.split() == ["hg19_x.txt", "hg38_clinvar.txt"]
    assert cli.main(["db", "list", str(demo), "--build", "hg19"]) == 0 and capsys.readouterr().out.split() == ["hg19_x.txt"]
    assert cli.main(["db", "stats", str(demo / "hg38_clinvar.txt")]) == 0 and json.loads(capsys.readouterr().out) == {"contigs": 1, "records": 1}
    (demo / "s.tsv").write_text("## any\n#Chrom\tPos\tRef\tAlt\tMore\tRawScore\tPHRED\nchr1\t10\tA\tC\tz\t0.5\t7.25\n")
    assert cli.main(["db", "import-scores", str(demo / "s.tsv"), str(demo / "imported")]) == 0
    r = spark.read.parquet(str(demo / "imported")).first()
    assert (r.chrom, r.start, r.end, r.ref, r.alt, list(r["values"])) == ("1", 9, 10, "A", "C", ["0.5", "7.25"])
    (demo / "s.tsv").write_text("#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED\n")
    assert cli.main(["db", "import-scores", str(demo / "s.tsv"), str(demo / "none")]) == 2
    (demo / "f").write_text("abc")
    url, good = (demo / "f").as_uri(), hashlib.sha256(b"abc").hexdigest()
    assert cli.main(["db", "download", url, str(demo / "got"), "--sha256", good]) == 0 and (demo / "got").read_text() == "abc"
    assert cli.main(["db", "download", url, str(demo / "bad"), "--sha256", "0" * 64]) == 2 and not (demo / "bad").exists()


def test_many_alternates(spark, lines):
    alts = ",".join("ACGT"[i % 4] * (i // 4 + 2) for i in range(1100))
    v = readers.parse_vcf(lines(f"1|10|.|A|{alts}|.|.|.", "1|11|.|A|C|.|.|."))
    assert v.count() == 1101 == v.select("row_id").distinct().count()


def blocked(text: bytes, size: int) -> bytes:
    from genoloom.sources.blocks import block

    return b"".join(block(text[i : i + size]) for i in range(0, len(text), size)) + block(b"")


@pytest.mark.parametrize("size, step", [(7, 40), (50, 64), (1000, 1 << 20), (64, 1)])
def test_block_ranges_hold_each_line_once(tmp_path, size, step):
    """Lines that end with blocks, span several ranges, are empty, or lack a last break."""
    from genoloom.sources.blocks import FileRanges, range_lines

    for text in (b"", b"\n", b"a" * 500, b"a" * 48 + b"\n\n" + b"b\n" * 90 + b"c" * 300 + b"\nlast", b"0123456789abc\n" * 40):
        (tmp_path / "x.gz").write_bytes(data := blocked(text, size))
        source = FileRanges((tmp_path / "x.gz").as_uri())
        got = [x for a in range(0, len(data), step) for rows in range_lines(source, a, min(a + step, len(data))) for x in rows]
        assert [x[1] for x in got] == (text.removesuffix(b"\n").split(b"\n") if text else [])
        assert [x[0] for x in got] == sorted({x[0] for x in got})


@pytest.mark.parametrize("name", ["s.tsv", "s.tsv.gz"])
def test_scores_by_ranges(spark, tmp_path, monkeypatch, name):
    """Local and remote score files, plain and block-gzipped, give the same rows."""
    from genoloom.sources import cadd

    body = ("##CADD GRCh38-v1.7 (c) x\n" + cadd.HEADER + "\n" + "".join(f"1\t{i}\tA\tC\t0.5\t{i}.25\n" for i in range(1, 4000))).encode()
    (tmp_path / name).write_bytes(data := blocked(body, 700) if name.endswith(".gz") else body)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            a, z = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(206)
            self.send_header("ETag", "a")
            self.send_header("Content-Range", f"bytes {a}-{min(z + 1, len(data)) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(data[a : z + 1])))
            self.end_headers()
            self.wfile.write(data[a : z + 1])

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(cadd, "text_lines", lambda s, p, real=cadd.text_lines: real(s, p, 5000))
    want = [("1", i, "A", "C", "0.5", f"{i}.25") for i in range(1, 4000)]
    for path in (str(tmp_path / name), f"http://127.0.0.1:{server.server_port}/{name}"):
        table, build, version = cadd.open_scores(spark, path, "hg38")
        assert (build, version) == ("hg38", "1.7")
        assert sorted(map(tuple, table.collect()), key=lambda r: r[1]) == want
    server.shutdown()


def test_indexed_genome(spark, tmp_path):
    """An index gives the same chunks as the whole file; entries that don't fit are errors."""
    from genoloom.sources import reference

    (tmp_path / "g.fa").write_bytes(b">chr1 x\nacgta\ncgtac\nGT\n>2\nTTTT\n>3\n")
    want = sorted(map(tuple, reference.chunked(readers.read_fasta(spark, str(tmp_path / "g.fa")), 4).collect()))
    fai = tmp_path / "g.fa.fai"
    fai.write_text("chr1\t12\t8\t5\t6\n2\t4\t26\t4\t5\n3\t0\t34\t0\t0\n")
    assert sorted(map(tuple, reference.read_genome(spark, str(tmp_path / "g.fa"), 4).collect())) == want
    for bad, told in (("chr1\t12\t8\t5\t5\n", "does not fit"), ("2\t40\t26\t4\t5\n", "does not fit"), ("2\tx\t26\t4\t5\n", "invalid length"), ("2\t4\t26\t4\t3\n", "invalid index entry"), ("1\t1\t8\t5\t6\nchr1\t1\t8\t5\t6\n", "twice")):
        fai.write_text(bad)
        with pytest.raises(Exception, match=told):
            reference.read_genome(spark, str(tmp_path / "g.fa"), 4).collect()


def test_genome_of_lines(spark, tmp_path):
    """Chunks put together from lines equal those of whole records, whatever the lines' lengths and the file's splits."""
    import random

    from genoloom.sources import reference

    rnd, path = random.Random(5), tmp_path / "g.fa"
    odd = [">chr1 first", "ACgt", "", " a c\tG\r", "T" * 41, ">2\r", ">chr3", "", ">4 x", "G" * 16, ">chr1 again", *("".join(rnd.choices("acgtN", k=rnd.choice([0, 1, 7, 8, 9, 60]))) for _ in range(300)), ">5", "A" * 8, "C" * 8]
    for text in ("\n".join(odd), "\n".join(odd) + "\n", "made of\nACGT\n>1\nAC", ">x", ">1\n" + "ACGTTGCA" * 100 + "A"):
        path.write_text(text)
        want = sorted(map(tuple, reference.chunked(readers.read_fasta(spark, str(path)), 8).collect()))
        for most in ("128m", "500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            try:
                assert sorted(map(tuple, reference.read_genome(spark, str(path), 8).collect())) == want
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
                spark.conf.unset("spark.sql.files.openCostInBytes")


def test_chunks_take_time_in_proportion(spark):
    """A chromosome of 12 million bases in chunks of 200: 60,000 copies of it would be 720 GB."""
    import time

    from genoloom.sources import reference

    began = time.time()
    got = reference.chunked(spark.range(1).selectExpr("'chr1' AS id", "repeat('ACGT', 3000000) AS seq"), 200).selectExpr("count(*)", "sum(length(seq))", "count(DISTINCT seq)", "max(length)", "max(chunk)").first()
    assert tuple(got) == (60_000, 12_000_000, 1, 12_000_000, 59_999) and time.time() - began < 60
