"""Reference sequences as tables of fixed-size chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.alleles import chrom
from genoloom.sources.blocks import KNOWN, FileRanges
from genoloom.sources.readers import fail, number
from genoloom.storage import file_system, qualified

#: Bases of a chunk, and those that one task reads by an index.
CHUNK, TASK_BASES = 1 << 16, 32 << 20


def _pieces(text, size: int):
    """text cut into pieces of size characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunked(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk, seq, length) of (id, seq): chunk i holds bases from i * size on; length is that of the whole chromosome."""
    n = F.length("seq")
    rows = sequences.select(chrom(F.col("id")).alias("chrom"), n.cast("long").alias("length"), F.posexplode(F.when(n <= size, F.array("seq")).otherwise(_pieces("seq", size))).alias("chunk", "piece"))
    return rows.select("chrom", F.col("chunk").cast("long").alias("chunk"), F.col("piece").alias("seq"), "length")


def read_genome(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """The chunks of a FASTA file: by byte ranges if it has an index, ``<path>.fai``, else put together from its lines."""
    uri = qualified(spark, path)
    fs, p = file_system(spark, f"{path}.fai")
    return indexed_genome(spark, path, size) if uri.startswith(KNOWN) and not path.endswith(".gz") and fs.exists(p) else line_chunks(spark, path, size)


def line_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks as of chunked() and read_fasta(), from the lines of a FASTA file, so that no row holds more than a line or a chunk.

    A line's record and its place in it come from running sums over its file split and, for what earlier splits hold, from a broadcast table with a row a split.
    """
    from pyspark.sql import Window

    split = Window.partitionBy("file", "block").orderBy("mid")
    so_far = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("mid"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a file's first line is a header in any case
    rows = raw.withColumn("head", F.col("value").startswith(">") | ((F.col("block") == 0) & (F.row_number().over(split) == 1)))
    rows = rows.withColumn("bases", F.when(F.col("head"), "").otherwise(F.upper(F.regexp_replace("value", r"\s+", "")))).withColumn("n", F.length("bases").cast("long"))
    rows = rows.withColumn("heads", F.sum(F.col("head").cast("long")).over(so_far)).withColumn("sum", F.sum("n").over(so_far)).withColumn("head_sum", F.max(F.when(F.col("head"), F.col("sum"))).over(so_far))

    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(c.over(before), F.lit(0))
    splits = rows.groupBy("file", "block").agg(F.max("heads").alias("heads"), F.max("sum").alias("sum"), F.max("head_sum").alias("head_sum")).withColumn("all", earlier(F.sum("sum")))
    splits = splits.select("file", "block", earlier(F.sum("heads")).alias("heads_before"), (F.col("all") - earlier(F.max(F.col("all") + F.col("head_sum")))).alias("open"))
    place = F.when(F.col("heads") == 0, F.col("open") + F.col("sum")).otherwise(F.col("sum") - F.col("head_sum")) - F.col("n")
    rows = rows.join(F.broadcast(splits), ["file", "block"]).select((F.col("heads_before") + F.col("heads")).alias("record"), place.alias("place"), "head", "value", "bases", "n")

    name = F.regexp_extract(F.regexp_replace("value", r"^>|\r", ""), r"^(\S+)", 1)
    records = rows.groupBy("record").agg(F.max(F.when(F.col("head"), name)).alias("id"), F.sum("n").alias("length")).filter("id <> '' or length > 0")
    last = Window.partitionBy("id").orderBy(F.desc("record"))  # of repeated ids the last one holds
    records = records.withColumn("i", F.row_number().over(last)).filter("i = 1").select("record", chrom(F.col("id")).alias("chrom"), "length")

    used = (F.col("place") % size).cast("int")  # bases of the line's first chunk in front of it
    cut = used + F.col("n") > size
    parts = F.when(cut, _pieces(F.concat(F.repeat(F.lit("."), used), "bases"), size)).otherwise(F.array("bases"))
    parts = rows.filter("head or n > 0").select("record", "place", F.when(cut, used).otherwise(0).alias("fill"), F.posexplode(parts).alias("i", "part"))
    part = F.when((F.col("i") == 0) & (F.col("fill") > 0), F.substr("part", F.col("fill") + 1)).otherwise(F.col("part"))
    parts = parts.select("record", (F.floor(F.col("place") / size) + F.col("i")).alias("chunk"), "place", part.alias("part"))
    chunks = parts.groupBy("record", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("seq"))
    return chunks.join(records, "record").select("chrom", "chunk", "seq", "length")


def indexed_genome(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Chunks as of chunked(), each read from its own byte range, which the index (name, bases, place, bases a line, bytes a line) gives.

    Malformed entries, two names of one chromosome, and ranges that don't hold as many bases as the index says are errors when the query runs. Chunks are dealt in the
    file's order to tasks of about 32 MB. An empty index gives no chunks.
    """
    uri, line = qualified(spark, path), F.monotonically_increasing_id() + 1
    p = F.split("value", "\t")
    entries = spark.read.text(f"{path}.fai").filter("trim(value) <> ''").select(line.alias("line"), F.get(p, F.lit(0)).alias("id"), *[number(F.get(p, F.lit(i)), n, F.col("line")).alias(n) for i, n in ((1, "length"), (2, "place"), (3, "bases"), (4, "bytes"))])
    ok = (F.col("id") != "") & ((F.col("bases") > 0) | (F.col("length") == 0)) & (F.col("bytes") >= F.col("bases"))
    entries = entries.withColumn("id", F.when(ok, F.col("id")).otherwise(fail("invalid index entry", F.col("line")))).withColumn("chrom", chrom(F.col("id")))
    twice = entries.groupBy("chrom").count().filter("count > 1").orderBy("chrom").first()  # a row a chromosome
    if twice:
        raise ValueError(f"the reference index names {twice.chrom} twice")
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("long") - 1)
    chunks = entries.select("chrom", F.explode(at).alias("chunk"), "length", "place", "bases", "bytes")
    total = entries.agg(F.sum("length")).first()[0] or 0

    def run(batches):
        source = FileRanges(uri)
        for b in batches:
            seqs = []
            for name, chunk, length, place, bases, width in zip(*[c.to_pylist() for c in b.columns]):
                a, z = chunk * size, min((chunk + 1) * size, length)
                where = lambda i: place + (i // bases * width + i % bases if bases else 0)  # noqa: B023, E731
                data = source.read(where(a), where(z - 1) + 1) if z > a else b""
                seq = b"".join(data.split())
                if len(seq) != z - a or b">" in seq:
                    raise ValueError(f"the index does not fit the reference at {name}:{a}")
                seqs.append(seq.decode().upper())
            yield pa.RecordBatch.from_arrays([b["chrom"], b["chunk"], pa.array(seqs, pa.string()), b["length"]], names=["chrom", "chunk", "seq", "length"])

    dealt = chunks.repartitionByRange(int(total // TASK_BASES + 1), "place", "chunk")
    return dealt.mapInArrow(run, "chrom string, chunk bigint, seq string, length bigint")


def extract(ranges: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """ranges (row_id, chrom, start, end) with seq, by joins on (chromosome, chunk); an unknown chromosome or a range past its end is an error."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    asks = ranges.select("row_id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))).alias("chunk"))
    c = chunks.select(F.col("chrom").alias("__c"), F.col("chunk").alias("__k"), F.col("seq").alias("__s"), F.col("length").alias("__n"))
    j = asks.join(c, (F.col("chrom") == F.col("__c")) & (F.col("chunk") == F.col("__k")), "left")
    a = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0))
    z = F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    piece = F.substr("__s", (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
    got = j.groupBy("row_id").agg(F.max("__n").alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    out = ranges.join(got, "row_id", "left")
    place = F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"))
    ok = F.when(F.col("__n").isNull(), F.raise_error(F.concat(F.lit("no reference sequence at "), place))).when(F.col("end") > F.col("__n"), F.raise_error(F.concat(F.lit("beyond the reference's end at "), place))).otherwise(F.col("seq"))
    return out.withColumn("seq", ok).drop("__n")


def fasta_records(variants: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(row_id, record): a FASTA record per variant, named by its number and one-based place."""
    from pyspark.sql import Window

    got = extract(variants.select("row_id", "chrom", "start", "end"), chunks, size)
    return got.select("row_id", F.concat(F.lit(">variant_"), (F.col("row_id") + 1).cast("string"), F.lit(" "), "chrom", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("\n"), "seq").alias("record"))
