"""Operator 7: WARC archives with an external index merge.

Every page becomes one WARC/1.1 record in a gzip member of its own, in archives that tasks write to the shared folder. Each task
also yields its captures sorted by URL key, timestamp and page: a locally sorted run. Runs are cut at common splitters, the
cuts exchanged, and the tasks merge the runs of their range with a loser tree. The merged index is a table in the shared folder with the
global position of every capture. Archives are read back by it: offsets, sizes, keys and positions come from the index alone.

Of pages with equal payloads of at least min_bytes, the one with the largest page_id is the response; the others are revisits of
it. Rows that repeat the largest page_id are all responses. A null payload counts as empty, a null URL as ``urn:x-none``; a
null page_id is never a response that others refer to while another page has the payload. An empty table gives empty archives and an empty
result. Columns other than the three named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.llm import losertree
from genoloom.llm.common import qualified, scratch, small_batches, stored, table

#: Compressed bytes after which a task begins another archive; captures that one task merges; archive bytes that one task reads; salts of a digest's join.
ARCHIVE_BYTES, MERGE_CAPTURES, READ_BYTES, SALTS = 8 << 20, 50_000, 32 << 20, 16
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)


def url_key(url: str) -> str:
    """The sortable form of a URL: host labels reversed, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def stamp(page_id: int | None) -> str:
    """The capture's timestamp: pages carry none, so one second per page_id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One record in one gzip member: a response, or a revisit that has the payload's headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {stamp(page_id)}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http;msgtype=response",
    ]
    body = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
        body = http
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda block: {k.lower(): v for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")[1:])}
    warc = fields(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(value: str) -> int | None:
    number = value.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with sha1 and refers_to, null for responses.

    Only digests of two pages or more are joined back; they are copied per salt so that a hot payload's pages are dealt to many tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html").withColumn("sha1", F.unhex(F.sha1(payload)))
    groups = pages.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    groups = groups.select("sha1", "response", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    joined = pages.withColumn("salt", salt("page_id")).join(groups, ["sha1", "salt"], "left")
    return joined.select("page_id", "url", "html", "sha1", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response")).alias("refers_to"))


_RUN = "run string, seq bigint, url_key string, ts string, page_id bigint, archive string, at bigint, size bigint"


def _write(folder: str):
    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name, n, out, captures, at = uuid.uuid4().hex, 0, None, [], 0
        for b in batches:
            for page, url, html, sha1, refers in zip(*[b[c].to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")]):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    archive, at, n = f"{name}-{n:05d}.warc.gz", 0, n + 1
                    out = where.open_output_stream(f"{base}/{archive}", compression=None)
                url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else "urn:x-none"
                member = record(page, url, (html or "").encode(), sha1, refers)
                out.write(member)
                captures.append((url_key(url), stamp(page), page, archive, at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
        captures.sort(key=lambda c: (c[0], c[1], -1 if c[2] is None else c[2], c[3], c[4]))
        for i in range(0, len(captures), 4096):
            part = list(zip(*captures[i : i + 4096]))
            yield pa.RecordBatch.from_pydict({"run": [name] * len(part[0]), "seq": range(i, i + len(part[0])), "url_key": part[0], "ts": part[1], "page_id": pa.array(part[2], pa.int64()), "archive": part[3], "at": part[4], "size": part[5]})

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write pages to archives under folder. The sorted capture runs of the tasks: run, seq, url_key, ts, page_id, archive, at, size.

    Archives get names of their own; those of a task that failed and ran again are in no run and are never read.
    """
    small_batches(pages.sparkSession)
    return stored(decide(pages, min_bytes).mapInArrow(_write(qualified(pages.sparkSession, folder)), _RUN), "runs")


_CAPTURE = "url_key string, ts string, page_id bigint, archive string, at bigint, size bigint"


def merge_index(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """The captures of all runs in global order of url_key, ts, page_id: position and the capture's columns, of a table of merged ranges in the shared folder.

    Splitters come from Spark's range sampling, which holds a fixed number of keys a range. The cuts of a range meet in one task, as runs end to
    end, which merges them by a loser tree without sorting. A hot URL's captures are cut by timestamp and page too. Captures
    of equal key, timestamp and page have positions next to each other, in the order of their archives' names and offsets.
    """
    parts = parts or runs.count() // MERGE_CAPTURES + 1

    def merged(batches):
        rows = pa.Table.from_batches(held) if (held := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        names = rows["run"].to_pylist()
        keys = list(zip(rows["url_key"].to_pylist(), rows["ts"].to_pylist(), [-1 if p is None else p for p in rows["page_id"].to_pylist()], rows["archive"].to_pylist(), rows["at"].to_pylist(), range(len(names))))
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        order = [k[-1] for k in losertree.merge([keys[a:b] for a, b in zip(starts, starts[1:])])]
        out = rows.select([f.split()[0] for f in _CAPTURE.split(", ")]).take(pa.array(order, pa.int64()))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches(max_chunksize=8192)

    cut = runs.repartitionByRange(parts, "url_key", "ts", F.coalesce("page_id", F.lit(-1).cast("long")), "archive", "at").sortWithinPartitions("run", "seq")
    ranges = stored(cut.mapInArrow(merged, f"{_CAPTURE}, part int, place bigint"), "ranges")
    counts = ranges.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.join(before, "part").select((F.col("before") + F.col("place")).alias("position"), *[f.split()[0] for f in _CAPTURE.split(", ")])


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per indexed record, from the archives' bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, and the index's url_key, ts, position.

    The records of an archive are read by one task in their order in the file; the number of tasks follows from the archives' bytes. A
    response's length and digest are taken from its payload, a revisit's from the headers that it keeps of it.
    """
    spark = index.sparkSession
    folder = qualified(spark, folder)

    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for b in batches:
            out = []
            for archive, at, size, key, ts, position in zip(*[b[c].to_pylist() for c in ("archive", "at", "size", "url_key", "ts", "position")]):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, where.open_input_file(f"{base}/{archive}")
                warc, http, payload = parse(source.read_at(size, at))
                told = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = warc["warc-type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != told:
                    raise ValueError(f"{archive} at {at}: the payload does not match its digest")
                n = len(payload) if kind == "response" else int(http["content-length"])
                out.append((_page(warc["warc-record-id"]), n, told, kind, _page(warc["warc-refers-to"]) if kind == "revisit" else None, key, ts, position))
            cols = list(zip(*out)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "position"])
        if source is not None:
            source.close()

    held = index.agg(F.countDistinct("archive").alias("files"), F.sum("size").alias("bytes")).first()
    tasks = max(1, min(held.files, max(spark.sparkContext.defaultParallelism, (held.bytes or 0) // READ_BYTES)))
    by_file = index.select("archive", "at", "size", "url_key", "ts", "position").repartition(tasks, "archive").sortWithinPartitions("archive", "at")
    return by_file.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, ts string, position bigint")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    runs = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(merge_index(runs), folder)
