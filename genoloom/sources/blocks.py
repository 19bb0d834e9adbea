"""Block-gzipped text by byte ranges, from a file system or over HTTP: each task inflates the blocks that begin in its range.

    spark.dataSource.register(BlockSource)
    spark.read.format("blocks").option("path", ...).load()     # one row (offset, value) a line

offset is the place of the line's block in the file times 65536, plus the line's place in the inflated block, so it follows the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from genoloom.sources.http_range import HttpRangeSource, RangeReader, _Range
from genoloom.sources.readers import lines
from genoloom.storage import qualified

MAGIC, MOST, FETCH = b"\x1f\x8b\x08\x04", 1 << 16, 1 << 20
#: Lines of a file's head, and the bytes that are looked through for them.
HEAD_LINES, HEAD_BYTES = 100, 1 << 20
REMOTE = ("http://", "https://")
#: Schemes of paths that Python's file systems read as Spark does.
KNOWN = ("file:", "hdfs:")


class FileRanges:
    """Byte ranges of a file that a URI names."""

    validator = None

    def __init__(self, uri: str):
        where, base = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(base)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        return self.file.read_at(end - start, start) if start < end else b""


def opened(uri: str, validator: str | None = None, size: int | None = None):
    return RangeReader(uri, validator, size) if uri.startswith(REMOTE) else FileRanges(uri)


def block(text: bytes) -> bytes:
    """One block of at most 65,280 bytes of text; of none, the mark of a file's end."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(text) + press.flush()
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def block_size(data: bytes, at: int = 0) -> int | None:
    """Bytes of the block that begins at a place, or None if none begins there."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    end = at + 12 + int.from_bytes(data[at + 10 : at + 12], "little")
    at += 12
    while at + 4 <= min(end, len(data)):
        n = int.from_bytes(data[at + 2 : at + 4], "little")
        if data[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(data):
            return int.from_bytes(data[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def first_block(source, start: int, end: int) -> int:
    """The place of the first block that begins in the range, or its end. A block is one whose checksum holds."""
    if start == 0:
        return 0
    data = source.read(start, start + 2 * MOST)
    i = data.find(MAGIC)
    while 0 <= i < end - start:
        if n := block_size(data, i):
            try:
                zlib.decompress(data[i : i + n], 31)
                return start + i
            except zlib.error:
                pass
        i = data.find(MAGIC, i + 1)
    return end


def inflated(source, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the blocks from a place on."""
    data, cut = b"", 0
    while at < source.size:
        if len(data) - cut < MOST:
            known = at + len(data) - cut
            data, cut = data[cut:] + source.read(known, known + FETCH), 0
        n = block_size(data, cut)
        if n is None or len(data) - cut < n:
            raise OSError(f"no whole block at byte {at}")
        yield at, zlib.decompress(data[cut : cut + n], 31)
        at, cut = at + n, cut + n


def range_lines(source, start: int, end: int) -> Iterator[list[tuple[int, bytes]]]:
    """(offset, line) of a range, a list a block.

    The first range has the lines from its first on; others leave out what precedes their first line break. Every range reads on to the first line break behind its blocks, so
    each line is in one range however long it is.
    """
    at = first_block(source, start, end)
    if at >= end:
        return
    skip, held, held_at = start > 0, b"", 0
    for at, text in inflated(source, at):
        if at >= end and skip:
            return
        out, place = [], 0
        *whole, rest = text.split(b"\n")
        for line in whole:
            if not skip:
                out.append((held_at, held + line) if held else (at << 16 | place, line))
            skip, held, place = False, b"", place + len(line) + 1
            if at >= end:
                break
        yield out
        if at >= end and whole:
            return
        if rest:
            held, held_at = (held + rest, held_at) if held else (rest, at << 16 | place)
    if held and not skip:
        yield [(held_at, held)]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("bytesperpartition", 16 << 20))
        first = opened(self.path)
        self.size, self.validator = first.size, first.validator
        if block_size(first.read(0, 1 << 10)) is None:
            raise OSError("the file isn't block-gzipped")

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(a + self.step, self.size)) for a in range(0, self.size, self.step)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        for rows in range_lines(opened(self.path, self.validator, self.size), part.start, part.end):
            if rows:
                yield pa.RecordBatch.from_pydict({"offset": pa.array([x[0] for x in rows], pa.int64()), "value": [x[1].removesuffix(b"\r").decode() for x in rows]})


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "offset bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def text_lines(spark: SparkSession, path: str, step: int = 16 << 20) -> tuple[DataFrame, list[str]]:
    """(line_no, value) of a text file and its first HEAD_LINES lines.

    Remote files (http, https), plain or block-gzipped, and block-gzipped files of a file system are read in ranges of step bytes by as many tasks; line_no then follows the
    file without counting its lines. Other gzip files, and those of file systems that only Spark knows, are read by one task.
    """
    remote = path.startswith(REMOTE)
    uri = path if remote else qualified(spark, path)
    if not remote and not (uri.startswith(KNOWN) and path.endswith((".gz", ".bgz"))):
        return _counted(spark, path)
    source = opened(uri)
    if block_size(source.read(0, 1 << 10)) is not None:
        spark.dataSource.register(BlockSource)
        raw = spark.read.format("blocks").option("path", uri).option("bytesPerPartition", str(step)).load()
        head = b""
        for _, text in inflated(source, 0):
            head += text
            if len(head) >= HEAD_BYTES or head.count(b"\n") >= HEAD_LINES:
                break
    elif not remote:
        return _counted(spark, path)
    elif source.read(0, 2) == MAGIC[:2]:
        raise ValueError("a remote gzip file must be block-gzipped")
    else:
        spark.dataSource.register(HttpRangeSource)
        raw = spark.read.format("http_range").option("url", uri).option("bytesPerPartition", str(step)).load()
        head = source.read(0, HEAD_BYTES)
    return raw.select((F.col("offset") + 1).alias("line_no"), "value"), [x.removesuffix("\r") for x in head.decode(errors="replace").split("\n")[:HEAD_LINES]]


def _counted(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    raw = lines(spark, path)
    return raw, [r.value for r in raw.filter(F.col("line_no") <= HEAD_LINES).orderBy("line_no").collect()]
