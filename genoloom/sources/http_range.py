"""A data source over HTTP byte ranges: a remote text file is cut into ranges that tasks fetch for themselves.

    spark.dataSource.register(HttpRangeSource)
    spark.read.format("http_range").option("url", ...).load()     # one row (offset, value) a line
"""

from __future__ import annotations

import urllib.request
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, CACHED = 64 << 10, 64


class RangeReader:
    """Reads a remote file in blocks, keeps the last CACHED ones, and fails if the file changes meanwhile."""

    def __init__(self, url: str, validator: str | None = None, size: int | None = None):
        self.url, self.validator, self.size = url, validator, size
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        if size is None:
            self._fetch(0)

    def _fetch(self, i: int) -> bytes:
        if i in self.blocks:
            self.blocks.move_to_end(i)
            return self.blocks[i]
        last = (i + 1) * BLOCK - 1 if self.size is None else min((i + 1) * BLOCK, self.size) - 1
        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={i * BLOCK}-{last}"})
        with urllib.request.urlopen(ask) as r:
            if r.status != 206:
                raise OSError("the server doesn't answer ranges")
            now = r.headers.get("ETag") or r.headers.get("Last-Modified")
            total = int(r.headers["Content-Range"].rpartition("/")[2])
            if self.size is not None and (total != self.size or now != self.validator):
                raise OSError("the remote file changed")
            self.size, self.validator = total, now
            data = r.read()
        if len(data) != min((i + 1) * BLOCK, total) - i * BLOCK:
            raise OSError("the server sent another length")
        self.blocks[i] = data
        if len(self.blocks) > CACHED:
            self.blocks.popitem(last=False)
        return data

    def read(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        return b"".join(self._fetch(i)[max(start - i * BLOCK, 0) : end - i * BLOCK] for i in range(start // BLOCK, -(-end // BLOCK))) if start < end else b""


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class HttpRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.step = options["url"], int(options.get("bytesperpartition", 16 << 20))
        first = RangeReader(self.url)
        self.size, self.validator = first.size, first.validator

    def partitions(self) -> list[InputPartition]:
        return [_Range(a, min(a + self.step, self.size)) for a in range(0, self.size, self.step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        """The lines that start in the range; the last one is read to its end beyond it."""
        source = RangeReader(self.url, self.validator, self.size)
        at = part.start
        held = source.read(at - 1, at) if at else b"\n"
        skip = held != b"\n"
        held, begin = b"", at
        while at < self.size:
            held += (more := source.read(at, at + BLOCK))
            at += len(more)
            while (cut := held.find(b"\n")) >= 0:
                line, held = held[:cut], held[cut + 1 :]
                if begin >= part.end:
                    return
                if not skip:
                    yield begin, line.rstrip(b"\r").decode()
                skip, begin = False, begin + cut + 1
            if begin >= part.end:
                return
        if held and not skip and begin < part.end:
            yield begin, held.rstrip(b"\r").decode()


class HttpRangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_range"

    def schema(self) -> str:
        return "offset bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return HttpRangeReader(self.options)
