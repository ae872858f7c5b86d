"""Files behind http(s): read by byte ranges (text) or row groups (Parquet), a task each.

Tasks copy their part once into the folder that all executors reach; what is analysed is
the copy, so that the passes of a profile don't ask the server again. A server that gives no
ranges is read by one task.
"""

from __future__ import annotations

import csv
import io
import os
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import scratch

#: Bytes of a range, of the head that tells what a file is, and that a task asks for at once.
RANGE, HEAD, CHUNK, TIMEOUT = 32 << 20, 64 << 10, 1 << 20, 60


def size_of(url: str) -> tuple[int | None, bool]:
    """(bytes, whether the server gives ranges)."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": "bytes=0-0"}), timeout=TIMEOUT) as r:
        if r.status == 206:
            total = r.headers.get("Content-Range", "").rpartition("/")[2]
            return (int(total), True) if total.isdigit() else (None, False)
        length = r.headers.get("Content-Length")
        return int(length) if length else None, False


def ranged(url: str, first: int, after: int) -> bytes:
    request = urllib.request.Request(url, headers={"Range": f"bytes={first}-{after - 1}"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
        return r.read() if r.status == 206 else r.read(after)[first:]


class Ranges(io.RawIOBase):
    """A file of which only what is asked for is fetched."""

    def __init__(self, url: str, size: int):
        self.url, self.size, self.at = url, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        n = min(len(into), self.size - self.at)
        if n <= 0:
            return 0
        data = ranged(self.url, self.at, self.at + n)
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def lines_of(url: str, first: int, after: int | None, size: int | None) -> Iterator[bytes]:
    """Lines that begin in [first, after): the one that `first` cuts belongs to the range before. after None: all."""
    if after is None:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
            yield from (line.rstrip(b"\r\n") for line in r)
        return
    # From the byte before on, a line that begins at `first` is told from one that is cut there.
    at = max(first - 1, 0)
    whole = io.BufferedReader(Ranges(url, size), CHUNK)
    whole.seek(at)
    if first:
        at += len(whole.readline())
    while at < after:
        line = whole.readline()
        if not line:
            return
        at += len(line)
        yield line.rstrip(b"\r\n")


class Part(InputPartition):
    def __init__(self, first: int, after: int | None):
        self.first, self.after = first, after


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.skip, self.whole = options["path"], int(options.get("skip", 0)), options.get("whole") == "true"
        self.range = int(options.get("range", RANGE))
        self.size, self.ranges = size_of(self.url)

    def partitions(self) -> list[Part]:
        if not self.ranges or self.whole:
            return [Part(0, None)]
        return [Part(a, min(a + self.range, self.size)) for a in range(0, self.size, self.range)] or [Part(0, None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for i, line in enumerate(lines_of(self.url, part.first, part.after, self.size)):
            if part.first == 0 and i < self.skip:
                continue
            held.append(line.decode("utf-8", "replace").removeprefix("﻿"))
            n += len(line)
            if n >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


class Lines(DataSource):
    """Lines of a text file at a URL; options: path, skip (first lines), whole (no ranges), range (bytes of one)."""

    @classmethod
    def name(cls) -> str:
        return "riskloom_http_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


def open_parquet(url: str):
    import pyarrow.parquet as pq

    size, ranges = size_of(url)
    if size is not None and ranges:
        return pq.ParquetFile(pa.PythonFile(io.BufferedReader(Ranges(url, size), CHUNK), mode="r"))
    with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
        return pq.ParquetFile(pa.BufferReader(r.read()))


class GroupReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["path"]

    def partitions(self) -> list[Part]:
        return [Part(g, None) for g in range(open_parquet(self.url).num_row_groups)] or [Part(-1, None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first >= 0:
            yield from open_parquet(self.url).iter_batches(row_groups=[part.first])


class Groups(DataSource):
    """Rows of a Parquet file at a URL, a task a row group."""

    @classmethod
    def name(cls) -> str:
        return "riskloom_http_parquet"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(open_parquet(self.options["path"]).schema_arrow)

    def reader(self, schema) -> DataSourceReader:
        return GroupReader(self.options)


def read_url(spark: SparkSession, url: str, range_bytes: int = RANGE) -> DataFrame:
    """A file by the suffix of its path, as read_path() reads it."""
    from .load import DELIMITED, JSON, json_is_one, quoted_breaks, read_delimited, sniff

    suffix = os.path.splitext(urlsplit(url).path.rstrip("/"))[1].lower()
    if suffix not in (".parquet", *DELIMITED, *JSON):
        raise ValueError(f"unsupported file type {suffix or url!r}; use .csv, .tsv, .txt, .parquet or .json")
    for source in (Lines, Groups):
        spark.dataSource.register(source)
    if suffix == ".parquet":
        return scratch.kept(spark.read.format(Groups.name()).load(url), "fetched")
    head = ranged(url, 0, HEAD).decode("utf-8", "replace").removeprefix("﻿").splitlines()
    head = head[: max(1, len(head) - 1)][:50]
    if suffix in JSON:
        one = json_is_one(head)
        lines = spark.read.format(Lines.name()).options(whole=str(one).lower(), range=range_bytes).load(url)
        # One value over many lines is one document, of one line again.
        return spark.read.json(scratch.kept_lines(lines.coalesce(1) if one else lines, "fetched"), multiLine=one)
    delimiter, header = sniff(head, suffix)
    broken = quoted_breaks(head)
    lines = spark.read.format(Lines.name()).options(skip="0" if broken else str(int(header)), whole=str(broken).lower(), range=range_bytes).load(url)
    where = scratch.kept_lines(lines.coalesce(1) if broken else lines, "fetched")
    if broken:
        return read_delimited(spark, where, delimiter, header, True)
    rows = read_delimited(spark, where, delimiter, False, False)
    names = next(csv.reader(head, delimiter=delimiter), [])
    return rows.toDF(*names) if header and len(names) == len(rows.columns) else rows
