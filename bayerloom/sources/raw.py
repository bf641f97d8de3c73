"""Headerless frames from files."""

from __future__ import annotations

import bisect
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..frames import ALL, Interpretation, described, read_by, tolerant
from ..numbering import numbered

#: Marks of the seekable zstd format.
SEEK_TABLE, SEEK_END = 0x184D2A5E, 0x8F92EAB1


class _Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class NumberFilter:
    """The frame numbers that are asked for: a range, and a set of them if one was given."""

    def __init__(self, options: dict | None = None):
        self.low, self.high, self.only = int((options or {}).get("first", 0)), int((options or {}).get("end", ALL)), None

    def take(self, filters: list[Filter]) -> list[Filter]:
        """Takes the filters on frame_no that it can keep exactly; gives the others back."""
        return [f for f in filters if not (f.attribute == ("frame_no",) and self._taken(f))] if filters else []

    def _taken(self, f: Filter) -> bool:
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            self._among({v for v in f.value if v is not None})
        elif getattr(f, "value", None) is None:
            return False
        elif isinstance(f, (EqualTo, EqualNullSafe)):
            self._among({f.value})
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThan):
            self.high = min(self.high, f.value)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value + 1)
        else:
            return False
        return True

    def _among(self, values: set[int]) -> None:
        self.only = values if self.only is None else self.only & values

    def spans(self, n: int, most: int) -> list[tuple[int, int]]:
        """Runs of at most `most` of the numbers that are left of 0 .. n - 1."""
        low, high = max(self.low, 0), min(self.high, n)
        if self.only is None:
            return [(k, min(high, k + most)) for k in range(low, high, most)]
        runs: list[tuple[int, int]] = []
        for k in sorted(v for v in self.only if low <= v < high):
            if runs and runs[-1][1] == k and k - runs[-1][0] < most:
                runs[-1] = (runs[-1][0], k + 1)
            else:
                runs.append((k, k + 1))
        return runs


class _BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.frame_bytes = options["path"], int(options["frame_bytes"])
        self.per_span = max(1, int(options.get("span_bytes", 64 << 20)) // self.frame_bytes)
        self.numbers = NumberFilter(options)

    def partitions(self) -> list[InputPartition]:
        n = os.path.getsize(self.path) // self.frame_bytes
        return [_Span(a, b) for a, b in self.numbers.spans(n, self.per_span)] or [_Span(0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            file.seek(partition.first * self.frame_bytes)
            for k in range(partition.first, partition.last):
                yield k, file.read(self.frame_bytes)


class _TakesFilters:
    """Of a reader with `numbers`: Spark's filters on frame_no choose what is read.

    Spark refuses such readers unless the session has pushdown to Python sources
    on, and keeps one reader for all scans of what was loaded: two scans of it
    with different filters in one query both read what the last one asks for.
    So this is for frames that a query scans once; frames.chosen has no such limit.
    """

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self.numbers.take(filters)


class _FilteredBlobReader(_TakesFilters, _BlobReader):
    pass


class BlobSource(DataSource):
    """One file of equal frames, read in byte ranges; a rest that is no whole frame is left out.

    Options first and end: the range of frames that is read. filters = true: filters on frame_no (comparisons with numbers, sets of them) choose too.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_blob"

    def schema(self) -> str:
        return "frame_no long, data binary"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredBlobReader if self.options.get("filters") == "true" else _BlobReader
        return kind(self.options)


def _loaded(spark: SparkSession, source: type[DataSource], path: str, interpretation: Interpretation, push_filters: bool) -> DataFrame:
    spark.dataSource.register(source)
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "frame_bytes": interpretation.frame_bytes, "filters": str(push_filters).lower()}

    def load(first: int, end: int) -> DataFrame:
        return described(spark.read.format(source.name()).options(**options, first=first, end=end).load(), interpretation)

    return read_by(load)


def read_blob(spark: SparkSession, path: str, interpretation: Interpretation, push_filters: bool = False) -> DataFrame:
    """The frames of a blob.

    push_filters: filters on frame_no choose the byte ranges that are read. For
    frames that a query scans once, see _TakesFilters; turns on Spark's filter
    pushdown to Python sources in the session.
    """
    return _loaded(spark, BlobSource, path, interpretation, push_filters)


BROADCAST_FILES = 100_000  # names of some hundred bytes


def numbered_files(spark: SparkSession, pattern: str) -> tuple[DataFrame, int]:
    """(path, content, frame_no) of the files, numbered from 0 in the order of paths, and how many there are.

    Only names are put in order. The numbers are broadcast, so that contents
    stay where they are read, up to BROADCAST_FILES files; beyond, files are
    dealt by name.
    """
    files = spark.read.format("binaryFile").load(pattern)
    names, n = numbered(files.select("path"), "path", "frame_no")
    return files.select("path", "content").join(F.broadcast(names) if n <= BROADCAST_FILES else names, "path"), n


def read_directory(spark: SparkSession, pattern: str, interpretation: Interpretation, loop: int = 1, keep_going: bool = False) -> DataFrame:
    """One frame per file, numbered in the order of paths; longer files are cut.

    Shorter ones end the query, or, with keep_going, become frames with an error.
    loop: how often the sequence is gone through.
    """
    size = interpretation.frame_bytes
    files, n = numbered_files(spark, pattern)
    enough, short = F.length("content") >= size, F.concat(F.lit("the file is shorter than a frame: "), F.col("path"))
    data = F.when(enough, F.substring("content", 1, size))
    frames = files.select("frame_no", (data if keep_going else data.otherwise(F.raise_error(short).cast("binary"))).alias("data"), F.when(~enough, short).alias("error"))
    if loop > 1:
        from ..operators.selecting import internal_loop

        frames = internal_loop(frames, loop, n)
    if not keep_going:
        return described(frames, interpretation)
    return tolerant(described(frames, interpretation, "error"))


def seek_table(path: str) -> list[tuple[int, int, int, int]] | None:
    """(place, size, place and size of what it holds) of each compressed frame, where the file ends with a table of them."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        if size < 17:
            return None
        file.seek(size - 9)
        n, flags, mark = struct.unpack("<IBI", file.read(9))
        width = 12 if flags & 0x80 else 8
        if mark != SEEK_END or flags & 0x7C or size < n * width + 17:
            return None
        file.seek(size - 17 - n * width)
        head, length = struct.unpack("<II", file.read(8))
        if head != SEEK_TABLE or length != n * width + 9:
            return None
        table = np.frombuffer(file.read(n * width), "<u4").reshape(n, width // 4).astype(np.int64)
    ends = np.cumsum(table[:, :2], axis=0)
    return [tuple(row) for row in np.stack([ends[:, 0] - table[:, 0], table[:, 0], ends[:, 1] - table[:, 1], table[:, 1]], axis=1).tolist()]


class _Blocks(InputPartition):
    """Frames first .. last - 1, and the compressed frames that hold them; none: the file is read from its beginning."""

    def __init__(self, first: int, last: int, blocks: list[tuple[int, int, int, int]] | None):
        self.first, self.last, self.blocks = first, last, blocks


class _ZstdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.frame_bytes = options["path"], int(options["frame_bytes"])
        self.per_span = max(1, int(options.get("span_bytes", 64 << 20)) // self.frame_bytes)
        self.numbers = NumberFilter(options)

    def partitions(self) -> list[InputPartition]:
        table = seek_table(self.path)
        if table is None:
            return [_Blocks(0, ALL, None)]
        size = self.frame_bytes
        begins = [b[2] for b in table]
        out = []
        for first, last in self.numbers.spans((table[-1][2] + table[-1][3]) // size if table else 0, self.per_span):
            a, b = bisect.bisect_right(begins, first * size) - 1, bisect.bisect_left(begins, last * size)
            out.append(_Blocks(first, last, table[a:b]))
        return out or [_Blocks(0, 0, [])]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        import zstandard

        size = self.frame_bytes
        with open(self.path, "rb") as file:
            if partition.blocks is None:
                with zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True) as stream:
                    left = self.numbers.spans(ALL, ALL)
                    number, stop = 0, max((b for _, b in left), default=0)
                    while number < stop:
                        data = b""
                        while len(data) < size and (more := stream.read(size - len(data))):
                            data += more
                        if len(data) < size:
                            break
                        if any(a <= number < b for a, b in left):
                            yield number, data
                        number += 1
                return
            held, at, number = b"", partition.blocks[0][2] if partition.blocks else 0, partition.first
            unpacker = zstandard.ZstdDecompressor()
            for place, length, _, whole_size in partition.blocks:
                file.seek(place)
                held += unpacker.decompress(file.read(length), max_output_size=whole_size) if whole_size else b""
                while number < partition.last and len(held) >= (number + 1) * size - at:
                    yield number, held[number * size - at : (number + 1) * size - at]
                    number += 1
                done = min(max(number * size - at, 0), len(held))
                held, at = held[done:], at + done


class _FilteredZstdReader(_TakesFilters, _ZstdReader):
    pass


class ZstdSource(DataSource):
    """One compressed file of equal frames. Where it ends with a table of its compressed frames, parts are read side by side; filters are as for blobs."""

    @classmethod
    def name(cls) -> str:
        return "zstd_blob"

    def schema(self) -> str:
        return "frame_no long, data binary"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredZstdReader if self.options.get("filters") == "true" else _ZstdReader
        return kind(self.options)


def read_zstd(spark: SparkSession, path: str, interpretation: Interpretation, push_filters: bool = False) -> DataFrame:
    """The frames of a zstd file: side by side if it is seekable, as write_blob makes them; else one task reads the stream."""
    return _loaded(spark, ZstdSource, path, interpretation, push_filters)
