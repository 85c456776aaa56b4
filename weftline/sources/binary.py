"""Data sources for three binary layouts, split on record boundaries, and writers of two of them.

``pkz``: zlib streams of UTF-8 documents back to back, with a ``.idx`` file of their lengths as little-endian int32.
``fixed_records``: records of one length. ``record_stream``: length-prefixed messages with a url, a body and a text.
Paths may be folders, globs or lists, local or of any store that pyarrow opens.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.shared import ship_by_value


def _store(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _files(path: str, leave_out: str = ".idx") -> list[tuple[str, int]]:
    """(uri, bytes) of the data files of a path, in order; hidden files and sidecars are left out."""
    out = []
    for one in path.split(","):
        scheme = one[: len(one) - len(one.split("://", 1)[1])] if "://" in one else ""
        store, at = _store(one)
        if any(c in at for c in "*?["):
            top = at[: min(at.index(c) for c in "*?[" if c in at)].rpartition("/")[0]
            found = [f for f in store.get_file_info(pafs.FileSelector(top, recursive=True)) if fnmatch.fnmatch(f.path, at)]
        else:
            info = store.get_file_info(at)
            found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
        names = [f for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and not f.path.endswith(leave_out)]
        out += [(scheme + f.path, f.size) for f in sorted(names, key=lambda f: f.path)]
    return out


def plan_splits(lengths: list[int] | np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first record, records): a record joins a split while the split stays below ``most`` or is empty."""
    upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    out, first = [], 0
    while first < len(lengths):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + most, "left")) - 1)
        out.append((first, end - first))
        first = end
    return out


@dataclass
class _Records(InputPartition):
    """Records ``first`` to ``first + count`` of a file, which begin at byte ``start``; ``base``: bytes of the files before it."""

    uri: str
    first: int
    count: int
    start: int
    base: int


class PkzReader(DataSourceReader):
    """Options: bytesPerSplit (64 MiB), onCorrupt (fail, skip, stop_split)."""

    def __init__(self, options: dict):
        self.path, self.most, self.bad = options["path"], int(options.get("bytespersplit", 64 << 20)), options.get("oncorrupt", "fail").lower()
        if self.bad not in ("fail", "skip", "stop_split"):
            raise ValueError(f"onCorrupt: {self.bad}")

    def partitions(self) -> list[InputPartition]:
        out, base = [], 0
        for uri, size in _files(self.path):
            store, at = _store(uri)
            with store.open_input_file(at + ".idx") as f:
                lengths = np.frombuffer(f.read(), "<i4")
            starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            out += [_Records(uri, a, n, int(starts[a]), base) for a, n in plan_splits(lengths, self.most)]
            base += size
        return out

    def read(self, partition: _Records) -> Iterator[tuple]:
        store, at = _store(partition.uri)
        with store.open_input_file(at + ".idx") as f:  # its own slice of the index
            f.seek(4 * partition.first)
            lengths = np.frombuffer(f.read(4 * partition.count), "<i4").tolist()
        with store.open_input_file(at) as f:
            f.seek(partition.start)
            offset = partition.base + partition.start
            for n in lengths:
                raw = f.read(n)
                try:
                    yield offset, zlib.decompress(raw).decode("utf-8")
                except (zlib.error, UnicodeDecodeError):
                    if self.bad == "fail":
                        raise
                    if self.bad == "stop_split":
                        return
                offset += n


class PkzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pkz"

    def schema(self) -> str:
        return "offset long, document string"

    def reader(self, schema) -> DataSourceReader:
        return PkzReader(self.options)


@dataclass
class _Range(InputPartition):
    uri: str
    first: int
    count: int


class FixedReader(DataSourceReader):
    """Options: recordBytes (required), bytesPerSplit (128 MiB, rounded down to whole records). A torn last record raises."""

    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options["recordbytes"])
        self.per = max(1, int(options.get("bytespersplit", 128 << 20)) // self.n)

    def partitions(self) -> list[InputPartition]:
        out = []
        for uri, size in _files(self.path):
            if size % self.n:
                raise ValueError(f"{uri}: {size} bytes are no whole number of records of {self.n}")
            total = size // self.n
            out += [_Range(uri, a, min(self.per, total - a)) for a in range(0, total, self.per)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, at = _store(partition.uri)
        with store.open_input_file(at) as f:
            f.seek(partition.first * self.n)
            for _ in range(partition.count):
                yield (f.read(self.n),)


class FixedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema) -> DataSourceReader:
        return FixedReader(self.options)


def parse_message(raw: bytes) -> tuple[str | None, str | None, str | None]:
    """Fields 1 to 3 (url, body, text) of a message; other fields are skipped, absent ones are null."""
    got: dict[int, bytes] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            varint()
        elif kind == 2:
            n = varint()
            got[tag >> 3] = raw[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")
    return tuple(got[i].decode("utf-8") if i in got else None for i in (1, 2, 3))


def format_message(url: str, body: str | None = None, text: str | None = None) -> bytes:
    out = b""
    for i, value in ((1, url), (2, body), (3, text)):
        if value is not None:
            data, n = value.encode("utf-8"), b""
            size = len(data)
            while size > 127:
                n, size = n + bytes([size & 127 | 128]), size >> 7
            out += bytes([i << 3 | 2]) + n + bytes([size]) + data
    return out


class StreamReader(DataSourceReader):
    """One partition per file, as neither framing nor gzip can be entered in the middle."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Range(uri, 0, 0) for uri, _ in _files(self.path)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, at = _store(partition.uri)
        with store.open_input_file(at) as raw:
            f = gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else io.BufferedReader(raw) if hasattr(raw, "readinto") else raw
            while head := f.read(4):
                size = struct.unpack("<i", head)[0] if len(head) == 4 else -1
                body = f.read(max(size, 0))
                if size < 0 or len(body) != size:
                    raise ValueError(f"{partition.uri}: the last record is torn")
                yield parse_message(body)


class StreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_stream"

    def schema(self) -> str:
        return "url string, body string, text string"

    def reader(self, schema) -> DataSourceReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the three formats known to ``spark.read.format``."""
    ship_by_value(sys.modules[__name__])
    for source in (PkzSource, FixedSource, StreamSource):
        spark.dataSource.register(source)


def _write_whole(store, name: str, fill) -> None:
    """A file under its name once it is whole, so that a task that runs twice never leaves or overwrites half of one."""
    aside = f"{name.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        fill(f)
    store.move(aside, name)


def write_pkz(df: DataFrame, uri: str, column: str = "text") -> int:
    """Writes a packed file and its index per partition; null documents are empty ones. Returns the documents written."""
    ship_by_value(sys.modules[__name__])

    def write(batches):
        from pyspark import TaskContext

        store, at = _store(uri)
        store.create_dir(at, recursive=True)
        name, lengths = f"{at}/part-{TaskContext.get().partitionId():06d}.pkz", []

        def fill(f):
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    raw = zlib.compress((text or "").encode("utf-8"))
                    lengths.append(len(raw))
                    f.write(raw)

        _write_whole(store, name, fill)
        _write_whole(store, name + ".idx", lambda f: f.write(np.array(lengths, "<i4").tobytes()))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(lengths)], pa.int64())})

    return df.select(column).mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0


def write_messages(df: DataFrame, uri: str) -> int:
    """Writes url, body and text as length-prefixed messages, a file per partition. Returns the messages written."""
    ship_by_value(sys.modules[__name__])

    def write(batches):
        from pyspark import TaskContext

        store, at = _store(uri)
        store.create_dir(at, recursive=True)
        n = 0

        def fill(f):
            nonlocal n
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    message = format_message(*row)
                    f.write(struct.pack("<i", len(message)) + message)
                    n += 1

        _write_whole(store, f"{at}/part-{TaskContext.get().partitionId():06d}.bin", fill)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select("url", "body", "text").mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0


def write_fixed(df: DataFrame, uri: str, column: str = "record") -> int:
    """Writes records of equal length back to back, a file per partition. Returns the records written."""
    ship_by_value(sys.modules[__name__])

    def write(batches):
        from pyspark import TaskContext

        store, at = _store(uri)
        store.create_dir(at, recursive=True)
        n = 0

        def fill(f):
            nonlocal n
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    f.write(record)
                    n += 1

        _write_whole(store, f"{at}/part-{TaskContext.get().partitionId():06d}.bin", fill)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select(column).mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0
