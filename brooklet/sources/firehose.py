"""A stream of lines from files, let in at so many kilobytes a second: a data source of its own, with control rows.

    spark.dataSource.register(Firehose)
    spark.readStream.format("firehose").schema("id long, t long, control long").option("path", folder).option("rate", 512).load()

The files of the folder are one run of bytes, in the order of their names; the stream's offset is a place in it. Each micro-batch takes what the rate has let in since the one
before, at least ``least`` bytes, and is dealt over tasks in pieces of ``piece`` bytes; a line belongs to the piece in which it begins. Lines are comma-separated values in the
order of the schema's columns but ``control``, which must be the last: a line whose first value is ``*`` is a control row, and its second value is what it tells,
a time up to which the stream is complete. Missing and unreadable values are null, and so is ``control`` for data.
"""

from __future__ import annotations

import csv
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Spark looks at a data source in processes that don't get the files that workers get.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTROL = "*"
_READ = {"bigint": int, "int": int, "double": float, "string": str}


def _store(uri: str):
    from pyarrow import fs

    uri = uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def files_of(uri: str) -> list[tuple[str, int]]:
    """Path and size of the folder's files, in the order of their names."""
    from pyarrow import fs

    store, path = _store(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def pieces(files: list[tuple[str, int]], start: int, end: int, most: int) -> list[Piece]:
    """The bytes from ``start`` to ``end`` of all files in pieces of one file and ``most`` bytes at the utmost."""
    out, base = [], 0
    for path, size in files:
        at, to = max(start - base, 0), min(end - base, size)
        while at < to:
            out.append(Piece(path, at, min(at + most, to)))
            at += most
        base += size
    return out


def lines(file, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end)."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    while at < end and (line := file.readline()):
        at += len(line)
        yield line


class Reader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.uri = options["path"]
        self.rate, self.least, self.piece = (int(float(options.get(k, v))) for k, v in (("rate", 1 << 20), ("least", 1 << 16), ("piece", 1 << 23)))
        self.kinds = [f.dataType.simpleString() for f in schema.fields[:-1]]
        if unknown := set(self.kinds) - set(_READ):
            raise ValueError(f"a firehose has no column of type {sorted(unknown)}")
        self.let_in: int | None = None
        self.since = time.monotonic()

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        now, there = time.monotonic(), sum(size for _, size in files_of(self.uri))
        if self.let_in is None:  # a stream that goes on has been let in up to where it starts, of which it tells in ``partitions``
            self.let_in = 0
        self.let_in = min(there, self.let_in + max(self.least, int((now - self.since) * self.rate * 1024)))
        self.since = now
        return {"at": self.let_in}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.let_in = max(self.let_in or 0, end["at"])
        return pieces(files_of(self.uri), start["at"], end["at"], self.piece)

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Piece) -> Iterator[tuple]:
        store, _ = _store(self.uri)
        with store.open_input_file(partition.path) as file:
            for values in csv.reader(line.decode("utf-8", "replace") for line in lines(_Lines(file), partition.start, partition.end)):
                if values and values[0] == CONTROL:
                    yield (*[None] * len(self.kinds), _value("bigint", values[1] if len(values) > 1 else ""))
                elif values:
                    yield (*[_value(k, values[i] if i < len(values) else "") for i, k in enumerate(self.kinds)], None)


def _value(kind: str, text: str):
    try:
        return _READ[kind](text) if text != "" else None
    except ValueError:
        return None


class _Lines:
    """Lines of a file that is read in blocks."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.held = file, block, b""

    def seek(self, at: int) -> None:
        self.file.seek(at)
        self.held = b""

    def readline(self) -> bytes:
        cut = self.held.find(b"\n")
        while cut < 0:
            more = self.file.read(self.block)
            if not more:
                break
            before = len(self.held)
            self.held += more
            cut = self.held.find(b"\n", before)
        line, self.held = (self.held, b"") if cut < 0 else (self.held[: cut + 1], self.held[cut + 1 :])
        return line


class Firehose(DataSource):
    @classmethod
    def name(cls) -> str:
        return "firehose"

    def streamReader(self, schema: T.StructType) -> Reader:
        if schema.fieldNames()[-1:] != ["control"]:
            raise ValueError("the last column of a firehose is control")
        return Reader(schema, dict(self.options))
