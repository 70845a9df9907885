"""A data source for binary files of fixed records, split by ranges of records.

A partition is a file and a range of its records of about RANGE_BYTES; a task reads its range CHUNK_BYTES at a time. So a file
of any size is read by many tasks, and no task holds more than a chunk. Files are listed and opened by pyarrow's file systems
(local, hdfs, s3, gcs, abfs), on executors too.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20

# Layout of the acquisition system's files.
HEADER_BYTES, RECORD_SAMPLES, RECORD_MARK = 1024, 1024, 10
RECORD = np.dtype([("timestamp", "<i8"), ("n", "<u2"), ("recording", "<u2"), ("data", ">i2", RECORD_SAMPLES), ("mark", "u1", RECORD_MARK)])
EVENT = np.dtype([("timestamp", "<i8"), ("sample", "<i2"), ("kind", "u1"), ("node", "u1"), ("event", "u1"), ("channel", "u1"), ("recording", "<u2")])
# Entry types of matrix files by their code.
MATRIX_TYPES = {-2: "u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}
EVENT_NUMBERS = ["sample", "kind", "node", "event", "channel", "recording"]


@dataclass
class Layout:
    """Where a file's records begin, the bytes of one, how many there are, and what decoding needs to know from the header."""

    begin: int
    size: int
    count: int
    detail: object = None


def _arrays(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


class Continuous:
    """Channel files: a text header with the scale, then records of RECORD_SAMPLES samples."""

    pattern = "*.continuous"
    schema = "file string, channel int, block_no long, timestamp long, recording int, data array<double>"

    @staticmethod
    def channel(file: str) -> int | None:
        found = re.search(r"CH(\d+)", file.rsplit("/", 1)[-1])
        return int(found[1]) if found else None

    @staticmethod
    def layout(file: str, length: int, head) -> Layout:
        if length < HEADER_BYTES or (length - HEADER_BYTES) % RECORD.itemsize:
            raise ValueError(f"{file}: not a header and whole records")
        scale = re.search(r"bitVolts\s*=\s*([0-9.eE+-]+)", head(HEADER_BYTES).decode("latin-1"))
        return Layout(HEADER_BYTES, RECORD.itemsize, (length - HEADER_BYTES) // RECORD.itemsize, float(scale[1]) if scale else 1.0)

    @classmethod
    def decode(cls, file: str, raw: bytes, first: int, layout: Layout) -> list:
        rows = np.frombuffer(raw, RECORD)
        if (rows["n"] != RECORD_SAMPLES).any():
            raise ValueError(f"{file}: a record of another size")
        n = len(rows)
        channel = pa.array([cls.channel(file)] * n, pa.int32())
        return [pa.array([file] * n), channel, pa.array(np.arange(first, first + n)), pa.array(rows["timestamp"].astype(np.int64)), pa.array(rows["recording"].astype(np.int32)), _arrays(rows["data"] * layout.detail)]


class Events:
    """Event files: a header, then short records; a rest that isn't a whole record is left out."""

    pattern = "*.events"
    schema = "file string, event_no long, timestamp long, " + ", ".join(f"{n} int" for n in EVENT_NUMBERS)

    @staticmethod
    def layout(file: str, length: int, head) -> Layout:
        return Layout(HEADER_BYTES, EVENT.itemsize, max(0, length - HEADER_BYTES) // EVENT.itemsize)

    @staticmethod
    def decode(file: str, raw: bytes, first: int, layout: Layout) -> list:
        rows = np.frombuffer(raw, EVENT)
        return [pa.array([file] * len(rows)), pa.array(np.arange(first, first + len(rows))), pa.array(rows["timestamp"].astype(np.int64)), *(pa.array(rows[n].astype(np.int32)) for n in EVENT_NUMBERS)]


class Matrices:
    """Matrix files: a code, the size of an entry, the dimensions (64 bits each where their number is negative), entries column by column; a record is a column."""

    pattern = "*.mda"
    schema = "file string, col long, values array<double>"

    @staticmethod
    def layout(file: str, length: int, head) -> Layout:
        code, _, dims = np.frombuffer(head(12), "<i4", 3).tolist() if length >= 12 else (0, 0, 0)
        wide, count = (8, abs(dims)) if dims < 0 else (4, dims)
        if code not in MATRIX_TYPES or not 2 <= count <= 6:
            raise ValueError(f"{file}: not a matrix file")
        begin = 12 + count * wide
        size = [int(x) for x in np.frombuffer(head(begin)[12:], "<i8" if wide == 8 else "<i4", count)]
        kind = np.dtype(MATRIX_TYPES[code])
        columns = 1
        for x in size[1:]:
            columns *= x
        if length < begin + columns * size[0] * kind.itemsize:
            raise ValueError(f"{file}: shorter than its dimensions say")
        return Layout(begin, size[0] * kind.itemsize, columns if size[0] else 0, (kind, size[0]))

    @staticmethod
    def decode(file: str, raw: bytes, first: int, layout: Layout) -> list:
        kind, rows = layout.detail
        values = np.frombuffer(raw, kind).reshape(-1, rows).astype(float)
        return [pa.array([file] * len(values)), pa.array(np.arange(first, first + len(values))), _arrays(values)]


KINDS = {"continuous": Continuous, "events": Events, "matrices": Matrices}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", path)
    if scheme is None:
        return fs.LocalFileSystem(), path
    if scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Range(InputPartition):
    """Records first to last of a file."""

    file: str
    first: int
    last: int
    layout: Layout


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], KINDS[options["kind"]]
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.channels = {int(c) for c in options["channels"].split(",")} if options.get("channels") else None

    def _files(self) -> list[tuple[str, int]]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, self.kind.pattern)]
        return sorted((x.path, x.size) for x in found if self.channels is None or self.kind is not Continuous or Continuous.channel(x.path) in self.channels)

    def partitions(self) -> list[Range]:
        system, _ = _opened(self.path)
        out = []
        for file, length in self._files():
            def head(n: int, file: str = file) -> bytes:
                with system.open_input_file(file) as f:
                    return f.read_at(n, 0)

            layout = self.kind.layout(file, length, head)
            step = max(1, self.bytes // max(1, layout.size))
            out += [Range(file, a, min(a + step, layout.count), layout) for a in range(0, layout.count, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        names = [x.split()[0] for x in self.kind.schema.split(", ")]
        size = partition.layout.size
        step = max(1, CHUNK_BYTES // max(1, size))
        with system.open_input_file(partition.file) as f:
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                raw = f.read_at(n * size, partition.layout.begin + a * size)
                yield pa.RecordBatch.from_arrays(self.kind.decode(partition.file, raw, a, partition.layout), names)


class RecordSource(DataSource):
    """Options: path, kind (a key of KINDS), rangeBytes, channels (numbers with commas: only their files are read)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return KINDS[self.options["kind"]].schema

    def reader(self, schema) -> Reader:
        return Reader({**self.options, "rangeBytes": self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))})
