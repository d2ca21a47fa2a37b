"""Vector files: uint32 n, uint32 dim, then n * dim little-endian numbers, as a data source that reads ranges of rows.

``fbin`` holds float32, ``ibin`` int32 (neighbours by id, nearest first), ``u8bin`` bytes. Each task opens the file at its own rows, so a
file of any size is read by many tasks with ``rows`` vectors held at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: each kind's numbers.
KINDS = {"fbin": ("<f4", pa.float32(), "float"), "ibin": ("<i4", pa.int32(), "int"), "u8bin": ("u1", pa.int16(), "smallint")}
HEADER = 8
#: Bytes of a task's range, about.
SPLIT = 64 << 20


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        files, name = fs.FileSystem.from_uri(path)
    else:
        files, name = fs.LocalFileSystem(), path
    return files, name


class _Range(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.path, self.kind = options["path"], kind
        self.first_id, self.rows, self.split = int(options.get("firstid", 0)), int(options.get("rows", 10_000)), int(options.get("split", SPLIT))
        files, name = _open(self.path)
        with files.open_input_file(name) as f:
            self.n, self.dim = struct.unpack("<II", f.read_at(HEADER, 0))
            size = f.size()
        self.width = self.dim * np.dtype(KINDS[kind][0]).itemsize
        if size < HEADER + self.n * self.width:
            raise ValueError(f"{self.path}: {self.n} vectors of {self.dim} numbers don't fit in {size} bytes")

    def partitions(self) -> list[InputPartition]:
        step = max(1, self.split // max(1, self.width))
        return [_Range(a, min(step, self.n - a)) for a in range(0, self.n, step)] or [_Range(0, 0)]

    def read(self, partition: _Range):
        number, arrow, _ = KINDS[self.kind]
        files, name = _open(self.path)
        with files.open_input_file(name) as f:
            for a in range(partition.first, partition.first + partition.count, self.rows):
                n = min(self.rows, partition.first + partition.count - a)
                data = np.frombuffer(f.read_at(n * self.width, HEADER + a * self.width), number).astype(arrow.to_pandas_dtype())
                vectors = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * self.dim, pa.array(data, arrow))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(self.first_id + a, self.first_id + a + n)), vectors], ["id", "embedding"])


class _Source(DataSource):
    kind = "fbin"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"id bigint, embedding array<{KINDS[self.kind][2]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self.kind)


class FloatFile(_Source):
    kind = "fbin"


class IntFile(_Source):
    kind = "ibin"


class ByteFile(_Source):
    kind = "u8bin"


def read_vectors(spark: SparkSession, path: str, kind: str = "fbin", first_id: int = 0, rows: int = 10_000, split: int = SPLIT) -> DataFrame:
    """One vector file as (id, embedding), numbered from ``first_id``. The path is one that all machines can open."""
    for source in (FloatFile, IntFile, ByteFile):
        spark.dataSource.register(source)
    return spark.read.format(kind).option("firstId", first_id).option("rows", rows).option("split", split).load(path)


def read_truth(spark: SparkSession, path: str, query_id: str = "query_id") -> DataFrame:
    """A file of known answers as (query id, neighbours)."""
    return read_vectors(spark, path, "ibin").withColumnsRenamed({"id": query_id, "embedding": "neighbours"})


def pack(rows: np.ndarray, kind: str = "fbin") -> bytes:
    """A vector file's bytes."""
    return struct.pack("<II", *rows.shape) + np.ascontiguousarray(rows, KINDS[kind][0]).tobytes()
