"""Checkpoints of length-prefixed binary columns as a Spark data source: read in pieces at known offsets, written as ordered part files.

A file is a column after another: four bytes with its number of values, then the values (int: 4 bytes, float: 4,
double: 8, little-endian).  A folder of part files is one checkpoint: in the order of their names, each part goes on where
the last one ended, column by column.  Parts lie where all executors can open them: a shared path, or any store that Arrow's
file systems reach by URI.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Types of values and their bytes (fixed values).
KINDS = {"int": "<i4", "float": "<f4", "double": "<f8"}
#: Values of a piece that one task reads.
PIECE = 1 << 20
SCHEMA = "name string, place long, value double"
RECORDS = "records.txt"


def kinds_of(text: str) -> list[tuple[str, str]]:
    """[(name, type)] of "name:type,name:type"."""
    out = [tuple(p.split(":")) for p in text.split(",") if p]
    for name, kind in out:
        if kind not in KINDS:
            raise ValueError(f"{name} has the unknown type {kind}")
    return out


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    path: str
    name: str
    kind: str
    offset: int
    count: int
    place: int


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, str]], piece: int):
        self.path, self.columns, self.piece = path, columns, piece

    def partitions(self) -> list[Piece]:
        """Pieces of all columns of all parts; of each column only its four bytes of length are read here."""
        store, path = located(self.path)
        info = store.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
        place, out = dict.fromkeys((n for n, _ in self.columns), 0), []
        for f in files:
            with store.open_input_file(f) as raw:
                at = 0
                for name, kind in self.columns:
                    raw.seek(at)
                    n, width = struct.unpack("<i", raw.read(4))[0], np.dtype(KINDS[kind]).itemsize
                    for a in range(0, n, self.piece):
                        out.append(Piece(f, name, kind, at + 4 + a * width, min(self.piece, n - a), place[name] + a))
                    at, place[name] = at + 4 + n * width, place[name] + n
        return out or [Piece("", "", "int", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.count:
            return
        store, _ = located(self.path)
        with store.open_input_file(piece.path) as raw:
            raw.seek(piece.offset)
            v = np.frombuffer(raw.read(piece.count * np.dtype(KINDS[piece.kind]).itemsize), KINDS[piece.kind]).astype(np.float64)
        for a in range(0, len(v), 65_536):
            own = v[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([piece.name] * len(own)), pa.array(np.arange(piece.place + a, piece.place + a + len(own))), pa.array(own)], names=["name", "place", "value"])


@dataclass
class Part(WriterCommitMessage):
    file: str
    size: int
    least: list
    most: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[tuple[str, str]]):
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One part: a task's rows, a column after another; a task holds its own rows."""
        held = [[] for _ in self.columns]
        for batch in iterator:
            for own, (name, kind) in zip(held, self.columns):
                own.append(batch.column(name).to_numpy(zero_copy_only=False).astype(KINDS[kind]))
        values = [np.concatenate(own) if own else np.zeros(0, KINDS[kind]) for own, (_, kind) in zip(held, self.columns)]
        store, path = located(self.path)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        part = f"part-{context.partitionId():08d}"
        name = f"{path}/.{part}.{context.taskAttemptId()}"  # until the write is committed
        with store.open_output_stream(name) as out:
            for v in values:
                out.write(struct.pack("<i", len(v)))
                out.write(v.tobytes())
        return Part(f"{name}|{path}/{part}", len(values[0]) if values else 0, [float(v.min()) if len(v) else None for v in values], [float(v.max()) if len(v) else None for v in values])

    def commit(self, messages: list[Part]) -> None:
        """Gives the parts their names, and writes the text of records: name, type, size, least and most of each column."""
        store, path = located(self.path)
        for m in messages:
            store.move(*m.file.split("|"))
        lines = []
        for k, (name, kind) in enumerate(self.columns):
            low, high = [m.least[k] for m in messages if m.least[k] is not None], [m.most[k] for m in messages if m.most[k] is not None]
            lines.append(f"{name} {kind} {sum(m.size for m in messages)} {min(low, default=0):g} {max(high, default=0):g}\n")
        with store.open_output_stream(f"{path}/{RECORDS}") as out:
            out.write("".join(lines).encode())

    def abort(self, messages: list[Part]) -> None:
        store, _ = located(self.path)
        for m in messages:
            if m:
                store.delete_file(m.file.split("|")[0])


class Columns(DataSource):
    """Format "gyre_columns"; options path, columns ("name:type,...") and, for reading, piece (values of a task)."""

    @classmethod
    def name(cls) -> str:
        return "gyre_columns"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], kinds_of(self.options["columns"]), int(self.options.get("piece", PIECE)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], kinds_of(self.options["columns"]))


def _option(columns: list[tuple[str, str]]) -> str:
    return ",".join(f"{n}:{k}" for n, k in columns)


def read_columns(spark: SparkSession, path: str, columns: list[tuple[str, str]], piece: int = PIECE) -> DataFrame:
    """(name, place, value) of a checkpoint file or folder, by as many tasks as it has pieces, however many wrote it."""
    spark.dataSource.register(Columns)
    return spark.read.format("gyre_columns").options(columns=_option(columns), piece=str(piece)).load(path)


def wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """(place, names): the columns of ``read_columns`` side by side."""
    return rows.groupBy("place").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def write_columns(rows: DataFrame, path: str, key: str, columns: list[tuple[str, str]]) -> None:
    """Writes columns in the order of a key: tasks hold ranges of it, and a task's range is a part file; the folder's old parts must be gone."""
    rows.sparkSession.dataSource.register(Columns)
    kinds = {"int": "int", "float": "float", "double": "double"}
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).selectExpr(*[f"CAST(`{n}` AS {kinds[k]}) AS `{n}`" for n, k in columns])
    ordered.write.format("gyre_columns").options(columns=_option(columns)).mode("append").save(path)
