"""Sequences to and from FASTA text, and a data source of that format."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from contagraph.functions.columns import BASES, WORD, bases, unpack, wrapped
from contagraph.plans.shared import copy_parts, scratch

#: Bytes of a split, and records of a batch that a reader hands on.
SPLIT, BATCH = 32 << 20, 1_000
SCHEMA = "node string, words array<bigint>, length int"
_CODE = np.full(256, 255, np.uint8)
_CODE[list(BASES.encode())] = range(4)


def fasta_records(packed_rows: DataFrame, words: str = "words", width: int = 100) -> DataFrame:
    """idx, record: the name line and the bases, `width` a line."""
    text = bases(unpack(F.col(words), F.col("length")))
    return packed_rows.select("idx", F.concat(F.lit(">"), F.col("node").cast("string"), F.lit("\n"), wrapped(text, width)).alias("record"))


def write_fasta(packed_rows: DataFrame, path: str, words: str = "words", partitions: int | None = None) -> None:
    """A folder of text files whose names sort in the order of idx."""
    rows = fasta_records(packed_rows, words)
    ordered = rows.repartitionByRange(partitions, "idx") if partitions else rows.repartitionByRange("idx")
    ordered.sortWithinPartitions("idx").select("record").write.text(path)


def write_fasta_file(packed_rows: DataFrame, path: str, words: str = "words") -> None:
    """One file, of the driver's machine or of a URI: tasks write their parts of the order to the shared folder, the file is these one after the other."""
    parts = scratch(packed_rows.sparkSession, "fasta-parts")
    write_fasta(packed_rows, parts, words)
    copy_parts(packed_rows.sparkSession, parts, path)


def pack_bases(text: bytes) -> np.ndarray:
    """Words of a sequence of A, C, G and T, as pack() makes them."""
    codes = _CODE[np.frombuffer(text, np.uint8)]
    if (codes > 3).any():
        raise ValueError(f"a sequence has a letter other than {BASES}")
    padded = np.zeros(-(-len(codes) // WORD) * WORD, np.uint64)
    padded[: len(codes)] = codes
    shifts = np.arange(62, -2, -2, dtype=np.uint64)
    return np.bitwise_or.reduce(padded.reshape(-1, WORD) << shifts, axis=1).view(np.int64) if len(codes) else np.zeros(0, np.int64)


def unpack_words(words: np.ndarray, length: int) -> str:
    """The bases again."""
    shifts = np.arange(62, -2, -2, dtype=np.uint64)
    codes = (words.view(np.uint64)[:, None] >> shifts & np.uint64(3)).ravel()[:length]
    return np.frombuffer(BASES.encode(), np.uint8)[codes].tobytes().decode()


def _located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else (pyarrow.fs.LocalFileSystem(), path)


class FastaSource(DataSource):
    """FASTA files (node, words, length), to be registered by register_fasta() and used as format "fasta".

    A file is read in splits of `split` bytes: a record belongs to the split that its > lies in. What is written becomes
    visible when all tasks have ended: they write files of names that readers pass over, and the commit renames those of
    the attempts that counted. Paths are those of Arrow's file systems; all tasks must reach them.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FastaWriter(self.options["path"], overwrite, int(self.options.get("width", 100)))


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Split]:
        fs, path = _located(self.path)
        found = fs.get_file_info(path)
        files = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=False))
        files = sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Split(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.list_(pa.int64()), pa.int32())
        rows: list[tuple] = []
        with _located(self.path)[0].open_input_file(partition.path) as f:
            for name, text in _records(f, partition.start, partition.end):
                rows.append((name, pack_bases(text), len(text)))
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["node", "words", "length"])
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["node", "words", "length"])


def _records(f, start: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[str, bytes]]:
    """Names and bases of the records whose > at the start of a line lies in start..end."""
    f.seek(max(0, start - 1))
    held, at = bytearray(b"" if start else b"\n"), start - 1  # at: the place of the first byte held
    looked, inside = 0, False
    while True:
        found = held.find(b"\n>", looked)
        if found < 0:
            looked = max(0, len(held) - 1)
            more = f.read(piece) if inside or at + looked < end else b""
            held += more
            if more:
                continue
        if inside:
            name, _, body = bytes(held if found < 0 else held[: found + 1]).partition(b"\n")
            yield name[1:].rstrip(b"\r").decode(), body.translate(None, b"\r\n \t")
        if found < 0 or at + found + 1 >= end:
            return
        del held[: found + 1]
        at, looked, inside = at + found + 1, 0, True


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class FastaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, width: int) -> None:
        self.path, self.overwrite, self.width = path, overwrite, width

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = _located(self.path)
        fs.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.fa"
        with fs.open_output_stream(f"{path}/_{name}") as out:
            for batch in batches:
                for node, words, length in zip(batch.column("node").to_pylist(), batch.column("words"), batch.column("length").to_pylist()):
                    text = unpack_words(words.values.to_numpy(), length)
                    lines = "\n".join(text[i : i + self.width] for i in range(0, max(1, len(text)), self.width))
                    out.write(f">{node}\n{lines}\n".encode())
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, path = _located(self.path)
        names = {m.name for m in messages if m is not None}
        fs.create_dir(path, recursive=True)
        for f in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=False)):
            if self.overwrite and f.is_file and not f.base_name.startswith("_"):
                fs.delete_file(f.path)
        for name in sorted(names):
            fs.move(f"{path}/_{name}", f"{path}/{name}")

    def abort(self, messages: list) -> None:
        fs, path = _located(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{path}/_{m.name}")


def register_fasta(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
