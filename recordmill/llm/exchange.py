"""Columnar exchange: records shuffled as binary blocks.

A task sorts its records by target partition and sends each target one block, so that a shuffle
of hundreds of millions of small records costs Spark one row per (task, target). Blocks are
addressed by ``repartitionById``; the shuffle itself, its spilling and its recovery stay Spark's.
Fixed-width records travel as numpy bytes, rows of any other kind as compressed Arrow tables.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordmill.llm import textkit as tk

FLUSH_BYTES = 16 << 20
TABLE_BYTES = 8 << 20
BLOCKS = "part int, block binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.binary())])
SPOOL_BYTES = 32 << 20
TABLES = "part int, kind int, block binary"
_TABLES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def parts(df: DataFrame, factor: float = 2.0) -> int:
    """Targets in proportion to the input's splits, so that a target's share doesn't grow with the input."""
    return max(8, int(df.rdd.getNumPartitions() * factor))


def target(key: np.ndarray, targets: int) -> np.ndarray:
    return (tk.mix(key.astype(np.uint64)) % np.uint64(targets)).astype(np.int32)


class Outbox:
    """Collects records and gives them out as blocks by target."""

    def __init__(self, targets: int, place: Callable[[np.ndarray, int], np.ndarray] = target):
        self.targets, self.place = targets, place
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append((self.place(key, self.targets), records))
            self.size += records.nbytes
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part = np.concatenate([p for p, _ in self.held])
        records = np.concatenate([r for _, r in self.held])
        self.held, self.size = [], 0
        order = np.argsort(part, kind="stable")
        part, records = part[order], records[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(part))
        blocks = [records[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blocks, pa.binary())], schema=_SCHEMA)


class Spool:
    """Records of a task by bucket. Beyond SPOOL_BYTES they wait in a file in Spark's local folder, which has no name and so ends with the task."""

    def __init__(self, dtype: np.dtype, buckets: int):
        self.dtype, self.counts = dtype, np.zeros(buckets, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.end, self.file = 0, 0, None
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each writing: buckets, places in the file, numbers

    def add(self, bucket: np.ndarray, records: np.ndarray) -> None:
        self.counts += np.bincount(bucket, minlength=len(self.counts))
        self.held.append((bucket, records))
        self.size += records.nbytes
        if self.size >= SPOOL_BYTES:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        bucket = np.concatenate([b for b, _ in self.held])
        order = np.argsort(bucket, kind="stable")
        number = np.bincount(bucket, minlength=len(self.counts))
        some = np.flatnonzero(number)
        self.parts.append((some, self.end + (np.cumsum(number) - number)[some] * self.dtype.itemsize, number[some]))
        self.end += self.file.write(np.concatenate([r for _, r in self.held])[order].tobytes())
        self.held, self.size = [], 0

    def take(self, low: int, high: int) -> np.ndarray:
        """The records of buckets from low up to high."""
        out = [r[(b >= low) & (b < high)] for b, r in self.held]
        if self.file is not None:
            self.file.flush()
        for some, at, number in self.parts:
            i, j = np.searchsorted(some, (low, high))
            if i < j:  # they are next to each other
                out.append(np.frombuffer(os.pread(self.file.fileno(), int(number[i:j].sum()) * self.dtype.itemsize, int(at[i])), self.dtype))
        return np.concatenate(out) if out else np.zeros(0, self.dtype)

    def close(self) -> None:
        self.held, self.parts = [], []
        if self.file is not None:
            self.file.close()


def send(df: DataFrame, targets: int, make: Callable[..., tuple[np.ndarray, np.ndarray]], size: int | None = None, state: Callable | None = None, place: Callable[[np.ndarray, int], np.ndarray] = target) -> DataFrame:
    """Blocks of the records that ``make`` gives, as (key, records), for each batch of df, or each slice of about ``size`` bytes of its texts; ``state`` makes what is handed on from slice to slice of a task, ``place`` the targets of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(targets, place)
        more = (state(),) if state else ()
        for batch in batches:
            for part in [batch] if size is None else tk.chunks(batch, size=size):
                if part.num_rows:
                    yield from out.add(*make(part, *more))
        yield from out.flush()

    return tk.arrow(df, run, BLOCKS).repartitionById(targets, "part")


def receive(blocks: DataFrame, dtype: np.dtype, work: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` once over all records of each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b.as_buffer(), dtype) for batch in batches for b in batch.column(1)]
        if held:
            yield from work(np.concatenate(held))

    return tk.arrow(blocks, run, schema)


def table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


class TableBox:
    """Collects rows and gives them out by target as compressed Arrow tables of a kind."""

    def __init__(self, targets: int, kind: int = 0):
        self.targets, self.kind = targets, kind
        self.held: list[tuple[np.ndarray, pa.RecordBatch]] = []
        self.size = 0

    def add(self, key: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            self.held.append((target(key, self.targets), rows))
            self.size += rows.nbytes
        if self.size >= TABLE_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part = np.concatenate([p for p, _ in self.held])
        rows = pa.Table.from_batches([r for _, r in self.held])
        self.held, self.size = [], 0
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(part))
        blocks = [packed(rows.take(pa.array(order[a:b]))) for a, b in zip(begin, end, strict=True)]
        kind = pa.array(np.full(len(begin), self.kind, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(part[begin]), kind, pa.array(blocks, pa.binary())], schema=_TABLES)


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(block: pa.BinaryScalar) -> list[pa.RecordBatch]:
    with pa.ipc.open_stream(block.as_buffer()) as stream:
        return list(stream)


def send_tables(df: DataFrame, targets: int, kind: int, make: Callable[..., Iterator[tuple[np.ndarray, pa.RecordBatch]]], state: Callable | None = None) -> DataFrame:
    """Table blocks of the (key, rows) that ``make`` gives for each batch of df; put the blocks of several kinds together by union, then share() them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = TableBox(targets, kind)
        more = (state(),) if state else ()
        for batch in batches:
            for key, rows in make(batch, *more):
                yield from out.add(key, rows)
        yield from out.flush()

    return tk.arrow(df, run, TABLES)


def share(targets: int, *blocks: DataFrame) -> DataFrame:
    every = blocks[0]
    for x in blocks[1:]:
        every = every.unionByName(x)
    return every.repartitionById(targets, "part")
