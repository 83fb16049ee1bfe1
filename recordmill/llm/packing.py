"""Operator 6: packing into training windows by the online sum-of-squares rule.

A document of ``n`` tokens fills ``n // window`` windows by itself; the rest, if any, is put
online into a partially filled window. With N(h) open windows filled to level h, it goes to the
level (0: a new window) that makes the sum of N(h)^2 smallest, found over the whole level array;
of equal levels the fullest is taken. Documents are dealt to shards by a hash of doc_id, of about
``shard_tokens`` tokens each, and every shard packs its own in the order of another hash: a
shard's state is its level array and open windows, so shards run in parallel.

Defined results: a row per piece (doc_id, piece, window_id, start, n_tokens): tokens
``piece * window`` to ``+ n_tokens`` of the document are at ``start`` in the window. Documents
without tokens (empty or null text) have no piece. Repeated rows are packed each; rows with a null
doc_id are packed like others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import textkit as tk
from recordmill.llm.token_counts import VOCABULARY, count_batch

WINDOW = 2048
SHARD_TOKENS = 1 << 23
SCHEMA = "doc_id bigint, piece bigint, window_id bigint, start bigint, n_tokens bigint"


class Levels:
    """Open windows of one shard by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.n = np.zeros(window + 1, np.int64)  # the last one, of full windows, stays 0
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, size: int) -> tuple[int, int]:
        """(window, level it had) for an item of less than a window."""
        top = self.window - size
        here, there = self.n[: top + 1], self.n[size:]
        cost = np.where(here > 0, 1 - 2 * here, np.int64(1) << 60)
        cost[0] = 0
        cost[:top] += 2 * there[:top] + 1
        level = top - int(np.argmin(cost[::-1]))
        if level:
            w = self.open[level].pop()
            self.n[level] -= 1
        else:
            w = self.new()
        if level + size < self.window:
            self.open[level + size].append(w)
            self.n[level + size] += 1
        return w, level


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) in one scan, by the workers' caches alone."""
    tk.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                n = pa.array(count_batch(tk.column(part, "text"), None, vocabulary), pa.int64())
                yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), n], ["doc_id", "n_tokens"])

    return tk.arrow(docs.select("doc_id", "text"), count, "doc_id bigint, n_tokens bigint")


def pack_lengths(counted: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack rows (doc_id, n_tokens)."""
    tk.ship(counted.sparkSession)
    counted = tk.checkpoint(counted.filter("n_tokens > 0"))
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    placed = (
        counted.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
        .repartition(int(min(shards, 100_000)), "_shard")
        .sortWithinPartitions("_shard", F.xxhash64("doc_id", F.lit(1)), "doc_id", "n_tokens")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for doc, n, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    shard, state = s, Levels(window)
                base = s << 32
                full, rest = divmod(n, window)
                out.extend((doc, p, base + state.new(), 0, window) for p in range(full))
                if rest:
                    w, level = state.place(rest)
                    out.append((doc, full, base + w, level, rest))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names)

    return tk.arrow(placed.select("doc_id", "n_tokens", "_shard"), run, SCHEMA)


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack the whole texts of docs(doc_id, text)."""
    return pack_lengths(lengths(docs, vocabulary), window, shard_tokens)
