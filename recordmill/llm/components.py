"""Distributed union-find: connected components of an edge table.

Every task first shrinks its own edges to a spanning forest. If the forest that is left is of a
checked small size, one more task finishes it; else alternating large-star and small-star rounds
run over joins and aggregations until nothing changes, each round checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import textkit as tk

ONE_TASK_EDGES = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while True:
            jump = up[up]
            if (jump == up).all():
                break
            up = jump
        left = up[x] != up[y]
        x, y = x[left], y[left]
    return nodes, nodes[up]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []

    def shrink(a, b):
        x = np.concatenate([a, *(h.column(0).to_numpy() for h in held)])
        y = np.concatenate([b, *(h.column(1).to_numpy() for h in held)])
        node, root = roots(x, y)
        keep = node != root
        return node[keep], root[keep]

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) > 1 << 20:
            a, b = shrink(a, b)
            held = []
    a, b = shrink(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES, shrunk: bool = False) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component; edges are its first two bigint columns.

    ``shrunk``: the tasks that make the edges give forests already.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).alias("node"), F.col(b).alias("root")).filter("node <> root")
    edges = tk.checkpoint(edges if shrunk else tk.arrow(edges, _forest, "node bigint, root bigint"))
    if edges.count() <= one_task:
        return tk.arrow(edges.coalesce(1), _forest, "node bigint, root bigint")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("_low")).select("node", F.least("node", "_low").alias("_low"))
        large = both.filter("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("_low").alias("root")).filter("node <> root")
        low = large.groupBy("node").agg(F.min("root").alias("_low"))
        small = large.join(low, "node").select(F.col("root").alias("node"), F.col("_low").alias("root")).filter("node <> root")
        edges = tk.checkpoint(small.unionByName(low.withColumnRenamed("_low", "root")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now
