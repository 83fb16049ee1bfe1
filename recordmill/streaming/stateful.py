"""Structured Streaming versions of the stateful operators: identities once, step order, windows of rows, token budgets, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDENTITY = ("session_id", "id", "thread_id", "step")


def unique_records(stream: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each identity once; with an event time, state older than the delay is dropped (without one it grows for ever)."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([c for c in IDENTITY if c in stream.columns])
    return stream.dropDuplicates([c for c in IDENTITY if c in stream.columns])


def backward_steps(stream: DataFrame) -> DataFrame:
    """(payload_id, thread_id, pos, step, previous) of rows whose step is below their thread's step before, across micro-batches."""

    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Plain arrays: there are very many threads of a few rows each.
        pos, step = (np.concatenate(x) for x in zip(*((p["pos"].to_numpy(), p["step"].to_numpy()) for p in parts), strict=True))
        order = np.argsort(pos, kind="stable")
        pos, step = pos[order], step[order]
        previous = np.append(state.get[0] if state.exists else step[0], step[:-1])
        bad = np.flatnonzero(step < previous)
        state.update((int(step[-1]),))
        if len(bad):
            yield pd.DataFrame({"payload_id": key[0], "thread_id": key[1], "pos": pos[bad], "step": step[bad], "previous": previous[bad]})

    return stream.select("payload_id", "thread_id", "pos", "step").groupBy("payload_id", "thread_id").applyInPandasWithState(
        check, "payload_id string, thread_id string, pos bigint, step bigint, previous bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )


def count_windows(stream: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block, n, first_pos, last_pos): windows of ``size`` rows a key, in update mode: the open one with every batch that adds to it, so that a stream's last windows are there however full. complete_windows() keeps the latest of each."""

    def fill(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, n, first, last = state.get if state.exists else (0, 0, 0, 0)
        out = []
        for pos in sorted(p for part in parts for p in part["pos"].tolist()):
            first, last, n = (first if n else pos), pos, n + 1
            if n == size:
                out.append((k[0], block, n, first, last))
                block, n = block + 1, 0
        if n:
            out.append((k[0], block, n, first, last))
        state.update((block, n, first, last))
        yield pd.DataFrame(out, columns=[key, "block", "n", "first_pos", "last_pos"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, "pos").groupBy(key).applyInPandasWithState(fill, f"`{key}` {kind}, block bigint, n bigint, first_pos bigint, last_pos bigint", "block bigint, n bigint, first_pos bigint, last_pos bigint", "update", GroupStateTimeout.NoTimeout)


def complete_windows(windows: DataFrame, key: str) -> DataFrame:
    """The latest state of each window from the output of count_windows()."""
    last = windows.groupBy(key, "block").agg(F.max_by(F.struct("n", "first_pos", "last_pos"), "n").alias("_w"))
    return last.select(key, "block", "_w.*")


def context_reducer(stream: DataFrame, context_window: int = 8000, keep_priority: int = 2) -> DataFrame:
    """(thread_id, used, n_records, compressions): histories of record rows (thread_id, pos, type, id, tokens, priority) that grow by update; when one goes beyond the window, its completed tool sequences become one memory each.

    A memory costs as much as the result it replaces; records of a kept priority stay. Update mode.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, ids, tokens, keeps, times = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state.get) if state.exists else ([], [], [], [], 0)
        rows = pd.concat(list(parts)).sort_values("pos")
        kinds, ids, tokens = kinds + rows["type"].tolist(), ids + rows["id"].tolist(), tokens + [int(x) for x in rows["tokens"]]
        keeps = keeps + (rows["priority"].fillna(3) <= keep_priority).tolist()
        if sum(tokens) > context_window:
            called = {i for t, i, k in zip(kinds, ids, keeps, strict=True) if t == "tool" and not k}
            cost = {i: n for t, i, n in zip(kinds, ids, tokens, strict=True) if t == "res"}
            done, made, out = called & cost.keys(), set(), []
            for t, i, n, k in zip(kinds, ids, tokens, keeps, strict=True):
                if k or i not in done or t not in ("tool", "res"):
                    out.append((t, i, n, k))
                elif t == "tool" and i not in made:
                    made.add(i)
                    out.append(("mem", i, cost[i], False))
            kinds, ids, tokens, keeps = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
            times += 1
        state.update((kinds, ids, tokens, keeps, times))
        yield pd.DataFrame({"thread_id": [key[0]], "used": [sum(tokens)], "n_records": [len(kinds)], "compressions": [times]})

    held = "kinds array<string>, ids array<string>, tokens array<bigint>, keeps array<boolean>, times bigint"
    return stream.select("thread_id", "pos", "type", "id", "tokens", "priority").groupBy("thread_id").applyInPandasWithState(run, "thread_id string, used bigint, n_records bigint, compressions bigint", held, "update", GroupStateTimeout.NoTimeout)


def token_budget(stream: DataFrame, window: int) -> DataFrame:
    """(thread_id, used, overflows): tokens of a thread since it last went beyond the window, by update(thread_id, tokens)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, times = state.get if state.exists else (0, 0)
        for n in pd.concat(list(parts)).sort_values("pos")["tokens"]:
            used += int(n)
            if used > window:
                used, times = 0, times + 1
        state.update((used, times))
        yield pd.DataFrame({"thread_id": [key[0]], "used": [used], "overflows": [times]})

    return stream.select("thread_id", "pos", "tokens").groupBy("thread_id").applyInPandasWithState(run, "thread_id string, used bigint, overflows bigint", "used bigint, times bigint", "update", GroupStateTimeout.NoTimeout)


def encode_batches(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = False):
    """Start a query, over what is there now or without end, that writes every micro-batch through ``encode`` as Parquet, a folder each; a batch that is tried again replaces its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        encode(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch:08d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends (timestamp, meta, payload) to a replay log, numbering entries on from the log's last."""
    from pyspark.sql import Window

    from recordmill.sources.tabular import read_log, write_log

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        last = (read_log(spark, path).agg(F.max("seq")).first()[0] or 0) if there else 0
        w = Window.orderBy("timestamp", "payload")  # a micro-batch
        write_log(batch.withColumn("seq", F.row_number().over(w) + F.lit(last)), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is available now, its output written as Parquet to the shared folder, and give that as a table; in update mode every update is a row."""
    from recordmill.sources import store

    spark = stream.sparkSession
    base = folder or store.folder(spark, "drained")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch:08d}")  # a batch that is tried again replaces its own

    writer.foreachBatch(write).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def decode_stream(spark, path: str, magic: str | None = None) -> DataFrame:
    """Wide records of payload files as they arrive in a folder, one payload a file; unreadable ones give none."""
    from recordmill import schema
    from recordmill.sources.payload import decode_payloads

    files = spark.readStream.schema("value string").option("wholetext", True).format("text").load(path)
    texts = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload"))
    return decode_payloads(texts, magic=magic or schema.MAGIC)


def decode_lines(stream: DataFrame, magic: str | None = None) -> DataFrame:
    """Wide records of payload lines (source, line_no, line) as they come: headers are kept by source, and each row behind them is given out at once; rows that can't be read, and those beyond the header's count, give none."""
    from recordmill import schema
    from recordmill.sources.payload import decode_rows

    first = magic or schema.MAGIC

    def read(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, payload, count, pos = state.get if state.exists else (0, key[0], 0, 0)  # 0: before the first line, 1: header, 2: rows
        out = []
        for line in pd.concat(list(parts)).sort_values("line_no")["line"]:
            if stage == 0:
                stage = 1 if line == first else 3
            elif stage == 1 and line.startswith("payload_id: "):
                payload = line[12:]
            elif stage == 1 and line.startswith("records: "):
                stage, count = (2, int(line[9:])) if line[9:].isdigit() else (3, 0)
            elif stage == 2 and pos < count:
                pos += 1
                out.append((payload, pos, line))
        state.update((stage, payload, count, pos))
        yield pd.DataFrame(out, columns=["payload_id", "pos", "line"])

    lines = stream.select("source", "line_no", "line").groupBy("source").applyInPandasWithState(read, "payload_id string, pos bigint, line string", "stage int, payload string, count bigint, pos bigint", "append", GroupStateTimeout.NoTimeout)
    return decode_rows(lines)
