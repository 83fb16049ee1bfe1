"""Compression of completed tool sequences, and packing of records into chunks under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions.scalar import estimate_tokens, truncated, with_line
from recordmill.operators.select import keep_types, priority, sliding_window, summary_rows


def completed_pairs(df: DataFrame) -> DataFrame:
    """(payload_id, id, tool_pos, res_pos, data) of ids that have a tool and a result: first tool, last result."""
    tool, res = F.col("type") == "tool", F.col("type") == "res"
    pairs = df.filter(tool | res).groupBy("payload_id", "id").agg(
        F.min(F.when(tool, F.col("pos"))).alias("tool_pos"), F.max(F.when(res, F.col("pos"))).alias("res_pos"),
        F.max_by(F.struct("data"), F.when(res, F.col("pos"))).getField("data").alias("data"),
    )
    return pairs.filter("tool_pos is not null and res_pos is not null")


def compress_completed(df: DataFrame, keep_priority: int = 2, preserve_cot: bool = False) -> DataFrame:
    """Completed tool sequences as one memory each, thoughts dropped or made memories; records of a kept priority stay as they are."""
    kept = priority() <= keep_priority
    # One shuffle by (payload, id) instead of a join with the pairs.
    by_id = Window.partitionBy("payload_id", "id")
    tool, res = F.col("type") == "tool", F.col("type") == "res"
    marked = df.withColumn("_kept", kept)
    marked = (
        marked.withColumn("_done", F.max(F.when(tool, 1)).over(by_id).isNotNull() & F.max(F.when(res, 1)).over(by_id).isNotNull())
        .withColumn("_data", F.max(F.when(res, F.struct("pos", "data"))).over(by_id).getField("data"))
        .withColumn("_first", F.min(F.when(tool & ~F.col("_kept"), F.col("pos"))).over(by_id))
    )
    call = ~F.col("_kept") & tool & F.col("_done")
    gone = ~F.col("_kept") & ((call & (F.col("pos") > F.col("_first"))) | (res & F.col("_done")))
    thought = ~F.col("_kept") & (F.col("type") == "cot")
    marked = marked.filter(~F.coalesce(gone, F.lit(False)) & (F.lit(True) if preserve_cot else ~thought)).withColumn("_call", call).withColumn("_thought", thought)
    payload = Window.partitionBy("payload_id").orderBy("pos")
    running = payload.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        marked.withColumn("_calls", F.sum(F.col("_call").cast("bigint")).over(running)).withColumn("_thoughts", F.sum(F.col("_thought").cast("bigint")).over(running))
        .withColumn("_pos", F.row_number().over(payload).cast("bigint"))
    )
    made = F.col("_call") | F.col("_thought")
    new = {
        "type": F.lit("mem"),
        "id": F.when(F.col("_call"), F.format_string("mem_cmp_%03d", "_calls")).otherwise(F.format_string("mem_cot_%03d", "_thoughts")),
        "key": F.when(F.col("_call"), F.concat(F.lit("tool_result_"), F.coalesce("name", "id"))).otherwise(F.concat(F.lit("cot_"), F.coalesce("cot_type", F.lit("step")), F.lit("_"), F.coalesce(F.col("index"), F.col("_thoughts")).cast("string"))),
        "value": F.when(F.col("_call"), truncated(F.coalesce("_data", F.lit("None")))).otherwise(truncated(F.coalesce("text", F.lit("")))),
        "confidence": F.when(F.col("_call"), F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(1.0))),
    }
    carried = {"payload_id", "thread_id", "step", *schema.META}

    def column(name: str) -> Column:
        if name == "pos":
            return F.col("_pos").alias("pos")
        if name in carried:
            return F.col(name)
        return F.when(made, new.get(name, F.lit(None).cast(schema.WIDE[name]))).otherwise(F.col(f"`{name}`")).alias(name)

    return marked.select(*map(column, schema.WIDE))


def compress(df: DataFrame, strategy: str = "completed_sequences", keep_priority: int = 2, types: tuple[str, ...] = (), window_size: int = 0, preserve_cot: bool = False) -> DataFrame:
    if strategy == "completed_sequences":
        return compress_completed(df, keep_priority, preserve_cot)
    if strategy == "keep_types":
        return keep_types(df, types, keep_priority)
    if strategy == "sliding_window":
        return sliding_window(df, window_size)
    raise ValueError(f"unknown strategy {strategy!r}")


# -- chunks ---------------------------------------------------------------------------------


def units(df: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """(payload_id, pos, unit, tokens): the atomic unit of each record, named by the position of its first one: a result goes with the oldest tool of its id that is waiting.

    Of the results up to a row, those in excess of the tools before them at their worst found none waiting; the k-th of the others
    goes with the k-th tool. So running counts by payload and id do, without lists.
    """
    lines = with_line(df, meta).select("payload_id", "pos", "type", "id", estimate_tokens("line").alias("tokens"))
    call = F.col("type").isin("tool", "res")
    # Other records are alone in their windows.
    own = (F.when(call, F.lit(-1).cast("bigint")).otherwise(F.col("pos"))).alias("_own")
    lines = lines.select("*", own)
    so_far = Window.partitionBy("payload_id", "id", "_own").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.sum(F.when(F.col("type") == kind, 1).otherwise(0)).over(so_far)
    lines = lines.withColumn("_tools", count("tool")).withColumn("_results", count("res"))
    lines = lines.withColumn("_lost", F.greatest(F.lit(0), F.max(F.col("_results") - F.col("_tools")).over(so_far)))
    before = F.coalesce(F.lag("_lost").over(Window.partitionBy("payload_id", "id", "_own").orderBy("pos")), F.lit(0))
    lone = (F.col("type") == "res") & (F.col("_lost") > before)
    lines = lines.withColumn("_k", F.when(F.col("type") == "tool", F.col("_tools")).when((F.col("type") == "res") & ~lone, F.col("_results") - F.col("_lost")).otherwise(-F.col("pos")))
    first = F.min("pos").over(Window.partitionBy("payload_id", "id", "_own", "_k"))
    return lines.select("payload_id", "pos", first.alias("unit"), "tokens")


def header_tokens(token_budget: int, thread_id: str = "", magic: str = schema.MAGIC) -> int:
    return (len(f"{magic}\nthread: {thread_id}\ncontext_window: {token_budget}\nrecords: 9999\n") + 3) // 4


def chunks(df: DataFrame, token_budget: int, overlap: int = 0, meta: tuple[str, ...] = (), magic: str = schema.MAGIC) -> DataFrame:
    """(payload_id, chunk_no, unit_no, unit, tokens, n_records): units in order, filled into chunks greedily; ``overlap`` units are repeated in the next chunk.

    Units come sorted by payload, and a task keeps no more of them than one batch and the overlap, however many a payload has.
    """
    budget = max(10, token_budget - header_tokens(token_budget, "", magic))
    cost = units(df, meta).groupBy("payload_id", "unit").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("n"))
    # The window brings each payload's units to one partition, in order.
    cost = cost.withColumn("i", F.row_number().over(Window.partitionBy("payload_id").orderBy("unit"))).select("payload_id", "unit", "tokens", "n", "i")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, used = 0, 0, 0  # number, units and tokens of the open chunk
        tail: list[tuple] = []  # the last units, for the overlap
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, unit, tokens, n, i = row
                if i == 1:
                    chunk, held, used, tail = 1, 0, 0, []
                elif held and used + tokens > budget:
                    again = tail[max(0, len(tail) - min(overlap, held)) :] if overlap else []
                    chunk, held, used = chunk + 1, 0, 0
                    for u, t, m in again:
                        held, used = held + 1, used + t
                        out.append((payload, chunk, held, u, t, m))
                held, used = held + 1, used + tokens
                out.append((payload, chunk, held, unit, tokens, n))
                if overlap:
                    tail = [*tail, (unit, tokens, n)][-overlap:]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["payload_id", "chunk_no", "unit_no", "unit", "tokens", "n_records"])

    return cost.mapInArrow(fill, "payload_id string, chunk_no bigint, unit_no bigint, unit bigint, tokens bigint, n_records bigint")


def chunk_records(df: DataFrame, token_budget: int, overlap: int = 0, meta: tuple[str, ...] = (), resort: bool = False) -> DataFrame:
    """Records with their chunk number and position in it; a unit's records stay together, by unit or, with ``resort``, by position."""
    placed = chunks(df, token_budget, overlap, meta)
    own = units(df, meta).select("payload_id", "pos", "unit")
    order = ["pos"] if resort else ["unit_no", "pos"]
    w = Window.partitionBy("payload_id", "chunk_no").orderBy(*order)
    rows = placed.select("payload_id", "chunk_no", "unit_no", "unit").join(own, ["payload_id", "unit"]).withColumn("chunk_pos", F.row_number().over(w).cast("bigint"))
    return rows.select("payload_id", "pos", "chunk_no", "chunk_pos").join(df, ["payload_id", "pos"])


def chunk_summary(df: DataFrame, token_budget: int, overlap: int = 0) -> DataFrame:
    """(payload_id, chunk_no, n_records, tokens) of each chunk."""
    placed = chunks(df, token_budget, overlap)
    return placed.groupBy("payload_id", "chunk_no").agg(F.sum("n_records").cast("bigint").alias("n_records"), F.sum("tokens").cast("bigint").alias("tokens"))


def chain(numbered: DataFrame, parent: str | None = None) -> DataFrame:
    """Ids of chunks and their predecessors': chunk_0001, chunk_0002 and so on within each payload."""
    w = Window.partitionBy("payload_id").orderBy("chunk_no")
    name = F.concat("payload_id", F.format_string("/chunk_%04d", "chunk_no"))
    out = numbered.select("payload_id", "chunk_no").distinct().withColumn("chunk_id", name)
    return out.withColumn("parent_chunk_id", F.coalesce(F.lag("chunk_id").over(w), F.lit(parent).cast("string")))


def summary_chain(df: DataFrame, token_budget: int) -> DataFrame:
    """Batches of as many records as the first one's size allows; all but the last of a payload as summaries by thread."""
    payload = Window.partitionBy("payload_id")
    first = F.min_by(F.struct(estimate_tokens("_line").alias("t")), F.col("pos")).over(payload)["t"]
    per = F.greatest(F.lit(1), F.floor((F.lit(token_budget) - 20) / F.greatest(F.lit(1), first))).cast("bigint")
    rows = with_line(df, name="_line").withColumn("_per", per).drop("_line").withColumn("_i", F.row_number().over(payload.orderBy("pos")) - 1).withColumn("batch", F.floor(F.col("_i") / F.col("_per")).cast("bigint"))
    rows = rows.withColumn("_last", F.max("batch").over(payload))
    old = summary_rows(rows.filter("batch < _last"), ("payload_id", "batch"))
    new = rows.filter("batch = _last").drop("_per", "_i", "_last")
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("payload_id", "batch").orderBy("pos")
    return both.withColumn("pos", F.row_number().over(w).cast("bigint")).select("batch", *schema.WIDE)
