"""Sessions of threads, payloads cut to subgraphs, bridges between text forms, and snapshots of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import schema
from recordmill.operators import codec, select, state
from recordmill.operators.compress import compress_completed
from recordmill.sources import payload, tabular

SNAPSHOT = ["pos", "type", "id", "thread_id", "step", "role", "turn", "content", "tokens", "flagged", "name", "args", "status", "data", "latency_ms", "key", "value", "confidence"]


def ingest(registry: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the records' new identities, how many were added by session)."""
    keys = ["session_id", "id", "thread_id", "step"]
    fresh = select.first_by_identity(records, ("session_id",), ("payload_id", "pos")).join(registry.select(*keys), keys, "left_anti")
    return registry.unionByName(fresh, allowMissingColumns=True), fresh.groupBy("session_id").agg(F.count("*").alias("added"))


def thread(registry: DataFrame, session_id: str, thread_id: str) -> DataFrame:
    return registry.filter((F.col("session_id") == session_id) & (F.col("thread_id") == thread_id)).orderBy("step", "payload_id", "pos")


def threads(registry: DataFrame) -> DataFrame:
    """(session_id, thread_id, n): the threads of each session."""
    return registry.groupBy("session_id", "thread_id").agg(F.count("*").alias("n"))


def subgraph_payloads(payloads: DataFrame, **which) -> DataFrame:
    """Payloads of the rows that select.subgraph() keeps, numbered anew; other header values are dropped."""
    kept = select.subgraph(payload.decode_payloads(payloads), **which)
    return payload.encode_payloads(kept)


def payload_to_csv(payloads: DataFrame, columns: list[str]) -> DataFrame:
    """(payload_id, pos, line) of payloads as typed CSV."""
    return tabular.csv_lines(payload.decode_payloads(payloads), columns, ("payload_id", "pos"))


def snapshots(states: DataFrame, level: int = 6) -> DataFrame:
    """(payload_id, block, data): each state as one compressed binary block."""
    return codec.encode_blocks(state.to_records(states), "payload_id", "pos", SNAPSHOT, rows=1 << 30, level=level)


def from_snapshots(blocks: DataFrame) -> DataFrame:
    fields = T.StructType([schema.RECORD[c] for c in SNAPSHOT])
    return state.to_states(schema.widen(codec.decode_blocks(blocks, "payload_id", fields, compressed=True)))


def snapshot_sizes(states: DataFrame, level: int = 6) -> DataFrame:
    """(thread_id, json_bytes, block_bytes, saving_pct) of states as JSON and as snapshots."""
    plain = states.select("thread_id", F.octet_length(F.to_json(F.struct("messages", "meta"))).cast("bigint").alias("json_bytes"))
    packed = snapshots(states, level).select(F.col("payload_id").alias("thread_id"), F.octet_length("data").cast("bigint").alias("block_bytes"))
    return plain.join(packed, "thread_id").withColumn("saving_pct", F.round(100.0 * (1 - F.col("block_bytes") / F.col("json_bytes")), 1))


def for_model(states: DataFrame, columns: list[str], compress: bool = False) -> DataFrame:
    """(payload_id, pos, line): message histories as typed CSV, completed tool sequences compressed if asked for."""
    records = state.to_records(states)
    return tabular.csv_lines(compress_completed(records) if compress else records, columns, ("payload_id", "pos"))


def event_records(events: DataFrame) -> DataFrame:
    """Wide records of events(event_id, node, messages, meta): a marker memory naming the node, then its state; without messages just a marker."""
    marker = events.select(
        F.col("event_id").cast("string").alias("payload_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("mem").alias("type"),
        F.when(F.col("node").isNull(), "empty-event").otherwise(F.concat(F.lit("node-"), "node")).alias("id"), F.lit("stream").alias("thread_id"), F.lit(1).cast("bigint").alias("step"),
        F.when(F.col("node").isNull(), "empty").otherwise("node").alias("key"), F.coalesce("node", F.lit("true")).alias("value"), F.lit(1.0).alias("confidence"),
    )
    inner = state.to_records(events.filter("messages is not null").select(F.col("event_id").cast("string").alias("thread_id"), "messages", F.coalesce("meta", F.lit("{}")).alias("meta")))
    return schema.widen(marker).unionByName(inner)
