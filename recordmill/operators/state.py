"""Message states: to records and back, the context reducer, and a key-value store of snapshots.

A state is a row (thread_id, messages, meta): messages of (type, id, content, tool_call_id, tool_calls) in order, meta
a JSON text of everything else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions.scalar import estimate_tokens
from recordmill.operators.compress import compress_completed

CALLS = "array<struct<id:string,name:string,args:string>>"
MESSAGES = f"array<struct<type:string,id:string,content:string,tool_call_id:string,tool_calls:{CALLS}>>"
CONTEXT_WINDOW = 8000


def _or(c: Column, prefix: str) -> Column:
    return F.coalesce(F.when(c != "", c), F.concat(F.lit(prefix), F.col("step").cast("string")))


def to_records(states: DataFrame) -> DataFrame:
    """Wide records of states, one for each thread, payload_id being the thread: people's, system's and plain model messages as msg, tool calls (their message's content is lost) as tool, answers as res, meta as a last mem."""
    # One pass over the messages: each gives its entries, and an entry its record.
    call_type, message_type = CALLS[6:-1], MESSAGES[6:-1]
    entries_type = f"array<struct<i:int,k:string,m:{message_type},c:{call_type}>>"
    none = F.lit(None)

    def entry(i: Column, kind: str, m: Column, c: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), F.lit(kind).alias("k"), m.cast(message_type).alias("m"), c.cast(call_type).alias("c"))

    def entries(m: Column, i: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda c: entry(i, "tool", m, c)).cast(entries_type)
        one = lambda kind: F.array(entry(i, kind, m, none)).cast(entries_type)
        of_model = F.when(F.size(m["tool_calls"]) > 0, calls).otherwise(one("msg"))
        return F.when(m["type"] == "ai", of_model).when(m["type"].isin("human", "system"), one("msg")).when(m["type"] == "tool", one("res")).otherwise(F.array().cast(entries_type))

    size = F.coalesce(F.size("messages"), F.lit(0))
    every = F.concat(F.coalesce(F.flatten(F.transform("messages", entries)), F.array().cast(entries_type)), F.array(entry(size, "mem", none, none)).cast(entries_type))
    rows = states.select("thread_id", "meta", F.posexplode(every).alias("_p", "_e"))
    rows = rows.select("thread_id", "meta", (F.col("_p") + 1).cast("bigint").alias("pos"), F.col("_e.k").alias("type"), (F.col("_e.i") + 1).cast("bigint").alias("step"), F.col("_e.m").alias("m"), F.col("_e.c").alias("c"))
    m, c, kind = F.col("m"), F.col("c"), F.col("type")
    content = F.coalesce(m["content"], F.lit(""))
    prefix = F.when(m["type"] == "human", "msg-").when(m["type"] == "system", "sys-").otherwise("ai-")
    plain_id = F.coalesce(F.when(m["id"] != "", m["id"]), F.concat(prefix, F.col("step").cast("string")))
    of = lambda **by: reduce(lambda out, x: out.when(kind == x[0], x[1]), by.items(), F)
    long = lambda n: F.lit(n).cast("bigint")
    return schema.widen(rows.select(
        F.col("thread_id").alias("payload_id"), "pos", "type", "thread_id", "step",
        of(msg=plain_id, tool=_or(c["id"], "tc-"), res=_or(m["tool_call_id"], "res-"), mem=F.lit("state-meta")).alias("id"),
        of(msg=F.when(m["type"] == "human", "user").when(m["type"] == "system", "system").otherwise("assistant")).alias("role"), of(msg=F.col("step")).alias("turn"),
        of(msg=content).alias("content"), of(msg=estimate_tokens(content)).alias("tokens"), of(msg=F.lit(False)).alias("flagged"),
        of(tool=F.coalesce(c["name"], F.lit("")), res=F.lit("tool_result")).alias("name"), of(tool=F.coalesce(c["args"], F.lit("{}"))).alias("args"), of(tool=F.lit("pending"), res=F.lit("done")).alias("status"),
        of(res=content).alias("data"), of(res=long(0)).alias("latency_ms"), of(mem=F.lit("agent_state")).alias("key"), of(mem=F.col("meta")).alias("value"), of(mem=F.lit(1.0)).alias("confidence"),
    ))


def to_states(records: DataFrame) -> DataFrame:
    """(thread_id, messages, meta) from records; of memories only the agent state is kept."""
    null = lambda t: F.lit(None).cast(t)
    kind = F.col("type")
    no_calls = null(CALLS)
    one = F.array(F.struct(F.col("id"), F.coalesce("name", F.lit("")).alias("name"), F.col("args")))
    message = F.struct(
        F.col("pos"),
        F.when(kind == "msg", F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "system", "system").otherwise("human")).when(kind == "tool", "ai").otherwise("tool").alias("type"),
        F.when(kind != "res", F.col("id")).alias("id"),
        F.when(kind == "tool", "").when(kind == "msg", F.coalesce("content", F.lit(""))).otherwise(F.coalesce("data", F.lit(""))).alias("content"),
        F.when(kind == "res", F.col("id")).alias("tool_call_id"),
        F.when(kind == "tool", one).otherwise(no_calls).alias("tool_calls"),
    )
    used = records.withColumn("_m", F.when(kind.isin("msg", "tool", "res"), message)).withColumn("_s", (kind == "mem") & (F.col("key") == "agent_state"))
    out = used.groupBy(F.col("payload_id").alias("thread_id")).agg(F.array_sort(F.collect_list("_m")).alias("_l"), F.max_by("value", F.when(F.col("_s"), F.col("pos"))).alias("meta"))
    drop = F.transform("_l", lambda x: F.struct(x["type"].alias("type"), x["id"].alias("id"), x["content"].alias("content"), x["tool_call_id"].alias("tool_call_id"), x["tool_calls"].alias("tool_calls")))
    return out.select("thread_id", drop.cast(MESSAGES).alias("messages"), F.coalesce("meta", F.lit("{}")).alias("meta"))


def message_tokens(messages: str = "messages") -> Column:
    return F.aggregate(F.transform(messages, lambda m: F.coalesce(estimate_tokens(m["content"]), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)


def reduce_context(states: DataFrame, updates: DataFrame, context_window: int = CONTEXT_WINDOW, compress: bool = True, reducer: Callable[[DataFrame], DataFrame] = compress_completed) -> DataFrame:
    """States with updates(thread_id, messages) appended; those beyond the window go through ``reducer`` as records, by default losing their completed tool sequences."""
    joined = states.join(updates.select("thread_id", F.col("messages").alias("_u")), "thread_id", "left")
    merged = joined.select("thread_id", F.concat("messages", F.coalesce("_u", F.array().cast(MESSAGES))).alias("messages"), "meta")
    if not compress:
        return merged
    sized = merged.withColumn("_t", message_tokens())
    small = sized.filter(F.col("_t") <= context_window).drop("_t")
    large = to_states(reducer(to_records(sized.filter(F.col("_t") > context_window).drop("_t"))))
    return small.unionByName(large)


def from_messages(spark, threads: dict[str, list], meta: dict[str, str] | None = None) -> DataFrame:
    """States from message objects or dicts on the driver; the type of an object without one follows from what it has."""
    import json

    def plain(m) -> dict:
        for name in ("model_dump", "dict"):
            if callable(getattr(m, name, None)):
                return getattr(m, name)()
        return dict(m) if isinstance(m, dict) else vars(m)

    def row(m) -> tuple:
        d = plain(m)
        kind = d.get("type") or {"user": "human", "assistant": "ai", "system": "system", "tool": "tool"}.get(d.get("role")) or ("tool" if d.get("tool_call_id") else "ai" if d.get("tool_calls") else "human")
        calls = [(c.get("id"), c.get("name"), c["args"] if isinstance(c.get("args"), str) else json.dumps(c.get("args") or {})) for c in d.get("tool_calls") or []]
        content = d.get("content")
        return kind, d.get("id"), content if content is None or isinstance(content, str) else json.dumps(content), d.get("tool_call_id"), calls or None

    rows = [(t, [row(m) for m in messages], (meta or {}).get(t, "{}")) for t, messages in threads.items()]
    return spark.createDataFrame(rows, f"thread_id string, messages {MESSAGES}, meta string")


# -- checkpoints ----------------------------------------------------------------------------
# A table (thread_id, namespace, version, data, metadata): snapshots of threads, the highest version being the latest.

CHECKPOINTS = "thread_id string, namespace string, version bigint, data binary, metadata string"


def put_checkpoint(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new(thread_id, namespace, data, metadata) as the next version of each thread and namespace."""
    last = table.groupBy("thread_id", "namespace").agg(F.max("version").alias("_v"))
    numbered = new.join(last, ["thread_id", "namespace"], "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1)
    return table.unionByName(numbered.select(*table.columns))


def list_checkpoints(table: DataFrame, thread_id: str | None = None, namespace: str | None = None, before: int | None = None) -> DataFrame:
    """Checkpoints that match, the latest first by thread and namespace."""
    for given, test in ((thread_id, F.col("thread_id") == thread_id), (namespace, F.col("namespace") == namespace), (before, F.col("version") < before)):
        if given is not None:
            table = table.filter(test)
    return table.orderBy("thread_id", "namespace", F.col("version").desc())


def latest_checkpoints(table: DataFrame) -> DataFrame:
    return prune(table, 1)


def prune(table: DataFrame, keep: int = 1) -> DataFrame:
    """The latest ``keep`` versions of each thread and namespace."""
    w = Window.partitionBy("thread_id", "namespace").orderBy(F.col("version").desc())
    return table.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def delete_thread(table: DataFrame, thread_id: str) -> DataFrame:
    return table.filter(~F.col("thread_id").eqNullSafe(F.lit(thread_id)))


def copy_thread(table: DataFrame, source: str, target: str) -> DataFrame:
    """The table with all checkpoints of a thread under another name as well, in place of what that had."""
    copied = table.filter(F.col("thread_id") == source).withColumn("thread_id", F.lit(target))
    return delete_thread(table, target).unionByName(copied)


# -- store ----------------------------------------------------------------------------------


def put(store: DataFrame, items: DataFrame) -> DataFrame:
    """store(namespace array<string>, key, value, version) with items in place of those of the same name."""
    both = store.unionByName(items)
    w = Window.partitionBy("namespace", "key").orderBy(F.col("version").desc())
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def get(store: DataFrame, namespace: list[str], key: str) -> DataFrame:
    return store.filter((F.col("namespace") == F.array(*map(F.lit, namespace))) & (F.col("key") == key))


def delete(store: DataFrame, namespace: list[str], key: str) -> DataFrame:
    return store.filter(~((F.col("namespace") == F.array(*map(F.lit, namespace))) & (F.col("key") == key)))


def search(store: DataFrame, prefix: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """Items below a namespace in order of name, a page of them."""
    found = store.filter(F.slice("namespace", 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else store
    return found.orderBy("namespace", "key").offset(offset).limit(limit)


def namespaces(store: DataFrame, depth: int | None = None) -> DataFrame:
    return store.select((F.slice("namespace", 1, depth) if depth else F.col("namespace")).alias("namespace")).distinct()
