"""Filters, summaries, memory lookups and deduplication over wide records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions.scalar import with_line
from recordmill.sources import store

KEPT_TYPES = ("msg", "err", "mem")
LOWEST = 3


def subgraph(df: DataFrame, thread_id: str | None = None, step_min: int | None = None, step_max: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Rows of a thread, a range of steps and some types; what isn't given doesn't restrict."""
    for given, test in ((thread_id, F.col("thread_id") == thread_id), (step_min, F.col("step") >= step_min), (step_max, F.col("step") <= step_max)):
        if given is not None:
            df = df.filter(test)
    return df.filter(F.col("type").isin(list(types))) if types else df


def priority(column: str = "priority") -> Column:
    """Priority of a record; missing or unreadable ones are the lowest."""
    return F.coalesce(F.col(column).try_cast("bigint"), F.lit(LOWEST).cast("bigint"))


def keep_types(df: DataFrame, types: tuple[str, ...] = KEPT_TYPES, keep_priority: int = 2) -> DataFrame:
    return df.filter(F.col("type").isin(list(types or KEPT_TYPES)) | (priority() <= keep_priority))


def summary_rows(df: DataFrame, by: tuple[str, ...] = ("payload_id",)) -> DataFrame:
    """A mem record per thread of each group: how many records of what types it has, up to what step; pos is that of its first record."""
    text = F.format_string("Compressed %d records (types: %s) up to step %d", "_n", F.array_join(F.array_sort("_types"), ","), "step")
    grouped = df.groupBy(*by, "thread_id").agg(F.count("*").alias("_n"), F.collect_set("type").alias("_types"), F.max("step").alias("step"), F.min("pos").alias("pos"))
    return grouped.select(
        *by, "pos", F.lit("mem").alias("type"), F.concat(F.lit("mem_summary_"), "thread_id").alias("id"), "thread_id", "step",
        F.concat(F.lit("context_summary_"), "thread_id").alias("key"), text.alias("value"), F.lit(0.9).alias("confidence"),
    )


def summarize_threads(df: DataFrame) -> DataFrame:
    return schema.widen(summary_rows(df))


def sliding_window(df: DataFrame, size: int = 0) -> DataFrame:
    """The last ``size`` records of each payload as they are (0: a quarter, 10 at least), those before as summaries in front."""
    payload = Window.partitionBy("payload_id")
    ranked = df.withColumn("_n", F.count("*").over(payload)).withColumn("_rank", F.row_number().over(payload.orderBy("pos")))
    window = F.lit(size) if size else F.greatest(F.lit(10), F.floor(F.col("_n") / 4))
    ranked = ranked.withColumn("_old", F.col("_rank") <= F.col("_n") - window)
    # The first old record of a thread becomes the summary of all, so that there is one pass and no union.
    thread = Window.partitionBy("payload_id", "thread_id", "_old")
    ranked = ranked.withColumns({
        "_count": F.count("*").over(thread), "_types": F.collect_set("type").over(thread), "_step": F.max("step").over(thread), "_first": F.min("pos").over(thread),
    }).filter("not _old or pos = _first")
    text = F.format_string("Compressed %d records (types: %s) up to step %d", "_count", F.array_join(F.array_sort("_types"), ","), "_step")
    made = {
        "type": F.lit("mem"), "id": F.concat(F.lit("mem_summary_"), "thread_id"), "step": F.col("_step"), "key": F.concat(F.lit("context_summary_"), "thread_id"), "value": text, "confidence": F.lit(0.9),
    }
    pos = F.row_number().over(payload.orderBy(F.col("_old").desc(), "pos")).cast("bigint")

    def column(name: str) -> Column:
        if name in ("payload_id", "thread_id"):
            return F.col(name)
        if name == "pos":
            return pos.alias("pos")
        return F.when(F.col("_old"), made.get(name, F.lit(None).cast(schema.WIDE[name]))).otherwise(F.col(f"`{name}`")).alias(name)

    return ranked.select(*map(column, schema.WIDE))


def latest_mem(df: DataFrame, key: str | None = None) -> DataFrame:
    """The memory of the highest step by payload and key (ties: the first), whatever its thread."""
    mem = df.filter((F.col("type") == "mem") & (F.col("step") > -1))
    mem = mem.filter(F.col("key") == key) if key is not None else mem
    top = mem.groupBy("payload_id", "key").agg(F.max_by(F.struct("id", "thread_id", "step", "value", "pos"), F.struct("step", -F.col("pos"))).alias("m"))
    return top.select("payload_id", "key", "m.*")


def dedup_mem(df: DataFrame) -> DataFrame:
    """Of the memories of a thread and key, the one of the highest step (ties: the first); other records as they are."""
    # Others are alone in their windows, so that none is large.
    alone = F.when(F.col("type") == "mem", F.lit(-1).cast("bigint")).otherwise(F.col("pos"))
    w = Window.partitionBy("payload_id", "thread_id", "key", alone).orderBy(F.col("step").desc(), "pos")
    return df.withColumn("_rn", F.row_number().over(w)).filter("type <> 'mem' or _rn = 1").drop("_rn")


def first_by_identity(df: DataFrame, within: tuple[str, ...] = (), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first record of each (id, thread_id, step), types aside."""
    w = Window.partitionBy(*within, "id", "thread_id", "step").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def offsets(counts: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, offset) of counts(group, key, n): the sum of n of the group's smaller keys.

    Keys are ranged over all partitions, however many a group has, and what precedes each partition is added.
    """
    ranged = store.checkpoint(counts.repartitionByRange(group, key).select(group, key, "n", F.spark_partition_id().alias("_part")))
    earlier = Window.unboundedPreceding, -1
    inner = F.coalesce(F.sum("n").over(Window.partitionBy(group, "_part").orderBy(key).rowsBetween(*earlier)), F.lit(0))
    # A row for each group in each partition: of the order of groups and partitions together.
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum("n").alias("_sum"))
    sizes = sizes.select("_g", "_p", F.coalesce(F.sum("_sum").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_inner", inner).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(group, key, (F.col("_inner") + F.col("_before")).alias("offset"))


def merge_threads(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Records of all payloads of a session, each identity once, numbered by thread and step."""
    # One shuffle by session and thread serves the identities, the numbers within threads and the join with the threads' offsets.
    placed = df.repartition(session, "thread_id")
    once = first_by_identity(placed, (session,), ("payload_id", "pos"))
    threads = offsets(once.groupBy(session, "thread_id").agg(F.count("*").alias("n")), session, "thread_id")
    threads = threads.select(F.col(session).alias("_s"), F.col("thread_id").alias("_t"), F.col("offset").alias("_offset"))
    within = F.row_number().over(Window.partitionBy(session, "thread_id").orderBy("step", "payload_id", "pos"))
    numbered = once.withColumn("_within", within).join(threads, F.col(session).eqNullSafe(F.col("_s")) & F.col("thread_id").eqNullSafe(F.col("_t")))
    return numbered.withColumn("merged_pos", (F.col("_within") + F.col("_offset")).cast("bigint")).drop("_within", "_offset", "_s", "_t")


def context_usage(df: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Rows, characters and tokens by payload and type."""
    sized = with_line(df, meta).select("payload_id", "type", F.length("line").alias("_chars"))
    tokens = F.floor((F.col("_chars") + 3) / 4).cast("bigint")
    return sized.groupBy("payload_id", "type").agg(F.count("*").alias("n_rows"), F.sum("_chars").cast("bigint").alias("chars"), F.sum(tokens).cast("bigint").alias("tokens"))


def context_totals(df: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Rows, characters and tokens of whole payloads; the tokens are those of all characters together."""
    usage = context_usage(df, meta).groupBy("payload_id").agg(F.sum("n_rows").cast("bigint").alias("n_rows"), F.sum("chars").cast("bigint").alias("chars"))
    return usage.withColumn("tokens", F.floor((F.col("chars") + 3) / 4).cast("bigint"))
