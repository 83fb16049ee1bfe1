"""Agent records derived from the driver's tables: each function reads one table and gives wide records without pos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions.scalar import estimate_tokens
from recordmill.sources import store


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _placed(spark: SparkSession, sf_dir: str, table: str, columns: str, payload_id, parts: int | None) -> DataFrame:
    """Columns of a table with payload_id; in so many partitions by payload, if given. Windows within payloads need no shuffle then, and rows go through it before they are wide."""
    df = read(spark, sf_dir, table).select(payload_id.alias("payload_id"), *columns.split())
    return df.repartition(parts, "payload_id") if parts else df


def _tens(prefix: str, column: str, n: int = 10):
    return F.concat(F.lit(prefix), F.floor(F.col(column) / n).cast("bigint").cast("string"))


def messages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    c = _placed(spark, sf_dir, "conversations", "conv_id turn role text", _tens("p", "conv_id"), parts)
    return c.select(
        "payload_id", F.lit("msg").alias("type"), F.concat(F.lit("m"), "conv_id", F.lit("_"), "turn").alias("id"),
        F.concat(F.lit("c"), "conv_id").alias("thread_id"), (F.col("turn") + 1).alias("step"), "role", (F.col("turn") + 1).alias("turn"),
        F.col("text").alias("content"), estimate_tokens("text").alias("tokens"), F.lit(False).alias("flagged"),
    )


def _ranked_orders(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = Window.partitionBy("payload_id", "o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = _placed(spark, sf_dir, "orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", _tens("u", "o_custkey"), parts)
    return orders.withColumn("rn", F.row_number().over(w).cast("bigint"))


def _tool_columns() -> list:
    return [
        F.col("payload_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("u"), "o_custkey").alias("thread_id"),
        F.col("o_orderpriority").alias("name"),
    ]


def tools(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    return _ranked_orders(spark, sf_dir, parts).select(
        *_tool_columns(), F.lit("tool").alias("type"), (2 * F.col("rn") - 1).alias("step"), F.lit("{}").alias("args"), status.alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(1)).cast("bigint").alias("priority"),
    )


def results(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    data = F.when(F.col("o_orderkey") % 11 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"))
    return _ranked_orders(spark, sf_dir, parts).filter("o_orderstatus in ('F', 'P')").select(
        *_tool_columns(), F.lit("res").alias("type"), (2 * F.col("rn")).alias("step"), data.alias("data"), F.lit("done").alias("status"), (F.col("o_orderkey") % 1000).alias("latency_ms"),
    )


def memories(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = Window.partitionBy("payload_id", "user_id").orderBy("ts", "event_id")
    return _placed(spark, sf_dir, "events", "user_id event_id ts event_type props", _tens("e", "user_id"), parts).select(
        "payload_id", F.lit("mem").alias("type"), F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("e"), "user_id").alias("thread_id"),
        F.row_number().over(w).cast("bigint").alias("step"), F.col("event_type").alias("key"), F.col("props").alias("value"), F.lit(1.0).alias("confidence"),
        F.col("event_type").alias("from_agent"), F.lead("event_type").over(w).alias("to_agent"),
    )


def thoughts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = Window.partitionBy("payload_id", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    kind = F.when(F.col("l_returnflag") == "A", "observe").when(F.col("l_returnflag") == "R", "verify").otherwise("compute")
    lines = _placed(spark, sf_dir, "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_returnflag l_tax", _tens("l", "l_orderkey", 100), parts)
    return lines.withColumn("rn", F.row_number().over(w).cast("bigint")).select(
        "payload_id", F.lit("cot").alias("type"), F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "rn").alias("id"), F.concat(F.lit("l"), "l_orderkey").alias("thread_id"),
        F.col("rn").alias("step"), F.col("l_linenumber").cast("bigint").alias("index"), kind.alias("cot_type"), F.concat(F.lit("part "), "l_partkey").alias("text"),
        (F.round(F.col("l_tax") * 100) / 8).alias("confidence"),
    )


def plans(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, schema.ENUMS["plan", "status"])), F.col("p_size") % 4 + 1)
    return _placed(spark, sf_dir, "part", "p_partkey p_size p_brand p_name p_type", _tens("q", "p_partkey"), parts).select(
        "payload_id", F.lit("plan").alias("type"), F.concat(F.lit("pl"), "p_partkey").alias("id"), _tens("q", "p_partkey").alias("thread_id"),
        (F.col("p_partkey") % 10 + 1).alias("step"), (F.col("p_partkey") % 10 + 1).alias("index"), F.concat(F.col("p_brand"), F.lit(' | "'), "p_name", F.lit('"\n'), "p_type", F.lit("\\")).alias("description"),
        status.alias("status"),
    )


def observations(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _placed(spark, sf_dir, "customer", "c_custkey c_mktsegment c_name", _tens("w", "c_custkey"), parts).select(
        "payload_id", F.lit("obs").alias("type"), F.concat(F.lit("ob"), "c_custkey").alias("id"), F.concat(F.lit("w"), "c_custkey").alias("thread_id"),
        F.lit(1).cast("bigint").alias("step"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("content"), (F.col("c_custkey") % 9 / 8).alias("confidence"),
        F.concat(F.lit("pl"), "c_custkey").alias("parent_id"),
    )


def errors(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = Window.partitionBy("payload_id", "user_id").orderBy("ts", "event_id")
    return _placed(spark, sf_dir, "events", "user_id event_id ts event_type props", _tens("x", "user_id"), parts).filter("event_type = 'error'").select(
        "payload_id", F.lit("err").alias("type"), F.concat(F.lit("er"), "event_id").alias("id"), F.concat(F.lit("x"), "user_id").alias("thread_id"),
        F.row_number().over(w).cast("bigint").alias("step"), F.concat(F.lit("E"), F.col("event_id") % 7).alias("code"), F.col("props").alias("message"), F.lit("events").alias("source"),
        (F.col("event_id") % 2 == 0).alias("recoverable"),
    )


def retrievals(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _placed(spark, sf_dir, "part", "p_partkey p_size p_brand p_name", _tens("r", "p_partkey"), parts).select(
        "payload_id", F.lit("rag").alias("type"), F.concat(F.lit("ra"), "p_partkey").alias("id"), F.concat(F.lit("r"), "p_partkey").alias("thread_id"),
        F.lit(1).cast("bigint").alias("step"), (F.col("p_partkey") % 10 + 1).alias("rank"), (F.col("p_size") / 64).alias("score"), F.col("p_brand").alias("source"), F.col("p_name").alias("chunk"),
        (F.col("p_size") % 2 == 0).alias("used"),
    )


def hypotheses(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    labels = _placed(spark, sf_dir, "labels", "doc_id quality toxic", _tens("h", "doc_id"), parts).filter("doc_id is not null")
    once = labels.groupBy("payload_id", "doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return once.select(
        "payload_id", F.lit("hyp").alias("type"), F.concat(F.lit("hy"), "doc_id").alias("id"), F.concat(F.lit("h"), "doc_id").alias("thread_id"),
        F.lit(1).cast("bigint").alias("step"), F.concat(F.lit("document "), "doc_id", F.lit(" is good")).alias("statement"), F.lit("").alias("evidence"),
        (F.coalesce("quality", F.lit(0)) / 2 + 0.25).alias("score"), (F.coalesce("toxic", F.lit(0)) == 0).alias("accepted"),
    )


#: The folder of the store that a record type is in; payloads never span folders.
FAMILIES = {"msg": "msg", "tool": "call", "res": "call", "mem": "mem", "cot": "cot", "plan": "plan", "obs": "obs", "err": "err", "rag": "rag", "hyp": "hyp"}
_STORED: dict[tuple[str, str, str], str] = {}


def positioned(df: DataFrame) -> DataFrame:
    """pos within each payload, by thread, step, id and type."""
    w = Window.partitionBy("payload_id").orderBy("thread_id", "step", "id", "type")
    return schema.widen(df.withColumn("pos", F.row_number().over(w).cast("bigint")))


def _store(spark: SparkSession, sf_dir: str, kind, *kinds) -> str:
    """The name of a table of all records of kinds. Buckets grow with the records, so that a bucket's, and so a task's, don't."""
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (k(spark, sf_dir, parts) for k in kinds))
    n = store.sized(spark, union(None).count())
    return store.save(positioned(union(n)).withColumn("kind", kind), buckets=n, placed=True)


def _family(spark: SparkSession, sf_dir: str, name: str, *kinds) -> DataFrame:
    """Records of kinds that share payloads, from the session's record store; stored when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = _store(spark, sf_dir, F.lit(name), *kinds)
    return spark.table(_STORED[key]).drop("kind")


def records(spark: SparkSession, sf_dir: str, *kinds) -> DataFrame:
    """Wide records of the given kinds (functions of this module), all of them by default."""
    if not kinds:
        key = (spark.sparkContext.applicationId, sf_dir, "all")
        if key not in _STORED:
            families = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
            _STORED[key] = _store(spark, sf_dir, families[F.col("type")], *ALL_KINDS)
        return spark.table(_STORED[key]).drop("kind")
    if set(kinds) == {memories, tools}:
        return _family(spark, sf_dir, "mem", memories).unionByName(_family(spark, sf_dir, "tool", tools))
    if set(kinds) == {tools, results}:
        return _family(spark, sf_dir, "call", tools, results)
    return _family(spark, sf_dir, kinds[0].__name__, kinds[0])


ALL_KINDS = (messages, tools, results, memories, thoughts, plans, observations, errors, retrievals, hypotheses)

#: The same views in SQL: WITH clauses to put before a query over ``rec``.
_PARTS = {
    "msg": """SELECT concat('p', conv_id // 10) AS payload_id, 'msg' AS type, concat('m', conv_id, '_', turn) AS id, concat('c', conv_id) AS thread_id, turn + 1 AS step,
  role, turn + 1 AS turn, text AS content, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 3) // 4 END AS tokens, false AS flagged FROM conversations""",
    "tool": """SELECT concat('u', o_custkey // 10) AS payload_id, 'tool' AS type, concat('o', o_orderkey) AS id, concat('u', o_custkey) AS thread_id, 2 * rn - 1 AS step,
  o_orderpriority AS name, '{}' AS args, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 1::BIGINT END AS priority FROM ranked_orders""",
    "res": """SELECT concat('u', o_custkey // 10) AS payload_id, 'res' AS type, concat('o', o_orderkey) AS id, concat('u', o_custkey) AS thread_id, 2 * rn AS step,
  o_orderpriority AS name, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS data, 'done' AS status, o_orderkey % 1000 AS latency_ms
  FROM ranked_orders WHERE o_orderstatus IN ('F', 'P')""",
    "mem": """SELECT concat('e', user_id // 10) AS payload_id, 'mem' AS type, concat('e', event_id) AS id, concat('e', user_id) AS thread_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS key, props AS value, 1.0::DOUBLE AS confidence,
  event_type AS from_agent, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_agent FROM events""",
    "cot": """SELECT concat('l', l_orderkey // 100) AS payload_id, 'cot' AS type, concat('l', l_orderkey, '_', rn) AS id, concat('l', l_orderkey) AS thread_id, rn AS step,
  l_linenumber::BIGINT AS index, CASE l_returnflag WHEN 'A' THEN 'observe' WHEN 'R' THEN 'verify' ELSE 'compute' END AS cot_type, concat('part ', l_partkey) AS text,
  round(l_tax * 100) / 8 AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem)""",
    "plan": """SELECT concat('q', p_partkey // 10) AS payload_id, 'plan' AS type, concat('pl', p_partkey) AS id, concat('q', p_partkey // 10) AS thread_id, p_partkey % 10 + 1 AS step, p_partkey % 10 + 1 AS index,
  concat(p_brand, ' | "', p_name, '"', chr(10), p_type, chr(92)) AS description, ['active', 'done', 'pending', 'skipped'][p_size % 4 + 1] AS status FROM part""",
    "obs": """SELECT concat('w', c_custkey // 10) AS payload_id, 'obs' AS type, concat('ob', c_custkey) AS id, concat('w', c_custkey) AS thread_id, 1::BIGINT AS step, c_mktsegment AS source, c_name AS content,
  (c_custkey % 9) / 8 AS confidence, concat('pl', c_custkey) AS parent_id FROM customer""",
    "err": """SELECT concat('x', user_id // 10) AS payload_id, 'err' AS type, concat('er', event_id) AS id, concat('x', user_id) AS thread_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  concat('E', event_id % 7) AS code, props AS message, 'events' AS source, event_id % 2 = 0 AS recoverable FROM events WHERE event_type = 'error'""",
    "rag": """SELECT concat('r', p_partkey // 10) AS payload_id, 'rag' AS type, concat('ra', p_partkey) AS id, concat('r', p_partkey) AS thread_id, 1::BIGINT AS step, p_partkey % 10 + 1 AS rank, p_size / 64 AS score,
  p_brand AS source, p_name AS chunk, p_size % 2 = 0 AS used FROM part""",
    "hyp": """SELECT concat('h', doc_id // 10) AS payload_id, 'hyp' AS type, concat('hy', doc_id) AS id, concat('h', doc_id) AS thread_id, 1::BIGINT AS step, concat('document ', doc_id, ' is good') AS statement, '' AS evidence,
  coalesce(max(quality), 0) / 2 + 0.25::DOUBLE AS score, coalesce(max(toxic), 0) = 0 AS accepted FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id""",
}


def sql_views(*kinds: str) -> str:
    """``WITH ... rec AS (...)`` for the given record types (all by default); the caller goes on with a comma or SELECT."""
    kinds = kinds or tuple(_PARTS)
    none = ", ".join(f"NULL::{ {'string': 'VARCHAR', 'bigint': 'BIGINT', 'double': 'DOUBLE', 'boolean': 'BOOLEAN'}[v] } AS {k}" for k, v in schema.WIDE.items() if k != "pos")
    union = " UNION ALL BY NAME ".join(f"({_PARTS[k]})" for k in kinds)
    return (
        "WITH RECURSIVE ranked_orders AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),\n"
        f"parts AS ((SELECT {none} WHERE false) UNION ALL BY NAME {union}),\n"
        "rec AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY thread_id, step, id, type) AS pos FROM parts)"
    )
