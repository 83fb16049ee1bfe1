"""Registered queries of the record engine over the driver's tables, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import schema
from recordmill.functions import scalar
from recordmill.operators import codec, compress, profile, routing, select, session, state, validate
from recordmill.sources import payload, store, tabular, text
from recordmill.sources.derived import memories, messages, read, records, results, sql_views, thoughts, tools
from recordmill.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
BUDGET = 200


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- SQL pieces -----------------------------------------------------------------------------

CALLS = sql_views("tool", "res")
ALL = sql_views()


def _cell(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "boolean":
        body = f"CASE WHEN {c} THEN 'T' ELSE 'F' END"
    elif kind in ("bigint", "double"):
        body = f"CAST({c} AS VARCHAR)"
    else:
        safe = f"replace({c}, chr(92), chr(92) || chr(92))"
        for a, b in (("chr(34)", "chr(34) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'")):
            safe = f"replace({safe}, {a}, {b})"
        unsafe = " OR ".join(f"contains({c}, {x})" for x in ("'|'", "chr(34)", "chr(92)", "chr(10)", "chr(13)"))
        body = f"CASE WHEN {c} = '' THEN '$0=' WHEN {unsafe} THEN chr(34) || {safe} || chr(34) ELSE {c} END"
    return f"CASE WHEN {c} IS NULL THEN 'N' ELSE {body} END"


def _line() -> str:
    head = [_cell(k, v) for k, v in schema.COMMON.items()]
    whens = " ".join(f"WHEN '{t}' THEN concat_ws('|', {', '.join(head + [_cell(k, v) for k, v in f.items()])})" for t, f in schema.FIELDS.items())
    return f"CASE type {whens} END"


LINES = f"lines AS (SELECT *, {_line()} AS line FROM rec)"
_EST = "(length({0}) + 3) // 4"
_SUMMARY = (
    "'mem' AS type, concat('mem_summary_', thread_id) AS id, thread_id, max(step) AS step, concat('context_summary_', thread_id) AS key, "
    "printf('Compressed %d records (types: %s) up to step %d', count(*), array_to_string(list_sort(list(DISTINCT type)), ','), max(step)) AS value, min(pos) AS first_pos"
)
_SHORT = ["payload_id", "pos", "type", "id", "thread_id", "step"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, tools, results)


# -- usage, filters, summaries --------------------------------------------------------------


@query(f"{ALL}, {LINES} SELECT payload_id, type, count(*) AS n_rows, sum(length(line))::BIGINT AS chars, sum({_EST.format('line')})::BIGINT AS tokens FROM lines GROUP BY ALL")
def context_usage(spark, sf_dir):
    return select.context_usage(records(spark, sf_dir))


@query(f"{ALL}, {LINES} SELECT payload_id, count(*) AS n_rows, sum(length(line))::BIGINT AS chars, ((sum(length(line)) + 3) // 4)::BIGINT AS tokens FROM lines GROUP BY ALL")
def context_totals(spark, sf_dir):
    return select.context_totals(records(spark, sf_dir))


@query(f"{ALL}, {LINES}, u AS (SELECT payload_id, count(*) AS n_rows, sum(length(line))::BIGINT AS chars, ((sum(length(line)) + 3) // 4)::BIGINT AS tokens FROM lines GROUP BY ALL) SELECT *, tokens - 2000 AS overage FROM u WHERE tokens > 2000")
def budget_overage(spark, sf_dir):
    return validate.budget_overage(select.context_totals(records(spark, sf_dir)), 2000)


@query(f"{ALL} SELECT {', '.join(_SHORT)} FROM rec WHERE step BETWEEN 5 AND 20 AND type IN ('mem', 'tool')")
def subgraph_filter(spark, sf_dir):
    return select.subgraph(records(spark, sf_dir), step_min=5, step_max=20, types=["mem", "tool"]).select(*_SHORT)


@query(f"{ALL} SELECT {', '.join(_SHORT)} FROM rec WHERE type IN ('msg', 'err', 'mem') OR coalesce(priority, 3) <= 2")
def keep_types(spark, sf_dir):
    return select.keep_types(records(spark, sf_dir)).select(*_SHORT)


@query(f"{ALL} SELECT type, coalesce(priority, 3) AS priority, count(*) AS n FROM rec GROUP BY ALL")
def priority_default(spark, sf_dir):
    return records(spark, sf_dir).groupBy("type", select.priority().alias("priority")).agg(F.count("*").alias("n"))


@query(
    f"{CALLS}, r AS (SELECT *, count(*) OVER (PARTITION BY payload_id) AS n FROM rec), w AS (SELECT *, pos <= n - greatest(10, n // 4) AS old FROM r), "
    f"s AS (SELECT payload_id, {_SUMMARY} FROM w WHERE old GROUP BY payload_id, thread_id), "
    "b AS (SELECT payload_id, type, id, thread_id, step, value, 0 AS part, first_pos FROM s UNION ALL SELECT payload_id, type, id, thread_id, step, NULL, 1, pos FROM w WHERE NOT old) "
    "SELECT payload_id, type, id, thread_id, step, value, row_number() OVER (PARTITION BY payload_id ORDER BY part, first_pos) AS pos FROM b"
)
def sliding_window(spark, sf_dir):
    return select.sliding_window(calls(spark, sf_dir)).select(*_SHORT, "value")


@query(f"{ALL} SELECT payload_id, {_SUMMARY.replace('first_pos', 'pos')} FROM rec GROUP BY payload_id, thread_id")
def summarize_threads(spark, sf_dir):
    return select.summarize_threads(records(spark, sf_dir)).select(*_SHORT, "key", "value")


@query(f"{sql_views('mem')} SELECT payload_id, key, id, thread_id, step, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY payload_id, key ORDER BY step DESC, pos) AS rn FROM rec) WHERE rn = 1")
def latest_mem(spark, sf_dir):
    return select.latest_mem(records(spark, sf_dir, memories))


@query(
    f"{sql_views('mem', 'tool')} SELECT {', '.join(_SHORT)} FROM (SELECT *, row_number() OVER (PARTITION BY payload_id, type, thread_id, key ORDER BY step DESC, pos) AS rn FROM rec) WHERE type <> 'mem' OR rn = 1"
)
def dedup_mem(spark, sf_dir):
    return select.dedup_mem(records(spark, sf_dir, memories, tools)).select(*_SHORT)


@query(f"{CALLS} SELECT payload_id, id, thread_id, step, type, count(*) AS n FROM rec GROUP BY ALL")
def merge_chunks(spark, sf_dir):
    """Chunks with overlap, merged again."""
    made = compress.chunk_records(calls(spark, sf_dir), BUDGET, overlap=2)
    merged = select.first_by_identity(made, ("payload_id",), ("chunk_no", "chunk_pos"))
    return merged.groupBy("payload_id", "id", "thread_id", "step", "type").agg(F.count("*").alias("n"))


@query(
    f"{ALL}, d AS (SELECT *, row_number() OVER (PARTITION BY substr(payload_id, 1, 1), id, thread_id, step // 2 ORDER BY payload_id, pos) AS rn, substr(payload_id, 1, 1) AS session_id FROM rec) "
    "SELECT session_id, id, thread_id, step // 2 AS step, row_number() OVER (PARTITION BY session_id ORDER BY thread_id, step // 2, payload_id, pos) AS merged_pos FROM d WHERE rn = 1"
)
def merge_threads(spark, sf_dir):
    df = records(spark, sf_dir).withColumn("session_id", F.substring("payload_id", 1, 1)).withColumn("step", F.floor(F.col("step") / 2))
    return select.merge_threads(df).select("session_id", "id", "thread_id", "step", "merged_pos")


# -- validation -----------------------------------------------------------------------------

_EVEN = "CAST(substr(payload_id, 2) AS BIGINT) % 2 = 0"
_DIRTY = f"""dirty AS (SELECT payload_id, pos, type,
  CASE WHEN pos % 97 = 0 AND {_EVEN} THEN '' ELSE id END AS id, CASE WHEN pos % 89 = 0 AND {_EVEN} THEN '' ELSE thread_id END AS thread_id,
  CASE WHEN pos % 83 = 0 AND {_EVEN} THEN 0 WHEN pos % 31 = 0 AND {_EVEN} THEN step - 3 ELSE step END AS step,
  CASE WHEN type = 'tool' AND pos % 37 = 0 AND {_EVEN} THEN 'waiting' ELSE status END AS status
  FROM rec WHERE NOT (type = 'tool' AND CAST(substr(id, 2) AS BIGINT) % 700 = 7)),
prev AS (SELECT *, lag(step) OVER (PARTITION BY payload_id, thread_id ORDER BY pos) AS before FROM dirty)"""
_ROWCHECK = """CASE WHEN thread_id = '' THEN printf('Row %d: thread_id is empty', pos) WHEN id = '' THEN printf('Row %d: id is empty', pos)
  WHEN step < 1 THEN printf('Row %d: step must be a positive integer, got %d', pos, step) END"""
_STEPCHECK = "CASE WHEN step < before THEN printf('Row %d: step %d is less than previous step %d in thread ''%s''', pos, step, before, thread_id) END"
_ENUMCHECK = """CASE WHEN type = 'tool' AND status NOT IN ('done', 'error', 'pending', 'running') THEN printf('Row %d: field ''status'' value ''%s'' not in [done, error, pending, running]', pos, status)
  WHEN type = 'res' AND status NOT IN ('done', 'error', 'timeout') THEN printf('Row %d: field ''status'' value ''%s'' not in [done, error, timeout]', pos, status) END"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools and results with faults, none but missing tools in odd payloads."""
    even = F.substring("payload_id", 2, 20).cast("bigint") % 2 == 0
    at = lambda n: (F.col("pos") % n == 0) & even
    df = calls(spark, sf_dir).filter(~((F.col("type") == "tool") & (F.substring("id", 2, 20).cast("bigint") % 700 == 7)))
    return df.withColumns({
        "id": F.when(at(97), "").otherwise(F.col("id")), "thread_id": F.when(at(89), "").otherwise(F.col("thread_id")),
        "step": F.when(at(83), 0).when(at(31), F.col("step") - 3).otherwise(F.col("step")).cast("bigint"),
        "status": F.when((F.col("type") == "tool") & at(37), "waiting").otherwise(F.col("status")),
    })


@query(f"{CALLS}, {_DIRTY} SELECT payload_id, pos, {_ROWCHECK} AS message FROM prev WHERE {_ROWCHECK} IS NOT NULL")
def validate_rows(spark, sf_dir):
    return validate.row_violations(dirty(spark, sf_dir)).select("payload_id", "pos", "message")


@query(f"{CALLS}, {_DIRTY} SELECT payload_id, pos, {_ENUMCHECK} AS message FROM prev WHERE {_ENUMCHECK} IS NOT NULL")
def validate_enums(spark, sf_dir):
    return validate.enum_violations(dirty(spark, sf_dir)).select("payload_id", "pos", "message")


@query(f"{CALLS}, {_DIRTY} SELECT payload_id, pos, {_STEPCHECK} AS message FROM prev WHERE {_STEPCHECK} IS NOT NULL")
def validate_steps(spark, sf_dir):
    return validate.step_violations(dirty(spark, sf_dir)).select("payload_id", "pos", "message")


@query(f"{CALLS}, {_DIRTY} SELECT payload_id, pos, id FROM dirty r WHERE type = 'res' AND NOT EXISTS (SELECT 1 FROM dirty t WHERE t.type = 'tool' AND t.payload_id = r.payload_id AND t.id = r.id)")
def orphan_results(spark, sf_dir):
    return validate.orphan_results(dirty(spark, sf_dir)).select("payload_id", "pos", "id")


_WRONG = """CASE WHEN thread_id = '' THEN ['thread_id', 'non-empty string', 'empty string', 'give every record a thread']
  WHEN id = '' THEN ['id', 'non-empty string', 'empty string', 'give every record an id'] WHEN step < 1 THEN ['step', 'integer >= 1', step::VARCHAR, 'count steps from 1']
  WHEN step < before THEN ['step', concat('>= ', before), step::VARCHAR, 'steps of a thread must not go back']
  WHEN type = 'tool' THEN ['status', '[done, error, pending, running]', status, 'use one of: done, error, pending, running'] ELSE ['status', '[done, error, timeout]', status, 'use one of: done, error, timeout'] END"""


@query(
    f"{CALLS}, {_DIRTY}, bad AS (SELECT payload_id, 0 AS phase, pos, coalesce({_ROWCHECK}, {_STEPCHECK}, {_ENUMCHECK}) AS message, {_WRONG} AS w FROM prev "
    "UNION ALL SELECT payload_id, 1, pos, printf('row %d: res id ''%s'' has no matching tool row', pos, id), ['id', concat('tool row with id=', id), 'no matching tool row', 'add the tool row or correct the id'] FROM dirty r WHERE type = 'res' "
    "AND NOT EXISTS (SELECT 1 FROM dirty t WHERE t.type = 'tool' AND t.payload_id = r.payload_id AND t.id = r.id)), "
    "first AS (SELECT payload_id, message, w, row_number() OVER (PARTITION BY payload_id ORDER BY phase, pos) AS rn, pos FROM bad WHERE message IS NOT NULL) "
    "SELECT p.payload_id, f.message IS NULL AS ok, f.message, f.pos AS \"row\", f.w[1] AS field, f.w[2] AS expected, f.w[3] AS got, f.w[4] AS suggestion FROM (SELECT DISTINCT payload_id FROM dirty) p LEFT JOIN first f ON p.payload_id = f.payload_id AND f.rn = 1"
)
def validate_payload(spark, sf_dir):
    return validate.validate(dirty(spark, sf_dir)).select("payload_id", "ok", "violation.*")


@query(
    f"{sql_views('tool')} SELECT payload_id, pos, CASE WHEN pos % 9 = 0 THEN 'unknown type' WHEN pos % 7 = 0 THEN 'missing status' WHEN pos % 5 = 0 THEN 'extra color' END AS problem FROM rec"
)
def schema_compliance(spark, sf_dir):
    base = ["type", "id", "thread_id", "step", "name", "args", "status"]
    keys = F.when(F.col("pos") % 7 == 0, F.array(*map(F.lit, base[:-1]))).when(F.col("pos") % 5 == 0, F.array(*map(F.lit, [*base, "color"]))).otherwise(F.array(*map(F.lit, base)))
    raw = records(spark, sf_dir, tools).select("payload_id", "pos", F.when(F.col("pos") % 9 == 0, "note").otherwise("tool").alias("type"), keys.alias("keys"))
    return validate.schema_compliance(raw).select("payload_id", "pos", "problem")


# -- routing --------------------------------------------------------------------------------

_REASON = "CASE WHEN (from_agent IS NULL) <> (to_agent IS NULL) THEN 'from_agent and to_agent must both be set or both absent' WHEN from_agent = to_agent THEN 'self-loop' END"


@query(
    f"{sql_views('mem')}, m AS (SELECT payload_id, pos, {_REASON} AS reason FROM rec) "
    "SELECT payload_id, min(CASE WHEN reason IS NOT NULL THEN pos END) IS NULL AS ok, min(CASE WHEN reason IS NOT NULL THEN pos END) AS \"row\", arg_min(reason, CASE WHEN reason IS NOT NULL THEN pos END) AS reason FROM m GROUP BY payload_id"
)
def routing_consistency(spark, sf_dir):
    return validate.routing_consistency(records(spark, sf_dir, memories))


_ROUTES = [("error", "*", "alarm"), ("error", "error", "loop"), ("*", "error", "before_error"), ("click", "view", "funnel"), ("*", "*", "rest")]


@query(
    f"{sql_views('mem')} SELECT payload_id, pos, CASE WHEN from_agent = 'error' AND to_agent = 'error' THEN 'loop' WHEN from_agent = 'click' AND to_agent = 'view' THEN 'funnel' "
    "WHEN from_agent = 'error' THEN 'alarm' WHEN to_agent = 'error' THEN 'before_error' ELSE 'rest' END AS handler FROM rec"
)
def route_lookup(spark, sf_dir):
    routes = spark.createDataFrame(_ROUTES, "from_agent string, to_agent string, handler string")
    return routing.route(records(spark, sf_dir, memories), routes).select("payload_id", "pos", "handler")


@query(f"{sql_views('mem')} SELECT payload_id, pos, CASE WHEN from_agent = 'error' THEN concat('!', value) WHEN to_agent = 'error' THEN id END AS result FROM rec")
def route_dispatch(spark, sf_dir):
    handlers = {("error", "*"): lambda d: F.concat(F.lit("!"), "value"), ("*", "error"): lambda d: F.col("id")}
    return routing.dispatch(records(spark, sf_dir, memories), handlers).select("payload_id", "pos", "result")


# -- compression and chunks -----------------------------------------------------------------

_PAIRS = (
    "pairs AS (SELECT payload_id, id, min(pos) FILTER (type = 'tool') AS tool_pos, max(pos) FILTER (type = 'res') AS res_pos, "
    "(max(struct_pack(p := pos, d := data)) FILTER (type = 'res')).d AS data FROM rec WHERE type IN ('tool', 'res') GROUP BY payload_id, id HAVING count(*) FILTER (type = 'tool') > 0 AND count(*) FILTER (type = 'res') > 0)"
)


@query(f"{CALLS}, {_PAIRS} SELECT * FROM pairs")
def completed_pairs(spark, sf_dir):
    return compress.completed_pairs(calls(spark, sf_dir))


def _compressed(cot: bool) -> str:
    thoughts = (
        "UNION ALL SELECT payload_id, pos, 'mem', printf('mem_cot_%03d', row_number() OVER (PARTITION BY payload_id ORDER BY pos)), thread_id, step, concat('cot_', cot_type, '_', index), substr(text, 1, 500), confidence FROM rec WHERE type = 'cot' AND coalesce(priority, 3) > 2"
        if cot
        else ""
    )
    return (
        f"{ALL}, {_PAIRS}, made AS (SELECT r.payload_id, r.pos, 'mem' AS type, printf('mem_cmp_%03d', row_number() OVER (PARTITION BY r.payload_id ORDER BY r.pos)) AS id, r.thread_id, r.step, "
        "concat('tool_result_', r.name) AS key, substr(coalesce(p.data, 'None'), 1, 500) AS value, 1.0::DOUBLE AS confidence FROM rec r JOIN pairs p ON r.payload_id = p.payload_id AND r.id = p.id WHERE r.type = 'tool' AND coalesce(r.priority, 3) > 2), "
        "kept AS (SELECT payload_id, pos, type, id, thread_id, step, key, value, confidence FROM rec r WHERE coalesce(priority, 3) <= 2 OR type NOT IN ('tool', 'res', 'cot') "
        "OR (type IN ('tool', 'res') AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.payload_id = r.payload_id AND p.id = r.id))) "
        f"SELECT payload_id, type, id, thread_id, step, key, value, confidence, row_number() OVER (PARTITION BY payload_id ORDER BY pos) AS pos FROM (SELECT * FROM made UNION ALL SELECT * FROM kept {thoughts})"
    )


_COMPRESSED = [*_SHORT, "key", "value", "confidence"]


@query(_compressed(False))
def compress_completed(spark, sf_dir):
    return compress.compress_completed(records(spark, sf_dir)).select(*_COMPRESSED)


@query(_compressed(True))
def compress_completed_cot(spark, sf_dir):
    return compress.compress_completed(records(spark, sf_dir), preserve_cot=True).select(*_COMPRESSED)


_UNITS = (
    f"{CALLS}, {LINES}, unit AS (SELECT l.payload_id, l.pos, coalesce(t.pos, l.pos) AS unit, {_EST.format('l.line')} AS tokens FROM lines l "
    "LEFT JOIN rec t ON l.type = 'res' AND t.type = 'tool' AND t.payload_id = l.payload_id AND t.id = l.id), "
    "cost AS (SELECT payload_id, unit, sum(tokens)::BIGINT AS tokens, count(*) AS n, row_number() OVER (PARTITION BY payload_id ORDER BY unit) AS i FROM unit GROUP BY payload_id, unit)"
)
_FIT = max(10, BUDGET - compress.header_tokens(BUDGET))


def _packed(overlap: bool) -> str:
    return (
        f"{_UNITS}, pack AS (SELECT payload_id, i, unit, tokens, n, 1::BIGINT AS chunk_no, tokens AS used, false AS opens FROM cost WHERE i = 1 "
        f"UNION ALL SELECT c.payload_id, c.i, c.unit, c.tokens, c.n, CASE WHEN p.used + c.tokens > {_FIT} THEN p.chunk_no + 1 ELSE p.chunk_no END, "
        f"CASE WHEN p.used + c.tokens > {_FIT} THEN {'p.tokens' if overlap else '0'} + c.tokens ELSE p.used + c.tokens END, p.used + c.tokens > {_FIT} FROM pack p JOIN cost c ON c.payload_id = p.payload_id AND c.i = p.i + 1)"
    )


@query(f"{_UNITS} SELECT payload_id, pos, unit, tokens FROM unit")
def chunk_units(spark, sf_dir):
    return compress.units(calls(spark, sf_dir))


@query(f"{_packed(False)} SELECT payload_id, chunk_no, sum(n)::BIGINT AS n_records, sum(tokens)::BIGINT AS tokens FROM pack GROUP BY ALL")
def chunk_payload(spark, sf_dir):
    return compress.chunk_summary(calls(spark, sf_dir), BUDGET)


@query(
    f"{_packed(True)}, every AS (SELECT payload_id, chunk_no, i, n, tokens FROM pack UNION ALL SELECT b.payload_id, a.chunk_no, b.i, b.n, b.tokens FROM pack a JOIN pack b ON a.opens AND a.payload_id = b.payload_id AND b.i = a.i - 1) "
    "SELECT payload_id, chunk_no, sum(n)::BIGINT AS n_records, sum(tokens)::BIGINT AS tokens FROM every GROUP BY ALL"
)
def chunk_overlap(spark, sf_dir):
    return compress.chunk_summary(calls(spark, sf_dir), BUDGET, overlap=1)


@query(
    f"{_packed(False)}, c AS (SELECT DISTINCT payload_id, chunk_no FROM pack) SELECT payload_id, chunk_no, printf('%s/chunk_%04d', payload_id, chunk_no) AS chunk_id, "
    "CASE WHEN chunk_no = 1 THEN 'root' ELSE printf('%s/chunk_%04d', payload_id, chunk_no - 1) END AS parent_chunk_id FROM c"
)
def chain_links(spark, sf_dir):
    return compress.chain(compress.chunks(calls(spark, sf_dir), BUDGET), "root")


@query(
    f"{CALLS}, {LINES}, f AS (SELECT payload_id, greatest(1, ({BUDGET} - 20) // greatest(1, {_EST.format('line')})) AS per FROM lines WHERE pos = 1), "
    "b AS (SELECT r.*, (r.pos - 1) // f.per AS batch FROM rec r JOIN f USING (payload_id)), m AS (SELECT *, max(batch) OVER (PARTITION BY payload_id) AS final FROM b), "
    f"s AS (SELECT payload_id, batch, {_SUMMARY} FROM m WHERE batch < final GROUP BY payload_id, batch, thread_id), "
    "u AS (SELECT payload_id, batch, type, id, thread_id, step, value, first_pos FROM s UNION ALL SELECT payload_id, batch, type, id, thread_id, step, NULL, pos FROM m WHERE batch = final) "
    "SELECT payload_id, batch, type, id, thread_id, step, value, row_number() OVER (PARTITION BY payload_id, batch ORDER BY first_pos) AS pos FROM u"
)
def summary_chain(spark, sf_dir):
    return compress.summary_chain(calls(spark, sf_dir), BUDGET).select("batch", *_SHORT, "value")


# -- text forms -----------------------------------------------------------------------------


@query(f"{ALL}, {LINES} SELECT payload_id, pos, line FROM lines")
def encode_rows(spark, sf_dir):
    return scalar.with_line(records(spark, sf_dir)).select("payload_id", "pos", "line")


@query(
    f"{ALL}, {LINES}, b AS (SELECT payload_id, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS n FROM lines GROUP BY payload_id) "
    f"SELECT payload_id, concat('{schema.MAGIC}', chr(10), 'context_window: 4000', chr(10), 'context_used: ', {_EST.format('body')}, chr(10), 'payload_id: ', payload_id, chr(10), 'records: ', n, chr(10), body, chr(10)) AS payload FROM b"
)
def encode_payload(spark, sf_dir):
    return payload.encode_payloads(records(spark, sf_dir), context_window=4000)


_WIRE = [c for c in schema.WIDE if c not in schema.META]


@query(f"{ALL} SELECT {', '.join(chr(34) + c + chr(34) for c in _WIRE)} FROM rec")
def decode_roundtrip(spark, sf_dir):
    """Records written as payloads and read again."""
    texts = payload.encode_payloads(records(spark, sf_dir)).select(F.col("payload_id").alias("source"), "payload")
    return payload.decode_payloads(texts).select(*_WIRE)


@query(f"{CALLS} SELECT payload_id, NULL::VARCHAR AS thread_id, count(*) AS record_count, count(*) AS n_rows, NULL::VARCHAR AS problem FROM rec GROUP BY payload_id")
def parse_headers(spark, sf_dir):
    texts = payload.encode_payloads(calls(spark, sf_dir)).select(F.col("payload_id").alias("source"), "payload")
    return payload.parse_headers(texts).select("payload_id", "thread_id", "record_count", F.size("rows").cast("bigint").alias("n_rows"), "problem")


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload texts as a model might write them: fenced, talked around, miscounted, with blank, unknown and cut rows; every seventh without its first line."""
    texts = payload.encode_payloads(records(spark, sf_dir, messages)).withColumn("n", F.substring("payload_id", 2, 9).cast("int"))
    body = F.regexp_replace(F.regexp_replace("payload", r"records: \d+", "records: 999"), r"\nmsg\|m(\d*[05])_1\|", "\nmsg|cut\n\nnote|m$1_1|")
    body = F.when(F.col("n") % 7 == 6, F.regexp_replace(body, "^[^\n]*\n", "")).otherwise(body)
    return texts.select(F.col("payload_id").alias("source"), F.concat(F.lit("Here it is:\n```\n"), body, F.lit("```\n")).alias("raw"))


_REPAIRED = (
    f"{sql_views('msg')}, {LINES}, k AS (SELECT payload_id, CAST(substr(payload_id, 2) AS BIGINT) % 7 <> 6 AS repaired, "
    "string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (turn = 2 AND CAST(substr(thread_id, 2) AS BIGINT) % 5 = 0)) AS body, count(*) FILTER (NOT (turn = 2 AND CAST(substr(thread_id, 2) AS BIGINT) % 5 = 0)) AS n FROM lines GROUP BY payload_id) "
)
_ERROR = "concat('{magic}', chr(10), 'records: 1', chr(10), 'err|er_val_001|REPAIR|1|VALIDATION_FAILED|', {problem}, '|validator|F', chr(10))"


@query(
    f"{_REPAIRED} SELECT payload_id AS source, repaired, CASE WHEN repaired THEN concat('{schema.MAGIC}', chr(10), 'payload_id: ', payload_id, chr(10), 'records: ', n, chr(10), body, chr(10)) "
    f"ELSE {_ERROR.format(magic=schema.MAGIC, problem=f"'no ''{schema.MAGIC}'' line found'")} END AS payload FROM k"
)
def repair_output(spark, sf_dir):
    return payload.repair(_broken(spark, sf_dir)).select("source", "repaired", "payload")


@query(
    f"{_REPAIRED}, c AS (SELECT payload_id, count(*) FILTER (turn = 2 AND CAST(substr(thread_id, 2) AS BIGINT) % 5 = 0) AS cut FROM rec GROUP BY payload_id) SELECT payload_id AS source, false AS repaired, "
    f"{_ERROR.format(magic=schema.MAGIC, problem=f"CASE WHEN NOT repaired THEN 'no ''{schema.MAGIC}'' line found' WHEN cut > 0 THEN printf('%d rows can''t be read', cut) ELSE 'wrong number of records' END")} AS payload FROM k JOIN c USING (payload_id)"
)
def repair_strict(spark, sf_dir):
    return payload.repair(_broken(spark, sf_dir), strict=True).select("source", "repaired", "payload")


@query(f"{ALL} SELECT {', '.join(chr(34) + c + chr(34) for c in schema.WIDE if c not in ('from_agent', 'to_agent'))} FROM rec")
def decode_meta(spark, sf_dir):
    """Records with extra fields written as payloads and read again by their own headers."""
    texts = payload.encode_payloads(records(spark, sf_dir), ("priority", "parent_id")).select(F.col("payload_id").alias("source"), "payload")
    return payload.decode_payloads(texts).drop("from_agent", "to_agent")


@query(
    f"{sql_views('msg')} SELECT payload_id AS source, CASE n % 5 WHEN 1 THEN 'magic line missing' WHEN 2 THEN 'records line missing' WHEN 3 THEN 'wrong number of records' ELSE 'row 1 can''t be read' END AS problem "
    "FROM (SELECT DISTINCT payload_id, CAST(substr(payload_id, 2) AS BIGINT) AS n FROM rec) WHERE n % 5 > 0"
)
def decode_errors(spark, sf_dir):
    """What is wrong with payloads that can't be read."""
    n = F.substring("payload_id", 2, 9).cast("int") % 5
    texts = payload.encode_payloads(records(spark, sf_dir, messages))
    broken = F.when(n == 1, F.concat(F.lit("x"), "payload")).when(n == 2, F.replace("payload", F.lit("records: "), F.lit("rows: "))).when(n == 3, F.concat("payload", F.lit("msg\n")))
    broken = broken.when(n == 4, F.regexp_replace("payload", r"(records: \d+\n)msg\|", "$1msg|||")).otherwise(F.col("payload"))
    return payload.unreadable(texts.select(F.col("payload_id").alias("source"), broken.alias("payload")))


@query(f"{sql_views('mem')}, {LINES} SELECT payload_id, concat('{schema.MAGIC}', chr(10), 'payload_id: ', payload_id, chr(10), 'records: ', count(*), chr(10), string_agg(line, chr(10) ORDER BY pos), chr(10)) AS payload FROM lines GROUP BY payload_id")
def payload_slices(spark, sf_dir):
    """Payloads cut into slices of bytes and put together again."""
    return payload.join_slices(payload.slices(payload.encode_payloads(records(spark, sf_dir, memories)), 1000))


@query(f"{sql_views('msg')}, {LINES} SELECT CAST(substr(payload_id, 2) AS BIGINT) AS seq, concat('{schema.MAGIC}', chr(10), 'payload_id: ', payload_id, chr(10), 'records: ', count(*), chr(10), string_agg(line, chr(10) ORDER BY pos), chr(10)) AS payload FROM lines GROUP BY payload_id")
def log_roundtrip(spark, sf_dir):
    """A replay log written and read."""
    texts = payload.encode_payloads(records(spark, sf_dir, messages))
    log = texts.select(F.substring("payload_id", 2, 9).cast("bigint").alias("seq"), F.lit(0.0).alias("timestamp"), F.create_map(F.lit("k"), F.lit("v")).alias("meta"), "payload")
    path = store.folder(spark, "log")
    tabular.write_log(log, path)
    return tabular.read_log(spark, path).select("seq", "payload")


schema.MIGRATIONS["0.9.0", "1.0.0"] = lambda df: df.withColumn("confidence", F.when(F.col("type") == "mem", F.coalesce("confidence", F.lit(1.0))).otherwise(F.col("confidence")))


@query(f"{sql_views('mem')} SELECT payload_id, pos, 1.0::DOUBLE AS confidence FROM rec")
def migrate_schema(spark, sf_dir):
    """Memories without a confidence, as an older schema had them, migrated."""
    old = records(spark, sf_dir, memories).withColumn("confidence", F.lit(None).cast("double"))
    return schema.migrate(old, "0.9.0", schema.VERSION).select("payload_id", "pos", "confidence")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' WHEN event_id % 4 = 1 THEN concat('{\"_raw\":\"x', event_id, '\"}') ELSE props END AS meta, event_id % 3 = 0 AS same FROM events"
)
def raw_fallback(spark, sf_dir):
    """JSON texts, with others kept as raw; and deep equality of numbers and NaN."""
    e = read(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("x"), "event_id")).when(F.col("event_id") % 4 > 1, F.col("props"))
    other = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("double")).when(F.col("event_id") % 3 == 1, float("nan"))
    return e.select("event_id", scalar.json_or_raw(given).alias("meta"), scalar.same_value("event_id", other).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 256 THEN printf('CC%02X', o_orderkey) WHEN o_orderkey < 65536 THEN printf('CD%04X', o_orderkey) ELSE printf('CE%08X', o_orderkey) END AS packed FROM orders")
def message_pack(spark, sf_dir):
    packed = F.pandas_udf(lambda s: s.map(codec.msgpack), "binary")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.hex(packed("o_orderkey")).alias("packed"))


_CSV = ["id", "thread_id", "step", "role", "turn", "content", "tokens", "flagged", "ttl"]


@query("SELECT * FROM (VALUES ('id', 's', 0::BIGINT), ('thread_id', 's', 1), ('step', 'd', 2), ('role', 's', 3), ('turn', 'd', 4), ('content', 's', 5), ('tokens', 'd', 6), ('flagged', 'b', 7), ('ttl', 'n', 8)) t(name, kind, ordinal) WHERE (SELECT count(*) FROM conversations) > 0")
def llm_csv_header(spark, sf_dir):
    return tabular.csv_header(records(spark, sf_dir, messages), _CSV)


@query(
    f"{sql_views('msg')} SELECT payload_id, pos, concat_ws(',', id, thread_id, step, role, turn, CASE WHEN content = '' THEN '$0=' WHEN regexp_matches(content, '[,\"\\n\\r:|{{}}\\[\\]]') THEN chr(34) || replace(content, chr(34), chr(34) || chr(34)) || chr(34) ELSE content END, tokens, 'F', 'N') AS line FROM rec"
)
def llm_csv_rows(spark, sf_dir):
    return tabular.csv_lines(records(spark, sf_dir, messages), _CSV, ("payload_id", "pos"))


@query(f"{sql_views('msg')} SELECT payload_id, pos, {', '.join(_CSV[:-1])} FROM rec")
def llm_csv_roundtrip(spark, sf_dir):
    lines = tabular.csv_lines(records(spark, sf_dir, messages), _CSV, ("payload_id", "pos"))
    header = "L|id:s,thread_id:s,step:d,role:s,turn:d,content:s,tokens:d,flagged:b,ttl:n"
    return tabular.read_csv_lines(lines, header, ("payload_id", "pos")).drop("ttl")


@query(
    f"{sql_views('msg')} SELECT payload_id, pos, CASE WHEN pos % 3 = 0 THEN printf('msg_%03d', pos) ELSE id END AS id, CASE WHEN pos % 4 = 0 THEN 't1' ELSE thread_id END AS thread_id, pos AS step FROM rec"
)
def csv_to_agent(spark, sf_dir):
    gaps = records(spark, sf_dir, messages).withColumns({"id": F.when(F.col("pos") % 3 != 0, F.col("id")), "thread_id": F.when(F.col("pos") % 4 != 0, F.col("thread_id")), "step": F.lit(None).cast("bigint")})
    return tabular.csv_to_records(gaps).select("payload_id", "pos", "id", "thread_id", "step")


@query(f"{ALL} SELECT {', '.join(chr(34) + c + chr(34) for c in schema.WIDE)} FROM rec")
def json_roundtrip(spark, sf_dir):
    return tabular.from_json(tabular.to_json(records(spark, sf_dir)))


_JSON = ", ".join(f'"{c}" := "{c}"' for c in schema.WIDE if c not in ("payload_id", "pos"))


@query(
    f"{sql_views('mem')}, {LINES}, p AS (SELECT payload_id, (length(concat('{schema.MAGIC}', chr(10), 'payload_id: ', payload_id, chr(10), 'records: ', count(*), chr(10))) + sum(length(line) + 1))::BIGINT AS payload_chars, "
    f"length(to_json(list(struct_pack({_JSON}) ORDER BY pos))::VARCHAR)::BIGINT AS json_chars FROM lines GROUP BY payload_id) "
    "SELECT *, round(100.0::DOUBLE * (json_chars - payload_chars) / json_chars, 1) AS saving_pct FROM p"
)
def size_compare(spark, sf_dir):
    return tabular.size_compare(records(spark, sf_dir, memories))


# -- scalar functions -----------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 3) // 4 END AS tokens FROM conversations")
def estimate_tokens(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.estimate_tokens("text").alias("tokens"))


_PIECES = r"regexp_extract_all({0}, '''(?:s|t|re|ve|m|ll|d)|[A-Za-z\x{{00C0}}-\x{{024F}}]+|\p{{Nd}}{{1,3}}|[^\s\p{{Z}}\pL\pN_]+|[\s\p{{Z}}]+')"
_COUNT = "coalesce(list_sum(list_transform({0}, lambda p: CASE WHEN strlen(p) <= 4 THEN 1 WHEN strlen(p) <= 8 THEN 2 ELSE (strlen(p) + 3) // 4 END)), 0)::BIGINT"


@query(f"SELECT doc_id, {_COUNT.format(_PIECES.format('text'))} AS tokens FROM documents")
def count_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalar.count_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {_COUNT.format(_PIECES.format('text'))} + greatest(0, length(text) - length(replace(text, chr(10), '')) - 3) * 3 AS tokens FROM documents")
def count_tokens_overhead(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", scalar.count_tokens_records("text").alias("tokens"))


@query(
    "SELECT conv_id, turn, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, strlen(role || thread) + 1), lambda i: ('0x' || substr(hex(encode(role || thread)), 2 * i - 1, 2))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS hash "
    "FROM (SELECT *, concat(conv_id, text) AS thread FROM conversations)"
)
def fnv1a(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", scalar.fnv1a(F.concat("role", F.col("conv_id").cast("string"), "text")).alias("hash"))


def _zz(x: str) -> str:
    z = f"(CASE WHEN {x} < 0 THEN -2 * ({x}) - 1 ELSE 2 * ({x}) END)"
    return "(CASE " + " ".join(f"WHEN {z} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)::BIGINT"


def _vl(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)::BIGINT"


@query(f"SELECT o_orderkey, {_zz('o_orderkey * o_orderkey * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END')} AS n_bytes FROM orders")
def zigzag_len(spark, sf_dir):
    n = F.col("o_orderkey") * F.col("o_orderkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.zigzag_length(n).alias("n_bytes"))


@query("SELECT o_orderkey, o_custkey - o_orderkey AS n FROM orders")
def zigzag_roundtrip(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.unzigzag(scalar.zigzag(F.col("o_custkey") - F.col("o_orderkey"))).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN printf('%02X', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128) ELSE printf('%02X%02X%02X', o_orderkey % 128 + 128, o_orderkey // 128 % 128 + 128, o_orderkey // 16384) END AS bytes FROM orders")
def varint_bytes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.varint_bytes("o_orderkey").alias("bytes"))


# -- profiles -------------------------------------------------------------------------------

_COLUMNS = ["name", "status", "step", "latency_ms", "data"]


def _profile_sql() -> str:
    out = []
    for c in _COLUMNS:
        number = c in ("step", "latency_ms")
        raw, delta, kinds = (f"sum({_zz(c)}) FILTER ({c} IS NOT NULL)::BIGINT", f"sum({_zz(f'({c} - coalesce(d, 0))')}) FILTER ({c} IS NOT NULL)::BIGINT", "0::BIGINT") if number else ("0::BIGINT", "0::BIGINT", f"count(DISTINCT {c})")
        out.append(
            f"SELECT payload_id, '{c}' AS name, count(*) AS n, count(*) - count({c}) AS nulls, {kinds} AS kinds, sum(CASE WHEN p IS NULL OR {c} IS DISTINCT FROM v THEN 1 ELSE 0 END)::BIGINT AS runs, {raw} AS raw_cost, {delta} AS delta_cost, '{'n' if number else 's'}' AS t "
            f"FROM (SELECT *, lag(pos) OVER w AS p, lag({c}) OVER w AS v, last_value({c} IGNORE NULLS) OVER (PARTITION BY payload_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM rec WINDOW w AS (PARTITION BY payload_id ORDER BY pos)) GROUP BY payload_id"
        )
    return f"{CALLS}, m AS ({' UNION ALL '.join(out)})"


@query(
    f"{_profile_sql()} SELECT payload_id, name, n, nulls, kinds, runs, raw_cost, delta_cost, CASE WHEN n = nulls THEN 'rle' WHEN t = 'n' THEN CASE WHEN n - nulls >= 2 AND delta_cost < raw_cost THEN 'delta' ELSE 'raw' END "
    "WHEN kinds <= greatest(8, (n - nulls) // 10) AND n - nulls > 4 THEN 'pool' WHEN runs < n * 0.6 THEN 'rle' ELSE 'raw' END AS strategy FROM (SELECT payload_id, name, n, nulls, kinds, runs, coalesce(raw_cost, 0) AS raw_cost, coalesce(delta_cost, 0) AS delta_cost, t FROM m)"
)
def column_strategy(spark, sf_dir):
    got = profile.column_profile(calls(spark, sf_dir), "payload_id", "pos", _COLUMNS)
    return got.fillna(0, ["raw_cost", "delta_cost"])


@query(
    f"{sql_views('mem')}, e AS (SELECT payload_id, pos, 0 AS k, 'key' AS value FROM rec UNION ALL SELECT payload_id, pos, 1, key FROM rec UNION ALL SELECT payload_id, pos, 2, 'value' FROM rec UNION ALL SELECT payload_id, pos, 3, value FROM rec), "
    "f AS (SELECT value, count(*) AS frequency, min(struct_pack(a := payload_id, b := pos, c := k)) AS first FROM e WHERE length(value) > 1 GROUP BY value), "
    "s AS (SELECT *, frequency * (length(value) - CASE WHEN (SELECT count(*) FROM f) <= 9 THEN 2 ELSE 4 END) AS score FROM f WHERE frequency >= 2), "
    "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) - 1 AS index FROM s WHERE score > 0) SELECT value, frequency, score, index FROM r WHERE index < 64"
)
def string_pool(spark, sf_dir):
    return profile.string_pool(records(spark, sf_dir, memories), ["key", "value"], ["payload_id", "pos"])


@query(
    f"{CALLS}, d AS (SELECT payload_id, step, step - coalesce(lag(step) OVER (PARTITION BY payload_id ORDER BY pos), 0) AS x FROM rec), "
    f"s AS (SELECT payload_id, sum({_zz('step')} + 1)::BIGINT AS raw, (1 + {_vl('count(*)')} + sum({_zz('x')}))::BIGINT AS delta FROM d GROUP BY payload_id) SELECT payload_id, raw, delta, raw - delta AS saving FROM s"
)
def delta_savings(spark, sf_dir):
    return profile.delta_savings(calls(spark, sf_dir), "payload_id", "pos", "step")


@query(f"{CALLS} SELECT payload_id, pos, step FROM rec")
def delta_roundtrip(spark, sf_dir):
    coded = profile.delta_encode(calls(spark, sf_dir), "payload_id", "pos", "step").select("payload_id", "pos", "delta")
    return profile.delta_decode(coded, "payload_id", "pos", "step").drop("delta")


_RUNS = f"{CALLS}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR name IS DISTINCT FROM lag(name) OVER w THEN 1 ELSE 0 END AS new FROM rec WINDOW w AS (PARTITION BY payload_id ORDER BY pos)), g AS (SELECT *, sum(new) OVER (PARTITION BY payload_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c), runs AS (SELECT payload_id, run, any_value(name) AS value, count(*) AS length FROM g GROUP BY payload_id, run)"


@query(f"{_RUNS} SELECT * FROM runs")
def rle_runs(spark, sf_dir):
    return profile.run_lengths(calls(spark, sf_dir), "payload_id", "pos", "name")


@query(f"{CALLS} SELECT payload_id, pos, name AS value FROM rec")
def rle_roundtrip(spark, sf_dir):
    return profile.run_expand(profile.run_lengths(calls(spark, sf_dir), "payload_id", "pos", "name"), "payload_id")


@query(
    f"{_RUNS}, a AS (SELECT payload_id, (sum(strlen(name)) + count(*) - 1)::BIGINT AS raw FROM rec GROUP BY payload_id), "
    f"b AS (SELECT payload_id, (1 + {_vl('count(*)')} + sum(CASE WHEN strlen(value) <= 3 THEN strlen(value) + 2 ELSE strlen(value) + 1 + {_vl('strlen(value)')} END + {_vl('length')}))::BIGINT AS rle FROM runs GROUP BY payload_id) SELECT payload_id, raw, rle, raw - rle AS saving FROM a JOIN b USING (payload_id)"
)
def rle_savings(spark, sf_dir):
    return profile.rle_savings(calls(spark, sf_dir), "payload_id", "pos", "name")


@query(f"{sql_views('msg')}, s AS (SELECT payload_id, 2 * count(*) AS raw, 1 + {_vl('count(*)')} + (count(*) + 7) // 8 AS bits FROM rec GROUP BY payload_id) SELECT payload_id, raw, bits, raw - bits AS saving FROM s")
def bits_savings(spark, sf_dir):
    return profile.bits_savings(records(spark, sf_dir, messages), "payload_id")


@query(f"{sql_views('msg')} SELECT payload_id, (pos - 1) // 8 AS byte_no, sum(CASE WHEN role = 'user' THEN 1 << ((pos - 1) % 8)::INT ELSE 0 END)::BIGINT AS byte FROM rec GROUP BY ALL")
def pack_bits(spark, sf_dir):
    return profile.pack_bits(records(spark, sf_dir, messages).withColumn("mine", F.col("role") == "user"), "payload_id", "pos", "mine")


@query(f"{sql_views('msg')} SELECT payload_id, pos, role = 'user' AS mine FROM rec")
def bits_roundtrip(spark, sf_dir):
    df = records(spark, sf_dir, messages).withColumn("mine", F.col("role") == "user")
    size = df.groupBy("payload_id").agg(F.count("*").alias("n"))
    return profile.unpack_bits(profile.pack_bits(df, "payload_id", "pos", "mine").join(size, "payload_id"), "payload_id", "pos", "mine")


@query(f"{sql_views('cot')} SELECT payload_id, (pos - 1) // 100 AS block, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM rec GROUP BY ALL")
def window_blocks(spark, sf_dir):
    blocks = profile.window_blocks(records(spark, sf_dir, thoughts), "payload_id", "pos", 100)
    return blocks.groupBy("payload_id", "block").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_BINARY = ["pos", "id", "step", "name", "status", "data", "latency_ms"]


@query(f"{CALLS} SELECT payload_id, {', '.join(_BINARY)} FROM rec")
def binary_roundtrip(spark, sf_dir):
    """Records as compressed binary blocks and back."""
    fields = T.StructType([schema.RECORD[c] for c in _BINARY])
    blocks = codec.encode_blocks(calls(spark, sf_dir), "payload_id", "pos", _BINARY, rows=100, level=6)
    return codec.decode_blocks(blocks, "payload_id", fields, compressed=True).drop("block", "row")


@query("SELECT conv_id, turn, text FROM conversations")
def zlib_roundtrip(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("z", F.encode("text", "UTF-8"))
    c = c.withColumn("z", codec.zlib_column("z")).withColumn("z", codec.unzlib_column("z"))
    return c.select("conv_id", "turn", F.decode("z", "UTF-8").alias("text"))


# -- states ---------------------------------------------------------------------------------


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per customer: each order a request, a call and, where done, its result."""
    null = lambda t: F.lit(None).cast(t)
    item = lambda kind, i, content, call, calls_: F.struct(F.lit(kind).alias("type"), i.alias("id"), content.alias("content"), call.alias("tool_call_id"), calls_.alias("tool_calls"))
    key = F.col("o_orderkey").cast("string")
    ask = item("human", F.concat(F.lit("h"), key), F.col("o_orderpriority"), null("string"), null(state.CALLS))
    one = F.array(F.struct(F.concat(F.lit("o"), key).alias("id"), F.lit("order").alias("name"), F.lit("{}").alias("args"))).cast(state.CALLS)
    call = item("ai", F.concat(F.lit("a"), key), F.lit(""), null("string"), one)
    answer = item("tool", null("string"), F.concat(F.lit("total "), key), F.concat(F.lit("o"), key), null(state.CALLS))
    parts = F.when(F.col("o_orderstatus") == "F", F.array(ask, call, answer)).otherwise(F.array(ask, call))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", parts.alias("m"))
    store.sized(spark, 3 * orders.count())  # messages, at most
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "m"))).alias("l"))
    return lists.select(F.concat(F.lit("u"), "o_custkey").alias("thread_id"), F.flatten(F.transform("l", lambda x: x["m"])).cast(state.MESSAGES).alias("messages"), F.lit('{"active":true}').alias("meta"))


_STATE = """WITH each AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, unnest(CASE WHEN o_orderstatus = 'F' THEN [0, 1, 2] ELSE [0, 1] END) AS k FROM orders),
m AS (SELECT *, concat('u', o_custkey) AS thread_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) AS step FROM each)"""


@query(
    f"{_STATE} SELECT thread_id, step, CASE k WHEN 0 THEN 'msg' WHEN 1 THEN 'tool' ELSE 'res' END AS type, CASE k WHEN 0 THEN concat('h', o_orderkey) ELSE concat('o', o_orderkey) END AS id, CASE k WHEN 0 THEN o_orderpriority END AS content, "
    "CASE k WHEN 2 THEN concat('total ', o_orderkey) END AS data FROM m UNION ALL SELECT thread_id, max(step) + 1, 'mem', 'state-meta', NULL, NULL FROM m GROUP BY thread_id"
)
def state_to_records(spark, sf_dir):
    return state.to_records(states(spark, sf_dir)).select("thread_id", "step", "type", "id", "content", "data")


@query(
    f"{_STATE} SELECT thread_id, count(*) AS n_messages, string_agg(CASE k WHEN 0 THEN 'human:' || o_orderpriority WHEN 1 THEN 'ai:' ELSE 'tool:total ' || o_orderkey END, ';' ORDER BY step) AS messages FROM m GROUP BY thread_id"
)
def records_to_state(spark, sf_dir):
    back = state.to_states(state.to_records(states(spark, sf_dir)))
    return back.select("thread_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["type"], F.lit(":"), m["content"])), ";").alias("messages"))


@query(
    f"{_STATE}, t AS (SELECT thread_id, sum(CASE k WHEN 0 THEN (length(o_orderpriority) + 3) // 4 WHEN 2 THEN (length(concat('total ', o_orderkey)) + 3) // 4 ELSE 0 END) AS used FROM m GROUP BY thread_id) "
    "SELECT thread_id, count(*) FILTER (used <= 40 OR k = 0 OR (k = 1 AND o_orderstatus <> 'F')) AS n_messages FROM m JOIN t USING (thread_id) GROUP BY thread_id"
)
def reducer(spark, sf_dir):
    empty = states(spark, sf_dir).select("thread_id", F.array().cast(state.MESSAGES).alias("messages"))
    out = state.reduce_context(states(spark, sf_dir), empty, context_window=40)
    return out.select("thread_id", F.size("messages").cast("bigint").alias("n_messages"))


@query("SELECT n_nationkey AS version, n_name AS key, concat('r', n_regionkey) AS region FROM nation WHERE n_regionkey = 2 ORDER BY n_name LIMIT 3 OFFSET 1")
def store_search(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    items = n.select(F.array(F.lit("geo"), F.concat(F.lit("r"), "n_regionkey")).alias("namespace"), F.col("n_name").alias("key"), F.lit("v").alias("value"), F.col("n_nationkey").cast("bigint").alias("version"))
    old = items.withColumn("version", F.lit(-1).cast("bigint"))
    return state.search(state.put(old, items), ["geo", "r2"], 3, 1).select("version", "key", F.element_at("namespace", 2).alias("region"))


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'got' ELSE 'left' END AS what, n_name AS key FROM nation WHERE n_nationkey % 2 = 0 OR (n_regionkey = 0 AND n_nationkey % 2 = 1) UNION ALL SELECT DISTINCT 'namespace', concat('r', n_regionkey) FROM nation")
def store_items(spark, sf_dir):
    """Items got one by one, deleted one by one, and namespaces."""
    n = read(spark, sf_dir, "nation")
    items = n.select(F.array(F.lit("geo"), F.concat(F.lit("r"), "n_regionkey")).alias("namespace"), F.col("n_name").alias("key"), F.lit("v").alias("value"), F.lit(1).cast("bigint").alias("version"))
    names = [(r.n_name, r.n_regionkey, r.n_nationkey) for r in n.collect()]  # 25 rows
    got = [state.get(items, ["geo", "r0"], name) for name, region, _ in names if region == 0]
    left = items.filter("namespace[1] <> 'r0'")
    for name, region, k in names:
        if k % 2:
            left = state.delete(left, ["geo", f"r{region}"], name)
    out = left.select(F.lit("left").alias("what"), "key")
    for g in got:
        out = out.unionByName(g.select(F.lit("got").alias("what"), "key"))
    return out.unionByName(state.namespaces(items, 2).select(F.lit("namespace").alias("what"), F.col("namespace")[1].alias("key")))


@query(
    "WITH v AS (SELECT concat('c', o_custkey) AS thread_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey FROM orders), "
    "p AS (SELECT thread_id, version, o_orderkey FROM v WHERE version > n - 2 AND thread_id <> 'c1') SELECT * FROM p UNION ALL SELECT 'copy', version, o_orderkey FROM p WHERE thread_id = 'c2'"
)
def checkpoint_table(spark, sf_dir):
    """Checkpoints pruned to two by thread, one thread deleted, one copied."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    table = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("thread_id"), F.lit("").alias("namespace"), F.row_number().over(w).cast("bigint").alias("version"), F.encode(F.lit("x"), "UTF-8").alias("data"), F.col("o_orderkey").cast("string").alias("metadata"),
    )
    out = state.list_checkpoints(state.copy_thread(state.delete_thread(state.prune(table, 2), "c1"), "c2", "copy"))
    return out.select("thread_id", "version", F.col("metadata").cast("bigint").alias("o_orderkey"))


# -- replay and streams ---------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = payload.encode_payloads(records(spark, sf_dir, messages))
    seq = F.substring("payload_id", 2, 9).cast("bigint") + 1
    return texts.select(seq.alias("seq"), F.lit(0.0).alias("timestamp"), F.create_map(F.lit("k"), F.lit("v")).alias("meta"), F.when(seq % 4 == 0, "broken").otherwise(F.col("payload")).alias("payload"))


@query(f"{sql_views('msg')} SELECT DISTINCT CAST(substr(payload_id, 2) AS BIGINT) + 1 AS seq FROM rec WHERE CAST(substr(payload_id, 2) AS BIGINT) + 1 >= 5")
def replay_slice(spark, sf_dir):
    return tabular.replay(_log(spark, sf_dir), 5).select("seq")


@query(f"{sql_views('msg')} SELECT payload_id, pos, id, content FROM rec WHERE (CAST(substr(payload_id, 2) AS BIGINT) + 1) % 4 <> 0")
def replay_records(spark, sf_dir):
    return tabular.replay_records(_log(spark, sf_dir)).select("payload_id", "pos", "id", "content")


def _streamed(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a table as a stream of files, with a folder for its checkpoints."""
    folder = store.folder(spark, "streams")
    df.write.parquet(f"{folder}/in")
    # A quarter of the files a micro-batch, so that the number of batches, each of which goes over all partitions of the state, doesn't grow with the table.
    files = max(4, -(-len(spark.read.schema(df.schema).parquet(f"{folder}/in").inputFiles()) // 4))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), f"{folder}/state"


@query("SELECT event_type AS session_id, concat('u', user_id) AS id, 'all' AS thread_id, event_id % 3 AS step, 1::BIGINT AS n FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("session_id"), F.concat(F.lit("u"), "user_id").alias("id"), F.lit("all").alias("thread_id"), (F.col("event_id") % 3).alias("step"))
    stream, folder = _streamed(spark, events)
    return stateful.drain(stateful.unique_records(stream), folder=folder).groupBy("session_id", "id", "thread_id", "step").agg(F.count("*").alias("n"))


@query(f"{CALLS}, {_DIRTY} SELECT payload_id, thread_id, pos, step, before AS previous FROM prev WHERE step < before")
def stream_step_check(spark, sf_dir):
    rows = dirty(spark, sf_dir).select("payload_id", "thread_id", "pos", "step").repartition("payload_id").sortWithinPartitions("payload_id", "pos")
    stream, folder = _streamed(spark, rows)
    return stateful.drain(stateful.backward_steps(stream), folder=folder)


@query(f"{sql_views('mem')} SELECT payload_id, (pos - 1) // 50 AS block, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM rec GROUP BY ALL")
def stream_count_windows(spark, sf_dir):
    rows = records(spark, sf_dir, memories).select("payload_id", "pos").repartition("payload_id").sortWithinPartitions("payload_id", "pos")
    stream, folder = _streamed(spark, rows)
    return stateful.complete_windows(stateful.drain(stateful.count_windows(stream, "payload_id", 50), "update", folder), "payload_id")


@query(
    f"{sql_views('msg')}, t AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY pos) AS i FROM rec), f AS (SELECT thread_id, i, CASE WHEN tokens > 60 THEN 0 ELSE tokens END AS used, (tokens > 60)::BIGINT AS overflows FROM t WHERE i = 1 "
    "UNION ALL SELECT t.thread_id, t.i, CASE WHEN f.used + t.tokens > 60 THEN 0 ELSE f.used + t.tokens END, f.overflows + (f.used + t.tokens > 60)::BIGINT FROM f JOIN t ON t.thread_id = f.thread_id AND t.i = f.i + 1) "
    "SELECT thread_id, arg_max(used, i)::BIGINT AS used, max(overflows) AS overflows FROM f GROUP BY thread_id"
)
def stream_budget(spark, sf_dir):
    """Tokens of each thread since it last went beyond a budget."""
    rows = records(spark, sf_dir, messages).select("thread_id", "pos", "tokens").repartition("thread_id").sortWithinPartitions("thread_id", "pos")
    stream, folder = _streamed(spark, rows)
    updates = stateful.drain(stateful.token_budget(stream, 60), "update", folder)
    return updates.groupBy("thread_id").agg(F.max(F.struct("overflows", "used")).alias("_l")).select("thread_id", "_l.used", "_l.overflows")


@query(f"{sql_views('mem')}, {LINES} SELECT payload_id, pos, line FROM lines")
def stream_encode(spark, sf_dir):
    """Records written as rows by micro-batches."""
    stream, folder = _streamed(spark, records(spark, sf_dir, memories))
    out = f"{folder}/lines"
    stateful.encode_batches(stream, lambda b: scalar.with_line(b).select("payload_id", "pos", "line"), out, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/epoch=*").drop("epoch")


# -- sessions, bridges, snapshots -----------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str, *kinds) -> DataFrame:
    return payload.encode_payloads(records(spark, sf_dir, *kinds)).select(F.col("payload_id").alias("source"), "payload")


@query(f"{CALLS}, s AS (SELECT * FROM rec WHERE type = 'tool' AND step >= 3), n AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY pos) AS k FROM s) SELECT payload_id, k AS pos, id, thread_id, step FROM n")
def subgraph_payload(spark, sf_dir):
    """Payload texts cut to later tool calls, read again."""
    cut = session.subgraph_payloads(_texts(spark, sf_dir, tools, results), step_min=3, types=["tool"])
    return payload.decode_payloads(cut.select(F.col("payload_id").alias("source"), "payload")).select("payload_id", "pos", "id", "thread_id", "step")


@query(f"{CALLS} SELECT payload_id, pos, concat_ws(',', type, id, step, coalesce(data, 'N')) AS line FROM rec")
def agent_to_csv(spark, sf_dir):
    return session.payload_to_csv(_texts(spark, sf_dir, tools, results), ["type", "id", "step", "data"])


@query(f"{ALL} SELECT substr(payload_id, 1, 1) AS session_id, count(DISTINCT concat(id, '/', thread_id, '/', step)) AS added FROM rec WHERE type <> 'mem' GROUP BY ALL")
def registry_ingest(spark, sf_dir):
    """New identities by session when all records come to a registry that has the memories."""
    df = records(spark, sf_dir).withColumn("session_id", F.substring("payload_id", 1, 1))
    return session.ingest(df.filter("type = 'mem'"), df)[1]


@query(f"{ALL} SELECT substr(payload_id, 1, 1) AS session_id, thread_id, count(*) AS n FROM rec GROUP BY ALL")
def registry_threads(spark, sf_dir):
    return session.threads(records(spark, sf_dir).withColumn("session_id", F.substring("payload_id", 1, 1)))


_TEXT = ["id", "name", "status", "step", "data", "latency_ms"]


@query(f"{CALLS} SELECT payload_id, pos, {', '.join(_TEXT)} FROM rec")
def text_roundtrip(spark, sf_dir):
    """Records in the pooled text form and back."""
    fields = T.StructType([schema.RECORD[c] for c in _TEXT])
    back = text.decode_tables(text.encode_tables(calls(spark, sf_dir), "payload_id", "pos", _TEXT), "payload_id", fields)
    return back.withColumnRenamed("row", "pos")


@query(ORACLE_SQL["records_to_state"])
def snapshot_roundtrip(spark, sf_dir):
    """States as compressed binary snapshots and back."""
    back = session.from_snapshots(session.snapshots(states(spark, sf_dir)))
    return back.select("thread_id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(F.transform("messages", lambda m: F.concat(m["type"], F.lit(":"), m["content"])), ";").alias("messages"))


@query(f"{_STATE} SELECT thread_id AS payload_id, count(*) FILTER (k < 2) + 1 AS n FROM m GROUP BY thread_id")
def context_for_model(spark, sf_dir):
    """Lines of compressed histories: requests, calls (completed ones as memories), and the state."""
    lines = session.for_model(states(spark, sf_dir), ["type", "id", "content", "key", "value"], compress=True)
    return lines.groupBy("payload_id").agg(F.count("*").alias("n"))


@query(f"{_STATE} SELECT thread_id AS payload_id, 'node' AS key, concat('n', o_custkey % 3) AS value, count(*) + 2 AS n FROM m GROUP BY thread_id, o_custkey")
def event_records(spark, sf_dir):
    events = states(spark, sf_dir).withColumn("node", F.concat(F.lit("n"), F.substring("thread_id", 2, 20).cast("bigint") % 3)).withColumnRenamed("thread_id", "event_id")
    made = session.event_records(events)
    mark = F.when(F.col("pos") == 0, F.struct("key", "value"))
    return made.groupBy("payload_id").agg(F.max(mark).alias("_m"), F.count("*").alias("n")).select("payload_id", "_m.key", "_m.value", "n")


@query(f"{CALLS} SELECT payload_id, pos, type, id, step, data FROM rec")
def stream_decode(spark, sf_dir):
    """Lines of payloads read as they come."""
    texts = payload.encode_payloads(calls(spark, sf_dir)).select(F.col("payload_id").alias("source"), F.posexplode(F.split("payload", "\n")).alias("line_no", "line"))
    stream, folder = _streamed(spark, texts.repartition("source").sortWithinPartitions("source", "line_no"))
    return stateful.drain(stateful.decode_lines(stream), folder=folder).select("payload_id", "pos", "type", "id", "step", "data")
