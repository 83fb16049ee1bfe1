"""Extra fields named by headers, errors, NaN and list blocks, streams to their end, checkpoints, plans."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import schema
from recordmill.functions import scalar
from recordmill.operators import codec, compress, profile, routing, select, state, validate
from recordmill.sources import payload, store, text
from recordmill.streaming import stateful
from tests.test_records import frame, got, msg, res, tool

GOOD = "msg|m1|t1|1|user|1|hi|1|F"


def test_extra_fields_are_those_that_the_header_names(spark):
    texts = {
        "both": f"{schema.MAGIC}\nmeta: priority, from_agent\nrecords: 1\n{GOOD}|2|a\n", "none": f"{schema.MAGIC}\nrecords: 1\n{GOOD}\n",
        "missing": f"{schema.MAGIC}\nmeta: priority\nrecords: 1\n{GOOD}\n", "null": f'{schema.MAGIC}\nmeta: parent_id\nrecords: 2\n{GOOD}|N\n{GOOD}|"x|y"\n',
    }
    df = spark.createDataFrame(list(texts.items()), "source string, payload string")
    rows = {(r.payload_id, r.pos): (r.priority, r.from_agent, r.parent_id) for r in payload.decode_payloads(df).collect()}
    assert rows == {("both", 1): (2, "a", None), ("none", 1): (None, None, None), ("null", 1): (None, None, None), ("null", 2): (None, None, "x|y")}
    assert {(r.source, r.problem) for r in payload.unreadable(df).collect()} == {("missing", "row 1 can't be read")}


def test_repair_with_extra_fields_and_strictly(spark):
    raws = {"meta": f"{schema.MAGIC}\nmeta: priority\nrecords: 1\n{GOOD}|3\n{GOOD}", "count": f"{schema.MAGIC}\nrecords: 3\n{GOOD}", "right": f"{schema.MAGIC}\nrecords: 1\n{GOOD}"}
    df = spark.createDataFrame(list(raws.items()), "source string, raw string")
    loose = {r.source: (r.repaired, r.payload) for r in payload.repair(df).collect()}
    assert loose["meta"] == (True, f"{schema.MAGIC}\nmeta: priority\nrecords: 1\n{GOOD}|3\n") and all(ok for ok, _ in loose.values())
    strict = {r.source: r.repaired for r in payload.repair(df, strict=True).collect()}
    assert strict == {"meta": False, "count": False, "right": True}


def test_nul_and_backslashes_come_back(spark):
    for value in ("a\0|b", "\\n|", "\\\\n\n|", '"', "\\", '\\"|', "\r\\r|", "$0=|", "|" * 5):
        df = frame(spark, msg(1, 1, content=value))
        texts = payload.encode_payloads(df).select(F.col("payload_id").alias("source"), "payload")
        assert payload.decode_payloads(texts).first().content == value, repr(value)


@pytest.mark.parametrize("x", [0.1, 1e7, 123456789.25, -2.5e15, 9007199254740993.0, 1e16, 1.5e300, 1e-4, 0.000123, 9.9e-5, -1e-10, 0.0, float("inf"), float("-inf"), float("nan")])
def test_doubles_are_written_like_python_does(spark, x):
    out = spark.createDataFrame([(x,)], "x double").select(scalar.float_text("x").alias("t")).first().t
    assert out == repr(x) or (math.isfinite(x) and float(out) == x and abs(x) > 1e17)


def test_nan_and_lists_in_blocks(spark):
    df = spark.createDataFrame([("g", 1, float("nan"), "a"), ("g", 2, None, None), ("g", 3, 1.5, "a")], "g string, pos bigint, x double, s string")
    fields = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("s", T.StringType())])
    for back in (codec.decode_blocks(codec.encode_blocks(df, "g", "pos", ["x", "s"], level=6), "g", fields, compressed=True), text.decode_tables(text.encode_tables(df, "g", "pos", ["x", "s"]), "g", fields)):
        rows = back.orderBy("row").collect()
        assert math.isnan(rows[0].x) and rows[1].x is None and rows[2].x == 1.5 and [r.s for r in rows] == ["a", None, "a"]
    values = [{"a": 1}, {"b": [1, "long text", None]}, "long text", float("inf"), True]
    assert codec.decode(codec.encode_list(values)) == values


def brute_units(rows):
    waiting, out = {}, {}
    for pos, kind, i in rows:
        if kind == "tool":
            waiting.setdefault(i, []).append(pos)
        out[pos] = waiting[i].pop(0) if kind == "res" and waiting.get(i) else pos
    return out


def test_units_of_interleaved_and_repeated_ids(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(p, str(rng.choice(["tool", "res", "msg"], p=[0.4, 0.5, 0.1])), f"c{rng.integers(0, 4)}") for p in range(1, 300)]
    make = {"tool": tool, "res": res, "msg": msg}
    df = frame(spark, *[make[k](i if k != "msg" else p, p) for p, k, i in rows])
    assert {r.pos: r.unit for r in compress.units(df).collect()} == brute_units(rows)


def test_chunks_against_a_loop(spark):
    df = frame(spark, *[x for i in range(40) for x in (msg(i, 3 * i + 1), tool(f"t{i % 9}", 3 * i + 2), res(f"t{i % 7}", 3 * i + 3))]).repartition(3)
    cost = {}
    for r in compress.units(df).collect():
        n = cost.setdefault(r.unit, [0, 0])
        n[0], n[1] = n[0] + r.tokens, n[1] + 1
    for budget, overlap in ((60, 0), (60, 2), (20, 1), (10_000, 3)):
        limit = max(10, budget - compress.header_tokens(budget))
        chunks, open_ = [], []
        for u in sorted(cost):
            if open_ and sum(cost[x][0] for x in open_) + cost[u][0] > limit:
                chunks.append(open_)
                open_ = open_[len(open_) - min(overlap, len(open_)) :] if overlap else []
            open_ = [*open_, u]
        chunks.append(open_)
        got_ = {}
        for r in compress.chunks(df, budget, overlap).orderBy("chunk_no", "unit_no").collect():
            got_.setdefault(r.chunk_no, []).append(r.unit)
        assert list(got_.values()) == chunks, (budget, overlap)


def stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_last_windows_and_lines_across_batches(spark, tmp_path):
    rows = spark.createDataFrame([("k", i) for i in range(1, 8)], "key string, pos bigint")
    parts = rows.repartitionByRange(3, "pos").sortWithinPartitions("pos")
    out = stateful.complete_windows(stateful.drain(stateful.count_windows(stream(spark, parts, f"{tmp_path}/in"), "key", 3), "update"), "key")
    assert sorted((r.block, r.n) for r in out.collect()) == [(0, 3), (1, 3), (2, 1)]
    lines = [schema.MAGIC, "payload_id: p", "records: 2", GOOD, "msg|bad", GOOD]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_no bigint, line string")
    made = stateful.drain(stateful.decode_lines(stream(spark, df.repartitionByRange(3, "line_no"), f"{tmp_path}/lines")))
    assert [(r.payload_id, r.pos, r.id) for r in made.collect()] == [("p", 1, "m1")]


def test_context_reducer_stream(spark, tmp_path):
    rows = [("t", 1, "msg", "m", 10, None), ("t", 2, "tool", "a", 40, None), ("t", 3, "res", "a", 30, None), ("t", 4, "tool", "b", 40, 1), ("t", 5, "res", "b", 5, None), ("u", 1, "msg", "m", 1, None)]
    df = spark.createDataFrame(rows, "thread_id string, pos bigint, type string, id string, tokens bigint, priority bigint").coalesce(1)
    out = {r.thread_id: (r.used, r.n_records, r.compressions) for r in stateful.drain(stateful.context_reducer(stream(spark, df, f"{tmp_path}/in"), 100), "update").collect()}
    assert out == {"t": (85, 4, 1), "u": (1, 1, 0)}


def test_checkpoints_and_messages(spark):
    empty = spark.createDataFrame([], state.CHECKPOINTS)
    new = lambda *names: spark.createDataFrame([(n, "", bytearray(b"x"), "{}") for n in names], "thread_id string, namespace string, data binary, metadata string")
    table = state.put_checkpoint(state.put_checkpoint(empty, new("a", "b")), new("a"))
    assert [r.version for r in state.list_checkpoints(table, "a").collect()] == [2, 1] and state.latest_checkpoints(table).count() == 2
    assert sorted(r.thread_id for r in state.delete_thread(state.copy_thread(table, "a", "c"), "a").collect()) == ["b", "c", "c"]

    class Message:
        def __init__(self):
            self.content, self.tool_call_id, self.id = "found", "c1", None

    df = state.from_messages(spark, {"t": [{"role": "user", "content": "hi"}, {"content": "", "tool_calls": [{"id": "c1", "name": "look", "args": {"q": 1}}]}, Message()]})
    assert got(state.to_records(df), "type", "args") == [("msg", None), ("tool", '{"q": 1}'), ("res", None), ("mem", None)]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_over_the_record_store(spark):
    """Payloads stay where they are stored: no shuffle, one scan, filters at the scan."""
    df = frame(spark, *[x for i in range(12) for x in (msg(i, 3 * i + 1), tool(f"t{i % 5}", 3 * i + 2), res(f"t{i % 7}", 3 * i + 3))])
    stored = spark.table(store.save(df.withColumn("kind", F.lit("k")))).drop("kind")
    assert stored.count() == df.count()
    for op in (validate.validate, select.sliding_window, select.dedup_mem, compress.compress_completed, validate.orphan_results, select.context_usage, compress.units):
        text_ = plan(op(stored))
        assert text_.count("Scan parquet") == 2 and "Exchange" not in text_, (op.__name__, text_)  # once in the tree, once in the list
        assert sorted(map(str, op(stored).collect())) == sorted(map(str, op(df).collect()))
    text_ = plan(select.subgraph(stored, step_min=5, types=["mem", "tool"]))
    assert "GreaterThanOrEqual(step,5)" in text_ and "In(type, [mem,tool])" in text_
    routes = spark.createDataFrame([("a", "b", "h")], "from_agent string, to_agent string, handler string")
    assert plan(routing.route(stored, routes)).count("BroadcastHashJoin") >= 4


def test_merge_threads_numbers_sessions_of_any_size(spark):
    df = frame(spark, *[msg(i, i // 7 + 1, f"t{i % 7}") for i in range(90)]).withColumn("session_id", F.when(F.col("pos") % 9 == 0, "b").when(F.col("pos") % 10 == 0, None).otherwise("a"))
    rows = sorted(select.merge_threads(df).collect(), key=lambda r: (str(r.session_id), r.merged_pos))
    for s in ("a", "b", None):
        own = [r for r in rows if r.session_id == s]
        assert [r.merged_pos for r in own] == list(range(1, len(own) + 1))
        assert [(r.thread_id, r.step) for r in own] == sorted((r.thread_id, r.step) for r in own)


def test_bits_unpacked(spark):
    df = spark.createDataFrame([("g", i, i % 3 == 0) for i in range(1, 20)], "g string, pos bigint, b boolean")
    packed = profile.pack_bits(df, "g", "pos", "b").withColumn("n", F.lit(19).cast("bigint"))
    assert got(profile.unpack_bits(packed, "g", "pos", "b"), "b") == [i % 3 == 0 for i in range(1, 20)]
