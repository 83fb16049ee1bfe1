"""Operators on small records made for one rule each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions import scalar
from recordmill.operators import compress, routing, select, state, validate
from recordmill.sources import payload, tabular


def rec(type_, id_, step, thread="t1", **more):
    return {"type": type_, "id": id_, "thread_id": thread, "step": step} | more


def msg(i, step, thread="t1", content="hello there", **more):
    return rec("msg", f"m{i}", step, thread, role="user", turn=step, content=content, tokens=3, flagged=False, **more)


def tool(i, step, **more):
    return rec("tool", i, step, name=f"n_{i}", args="{}", status="done", **more)


def res(i, step, data="out", **more):
    return rec("res", i, step, name=f"n_{i}", data=data, status="done", latency_ms=5, **more)


def frame(spark, *records, payload_id="p1"):
    rows = [tuple({"payload_id": payload_id, "pos": k + 1, **r}.get(c) for c in schema.WIDE) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, schema.RECORD)


ALL_TYPES = [
    msg(1, 1), tool("a", 2), res("a", 3), rec("plan", "pl", 4, index=1, description="do", status="active"), rec("obs", "ob", 5, source="s", content="c", confidence=0.5),
    rec("err", "er", 6, code="E1", message="bad", source="s", recoverable=True), rec("mem", "me", 7, key="k", value="v", confidence=1.0, ttl=None),
    rec("rag", "ra", 8, rank=1, score=0.25, source="s", chunk="text", used=False), rec("hyp", "hy", 9, statement="s", evidence="e", score=1e-7, accepted=False), rec("cot", "co", 10, index=1, cot_type="plan", text="t", confidence=0.1),
]


def got(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.orderBy("pos").select(*names).collect()]


def test_rows_of_all_types_come_back(spark):
    odd = [msg(i, 20 + i, content=c) for i, c in enumerate(["a|b", 'say "hi"', "back\\slash \\n kept", "two\nlines\r", "", "日本 😀 _", 'ends with "', "|", '"', "long | " * 20_000, 'q"' * 3_000])]
    df = frame(spark, *ALL_TYPES, *odd)
    texts = payload.encode_payloads(df).select(F.col("payload_id").alias("source"), "payload")
    back = payload.decode_payloads(texts)
    assert got(back, *schema.WIDE) == got(df, *schema.WIDE)
    meta = ("from_agent", "priority")
    tagged = df.withColumn("from_agent", F.lit("x|y")).withColumn("priority", F.when(F.col("pos") % 2 == 0, 1).cast("bigint"))
    texts = payload.encode_payloads(tagged, meta).select(F.col("payload_id").alias("source"), "payload")
    assert got(payload.decode_payloads(texts, meta), *schema.WIDE) == got(tagged, *schema.WIDE)


def test_split_row(spark):
    lines = ["a|b", "a|b|", '"x|y"|b', '"x""y"|', "|", "", 'a|"q"', '""|b']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "pos bigint, line string")
    assert got(df.withColumn("c", scalar.split_row("line")), "c") == [["a", "b"], ["a", "b", ""], ['"x|y"', "b"], ['"x""y"', ""], ["", ""], [""], ["a", '"q"'], ['""', "b"]]


def test_float_text_comes_back(spark):
    random.seed(1)
    values = [0.0, -0.0, 1.0, 0.1, 1e-3, 1.5e-4, 1e-5, 1e7, 123456789.0, 1e16, 1.2345e22, 1e100, float("inf"), float("-inf"), float("nan"), -2.5e8] + [random.uniform(-1, 1) * 10 ** random.randint(-12, 20) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos bigint, v double")
    for v, t in zip(values, got(df.withColumn("t", scalar.float_text("v")), "t"), strict=True):
        assert (v != v and t == "nan") or float(t) == v
        assert t == repr(v) or abs(v) > 1e17  # beyond, older JVMs print a digit more than needed


def test_integer_coding(spark):
    values = [0, -1, 1, 63, 64, -64, -65, 2**31, -(2**40), 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos bigint, v bigint")
    z = [-2 * v - 1 if v < 0 else 2 * v for v in values]
    assert [x % 2**64 for x in got(df.withColumn("z", scalar.zigzag("v")), "z")] == z
    assert got(df.withColumn("z", scalar.unzigzag(scalar.zigzag("v"))), "z") == values
    assert got(df.filter("pos < 9").withColumn("n", scalar.zigzag_length("v")), "n") == [max(1, -(-x.bit_length() // 7)) for x in z[:9]]
    assert spark.range(1).select(scalar.varint_bytes(F.lit(300))).first()[0] == "AC02"
    assert spark.range(1).select(scalar.fnv1a(F.lit("")), scalar.fnv1a(F.lit("é")), scalar.fnv1a(F.lit("a"))).first()[:] == (0x811C9DC5, ((((0x811C9DC5 ^ 0xC3) * 16777619) % 2**32 ^ 0xA9) * 16777619) % 2**32, 0xE40C292C)


def test_token_counts(spark):
    texts = ["", "a", "hello, world! it's 12345", "日本語", "naïve_code", "a b\n\nc", "１２３４", "x" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos bigint, t string")
    assert got(df.withColumn("n", scalar.estimate_tokens("t")), "n") == [(len(t) + 3) // 4 for t in texts]
    counts = got(df.withColumn("n", scalar.count_tokens("t")), "n")
    assert counts[0] == 0 and counts[1] == 1 and counts[3] == 1 and counts[7] == 25


def test_completed_sequences(spark):
    df = frame(spark, msg(1, 1), tool("a", 2), res("a", 3, "first"), tool("b", 4), tool("a", 5), res("a", 6, "x" * 600), rec("cot", "c", 7, index=2, cot_type="plan", text="think", confidence=0.5), res("z", 8), tool("n", 9), res("n", 10, None))
    out = compress.compress_completed(df)
    assert got(out, "pos", "type", "id") == [(1, "msg", "m1"), (2, "mem", "mem_cmp_001"), (3, "tool", "b"), (4, "res", "z"), (5, "mem", "mem_cmp_002")]
    assert got(out, "value") == [None, "x" * 500, None, None, "None"] and got(out, "key")[1] == "tool_result_n_a"
    kept = compress.compress_completed(df, preserve_cot=True).filter("id like 'mem_cot%'").first()
    assert (kept.id, kept.key, kept.value, kept.confidence, kept.content) == ("mem_cot_001", "cot_plan_2", "think", 0.5, None)


def test_kept_tool_loses_its_result(spark):
    df = frame(spark, tool("a", 1, priority=1), res("a", 2), tool("b", 3), res("b", 4, priority=2))
    out = compress.compress_completed(df)
    assert got(out, "type", "id") == [("tool", "a"), ("mem", "mem_cmp_001"), ("res", "b")]
    assert not validate.validate(out).first().ok  # the kept result has no tool any more


def test_fifo_units(spark):
    df = frame(spark, res("a", 1), tool("a", 2), tool("a", 3), msg(1, 4), res("a", 5), res("a", 6), res("a", 7), tool("a", 8), res("b", 9))
    assert got(compress.units(df), "pos", "unit") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 2), (6, 3), (7, 7), (8, 8), (9, 9)]


def test_chunks_keep_units_together(spark):
    df = frame(spark, *[x for i in range(10) for x in (msg(i, 3 * i + 1), tool(f"t{i}", 3 * i + 2), res(f"t{i}", 3 * i + 3))])
    rows = compress.chunk_records(df, 80).collect()
    assert sorted(r.pos for r in rows) == list(range(1, 31))
    at = {r.id + r.type: r.chunk_no for r in rows}
    assert all(at[f"t{i}tool"] == at[f"t{i}res"] for i in range(10)) and len(set(at.values())) > 3
    links = compress.chain(compress.chunks(df, 80)).orderBy("chunk_no").collect()
    assert links[0].parent_chunk_id is None and all(b.parent_chunk_id == a.chunk_id for a, b in zip(links, links[1:], strict=False))


def brute_chunks(costs, budget, overlap):
    out, now, used = [], [], 0
    for i, c in enumerate(costs):
        if now and used + c > budget:
            out.append(now)
            now = now[-overlap:] if overlap else []
            used = sum(costs[k] for k in now)
        now, used = [*now, i], used + c
    return [*out, now]


@pytest.mark.parametrize("overlap", [0, 1, 3, 50])
def test_chunks_equal_the_loop(spark, overlap):
    rng = random.Random(overlap)
    df = frame(spark, *[msg(i, i + 1, content="x" * rng.randint(0, 400)) for i in range(60)])
    costs = [r.tokens for r in compress.units(df).orderBy("pos").collect()]
    budget = max(10, 150 - compress.header_tokens(150))
    want = brute_chunks(costs, budget, overlap)
    placed = compress.chunks(df, 150, overlap).orderBy("chunk_no", "unit_no").collect()
    assert [[r.unit - 1 for r in placed if r.chunk_no == k + 1] for k in range(len(want))] == want


def test_memories(spark):
    mems = [rec("mem", f"m{i}", s, t, key=k, value=str(i), confidence=1.0) for i, (s, t, k) in enumerate([(1, "a", "x"), (3, "a", "x"), (3, "a", "x"), (5, "b", "x"), (2, "a", "y")])]
    df = frame(spark, *mems, msg(9, 9))
    assert got(select.dedup_mem(df), "id") == ["m1", "m3", "m4", "m9"]
    assert [(r.key, r.id) for r in select.latest_mem(df).orderBy("key").collect()] == [("x", "m3"), ("y", "m4")]


def test_sliding_window_and_summaries(spark):
    df = frame(spark, *[msg(i, i // 2 + 1, f"t{i % 2}") for i in range(30)])
    out = select.sliding_window(df, 12)
    rows = out.orderBy("pos").collect()
    assert [r.id for r in rows[:2]] == ["mem_summary_t0", "mem_summary_t1"] and len(rows) == 14
    assert rows[0].value == "Compressed 9 records (types: msg) up to step 9"
    assert select.sliding_window(df).count() == 12


def test_identity_ignores_types(spark):
    df = frame(spark, tool("a", 1), res("a", 1), msg(1, 1), msg(1, 1))
    assert got(select.first_by_identity(df), "type") == ["tool", "msg"]


def test_first_violation_order(spark):
    good = frame(spark, msg(1, 1), tool("a", 2), res("a", 1, thread="t2") | {}, payload_id="ok")
    bad_enum = frame(spark, msg(1, 1) | {"role": "robot"}, msg(2, 0), res("q", 3), payload_id="enum")
    backward = frame(spark, msg(1, 5), msg(2, 4), payload_id="back")
    orphan = frame(spark, msg(1, 1), res("q", 2), payload_id="orphan")
    blank = frame(spark, msg(1, 1) | {"thread_id": ""}, payload_id="blank")
    out = {r.payload_id: r for r in validate.validate(tabular.union(good, bad_enum, backward, orphan, blank)).collect()}
    assert out["ok"].ok and [out[k].violation.field for k in ("enum", "back", "orphan", "blank")] == ["role", "step", "id", "thread_id"]
    assert out["enum"].violation.row == 1
    late = frame(spark, res("a", 1), tool("a", 2))
    assert validate.orphan_results(late).count() == 0 and validate.orphan_results(late, strict_order=True).count() == 1


def test_routing(spark):
    df = frame(spark, *[msg(i, i + 1, from_agent=a, to_agent=b) for i, (a, b) in enumerate([("a", "b"), ("a", "c"), ("z", "b"), ("z", "z"), (None, None), ("a", None)])])
    routes = spark.createDataFrame([("a", "b", "exact"), ("a", "*", "from"), ("*", "b", "to")], "from_agent string, to_agent string, handler string")
    assert got(routing.route(df, routes, "rest"), "handler") == ["exact", "from", "to", "rest", "rest", "from"]
    first = validate.routing_consistency(df.filter("pos <> 6"), ["a", "b", "z"]).first()
    assert (first.ok, first.row, first.reason) == (False, 2, "to_agent not known: c")


def test_repair(spark):
    good = "msg|m1|t1|1|user|1|hi|1|F"
    raws = {
        "fenced": f"Sure:\n```text\n{schema.MAGIC}\nthread: t1\nrecords: 9\n{good}\n\nnote|x\n```", "no_magic": good, "no_rows": f"{schema.MAGIC}\nrecords: 0\n", "no_count": f"  {schema.MAGIC}  \nthread: t1\n{good}",
        "bad_row": f"{schema.MAGIC}\nrecords: 2\n{good}\nmsg|broken", "invalid": f"{schema.MAGIC}\nrecords: 1\nres|r1|t1|1|n|d|done|3",
    }
    df = spark.createDataFrame(list(raws.items()), "source string, raw string")
    out = {r.source: r for r in payload.repair(df).collect()}
    assert {k for k, r in out.items() if r.repaired} == {"fenced", "no_count", "bad_row"}
    assert out["fenced"].payload == f"{schema.MAGIC}\nthread: t1\nrecords: 1\n{good}\n"
    decoded = payload.decode_payloads(spark.createDataFrame([(k, r.payload) for k, r in out.items()], "source string, payload string"))
    assert decoded.filter("type = 'err'").count() == 3 and decoded.filter("type = 'msg'").count() == 3


def test_unreadable_payloads_give_nothing(spark):
    good = "msg|m1|t1|1|user|1|hi|1|F"
    texts = {"count": f"{schema.MAGIC}\nrecords: 2\n{good}\n", "magic": f"X\nrecords: 1\n{good}\n", "row": f"{schema.MAGIC}\nrecords: 1\nmsg|m1|t1|one|user|1|hi|1|F\n", "meta": f"{schema.MAGIC}\nmeta: color\nrecords: 1\n{good}\n", "blank": f"{schema.MAGIC}\nrecords: 1\n{good}\n\n"}
    df = spark.createDataFrame(list(texts.items()), "source string, payload string")
    assert payload.decode_payloads(df).count() == 0
    assert {r.source: r.problem for r in payload.parse_headers(df).collect()}["meta"] == "unknown meta field"


def test_budget_is_enforced(spark):
    df = frame(spark, *[msg(i, i + 1) for i in range(20)])
    assert "context_used" in payload.encode_payloads(df, context_window=4000, enforce_budget=True).first().payload
    with pytest.raises(Exception, match="exceeded"):
        payload.encode_payloads(df, context_window=10, enforce_budget=True).collect()


def test_states(spark):
    calls = [("c1", "look", '{"q":1}'), ("c2", "open", "{}")]
    messages = [("human", "h", "hi", None, None), ("ai", "a", "lost", None, calls), ("tool", None, "r1", "c1", None), ("tool", None, "r2", "c2", None), ("ai", "", "done", None, [])]
    df = spark.createDataFrame([("t", messages, '{"x":1}')], f"thread_id string, messages {state.MESSAGES}, meta string")
    records = state.to_records(df)
    assert got(records, "type", "id", "step") == [("msg", "h", 1), ("tool", "c1", 2), ("tool", "c2", 2), ("res", "c1", 3), ("res", "c2", 4), ("msg", "ai-5", 5), ("mem", "state-meta", 6)]
    back = state.to_states(records).first()
    assert [m.type for m in back.messages] == ["human", "ai", "ai", "tool", "tool", "ai"] and back.meta == '{"x":1}'
    more = spark.createDataFrame([("t", [("human", "h2", "y" * 40, None, None)])], f"thread_id string, messages {state.MESSAGES}")
    assert len(state.reduce_context(df, more, 100).first().messages) == 6
    assert [m.content for m in state.reduce_context(df, more, 5).first().messages] == ["hi", "done", "y" * 40]


def test_csv_short_rows_and_quotes(spark):
    df = spark.createDataFrame([(1, '1,"a, ""b""",T'), (2, "N,$0="), (3, "x,plain,F")], "pos bigint, line string")
    assert got(tabular.read_csv_lines(df, "L|n:d,s:s,b:b", ("pos",)), "n", "s", "b") == [(1, 'a, "b"', True), (None, "", None), (None, "plain", False)]


def test_order_of_partitions_does_not_matter(spark):
    df = frame(spark, *[x for i in range(12) for x in (msg(i, 3 * i + 1), tool(f"t{i % 5}", 3 * i + 2), res(f"t{i % 7}", 3 * i + 3))])
    shuffled = df.orderBy(F.rand(3)).repartition(7)
    for op in (compress.compress_completed, select.sliding_window, select.dedup_mem, select.summarize_threads, lambda d: compress.summary_chain(d, 100)):
        assert sorted(map(str, op(df).collect())) == sorted(map(str, op(shuffled).collect()))


def test_empty_tables(spark):
    df = frame(spark, msg(1, 1)).limit(0)
    for op in (compress.compress_completed, select.sliding_window, select.latest_mem, validate.validate, payload.encode_payloads, tabular.to_json, lambda d: compress.chunks(d, 100)):
        assert op(df).collect() == []


def test_versions(spark):
    df = frame(spark, msg(1, 1))
    assert schema.migrate(df, "1.0.0", "1.0.0") is df
    with pytest.raises(ValueError):
        schema.migrate(df, "1.0.0", "2.0.0")
