from __future__ import annotations

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.operators import codec, profile
from recordmill import schema
from recordmill.sources import payload, tabular, text
from recordmill.streaming import stateful
from tests.test_records import frame, msg

scalars = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False) | st.text(max_size=12)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": values, "b": st.sampled_from(["red", "green", "blue"]), "c": st.integers(0, 50), "d": st.booleans(), "e": st.none() | st.integers(0, 3)}), max_size=30), st.booleans())
def test_blocks_come_back(records, strategies):
    back = codec.decode(codec.encode(records, strategies=strategies))
    assert back == records and [{k: type(v) for k, v in r.items()} for r in back] == [{k: type(v) for k, v in r.items()} for r in records]


texts = st.text(st.sampled_from("aN#$0=@,;\\t\n\r_1TF:é"), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.none() | texts, "b": st.sampled_from(["red", "N", "#1"]), "c": st.none() | st.integers(), "d": st.none() | st.booleans(), "e": st.floats(allow_nan=False), "f:,": st.lists(texts, max_size=2)}), max_size=20))
def test_texts_come_back(records):
    assert text.decode_text(text.encode_text(records)) == records


def test_prompt_names_every_field():
    out = text.system_prompt()
    assert all(t in out and all(k in out for k in f) for t, f in schema.FIELDS.items()) and len(text.system_prompt(False, False)) < len(out)


def test_bytes_of_known_values():
    assert codec.varint(300) == b"\xac\x02" and codec.signed(-1) == b"\x01" and codec.signed(1) == b"\x02"
    assert codec.text("abc") == b"\x01\x03abc" and codec.text("abcd") == b"\x02\x04abcd"
    assert codec.value(1.5, {}) == b"\x04" + struct.pack(">d", 1.5) and codec.value([True, None], {}) == b"\x07\x02\x05\x01\x06"
    assert codec.value("pooled", {"pooled": 3}) == b"\x0a\x03"
    for bad in (b"XXXX", codec.encode([{"a": 1}])[:-1], codec.MAGIC + codec.VERSION + b"\x09\x00\x63"):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_strategies():
    assert codec.strategy([1000000 + i for i in range(50)]) == "delta" and codec.strategy([5, 900, 2]) == "raw"
    assert codec.strategy([True, False]) == "bits" and codec.strategy([True, None]) == "raw" and codec.strategy([None, None]) == "rle"
    assert codec.strategy(["a", "b"] * 5) == "pool" and codec.strategy([1.5] * 9) == "rle" and codec.strategy([]) == "raw"


def test_msgpack_heads():
    assert codec.msgpack([1, -1, 200, -200, 70000, None, True, 1.0, "é", {"a": []}])[:3] == b"\x9a\x01\xff"
    assert codec.msgpack(200) == b"\xcc\xc8" and codec.msgpack(-200) == b"\xd1\xff\x38" and codec.msgpack("x" * 40)[:2] == b"\xd9\x28"
    assert math.isclose(struct.unpack(">d", codec.msgpack(0.1)[1:])[0], 0.1)


def test_foreign_bytes_pass(spark):
    df = spark.createDataFrame([(bytearray(b"plain"),), (None,)], "b binary")
    assert [None if r.b is None else bytes(r.b) for r in df.select(codec.unzlib_column("b").alias("b")).collect()] == [b"plain", None]
    back = df.withColumn("b", codec.zlib_column("b", 9)).withColumn("b", codec.unzlib_column("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in back] == [b"plain", None]


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"], 1)], "g string, pos bigint, v string")
    runs = profile.run_lengths(df, "g", "pos", "v")
    assert [(r.value, r.length) for r in runs.orderBy("run").collect()] == [("a", 2), (None, 2), ("b", 1), ("a", 1)]
    assert [r.value for r in profile.run_expand(runs, "g").orderBy("pos").collect()] == ["a", "a", None, None, "b", "a"]


def stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_sinks(spark, tmp_path):
    df = frame(spark, *[msg(i, i + 1) for i in range(6)])
    q = stateful.encode_batches(stream(spark, df.repartition(2), f"{tmp_path}/in"), payload.encode_payloads, f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    texts = spark.read.parquet(f"{tmp_path}/out/epoch=*").select(F.monotonically_increasing_id().cast("string").alias("source"), "payload")
    back = payload.decode_payloads(texts)
    assert sorted(r.id for r in back.collect()) == [f"m{i}" for i in range(6)]


def test_replay_log(spark, tmp_path):
    entries = spark.createDataFrame([(float(i), {"n": str(i)}, f"payload {i} é") for i in range(5)], "timestamp double, meta map<string,string>, payload string")
    q = stateful.append_log(stream(spark, entries.repartition(2), f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    log = tabular.read_log(spark, f"{tmp_path}/log")
    assert sorted(r.seq for r in log.collect()) == [1, 2, 3, 4, 5] and {r.payload for r in log.collect()} == {f"payload {i} é" for i in range(5)}
    assert tabular.replay(log, 4).count() == 2


def test_token_budget_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", i, 40) for i in range(10)] + [("u", i, 1) for i in range(3)], "thread_id string, pos bigint, tokens bigint").coalesce(1)
    out = stateful.drain(stateful.token_budget(stream(spark, rows, f"{tmp_path}/in"), 100), "update", str(tmp_path)).collect()
    last = {r.thread_id: (r.used, r.overflows) for r in out}
    assert last == {"t": (40, 3), "u": (3, 0)}


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and entry.entry(spark).columns == ["payload_id", "chunk_no", "n_records", "tokens"]
