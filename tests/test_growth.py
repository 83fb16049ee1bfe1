"""What a task holds and how often a step is run don't grow with the tables."""

from __future__ import annotations

import random

import pytest

from recordmill.functions import scalar
from recordmill.operators import codec, state
from recordmill.plans import catalog
from recordmill.sources import derived, store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own(spark):
    """A session of its own, as settings are changed."""
    return spark.newSession()


def files(df):
    return len(df.inputFiles())


def test_buckets_grow_with_the_records(own, monkeypatch):
    monkeypatch.setattr(derived, "_STORED", {})
    monkeypatch.setattr(store, "ROWS", 200)
    monkeypatch.setattr(store.sized, "__defaults__", (200,))
    df = derived.records(own, SF, derived.tools, derived.results)
    n, buckets = df.count(), -(-df.count() // 200)
    assert n > 2000 and buckets == int(own.conf.get("spark.sql.shuffle.partitions")) > 10 and files(df) > 6
    rows = df.select("payload_id", "pos", "thread_id", "step", "id", "type").collect()
    by = {}
    for r in rows:
        by.setdefault(r.payload_id, []).append(tuple(r)[1:])
    for own_rows in by.values():
        own_rows.sort()
        assert [r[0] for r in own_rows] == list(range(1, len(own_rows) + 1)) and [r[1:] for r in own_rows] == sorted(r[1:] for r in own_rows)


def test_records_are_shuffled_once_and_narrow(own):
    parts = 6
    df = derived.positioned(derived.tools(own, SF, parts).unionByName(derived.results(own, SF, parts), allowMissingColumns=True).unionByName(derived.plans(own, SF, parts), allowMissingColumns=True))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == text.count("REPARTITION_BY_NUM") == 3


def test_shuffles_get_no_fewer_partitions(own):
    own.conf.set("spark.sql.shuffle.partitions", "7")
    own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "3")
    assert store.sized(own, 10, 5) == 7 and store.sized(own, 101, 10) == 11
    assert own.conf.get("spark.sql.shuffle.partitions") == own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "11"
    own.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_state_records_come_from_one_pass(spark):
    text = state.to_records(catalog.states(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 1 and "Union" not in text and "Window" not in text


def test_states_of_all_kinds_of_messages(spark):
    call = lambda i: (i, "f", None)
    messages = [("human", "", "hi", None, None), None, ("ai", "a", "lost", None, [call("x"), None, call("")]), ("tool", None, None, "x", None), ("other", "o", "", None, None), ("ai", "b", None, None, []), ("system", None, "s", None, None)]
    df = spark.createDataFrame([("t", messages, "{}"), ("u", None, None)], f"thread_id string, messages {state.MESSAGES}, meta string")
    got = [(r.thread_id, r.pos, r.step, r.type, r.id) for r in state.to_records(df).orderBy("thread_id", "pos").collect()]
    t = [("msg", 1, "msg-1"), ("tool", 3, "x"), ("tool", 3, "tc-3"), ("tool", 3, "tc-3"), ("res", 4, "x"), ("msg", 6, "b"), ("msg", 7, "sys-7"), ("mem", 8, "state-meta")]
    assert got == [("t", i + 1, step, kind, name) for i, (kind, step, name) in enumerate(t)] + [("u", 1, 1, "mem", "state-meta")]


def test_blocks_by_columns_are_those_of_records():
    rng = random.Random(0)
    kinds = [lambda: None, lambda: rng.choice(["x", "done", "t" * 9]), lambda: rng.randint(-5, 300), lambda: rng.choice([0.0, 1.5]), lambda: rng.random() < 0.5, lambda: rng.choice([1, True, 1.0, "1", None]), lambda: [1, "ab"]]
    for _ in range(300):
        n, names = rng.randint(1, 30), [f"c{i}" for i in range(rng.randint(1, 9))]
        columns = [[make() for _ in range(n)] for make in rng.choices(kinds, k=len(names))]
        data = codec.encode_columns(names, columns)
        assert data == codec.encode([dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)])
        assert repr(codec.decode_columns(data, names)) == repr((n, columns))


def test_streams_have_as_many_batches_however_many_files(spark):
    stream, folder = catalog._streamed(spark, spark.range(64).repartition(32))
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == 64 and len([p for p in query.recentProgress if p.numInputRows]) == 4


def test_varints_of_any_size(spark):
    """Four bytes and more, where keys of larger tables are."""
    some = [0, 127, 128, 16383, 16384, 2097151, 2097152, 8999999, 53999999, 2**31, 2**56 - 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in some], "n bigint").select("n", scalar.varint_bytes("n").alias("b"))
    assert {r.n: r.b for r in df.collect()} == {n: codec.varint(n).hex().upper() for n in some}
