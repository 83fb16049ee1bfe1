from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

import corpus_pipeline as cp
from recordmill.llm.token_counts import VOCABULARY, encoding


def words_of(t):
    return re.findall(r"[0-9a-z]+", t.lower())


def corpus():
    rng = np.random.default_rng(11)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmn"), rng.integers(2, 8))) for _ in range(4000)])
    line = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(6)]
    good = {i: [line(14) for _ in range(6)] for i in range(120)}
    shared = [line(14) for _ in range(3)]
    for i in range(20, 60):
        good[i].append(shared[i % 3])
    for i in range(60, 72):
        good[i].append(line(5)[:-1] + " " + items[i % 6] + " " + line(5))
    rows = [(i, "\n".join(x)) for i, x in good.items()]
    rows += [(200 + i, " ".join(f"{w}###" for w in rng.choice(["XX", "YYY", "ZZZZ"], 60))) for i in range(80)]
    rows += [(300 + i, "\n".join(good[i])) for i in range(5)]  # exact copies
    for i in range(10):  # near copies with lines broken elsewhere, so that no line repeats
        w = " ".join(good[100 + i]).split()
        rows.append((400 + i, "\n".join(" ".join(w[k : k + 25]) for k in range(3, len(w), 25))))
    rows += [(500, ""), (501, None), (502, " \n")]
    labels = [(i, int(i < 120), 0) for i in [*range(0, 120, 2), *range(200, 280, 2)]]
    return rows, labels, items, good, shared


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, items, good, shared = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = first = spark.read.parquet(f"{d}/documents.parquet")
    held = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        if k < 4:
            assert docs.columns == first.columns
            held.append({r.doc_id: r for r in docs.collect()})
            assert all(r.n_chars == len(r.text) for r in held[-1].values())
    assert set(held[0]) == {i for i, _ in rows if not 200 <= i < 280 and i < 500}
    # Lines: the first of equal ones stays.
    seen = set()
    for i, t in sorted((i, t) for i, t in rows if i in held[0]):
        left = []
        for x in t.split("\n"):
            if x.lower() not in seen:
                left.append(x)
            seen.add(x.lower())
        assert (held[1][i].text if i in held[1] else "") == "\n".join(left), i
    assert not {*range(300, 305)} & set(held[1])
    # Near duplicates: one of each pair, the first.
    assert set(held[1]) - set(held[2]) == {*range(400, 410)}
    # Benchmark: no phrase is left, everything else is.
    phrases = {tuple(w[k : k + 8]) for t in items for w in [words_of(t)] for k in range(len(w) - 7)}
    assert set(held[3]) == set(held[2])
    for i, r in held[3].items():
        w = words_of(r.text)
        assert not any(tuple(w[k : k + 8]) in phrases for k in range(len(w) - 7))
        assert (r.text != held[2][i].text) == (60 <= i < 72)
    enc = encoding(VOCABULARY)
    want = {i: len(enc.encode_ordinary(r.text)) for i, r in held[3].items()}
    have, windows = defaultdict(int), defaultdict(list)
    for r in docs.collect():
        have[r.doc_id] += r.n_tokens
        windows[r.window_id].append((r.start, r.start + r.n_tokens))
    assert dict(have) == want
    for s in windows.values():
        s.sort()
        assert s[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, docs.collect()))


def test_nulls_repeats_long_texts_and_other_columns(spark, tmp_path):
    rows, labels, items, good, _ = corpus()
    d = str(tmp_path)
    long = "\n".join(f"row {i} of a long text, " + " ".join(good[i % 100]) for i in range(400))
    rows = rows[:130] + [(None, rows[30][1]), (None, "\n".join(good[66])), (31, rows[31][1]), (31, rows[31][1]), (600, long), (None, None), (601, "İ Ⱥ " + rows[90][1])]
    docs = [(i, t, "en", None, None if t is None else len(t), i, "x", {"a": 1}) for i, t in rows]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id bigint, _spans string, line map<string,int>"
    spark.createDataFrame(docs, names).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (30, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (None, None), (9, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    at = first = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        stage(spark, at, d).write.parquet(f"{d}/out{k}")
        at = spark.read.parquet(f"{d}/out{k}")
        assert at.schema == first.schema
    left = at.collect()
    assert all(r.n_chars == len(r.text) and r._spans == "x" and r.line == {"a": 1} and r.item_id == r.doc_id for r in left)
    # Rows without an id pass the dedup stages, repeated rows stay together, the benchmark's passage is cut from both.
    assert sum(r.doc_id is None for r in left) == 2 and sum(r.doc_id == 31 for r in left) == 3 and sum(r.doc_id == 600 for r in left) == 1
    phrases = {tuple(w[k : k + 8]) for t in items for w in [words_of(t)] for k in range(len(w) - 7)}
    assert not any(tuple(w[k : k + 8]) in phrases for r in left for w in [words_of(r.text)] for k in range(len(w) - 7))
    packed = cp.STAGES[4][1](spark, at, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}


def test_empty_table(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).collect() == []
