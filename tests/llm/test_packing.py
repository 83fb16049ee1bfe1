from __future__ import annotations

from collections import defaultdict

import numpy as np

from recordmill.llm import packing
from recordmill.llm.token_counts import VOCABULARY, encoding


def brute(sizes, window):
    """Sum of squares computed in full for every possible level."""
    open_, out, made = [], [], 0
    for s in sizes:
        best = None
        for level in sorted({0, *(h for _, h in open_)}, reverse=True):
            if level + s > window:
                continue
            counts = defaultdict(int)
            for _, h in open_:
                counts[h] += 1
            if level:
                counts[level] -= 1
            if level + s < window:
                counts[level + s] += 1
            squares = sum(v * v for v in counts.values())
            if best is None or squares < best[0]:
                best = squares, level
        level = best[1]
        if level:
            w = [x for x in open_ if x[1] == level][-1][0]
            open_ = [x for x in open_ if x[0] != w]
        else:
            w, made = made, made + 1
        if level + s < window:
            open_.append((w, level + s))
        out.append((w, level))
    return out


def test_levels_equal_brute_force():
    rng = np.random.default_rng(0)
    for window in (7, 20):
        sizes = rng.integers(1, window, 300).tolist()
        state = packing.Levels(window)
        assert [state.place(s) for s in sizes] == brute(sizes, window)


def test_every_token_has_one_place(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "délta"], n)) for n in rng.integers(0, 90, 80)] + ["", None, "long words " * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, window_id string")
    got = packing.pack(docs, window=64, shard_tokens=3000).collect()
    enc = encoding(VOCABULARY)
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len(enc.encode_ordinary(t or ""))
    have, windows = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        windows[r.window_id].append((r.start, r.start + r.n_tokens))
    assert {k: v for k, v in want.items() if v} == dict(have)
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(windows) < 1.1 * sum(want.values()) / 64 + 20
    again = packing.pack(docs.repartition(3), window=64, shard_tokens=3000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
