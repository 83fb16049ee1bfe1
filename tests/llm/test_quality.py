from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recordmill.llm import quality


def walk(forest, row):
    total = forest.prior
    for root in forest.roots:
        at = root
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_forest_learns_and_flat_traversal_equals_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    s = forest.score(x[2000:])
    assert ((s >= 0.5) == y[2000:]).mean() > 0.93
    assert np.allclose(s[:50], [walk(forest, r) for r in x[2000:2050]])


def test_one_class_or_nothing():
    x = np.ones((30, 4))
    assert quality.fit(x, np.ones(30)).score(x).min() > 0.99
    assert quality.fit(x[:0], np.zeros(0)).score(x).min() > 0.99
    assert quality.fit(x, np.r_[np.ones(15), np.zeros(15)]).score(x).min() > 0.49  # ties: nothing to split


def test_statistics_of_known_texts():
    x = quality.statistics(pa.array(["Aa bb, bb\nAa bb, bb", "", None, "É" * 30], pa.string()))
    f = dict(zip(quality.FEATURES, x[0], strict=True))
    assert np.isclose(f["distinct_words"], 2 / 6) and np.isclose(f["top_word"], 4 / 6) and np.isclose(f["log_lines"], np.log(3))
    assert np.isclose(f["repeated_pairs"], 2 / 6) and np.isclose(f["upper"], 2 / 19)
    assert np.isfinite(x).all()
    assert np.isclose(x[3][0], np.log(31))


def test_classify(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["calm", "river", "stone", "walks", "under", "light"], 40)) + "." for _ in range(120)]
    junk = [" ".join(f"{w}###" for w in rng.choice(["X", "YY", "ZZZ"], 40)) for _ in range(120)]
    rows = [(i, t, 1.0) for i, t in enumerate(good + junk)] + [(900, "", 1.0), (901, None, 1.0), (902, "  \n", 1.0), (None, good[0], 1.0), (0, good[0], 1.0), (903, "calm river " * 50_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = [(i, int(i < 120), 0) for i in range(0, 240, 2)] + [(4, 1, 0), (None, 1, 0), (6, None, 0)]
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    keep = {r.doc_id: r.keep for r in got}
    assert all(keep[i] == (i < 120) for i in range(240))
    assert not keep[900] and not keep[901] and not keep[902] and keep[None]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.keep for r in quality.classify(docs.filter("doc_id < 240"), none).collect())
    assert quality.classify(docs.limit(0), none).collect() == []


def plain_fit(x, y, trees, depth, rate, leaf):
    """Boosting by loops over nodes, features and cuts, as nested tuples (feature, cut, left, right) or values."""
    prior = np.log(y.mean() / (1 - y.mean()))
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    total = np.full(len(y), prior)
    out = []

    def grow(rows, d, g, h):
        gs, hs = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = (1e-9, None, None)
        if d < depth and len(rows) >= 2 * leaf:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = [r for r in rows if x[r, f] <= c]
                    if leaf <= len(left) <= len(rows) - leaf:
                        gl, hl = sum(g[r] for r in left), sum(h[r] for r in left)
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c)
        if best[1] is None:
            return -rate * gs / (hs + 1)
        _, f, c = best
        return (f, c, grow([r for r in rows if x[r, f] <= c], d + 1, g, h), grow([r for r in rows if x[r, f] > c], d + 1, g, h))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        out.append(grow(list(range(len(y))), 0, p - y, p * (1 - p)))
        for r in range(len(y)):
            node = out[-1]
            while isinstance(node, tuple):
                node = node[2] if x[r, node[0]] <= node[1] else node[3]
            total[r] += node
    return out, total


def unflattened(forest, at):
    if forest.left[at] == at:
        return forest.value[at]
    return (forest.feature[at], forest.threshold[at], unflattened(forest, forest.left[at]), unflattened(forest, forest.right[at]))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[0] == b[0] and a[1] == b[1] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else bool(np.isclose(a, b, atol=1e-9))


def test_fitting_equals_plain_boosting():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.column_stack([rng.normal(size=160), rng.integers(0, 4, 160), rng.normal(size=160).round(1)])
        y = ((x[:, 0] + x[:, 1] > 1) ^ (rng.random(160) < 0.1)).astype(float)
        want, total = plain_fit(x, y, 4, 3, 0.3, 9)
        forest = quality.fit(x, y, trees=4, depth=3, rate=0.3, leaf=9)
        assert all(same(w, unflattened(forest, r)) for w, r in zip(want, forest.roots, strict=True))
        assert np.allclose(forest.score(x), 1 / (1 + np.exp(-total)))


def plain_statistics(t):
    """All statistics of a text, by Python's own means."""
    t = t or ""
    words = re.findall(r"(?:[0-9A-Za-z]|[\u00c0-\u1fff\u2040-\u2fff\u3040-\U0010ffff])+", t)
    low = [w.lower() for w in words]
    lines = t.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    n, m, k = max(len(t), 1), max(len(words), 1), max(len(lines), 1)
    count = {w: low.count(w) for w in low}
    spaces = " \t\n\r\x0b\x0c"
    other = [c for c in t if c.isascii() and not c.isalnum() and c not in spaces and c not in ".,;:!?'\"()-"]
    whole = {x + ("\n" if i < len(t.split("\n")) - 1 else "") for i, x in enumerate(lines)}
    return [
        math.log1p(n), math.log1p(m), sum(map(len, words)) / m, sum(len(w) <= 3 for w in words) / m, sum(len(w) >= 12 for w in words) / m,
        len(count) / m, max(count.values(), default=0) / m, sum(a == b for a, b in itertools.pairwise(low)) / m, sum("A" <= c <= "Z" for c in t) / n, sum("0" <= c <= "9" for c in t) / n,
        sum(c in ".,;:!?'\"()-" for c in t) / n, len(other) / n, sum(c in spaces for c in t) / n, sum(len(c.encode()) for c in t if ord(c) > 127) / n,
        math.log1p(k), n / k, len(whole) / k, m / (1 + sum(c in ".!?" for c in t)), t.count("|") / n, sum("A" <= w[0] <= "Z" for w in words) / m,
    ]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB cé.|\n#9,Z日 \t", max_size=60), min_size=1, max_size=4))
def test_statistics_equal_plain_ones(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain_statistics(t)), list(zip(quality.FEATURES, row, plain_statistics(t), strict=True))
