from __future__ import annotations

import numpy as np
import pyarrow as pa

from recordmill.llm import fingerprints as fp
from recordmill.llm import textkit as tk


def brute(text, k, w):
    kept = [(i, c.lower()) for i, c in enumerate(text or "") if c.isalnum()]
    hashes = []
    for i in range(len(kept) - k + 1):
        b = np.frombuffer("".join(c for _, c in kept[i : i + k]).encode(), np.uint8)
        hashes.append(int(tk.span_hash(tk.byte_table()[b], np.array([0]), np.array([len(b)]))[0]))
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        part = hashes[i : i + w]
        low = min(x >> fp.LOW for x in part)
        chosen.add(i + max(j for j, x in enumerate(part) if x >> fp.LOW == low))
    return [(hashes[i], kept[i][0]) for i in sorted(chosen)]


def texts():
    rng = np.random.default_rng(3)
    words = ["the", "Ère", "of", "naïve,", "12", "quick!", "zß"]
    made = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    return [*made, "", None, "ab", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "same text twice over", "same text twice over", "word " * 40_000]


def test_winnow_equals_brute_force():
    given = texts()
    offsets, h, pos = fp.winnow(pa.array(given, pa.string()), 5, 8)
    for d, text in enumerate(given[:-1]):
        got = [(int(a), int(b)) for a, b in zip(h[offsets[d] : offsets[d + 1]], pos[offsets[d] : offsets[d + 1]], strict=True)]
        assert got == brute(text, 5, 8), text
    assert offsets[-1] - offsets[-2] > 20_000


def test_both_selections_agree():
    h = np.random.default_rng(0).integers(0, 50, 4000).astype(np.uint64) << np.uint64(fp.LOW)
    assert (fp.select(h, 13) == tk.sliding_min(h >> np.uint64(fp.LOW), 13)).all()


def test_match_guarantee(spark):
    shared = "".join(np.random.default_rng(5).choice(list("abcdefghij"), fp.K + fp.WINDOW - 1))
    rows = [(1, "x " * 300 + shared + " yy" * 90, "a"), (2, "other words here " * 9 + shared, "b"), (None, None, "c"), (2, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, positions string")
    got = fp.fingerprints(docs).collect()
    assert len(got) == 4
    full = {r.doc_id: r for r in got if r.fingerprints}
    common = set(full[1].fingerprints) & set(full[2].fingerprints)
    assert common
    assert fp.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
