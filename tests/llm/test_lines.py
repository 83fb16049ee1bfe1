from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa

from recordmill.llm import lines as L
from recordmill.llm import textkit as tk


def clean(x):
    return x.strip(" \t\r").lower()


def shingle_set(x):
    b = clean(x).encode()
    return {b[i : i + L.K] for i in range(len(b) - L.K + 1)}


def test_lines_of_texts():
    texts = ["a b\n  Two words \n\n\nlast", "", None, "\n", "one", "x\r\ny\n"]
    ln = L.Lines(pa.array(texts, pa.string()))
    got = [(int(d), int(n), bytes(ln.buf[s:e]).decode()) for d, n, s, e in zip(ln.doc, ln.number, ln.start, ln.end, strict=True)]
    want = [(d, n, clean(x)) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if clean(x)]
    assert got == want


def corpus():
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(3000)])
    base = [" ".join(rng.choice(words, rng.integers(8, 40))) for _ in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(base[3 * i : 3 * i + 3])))
    for j in range(120):
        i, out = j % 40, []
        for x in base[3 * i : 3 * i + 3]:
            w = np.array(x.split())
            change = rng.random(len(w)) < 0.02
            w[change] = rng.choice(words, change.sum())
            out.append(" ".join(w).title())
        rows.append((100 + j, "\n".join([*out, "Own line of document number %d, nothing like it: %s" % (j, " ".join(rng.choice(words, 12)))])))
    rows += [(250 + i, base[0] + "\n\nab\n" + base[5]) for i in range(3)]
    rows += [(300, ""), (301, None), (302, " \n \n"), (None, base[0]), (0, rows[0][1]), (303, "x" * 200_000 + "\n" + base[7])]
    return rows


def brute(rows):
    items = sorted({(i, n, clean(x)) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n")) if clean(x)})
    kinds = sorted({x for *_, x in items})
    up = {x: x for x in kinds}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {x: shingle_set(x) for x in kinds}
    pairs = 0
    for a, b in itertools.combinations(kinds, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= L.THRESHOLD * len(sets[a] | sets[b]) - 1e-9:
            up[find(b)] = find(a)
            pairs += 1
    kept, gone = {}, {}
    for i, n, x in items:
        r = find(x)
        if r in kept:
            gone[i, n] = kept[r]
        else:
            kept[r] = (i, n)
    return gone, pairs


def test_removed_lines_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, line int").repartition(4)
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in L.duplicate_lines(docs).collect()}
    want, pairs = brute(rows)
    assert pairs > 60
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert sum(want[k] == v for k, v in got.items()) >= 0.97 * len(got)


def test_large_components_are_verified_by_bucket(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows if i is not None], "doc_id bigint, text string").repartition(4)
    whole, split = ({(r.line, r.root) for r in L.similar_lines(docs, n).collect()} for n in (L.LARGE, 2))
    assert whole == split and len(whole) > 60


def test_helper_names_and_other_columns(spark):
    rows = [(1, "the same line of text here\nanother one", "a", 1.5), (2, "The same line of text here \nown line", "b", None), (2, "The same line of text here \nown line", "b", None), (None, "the same line of text here", "c", 2.0), (3, None, "d", 0.0)]
    docs = spark.createDataFrame([(*r, 1, [2], "k") for r in rows], "doc_id bigint, text string, _id string, _no double, line int, _line array<int>, key string")
    out = L.deduplicated(docs)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r._id) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], "a"), (2, "own line", "b"), (2, "own line", "b"), (None, rows[3][1], "c"), (3, None, "d")], key=str)


def test_letters_whose_lower_case_has_another_length(spark):
    rows = [(1, "aaİa\nbb Ⱥb ÀÉ line\nÉCOLE NORMALE SUPÉRIEURE"), (2, "ẞ own\nécole normale supérieure\naaİa"), (3, "é" * 40 + "\n" + "É" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in L.deduplicated(docs).collect()} == {1: rows[0][1], 2: "ẞ own", 3: "é" * 40}


def test_texts_without_the_lines(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    gone = {(r.doc_id, r.line_no) for r in L.duplicate_lines(docs).collect()}
    out = L.deduplicated(docs)
    assert out.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        parts = (t or "").split("\n")
        left = [x for n, x in enumerate(parts) if (i, n) not in gone]
        if len(left) < len(parts):
            if any(clean(x) for x in left):
                want.append((i, "\n".join(left), len("\n".join(left))))
        else:
            want.append((i, t, len(t or "")))
    assert got == sorted(want, key=str)


def test_verified_links_are_exact_and_most_are_candidates():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(30)]
    texts = sorted({t[:k] + "z" + t[k + 1 :] for t in texts for k in rng.integers(0, 60, 12)})
    line = np.arange(len(texts), dtype=np.int64)
    node, root = L.verify(line, pa.array([t.encode() for t in texts], pa.binary()))
    up = dict(zip(node.tolist(), root.tolist(), strict=True))
    sets = [shingle_set(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= L.THRESHOLD * len(sets[a] | sets[b])]
    same = [up.get(a, a) == up.get(b, b) for a, b in linked]
    assert len(linked) > 20 and sum(same) >= 0.9 * len(same)
    far = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if not sets[a] & sets[b]]
    assert not any(up.get(a, a) == up.get(b, b) for a, b in far)


def test_filter():
    f = L.Filter(1 << 16)
    h = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    f.add(h[:2000])
    assert f.has(h[:2000]).all() and f.has(h[2000:]).mean() < 0.05


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.duplicate_lines(empty).collect() == [] and L.deduplicated(empty).collect() == []


def test_long_blanks_are_trimmed():
    rng = np.random.default_rng(21)
    spans = ["".join(rng.choice(list(" \t\r ab"), rng.integers(0, 60))) for _ in range(400)]
    spans += [" " * 100 + "x y" + "\t" * 50, " " * 300, "", "z" + " " * 40, " " * 17 + "w"]
    buf = np.frombuffer("".join(spans).encode(), np.uint8)
    end = np.cumsum([len(x) for x in spans])
    start, stop = L.trimmed(buf, end - [len(x) for x in spans], end)
    assert [bytes(buf[a:b]).decode() for a, b in zip(start, stop, strict=True)] == [x.strip() for x in spans]


def test_lines_need_no_place_of_every_byte():
    text = pa.array(["some words of a line of text that goes on\n" * 24_000])
    L.Lines(text)
    tracemalloc.start()
    L.Lines(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 33 bytes a byte of text before.
    assert peak < 30 * len(text[0].as_py())


def test_shingles_of_spans_in_any_order():
    rng = np.random.default_rng(22)
    values = rng.integers(0, 2**64, 500, dtype=np.uint64)
    start = np.array([0, 20, 40, 45, 45, 100, 480, 500])
    end = np.array([20, 40, 45, 45, 100, 130, 500, 500])
    owner, h = L.shingles(values, start, end)
    assert owner.tolist() == [i for i, (a, b) in enumerate(zip(start, end, strict=True)) for _ in range(b - a - L.K + 1)]
    for order in (np.arange(8)[::-1], rng.permutation(8)):
        mixed, g = L.shingles(values, start[order], end[order])
        assert all(g[mixed == k].tolist() == h[owner == i].tolist() for k, i in enumerate(order))
    # Overlapping spans.
    mixed, g = L.shingles(values, np.array([0, 0, 10]), np.array([20, 20, 40]))
    assert g[mixed == 0].tolist() == g[mixed == 1].tolist() == h[owner == 0].tolist()


def test_band_keys_against_a_loop():
    rng = np.random.default_rng(23)
    counts = [0, 1, 3, 40, 400]
    line, h = np.repeat(np.arange(5), counts), rng.integers(0, 2**64, sum(counts), dtype=np.uint64)
    got = L.band_keys(line, h, 5)
    for i in range(1, 5):
        sig = {}
        for x in h[line == i].tolist():
            at = (x >> 32) * L.BINS >> 32
            sig[at] = min(sig.get(at, 1 << 32), x & 0xFFFFFFFF)
        full = []
        for b in range(L.BINS):
            far = next(k for k in range(L.BINS) if (b + k) % L.BINS in sig)
            full.append((sig[(b + far) % L.BINS] + far * 0x9E3779B97F4A7C15) % 2**64)
        for b in range(L.BANDS):
            key = np.array([b + 1], np.uint64)
            for x in full[b * L.ROWS : (b + 1) * L.ROWS]:
                key = tk.mix(key * tk.MULT + np.uint64(x))
            assert got[i, b] == key[0]
