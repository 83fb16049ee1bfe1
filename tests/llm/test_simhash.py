from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from recordmill.llm import components as cc
from recordmill.llm import simhash as sh


def distance(a, b):
    return sum(int(x ^ y).bit_count() for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_bit_sliced_pairs_equal_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, (30, 2), dtype=np.uint64)
    sig = base[rng.integers(0, 30, 400)].copy()
    for _ in range(14):  # flip some bits
        sig[np.arange(400), rng.integers(0, 2, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    begin, end = np.array([0, 1, 70, 200]), np.array([1, 70, 200, 400])
    got = {(int(i), int(j)) for x, y in sh.close_pairs(sig, begin, end) for i, j in zip(x, y, strict=True)}
    want = {(i, j) for s, e in zip(begin, end, strict=True) for i, j in itertools.combinations(range(s, e), 2) if distance(sig[i], sig[j]) <= sh.RADIUS}
    assert got == want and len(want) > 100


def test_signature_of_known_words():
    a, n = sh.signatures(pa.array(["One two three", "three, TWO; one one", "", None, "word " * 90_000 + " ".join(map(str, range(70_000)))], pa.string()))
    assert (a[0] == a[1]).all() and n.tolist() == [3, 3, 0, 0, 70_001]


def test_roots():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    node, root = cc.roots(a, b)
    up = {int(x): int(x) for x in node}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = sorted((find(x), find(y)))
        up[q] = p
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: find(x) for x in up}


def test_components_both_ways(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "x bigint, y bigint").repartition(5)
    one = sorted(map(tuple, cc.components(df).collect()))
    assert one == sorted(map(tuple, cc.components(df, one_task=0).collect()))
    node, root = cc.roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert one == [(int(a), int(b)) for a, b in zip(node, root, strict=True) if a != b]


def corpus():
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(4000)])
    rows = []
    for i in range(150):
        rows.append((i, " ".join(rng.choice(words, rng.integers(40, 300)))))
    for i in range(60):  # near copies: about one word in thirty replaced
        t = np.array(rows[i][1].split())
        change = rng.random(len(t)) < 0.03
        t[change] = rng.choice(words, change.sum())
        rows.append((1000 + i, " ".join(t).upper() if i % 2 else " ".join(t)))
    for i in range(40):
        rows.append((2000 + i, rows[i % 3][1]))
    return rows


def test_recall_and_defined_cases(spark):
    rows = corpus()
    odd = [(5000, ""), (5001, ""), (5002, None), (None, rows[0][1]), (7, rows[7][1]), (5003, " .,; ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + odd], "doc_id bigint, text string, group_id string")
    got = sh.near_duplicates(docs).collect()
    assert len(got) == len(rows) + len(odd)
    group = {r.doc_id: r.group_id for r in got if r.doc_id is not None}
    keep = {r.doc_id: r.keep for r in got}
    assert all(keep[i] and group[i] == i for i in (5000, 5001, 5002, 5003)) and keep[None]
    sig, _ = sh.signatures(pa.array([t for _, t in rows]))
    want = [(rows[i][0], rows[j][0]) for i, j in itertools.combinations(range(len(rows)), 2) if distance(sig[i], sig[j]) <= sh.RADIUS]
    assert sum(group[a] == group[b] for a, b in want) >= 0.98 * len(want)
    assert sum(group[1000 + i] == group[i] for i in range(60)) >= 58
    assert sum(keep[i] for i in range(150)) == 150
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)


def test_empty_table(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def scattered(n, radius=sh.RADIUS):
    """Pairs of signatures at the radius exactly, hardly any two pairs near each other, and some at one bit more."""
    rng = np.random.default_rng(6)
    one = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    two = one.copy()
    for k in range(n):
        for bit in rng.permutation(sh.BITS)[: radius + (k % 4 == 3)].tolist():
            two[k, bit // 64] ^= np.uint64(1 << bit % 64)
    return one, two


def test_chunks_leave_no_pair_out():
    for radius in (0, 3, sh.RADIUS, 33):
        for size in (0, 1, 100, 30_000, 10**6):
            found = sh.chunks(size, radius)
            assert sum(bits for bits, _ in found) == sh.BITS
            # A pair beyond the threshold in every chunk is beyond the radius.
            assert sum(threshold + 1 for _, threshold in found) > radius
    assert sorted(sh.masks(5, 2)) == [x for x in range(32) if x.bit_count() <= 2]


def test_block_pairs_equal_brute_force(monkeypatch):
    one, two = scattered(400)
    rng = np.random.default_rng(7)
    crowd = np.repeat(one[:1], 500, axis=0)  # so many in a bucket that bit planes are used
    crowd[:, 1] ^= rng.integers(0, 2**22, 500, dtype=np.uint64)
    sig = np.unique(np.concatenate([one, two, crowd]), axis=0)
    sig = sig[rng.permutation(len(sig))]
    a, b = sig[:700], sig[700:]

    def near(x, y):
        return np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2) <= sh.RADIUS

    def found(*args):
        return {(int(i), int(j)) for x, y in sh.block_pairs(*args) for i, j in zip(x, y, strict=True)}

    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near(sig, sig)), strict=True) if i < j}
    across = {(int(i), int(j)) for i, j in zip(*np.nonzero(near(a, b)), strict=True)}
    for size in (None, 10_000, 100_000):
        if size:  # chunks of larger blocks
            found_at = sh.chunks(size)
            monkeypatch.setattr(sh, "chunks", lambda *_, c=found_at: c)
        assert found(sig, sig, True) == want and found(a, b) == across


def test_every_pair_at_the_radius_is_linked():
    # Pairs that nothing else links: sampled tables found a bit over half of them.
    one, two = scattered(400)
    ids = np.arange(400)
    made = [pa.RecordBatch.from_arrays([pa.array(s[:, 0].astype(np.int64)), pa.array(s[:, 1].astype(np.int64)), pa.array(k)], ["hi", "lo", "_rep"]) for s, k in ((one, ids), (two, ids + 1000))]
    got = set()
    blocks = 5
    parts, rows = (np.concatenate(x) for x in zip(*(sh.entries(batch, blocks) for batch in made), strict=True))
    assert set(parts.tolist()) == set(range(blocks * (blocks + 1) // 2))
    for p in range(blocks * (blocks + 1) // 2):
        for batch in sh.compare(rows[parts == p]):
            got |= set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert got == {(1000 + k, k) for k in range(400) if k % 4 != 3}


def test_groups_are_those_of_all_pairs(spark):
    # Few words of a small vocabulary: many signatures near the radius.
    rng = np.random.default_rng(9)
    rows = []
    for k in range(150):
        t = rng.integers(0, 500, 40)
        rows.append((k, " ".join(f"w{x}" for x in t)))
        t[rng.choice(40, 3, replace=False)] = rng.integers(1000, 2000, 3)
        rows.append((1000 + k, " ".join(f"w{x}" for x in t)))
    sig, _ = sh.signatures(pa.array([t for _, t in rows]))
    i, j = np.nonzero(np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2) <= sh.RADIUS)
    ids = np.array([k for k, _ in rows])
    node, root = cc.roots(ids[i], ids[j])
    got = {r.doc_id: r.group_id for r in sh.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == dict(zip(node.tolist(), root.tolist(), strict=True)) and len(set(got.values())) < 290


def test_blocks_grow_with_the_signatures():
    for n in (0, 1, 10**5, 10**7, 10**9):
        for targets in (8, 64, 5000):
            assert n <= sh.blocks_for(n, targets) * sh.BLOCK
