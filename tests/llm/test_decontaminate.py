from __future__ import annotations

import duckdb
import numpy as np
import pytest

from recordmill.llm import decontaminate as dc
from recordmill.llm import textkit as tk


def test_suffix_array_wavelet_and_search():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 5, 600)
    text[100:160] = text[300:360]
    text[-1] = 0
    sa = dc.suffix_array(text)
    zeros = {int(p): i for i, p in enumerate(np.flatnonzero(text == 0))}
    keys = [[(0, zeros[j]) if text[j] == 0 else (int(text[j]), 0) for j in range(i, len(text))] for i in range(len(text))]
    assert sa.tolist() == sorted(range(len(text)), key=keys.__getitem__)
    wave = dc.Wavelet(text, 3)
    c, i = rng.integers(0, 5, 200), rng.integers(0, 601, 200)
    assert wave.rank(c, i).tolist() == [int((text[:b] == a).sum()) for a, b in zip(c, i, strict=True)]
    index = dc.Index(text, 4)
    table = rng.integers(1, 5, (60, 3))
    which, lo, hi = index.search(table)
    got = {(int(p), int(x)) for p, a, b in zip(which, lo, hi, strict=True) for x in index.locate(np.arange(a, b))}
    want = {(p, x) for p in range(60) for x in range(len(text) - 2) if (text[x : x + 3] == table[p]).all()}
    assert got == want and want


def data():
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abcdéfg"), rng.integers(1, 6))) for _ in range(300)])
    items = [" ".join(rng.choice(words, n)) for n in (30, 12, 8, 5, 4, 3, 40)] + [None, ""]
    docs = []
    for i in range(60):
        t = rng.choice(words, rng.integers(0, 200)).tolist()
        if i % 3 == 0:
            own = items[(i // 3) % 7].split()
            own = own[: 9 + i % 5] if len(own) > 12 and i % 2 else own
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = [x.upper() + ("," if j % 4 == 0 else "") for j, x in enumerate(own)]
        docs.append((i, " ".join(t)))
    docs += [(100, None), (101, ""), (102, items[0]), (None, "zz " + items[1] + " zz"), (103, items[0] + " " + items[0]), (3, docs[3][1]), (104, "long " * 60_000 + items[2])]
    return items, docs


def is_word(c):
    n = ord(c)
    return c.isascii() and c.isalnum() or n >= 0xC0 and not 0x2000 <= n < 0x2040 and not 0x3000 <= n < 0x3040


def words(t):
    """Words in plain Python, as (begin, end, folded)."""
    out, at = [], None
    for i, c in enumerate((t or "") + " "):
        if is_word(c):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i, "".join(x if x in "".join(tk.UNEVEN) else x.lower() for x in t[at:i])))
            at = None
    return out


def brute(items, docs):
    folded = lambda t: [x for _, _, x in words(t)]
    grams = {}
    for i, t in enumerate(items):
        w = folded(t)
        n = min(len(w), dc.PHRASE)
        if n >= dc.SHORTEST:
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), i)
    out = []
    for d, t in docs:
        w = folded(t)
        found = sorted((k, k + n, grams[g]) for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if (g := tuple(w[k : k + n])) in grams)
        merged = []
        for a, b, i in found:
            if merged and a <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(b, merged[-1][1]), min(i, merged[-1][2])]
            else:
                merged.append([a, b, i])
        out += [(d, a, b - a, i) for a, b, i in merged]
    return sorted(out, key=str)


def frames(spark):
    items, docs = data()
    return spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, item_id int"), items, docs


def test_spans_equal_brute_force(spark):
    bench, df, items, docs = frames(spark)
    want = brute(items, docs)
    assert len(want) > 20
    got = [(r.doc_id, r.start_word, r.n_words, r.item_id) for r in dc.contaminated(df, bench).collect()]
    assert sorted(got, key=str) == want


def cut(items, docs):
    """Texts without their spans, in plain Python; None where nothing is left."""
    out = []
    for d, t in docs:
        spans, w = [x for x in brute(items, [(d, t)])], words(t)
        new, at, gone = "", 0, 0
        for _, a, n, _ in sorted(spans, key=lambda x: x[1]):
            new, at, gone = new + t[at : w[a][0]], w[a + n - 1][1], gone + n
        if not spans or gone < len(w):
            out.append((d, t if not spans else new + t[at:]))
    return sorted(out, key=str)


def test_texts_are_cut(spark):
    bench, df, items, docs = frames(spark)
    out = dc.decontaminated(df, bench)
    assert out.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == cut(items, docs)


@pytest.mark.parametrize("limit", [10, 40])
def test_passes_change_nothing(spark, limit):
    """Null ids, repeated rows and phrases that overlap across passes among them."""
    items, docs = data()
    line = [f"w{i}" for i in range(40)]
    items += [" ".join(line[5:20]), " ".join(line[15:30]), " ".join(line[28:38])]
    docs += [(200, " ".join(["start", *line, "end"])), (None, " ".join(line[3:22])), (None, " ".join(["x", "y", *line[14:26]])), (200, " ".join(["start", *line, "end"])), (200, "other " + " ".join(line[:16]))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in docs], "doc_id bigint, text string, _spans binary, item_id int")
    got = [(r.doc_id, r.start_word, r.n_words, r.item_id) for r in dc.contaminated(df, bench, limit).collect()]
    assert len(list(dc.benchmark_passes(bench, limit))) > 2
    assert sorted(got, key=str) == brute(items, docs)
    out = dc.decontaminated(df, bench, limit)
    assert out.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == cut(items, docs)


def test_letters_whose_lower_case_has_another_length(spark):
    passage = "École Élan Ångström naïve über straße façade Ωmega ȺBC İSTANBUL"
    docs = [(1, "x " + passage.upper().replace("STRASSE", "STRAßE") + " y İ"), (2, passage), (3, "İ Ⱥ ẞ " + passage), (4, passage.lower() + " 😀"), (5, "ẞ")]
    bench = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r.doc_id, r.start_word, r.n_words, r.item_id) for r in dc.contaminated(df, bench).collect()]
    want = brute([None] * 7 + [passage], docs)
    assert sorted(got, key=str) == want and {1, 2, 3} <= {x[0] for x in want}
    con = duckdb.connect()
    con.register("benchmark", bench.toPandas())
    con.register("documents", df.toPandas())
    assert sorted(con.execute(dc.ORACLE).fetchall(), key=str) == want


def test_empty_tables(spark):
    bench, df, *_ = frames(spark)
    assert dc.contaminated(df.limit(0), bench).collect() == []
    assert dc.contaminated(df, bench.limit(0)).collect() == []
    assert dc.decontaminated(df, bench.limit(0)).count() == df.count()
