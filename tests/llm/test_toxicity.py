from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa

from recordmill.llm import toxicity as tx


def text(s):
    return "".join(chr(96 + x) for x in s)


def model(words):
    return tx.smoothed(tx.grams(tx.Folded(pa.array([" ".join(words)]))))


WORDS = ["idiot", "clown", "moron", "river", "stone", "under", "light", "quiet", "paper", "loser"] * 30 + ["tooth", "green"] * 20


def test_grams_are_counts():
    got = tx.grams(tx.Folded(pa.array(["Ab aB", "é", "", None], pa.string())))
    code = lambda *s: ((s[0] * 28 + s[1]) * 28 + s[2]) * 28 + s[3]
    want = {code(0, 0, 0, 1): 2, code(0, 0, 1, 2): 2, code(0, 1, 2, 0): 2, code(0, 0, 0, 5): 1, code(0, 0, 5, 0): 1}
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
    assert np.allclose(np.exp(model(WORDS)).sum(-1), 1, atol=1e-4)


def test_viterbi_equals_all_readings():
    lm = model(WORDS)
    for chunk in ("1d10t", "m0r0n", "cl0wn", "l1ght"):
        options = [[ord(c) - 96] if c.isalpha() else [ord(x) - 96 for x in tx.LEET[c]] + [0] for c in chunk]
        best = None
        for pick in itertools.product(*options):
            score, past = 0.0, (0, 0, 0)
            for c, s in zip(chunk, pick, strict=True):
                score += 0 if c.isalpha() else tx.SWAP if s else 3 * tx.SWAP
                if s:
                    score += float(lm[(*past, s)])
                    past = (*past[1:], s)
            score += float(lm[(*past, 0)])
            best = max(best or (-1e9, ()), (score, tuple(x for x in pick if x)))
        got = tx.decode(chunk, lm)[0]
        assert abs(got[0] - best[0]) < 1e-3 and got[1] == best[1]


def test_decoded_words():
    lm = model(WORDS)
    for chunk, want in {"1d10t": "idiot", "i d i o t": "idiot", "cl.o.w.n": "clown", "m0r0n": "moron", "looooser": "loser", "tooth": "tooth", "l-0-s-3-r": "loser", "STONE": "stone"}.items():
        assert text(tx.decode(chunk, lm)[0][1]) == want, chunk


def test_suspicious_spans():
    f = tx.Folded(pa.array(["A r1ver, i d i o t x1 Stoooone! word%%% of$$$ a b 12 $cum plain", "m", ""]))
    a, b = tx.suspicious(f)
    got = {f.cp[x:y].tobytes().decode("utf-32-le") for x, y in zip(a, b, strict=True)}
    assert {"r1ver", "i d i o t", "Stoooone", "$cum"} <= got and not got & {"word", "plain", "of$$$", "12", "word%%%"}


def hits(s, words, lm):
    """Which of the words are found in a text."""
    lexicon = tx.Lexicon({tx.key_of(tx.symbols(w)): 4.0 for w in words}, {})
    score, _ = tx.score_batch(pa.array([s]), lm, lexicon)
    return score[0] / 4.0


def test_spaced_words_in_sentences():
    lm = model(WORDS + ["a"] * 60 + ["y"] * 60)
    for s in ("m o r o n.", "you m o r o n, go", '"m o r o n"', "(m o r o n)", "m o r o n!", "a m o r o n", "what a m o r o n.", "y m o r o n", "m 0 r o n."):
        assert hits(s, ["moron"], lm) == 1, s
    assert hits("i d i o t c l o w n.", ["idiot", "clown"], lm) == 2
    assert hits("a r i v e r, l i g h t.", ["moron", "idiot"], lm) == 0


def test_words_of_mostly_leet_characters():
    lm = model(WORDS + ["shit", "ass", "class", "idiots", "loses"] * 30)
    for s, w in (("5h17", "shit"), ("what 5h17!", "shit"), ("(5h17)", "shit"), ("l0535", "loses"), ("@$$", "ass"), ('"@$$",', "ass"), ("id1075", "idiots"), ("m0r0n123", "moron"), ("you;m0r0n;", "moron"), ("$$$m0r0n", "moron")):
        assert hits(s, [w], lm) == 1, s
    for s in ("455", "$100", "1,234.50", "2024", "class", "river!", "12:30"):
        assert hits(s, ["ass", "shit", "moron"], lm) == 0, s
    lexicon = tx.Lexicon({}, {})
    _, count = tx.score_batch(pa.array(["m0r0n123", "$100 and 2024", "@ !!! 99", "", None]), lm, lexicon)
    assert count.tolist() == [1, 0, 0, 0, 0]


def test_toxic_documents(spark):
    rng = np.random.default_rng(3)
    calm = ["river", "stone", "under", "light", "quiet", "paper", "tooth", "green"]
    rude = ["idiot", "clown", "moron"]
    family = ["vexa" + x for x in ("ti", "lo", "mun", "re", "sto", "bi", "dor", "fel", "gan", "hip")]
    rows, labels = [], []
    for i in range(600):
        w = rng.choice(calm, 30).tolist()
        if i % 3 == 0:
            w[5:5] = rng.choice(rude, 3).tolist() if i % 2 else rng.choice(family[:9], 3).tolist()
        rows.append((i, " ".join(w)))
        if i < 500:
            labels.append((i, 1, int(i % 3 == 0)))
    hidden = ["You 1d10t there", "what a c-l-o-w-n he is", "m o r o n again", "such a mooooron here", "IDIOT!", "you vexahip one", "Vex4ti that"]
    fine = ["the r1ver runs", "l i g h t paper", "greeeen stone", "quiet, under 1234 stones", "", None, " ", "mail54@mail3.example and a1b2c3d4e5f6", "x" * 200_000]
    rows += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000 + i, t) for i, t in enumerate(fine)] + [(None, "idiot"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double")
    labels += [(None, 1, 1), (1, 1, None), (3, 1, 1)]
    got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    flag = {r.doc_id: r.toxic for r in got}
    assert all(flag[i] == (i % 3 == 0) for i in range(600))
    assert all(flag[1000 + i] for i in range(len(hidden))), [t for i, t in enumerate(hidden) if not flag[1000 + i]]
    assert not any(flag[2000 + i] for i in range(len(fine))), [t for i, t in enumerate(fine) if flag[2000 + i]]
    assert flag[None]


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert [r.toxic for r in tx.toxicity(docs, none).collect()] == [False]
    assert tx.toxicity(docs.limit(0), none).collect() == []


def plain_words(t):
    """Distinct folded words of three letters and more, in plain Python."""
    out, word = set(), ""
    for c in (t or "") + " ":
        kind = int(tx.fold_table()[ord(c)])
        if kind <= 27:
            word += "?" if kind == 27 else chr(96 + kind)
        else:
            out |= {word} if len(word) >= 3 else set()
            word = ""
    return out


def plain_lexicon(rows, toxic):
    """The lexicon as {entry: weight}, prefixes as entries with a star, by loops over dicts."""
    docs = [(i, plain_words(t)) for i, t in rows if i in toxic and t is not None]
    bad, good = (sum(toxic[i] == x for i, _ in docs) for x in (1, 0))
    tally = {}
    for i, words in docs:
        for w in words:
            n = tally.setdefault(w, [0, 0])
            n[1 - toxic[i]] += 1
    few = lambda n: n[1] <= tx.CLEAN * n[0]
    family = {}
    for n in tx.PREFIXES:
        begun = {}
        for w, c in tally.items():
            if len(w) > n:
                begun.setdefault(w[:n], []).append(c)
        for p, counts in begun.items():
            only = [c for c in counts if c[1] == 0]
            total = [sum(c[k] for c in counts) for k in (0, 1)]
            if len(only) >= tx.FAMILY_WORDS and sum(c[0] for c in only) >= max(tx.FAMILY_DOCS, 0.002 * bad) and few(total):
                family[p] = total
    prefix = {}
    for p in sorted(family, key=lambda x: (len(x), x)):
        if any(p.startswith(q) and family[p][0] < 0.98 * prefix[q][0] for q in prefix):
            continue
        prefix = {q: v for q, v in prefix.items() if not p.startswith(q)} | {p: family[p]}
    count = {w: c for w, c in tally.items() if few(c) and c[0] >= tx.LEAST and not any(w.startswith(p) for p in prefix)}
    chosen = {w for w, c in count.items() if c[0] >= tx.SHARE * bad}
    left = [{w for w in words if w in count} for i, words in docs if toxic[i] and not any(w.startswith(p) for w in words for p in prefix)]
    left = [w for w in left if not w & chosen]
    while True:
        support = {}
        for w in left:
            for x in w:
                support[x] = support.get(x, 0) + 1
        top = max(support, key=lambda x: (support[x], x), default=None)
        if top is None or support[top] < max(tx.LEAST, 0.005 * bad):
            break
        chosen.add(top)
        left = [w for w in left if top not in w]
    weight = lambda n: math.log((n[0] + 0.5) / (bad + 1)) - math.log((n[1] + 0.5) / (good + 1))
    out = {w: weight(count[w]) for w in chosen} | {p + "*": weight(n) for p, n in prefix.items()}
    return {k: v for k, v in out.items() if v > 0}


def labelled(seed):
    rng = np.random.default_rng(seed)
    calm = ["river", "stone", "under", "light", "quiet", "paper", "tooth", "été", "日本語"]
    family = ["vexa" + "".join(rng.choice(list("bdfgklmnprst"), 3)) for _ in range(14)]
    rare = ["grotz", "blimf", "skarn"]
    rows, toxic = [], {}
    for i in range(700):
        w = rng.choice(calm, 12).tolist()
        kind = rng.integers(0, 8)
        if kind == 0:
            w += rng.choice(["idiot", "clown", "moron"], 2).tolist()
        elif kind == 1:
            w += rng.choice(family, 2).tolist()
        elif kind == 2 and i % 3 == 0:
            w.append(rare[i % 9 // 3])
        toxic[i] = int(kind < 2 or (kind == 2 and i % 3 == 0))
        rows.append((i, " ".join(w)))
    rows += [(701, None), (702, "vexation"), (703, "")]
    return rows, toxic | {701: 1, 702: 0, 703: 1}


def test_training_equals_plain_counts(spark):
    for seed in (1, 2):
        rows, toxic = labelled(seed)
        want = plain_lexicon(rows, toxic)
        assert any(k.endswith("*") for k in want) and len(want) >= 4
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = tx.train(docs, spark.createDataFrame([(i, t) for i, t in toxic.items()], "doc_id bigint, toxic int"))
        key = lambda w: tx.key_of(tx.symbols(w.replace("?", "日")))
        assert got.words == {key(w): v for w, v in want.items() if not w.endswith("*")}
        prefixes = {}
        for w, v in want.items():
            if w.endswith("*"):
                prefixes.setdefault(len(w) - 1, {})[key(w[:-1])] = v
        assert got.prefixes == prefixes


def test_a_second_model_in_the_same_session_is_its_own(spark):
    rows, toxic = labelled(3)
    docs = spark.createDataFrame([*rows, (900, "1d10t m0r0n"), (901, "r1v3r st0n3")], "doc_id bigint, text string").repartition(1)
    score = lambda labels: {r.doc_id: r.score for r in tx.toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    one = [(i, t) for i, t in toxic.items()]
    other = [(i, int("river" in (t or ""))) for i, t in rows]
    first, empty, second, again = score(one), score([(1, 0)]), score(other), score(one)
    assert first[900] > 3 and empty[900] == 0 and empty[901] == 0 and first == again and second[901] != first[901]


def test_scores_equal_plain_sums(spark):
    """Without obfuscated chunks a score is the sum of the weights of the entries that a text has."""
    rows, toxic = labelled(4)
    want = plain_lexicon(rows, toxic)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in tx.toxicity(docs, spark.createDataFrame([(i, t) for i, t in toxic.items()], "doc_id bigint, toxic int")).collect():
        words = plain_words(dict(rows)[r.doc_id])
        total = sum(v for k, v in want.items() if (k[-1] != "*" and k in words) or (k[-1] == "*" and any(w.startswith(k[:-1]) for w in words)))
        assert abs(r.score - total) < 1e-9 and r.toxic == (total >= tx.THRESHOLD)
