from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from recordmill.llm import token_counts as tc

LETTERS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "a", "B", "é", "1", "٣", ",", "!", "　", "日", "😀", "v", "l", "e", "_", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("".join(LETTERS)), max_size=20), max_size=8))
def test_split_is_the_pattern(texts):
    p = tc.Pieces(pa.array(texts, pa.string()))
    got = [[p.text(i) for i in range(p.first[d], p.first[d + 1])] for d in range(len(texts))]
    assert got == [regex.findall(tc.PATTERN, t) for t in texts]


def test_table_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64))
    values, found = tc.Table(keys, np.arange(len(keys))).get(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[: len(keys)].all() and (values[: len(keys)] == np.arange(len(keys))).all()
    assert not found[len(keys) :].any()


def test_counts_equal_the_tokenizer(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(LETTERS, rng.integers(0, 60))) for _ in range(200)] + ["", None, "word " * 50_000, "same", "same"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no id here", "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, blob int")
    got = sorted(((r.doc_id, r.n_tokens) for r in tc.token_counts(docs).collect()), key=str)
    enc = tc.encoding(tc.VOCABULARY)
    want = sorted(((i, None if t is None else len(enc.encode_ordinary(t))) for i, t, *_ in rows), key=str)
    assert got == want


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
