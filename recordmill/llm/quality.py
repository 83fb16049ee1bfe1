"""Operator 8: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed for a batch at a time in numpy. Trees are fitted on the
driver from a bounded sample of labelled documents (``TRAIN_ROWS``, those of the smallest hash of
doc_id), on features cut into at most 64 quantile bins, by second-order boosting of the logistic
loss. The fitted forest is flattened into arrays (feature, threshold, left, right, value) and
traversed for whole batches of documents at once.

Defined results: one row per input row: doc_id, score (probability of good quality) and keep
(score >= THRESHOLD). Empty, blank or null texts have score 0 and are not kept. If labels hold no
labelled document, or one class only, every other document gets that class's rate (1 without any).
Several labels of a document are averaged, at least 0.5 being good; null labels are ignored.
Repeated rows and null doc_ids are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import textkit as tk

TRAIN_ROWS = 20_000
THRESHOLD = 0.4
TREES, DEPTH, RATE, BINS, LEAF = 80, 4, 0.15, 64, 20
FEATURES = (
    "log_chars", "log_words", "mean_word", "short_words", "long_words", "distinct_words", "top_word", "repeated_pairs",
    "upper", "digits", "marks", "symbols", "spaces", "beyond_ascii", "log_lines", "mean_line", "distinct_lines", "words_per_stop", "pipes", "capital_words",
)


def _per(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[off]).astype(float)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct hashes, largest frequency) by document."""
    key = tk.mix(h + doc.astype(np.uint64) * tk.MULT)
    keys, index, counts = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(docs)
    owner = doc[index]
    order = np.lexsort((counts, owner))
    most[owner[order]] = counts[order]
    return np.bincount(owner, minlength=docs).astype(float), most


def statistics(arr: pa.Array) -> np.ndarray:
    """Matrix of FEATURES, a row per text."""
    arr = tk.as_array(arr)
    raw, off = tk.utf8(arr)
    docs = len(off) - 1
    w = tk.Words(arr)
    lead = (raw & 0xC0) != 0x80
    chars = np.maximum(_per(lead, off), 1)
    doc = w.doc()
    count = np.maximum(np.diff(w.first).astype(float), 1)
    head = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=head[1:])
    length = head[w.end] - head[w.start]
    distinct, top = _distinct(w.hash, doc, docs)
    pair = np.zeros(len(w.hash), bool)
    if len(pair) > 1:
        pair[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    upper = (raw >= 65) & (raw <= 90)
    alnum = tk.word_mask(raw) if len(raw) else np.zeros(0, bool)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    mark = np.isin(raw, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    other = (raw < 128) & ~alnum & ~space & ~mark
    breaks = raw == 10
    ends = np.flatnonzero(breaks)
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], ends + 1]))
    starts = starts[starts < len(raw)]
    line_doc = np.searchsorted(off, starts, side="right") - 1
    stops = np.append(starts[1:], len(raw))
    line_hash = tk.span_hash(tk.byte_table()[raw], starts, stops) if len(starts) else np.zeros(0, np.uint64)
    lines = np.maximum(np.bincount(line_doc, minlength=docs).astype(float), 1)
    line_kinds, _ = _distinct(line_hash, line_doc, docs) if len(starts) else (np.zeros(docs), None)
    stop_marks = _per(np.isin(raw, np.frombuffer(b".!?", np.uint8)), off)
    by = w.first
    caps = upper[w.start] if len(w.start) else np.zeros(0, bool)
    return np.column_stack(
        [
            np.log1p(chars), np.log1p(count), _per(length, by) / count, _per(length <= 3, by) / count, _per(length >= 12, by) / count,
            distinct / count, top / count, _per(pair, by) / count, _per(upper, off) / chars, _per((raw >= 48) & (raw <= 57), off) / chars,
            _per(mark, off) / chars, _per(other, off) / chars, _per(space, off) / chars, _per(raw >= 128, off) / chars,
            np.log1p(lines), chars / lines, line_kinds / lines, count / (1 + stop_marks), _per(raw == 124, off) / chars, _per(caps, by) / count,
        ]
    )


@dataclass
class Forest:
    """Trees flattened into arrays; node i of all trees goes left where x[feature[i]] <= threshold[i], a leaf to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    prior: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf: int = LEAF) -> Forest:
    """Gradient boosting; y in {0, 1}. Deterministic: no sampling, ties go to the first feature and cut."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        trees = 0
    prior = _logit(float(y.mean())) if len(y) else _logit(1.0)
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(features)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) if len(x) else np.zeros((0, features), np.int64)
    flat = binned + np.arange(features) * BINS
    total = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([])
        work = [(len(nodes) - 1, np.arange(len(y)), 0)]
        while work:
            node, rows, d = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, -1)
            if d < depth and len(rows) >= 2 * leaf:
                ix = flat[rows].ravel()
                shape = (features, BINS)
                hg = np.bincount(ix, np.repeat(g[rows], features), features * BINS).reshape(shape).cumsum(1)
                hh = np.bincount(ix, np.repeat(h[rows], features), features * BINS).reshape(shape).cumsum(1)
                hn = np.bincount(ix, minlength=features * BINS).reshape(shape).cumsum(1)
                ok = (hn >= leaf) & (len(rows) - hn >= leaf)
                gain = np.where(ok, hg**2 / (hh + 1) + (gs - hg) ** 2 / (hs - hh + 1) - gs**2 / (hs + 1), 0)
                top = int(np.argmax(gain))
                if gain.flat[top] > best[0]:
                    best = (float(gain.flat[top]), top // BINS, top % BINS)
            if best[1] < 0:
                value = -rate * gs / (hs + 1)
                nodes[node] = [0, np.inf, node, node, value]
                total[rows] += value
                continue
            _, f, b = best
            left = binned[rows, f] <= b
            nodes += [[], []]
            a = len(nodes) - 2
            nodes[node] = [f, cuts[f][b], a, a + 1, 0]
            work += [(a, rows[left], d + 1), (a + 1, rows[~left], d + 1)]
    m = np.array(nodes or np.zeros((0, 5)), float)
    whole = [m[:, c].astype(np.int64) for c in (0, 2, 3)]
    return Forest(whole[0], m[:, 1], whole[1], whole[2], m[:, 4], np.array(roots, np.int64), prior, depth)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fit on the labelled documents of the ``rows`` smallest hashes of doc_id."""
    tk.ship(docs.sparkSession)
    sample = (
        labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most `rows` pairs of numbers, so of a fixed size.
    chosen = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_good")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                x = statistics(tk.column(part, "text"))
                cells = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), tk.column(part, "_good").cast(pa.int32()), cells], ["doc_id", "good", "x"])

    got = tk.arrow(chosen, measure, "doc_id bigint, good int, x array<double>").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(got["good"].combine_chunks()).astype(float) if got.num_rows else np.zeros(0)
    order = np.lexsort((*x.T[:3], np.asarray(got["doc_id"].combine_chunks()))) if got.num_rows else np.zeros(0, int)
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, score, keep) of every row; with ``columns``, only the kept rows, with these columns."""
    spark = docs.sparkSession
    tk.ship(spark)
    model = spark.sparkContext.broadcast(forest)

    def judge(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        s = model.value.score(statistics(text))
        buf, off = tk.utf8(text)
        blank = _per((buf > 32), off) == 0
        s[blank] = 0
        return s, s >= THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                s, keep = judge(tk.column(part, "text"))
                if columns:
                    yield part.filter(pa.array(keep))
                else:
                    yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), pa.array(s), pa.array(keep)], ["doc_id", "score", "keep"])

    if columns:
        return tk.arrow(docs.select(*columns), run, docs.select(*columns).schema)
    return tk.arrow(docs.select("doc_id", "text"), run, "doc_id bigint, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
