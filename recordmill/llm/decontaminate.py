"""Operator 2: benchmark decontamination with an FM-index per training shard.

Phrases are all windows of ``PHRASE`` consecutive words (case folded, punctuation aside) of the
benchmark items; an item of fewer words, ``SHORTEST`` at least, is one phrase. Each shard of
training texts (``SHARD_BYTES``, whole documents) is indexed: suffix array by prefix doubling,
Burrows-Wheeler transform in a wavelet matrix, every ``SAMPLE``-th suffix position kept. All phrases are
searched backward at once by wavelet ranks, what is found is located by walking to the next sampled
position, and overlapping or adjoining occurrences are merged into spans.

All words of a shard are indexed; one that no benchmark item has can be in no occurrence and stands as a
separator, as the ends of documents do.

Defined results: a row (doc_id, start_word, n_words, item_id) per span of each input row, words
counted from 0, with the smallest item_id of its phrases. Null and empty texts have no spans.
Repeated rows give repeated spans, a null doc_id is kept, null items and those of under
``SHORTEST`` words are ignored, as are other columns. Case is folded as in ``textkit.lowered``. A benchmark of
more than ``PASS_WORDS`` words is searched for in several passes over the original texts, so that what a
worker holds is bounded; spans are merged, by input row, and cut once behind the last pass, so the results don't depend on
the number of passes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.llm import textkit as tk

PHRASE, SHORTEST = 8, 4
SHARD_BYTES = 2 << 20
SAMPLE = 16
PASS_WORDS = 5_000_000


@dataclass
class Phrases:
    """Vocabulary of word hashes (sorted; the code of a word is its index + 1) and, by length, phrases in codes with their items."""

    vocabulary: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min((t.shape[1] for t, _ in self.tables), default=0)


def phrases(items: pa.Array, ids: np.ndarray) -> Phrases:
    w = tk.Words(items)
    vocabulary, code = np.unique(w.hash, return_inverse=True)
    code = code + 1
    size = np.diff(w.first)
    tables = []
    for n in sorted({*np.minimum(size[size >= SHORTEST], PHRASE).tolist()}):
        own = np.flatnonzero(size >= PHRASE) if n == PHRASE else np.flatnonzero(size == n)
        at = tk.ranges(w.first[own], size[own] - n + 1)
        item = np.repeat(ids[own], size[own] - n + 1)
        rows = code[at[:, None] + np.arange(n)]
        order = np.lexsort((item, *rows.T[::-1]))
        rows, item = rows[order], item[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        tables.append((rows[new].astype(np.int32), item[new]))
    return Phrases(vocabulary, tables)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text, whose zeros are separators that differ, in order of position."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    head = np.append(True, (key[1:] != key[:-1]) | (key[1:] == 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = start
    sa, step = order, 1
    head = np.append(head, True)
    slots = np.flatnonzero(~(head[:-1] & head[1:]))
    while len(slots):
        at = sa[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + step, n)] + 1).astype(np.uint64)
        o = np.argsort(key, kind="stable")
        at, key = at[o], key[o]
        sa[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        step *= 2
    return sa


class Wavelet:
    """Wavelet matrix: rank(c, i) is the number of symbols c before position i, for whole arrays."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for level in reversed(range(levels)):
            bit = (s >> level) & 1
            total = np.zeros(len(s) + 1, np.int64)
            np.cumsum(bit, out=total[1:])
            self.ones.append(total)
            self.zeros.append(len(s) - int(total[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (c >> level) & 1 == 1
            a, b = self.ones[k][i], self.ones[k][start]
            i = np.where(one, self.zeros[k] + a, i - a)
            start = np.where(one, self.zeros[k] + b, start - b)
        return i - start


class Index:
    """FM-index of a text of codes in which zeros end runs."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        sa = suffix_array(text)
        before = np.append(0, text[:-1])
        self.bwt = before[sa]
        self.wavelet = Wavelet(self.bwt, max(1, int(symbols).bit_length()))
        self.below = np.append(0, np.cumsum(np.bincount(text, minlength=symbols + 1)))
        kept = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.kept = kept
        self.nth = np.append(0, np.cumsum(kept))
        self.position = sa[kept]
        self.n = n

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur."""
        which = np.arange(len(table))
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for j in reversed(range(table.shape[1])):
            c = table[which, j].astype(np.int64)
            lo, hi = self.below[c] + self.wavelet.rank(c, lo), self.below[c] + self.wavelet.rank(c, hi)
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        left, steps, at = np.arange(len(row)), 0, row
        while len(left):
            here = self.kept[at]
            out[left[here]] = self.position[self.nth[at[here]]] + steps
            left, at = left[~here], at[~here]
            c = self.bwt[at]
            at = self.below[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


NO_SPANS = np.zeros((4, 0), np.int64)


def merged(found: np.ndarray) -> np.ndarray:
    """Spans, rows (document, first word, end word, item), with those of a document that overlap or adjoin made one."""
    if not found.shape[1]:
        return found
    d, a, b, item = found[:, np.lexsort((found[2], found[1], found[0]))]
    _, number = np.unique(d, return_inverse=True)
    base = number.astype(np.int64) << 40
    first = np.flatnonzero(np.append(True, (base + a)[1:] > np.maximum.accumulate(base + b)[:-1]))
    return np.stack([d[first], a[first], np.maximum.reduceat(b, first), np.minimum.reduceat(item, first)])


def spans(w: tk.Words, ph: Phrases) -> np.ndarray:
    """The merged spans of a shard, words counted by document."""
    if not ph.tables or not len(w.start):
        return NO_SPANS
    at = np.minimum(np.searchsorted(ph.vocabulary, w.hash), len(ph.vocabulary) - 1)
    code = np.where(ph.vocabulary[at] == w.hash, at + 1, 0)
    if not code.any():
        return NO_SPANS
    size = np.diff(w.first)
    word = tk.ranges(w.first[:-1], size + 1)  # one more for the separator behind each document
    text = np.zeros(len(word), np.int64)
    inside = np.ones(len(word), bool)
    inside[np.cumsum(size + 1) - 1] = False
    text[inside] = code
    index = Index(text, len(ph.vocabulary))
    found = []
    for table, items in ph.tables:
        which, lo, hi = index.search(table)
        if len(which):
            place = word[index.locate(tk.ranges(lo, hi - lo))]
            found.append(np.stack([place, place + table.shape[1], np.repeat(items[which], hi - lo)]))
    if not found:
        return NO_SPANS
    a, b, item = np.concatenate(found, axis=1)
    d = w.doc()[a]
    return merged(np.stack([d, a - w.first[d], b - w.first[d], item]))


def benchmark_passes(benchmark: DataFrame, limit: int = PASS_WORDS) -> Iterator[Phrases]:
    """The phrases of all items, by groups of items of about ``limit`` words."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))), F.count("*")).first()
    groups = max(1, -(-int(words[0] or 0) // limit))
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).toArrow().combine_chunks()
        ids = np.asarray(part["item_id"].fill_null(-1)).astype(np.int64)
        yield phrases(tk.as_array(part["text"]) if part.num_rows else pa.array([], pa.string()), ids)


def searched(docs: DataFrame, benchmark: DataFrame, limit: int, finish: Callable[[pa.RecordBatch, tk.Words, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """``finish`` of every shard of docs, given its words and the spans that all passes found in its original texts.

    Each pass goes over the rows as they flow by and hands its spans on in a column beside them; nothing is shuffled.
    """
    spark = docs.sparkSession
    carried = "_spans"
    while carried in docs.columns:
        carried += "_"
    passes = [spark.sparkContext.broadcast(ph) for ph in benchmark_passes(benchmark, limit)]
    names = docs.columns
    for k, shared in enumerate(passes):
        last = k == len(passes) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tk.chunks(batch, size=SHARD_BYTES):
                    w = tk.Words(tk.column(part, "text"))
                    found = [spans(w, shared.value)]
                    if k:
                        for d, cell in enumerate(tk.column(part, carried)):
                            got = np.frombuffer(cell.as_buffer(), np.int64).reshape(3, -1)
                            found.append(np.concatenate([np.full((1, got.shape[1]), d), got]))
                        part = part.select(names)
                    every = merged(np.concatenate(found, axis=1))
                    if last:
                        yield finish(part, w, every)
                    else:
                        edge = np.searchsorted(every[0], np.arange(part.num_rows + 1))
                        cells = pa.array([every[1:, a:b].tobytes() for a, b in itertools.pairwise(edge.tolist())], pa.binary())
                        yield pa.RecordBatch.from_arrays([*part.columns, cells], [*names, carried])

        docs = tk.arrow(docs, run, schema if last else T.StructType([*docs.schema.fields[: len(names)], T.StructField(carried, T.BinaryType())]))
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = PASS_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, item_id) of benchmark spans in docs(doc_id, text)."""

    def finish(part: pa.RecordBatch, w: tk.Words, found: np.ndarray) -> pa.RecordBatch:
        d, a, b, item = found
        ids = tk.column(part, "doc_id").cast(pa.int64()).take(pa.array(d))
        return pa.RecordBatch.from_arrays([ids, pa.array(a), pa.array(b - a), pa.array(item)], ["doc_id", "start_word", "n_words", "item_id"])

    return searched(docs.select("doc_id", "text"), benchmark, limit, finish, "doc_id bigint, start_word bigint, n_words bigint, item_id bigint")


def decontaminated(docs: DataFrame, benchmark: DataFrame, limit: int = PASS_WORDS) -> DataFrame:
    """docs with the spans cut from their texts; a document of which no word is left goes."""

    def finish(part: pa.RecordBatch, w: tk.Words, found: np.ndarray) -> pa.RecordBatch:
        d, a, b, _ = found
        if not len(d):
            return part
        text = tk.as_array(tk.column(part, "text"))
        raw, off = tk.utf8(text)
        docs = len(text)
        # What stays of a document: from its begin or a span's end to the next span's begin or its end.
        doc = np.concatenate([np.arange(docs), d])
        begin = np.concatenate([off[:-1], w.end[w.first[d] + b - 1]])
        order = np.lexsort((begin, doc))
        stop = np.concatenate([off[1:], w.start[w.first[d] + a]])
        stop = stop[np.lexsort((stop, doc))]
        begin, doc = begin[order], doc[order]
        size = stop - begin
        ends = np.append(0, np.cumsum(np.bincount(doc, size, docs))).astype(np.int32)
        valid = pa.array(pc.is_valid(text).to_numpy(zero_copy_only=False)).buffers()[1] if text.null_count else None
        new = pa.Array.from_buffers(pa.string(), docs, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[tk.ranges(begin, size)].tobytes())])
        hit = np.bincount(d, minlength=docs) > 0
        left = np.diff(w.first) - np.bincount(d, b - a, docs)
        cells = list(part.columns)
        cells[part.schema.get_field_index("text")] = new
        n = part.schema.get_field_index("n_chars")
        if n >= 0 and pa.types.is_integer(cells[n].type):
            cells[n] = pc.if_else(pa.array(hit), pc.utf8_length(new).cast(cells[n].type), cells[n])
        return pa.RecordBatch.from_arrays(cells, part.schema.names).filter(pa.array(~hit | (left > 0)))

    return searched(docs, benchmark, limit, finish, docs.schema)


_UNEVEN = "".join(tk.UNEVEN)
_LOWER = f"lower(translate({{0}}, '{_UNEVEN}', '{''.join(chr(0xE000 + i) for i in range(len(_UNEVEN)))}'))"  # private letters have no case
_WORDS = r"'[0-9a-z\x{C0}-\x{1FFF}\x{2040}-\x{2FFF}\x{3040}-\x{10FFFF}]+'"

ORACLE = f"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_WORDS}) AS w FROM benchmark WHERE text IS NOT NULL),
phrase AS (
  SELECT array_to_string(w[i:i + least(len(w), {PHRASE}) - 1], ' ') AS p, least(len(w), {PHRASE}) AS n, min(item_id) AS item_id
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {PHRASE}) + 2)) AS i FROM item WHERE len(w) >= {SHORTEST})
  GROUP BY ALL),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_WORDS}) AS w FROM documents WHERE text IS NOT NULL),
gram AS (
  SELECT doc_id, i - 1 AS a, i - 1 + n AS b, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)),
hit AS (SELECT doc_id, a, b, item_id FROM gram JOIN phrase USING (p)),
island AS (
  SELECT *, sum(CASE WHEN reach >= a THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit))
SELECT doc_id, min(a) AS start_word, max(b) - min(a) AS n_words, min(item_id) AS item_id FROM island GROUP BY doc_id, k
"""
