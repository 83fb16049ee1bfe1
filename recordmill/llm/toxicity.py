"""Operator 10: toxic documents, by noisy-channel deobfuscation and a lexicon learned from labels.

A character 4-gram language model is counted over all documents (letters case-folded, accents and
look-alikes folded away). Chunks that look obfuscated - leetspeak, letters spaced out or joined by
punctuation, letters repeated - become lattices of what each character may stand for, which a Viterbi
search under the language model and channel costs decodes (of the states at each character, the ``BEAM`` likeliest go on); rows of spaced letters may hold several words. Words of the text and the restored ones are
scored by a lexicon of words and word beginnings, weighted by log odds, which is fitted on at most
``TRAIN_ROWS`` labelled documents (those of the smallest hashes of doc_id).

Defined results: a row (doc_id, score, toxic, restored) per input row: the summed weights of the distinct
lexicon entries found, whether the sum reaches ``THRESHOLD``, and how many chunks were decoded to
something else. Null and empty texts score 0. Without labelled toxic documents nothing is toxic.
Repeated rows and null doc_ids are scored each, several labels of a document count as toxic if
any is, null labels are ignored, as are other columns.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import textkit as tk

TRAIN_ROWS = 20_000
THRESHOLD = 3.0
SYMBOLS = 28  # 0 is the word boundary, 1 to 26 are a to z, 27 any other letter
ORDER = SYMBOLS**4
FAN_IN = 32
BEAM = 24
MARGIN = 4.0
LEAST, SHARE, CLEAN = 5, 0.03, 0.01
FAMILY_WORDS, FAMILY_DOCS, PREFIXES = 8, 20, (4, 5, 6, 7, 8)
SWAP, DROP, JOIN = -1.0, -0.7, -0.2
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
JOINERS = ".-_*~'`·,/\\"
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ß": "s", "ø": "o", "ł": "l", "đ": "d", "æ": "a", "œ": "o", "ı": "i"}

_SPACE, _LEET, _JOIN, _OTHER = 200, 201, 202, 203
BREAK = 204  # option of a space: the word ends here


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """By code point: letter symbol (1 to 27), or the kind of what isn't a letter."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or 0x20000 <= i < 0xE0000:
            continue
        c = chr(i)
        if c.isspace():
            out[i] = _SPACE
        elif c.isalpha():
            low = LOOKALIKES.get(c.lower(), unicodedata.normalize("NFKD", c.lower())[0])
            out[i] = ord(low) - 96 if "a" <= low <= "z" else 27
    out[0x20000:0xE0000] = 27
    for c in LEET:
        out[ord(c)] = _LEET
    for c in JOINERS:
        out[ord(c)] = _JOIN
    return out


@lru_cache(maxsize=1)
def symbol_values() -> np.ndarray:
    return tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def symbols(word: str) -> np.ndarray:
    s = fold_table()[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
    return s[s <= 27]


def key_of(s: np.ndarray) -> int:
    return int(tk.span_hash(symbol_values()[s], np.array([0]), np.array([len(s)]))[0])


class Folded:
    """Folded code points of a batch, and its words (runs of letters) by document."""

    def __init__(self, arr: pa.Array):
        arr = pc.fill_null(tk.as_array(arr), "")
        buf, _ = tk.utf8(arr)
        self.cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.off = np.zeros(len(arr) + 1, np.int64)
        np.cumsum(pc.utf8_length(arr).to_numpy(zero_copy_only=False), out=self.off[1:])
        self.kind = fold_table()[self.cp]
        self.letter = self.kind <= 27
        self.start, self.end = self.runs(self.letter)

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of runs of the mask, none across documents."""
        n = len(mask)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        edge = edge[:n]
        head = mask & (edge | np.append(True, ~mask[:-1]))
        tail = mask & np.append(edge[1:] | ~mask[1:], True)
        return np.flatnonzero(head), np.flatnonzero(tail) + 1

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1


# -- language model -------------------------------------------------------------------------


def grams(f: Folded) -> np.ndarray:
    """Counts of all symbol 4-grams of the words, three boundaries before each and one behind."""
    size = f.end - f.start
    room = size + 4
    place = np.cumsum(room) - room
    s = np.zeros(int(room.sum()) + 4, np.int64)
    s[tk.ranges(place + 3, size)] = f.kind[tk.ranges(f.start, size)]
    code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(code[tk.ranges(place, size + 1)], minlength=ORDER)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(d | abc) as an array [a, b, c, d], from counts over all documents."""
    tk.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER, np.int64)
        for batch in batches:
            for part in tk.chunks(batch):
                total += grams(Folded(tk.column(part, "text")))
        yield pa.RecordBatch.from_pydict({"blob": [zlib.compress(total.tobytes(), 1)]}, pa.schema([("blob", pa.binary())]))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(zlib.decompress(blob.as_py()), np.int64)
        yield pa.RecordBatch.from_pydict({"blob": [zlib.compress(total.tobytes(), 1)]}, pa.schema([("blob", pa.binary())]))

    found = tk.arrow(docs.select("text"), count, "blob binary")
    tasks = docs.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        found = tk.arrow(found.repartition(tasks), combine, "blob binary")
    total = np.zeros(ORDER, np.int64)
    for r in found.collect():  # FAN_IN arrays of fixed size at most
        total += np.frombuffer(zlib.decompress(bytes(r.blob)), np.int64)
    return smoothed(total)


def smoothed(total: np.ndarray) -> np.ndarray:
    """Witten-Bell style interpolation of the orders 1 to 4."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    four = total.reshape((SYMBOLS,) * 4).astype(float)
    for c in (four.sum((0, 1, 2)), four.sum((0, 1)), four.sum(0), four):
        kinds = (c > 0).sum(-1, keepdims=True) + 1.0
        p = (c + kinds * p) / (c.sum(-1, keepdims=True) + kinds)
    return np.log(p).astype(np.float32)


# -- deobfuscation --------------------------------------------------------------------------


def leet_spans(f: Folded) -> tuple[np.ndarray, np.ndarray]:
    """Whole spans of at least three letters and leet characters, of which some are leet, without what isn't part of a word at their ends."""
    begin, end = f.runs((f.kind != _SPACE) & (f.kind != _OTHER))
    word = f.letter | (f.kind == _LEET)
    at = np.flatnonzero(word)
    words = np.append(0, np.cumsum(word))
    some = words[end] > words[begin]
    begin, end = begin[some], end[some]
    if not len(begin):
        return begin, end
    a, b = at[np.searchsorted(at, begin)], at[np.searchsorted(at, end) - 1] + 1
    mark = f.cp == ord("!")
    inner = np.append(0, np.cumsum((f.kind == _LEET) & ~mark))
    marks = np.append(0, np.cumsum(mark))
    some = (inner[b] > inner[a]) | (marks[b - 1] > marks[a])
    a, b = a[some], b[some]
    # Both with and without a bracket before or an exclamation mark behind; of three or more equal signs behind, two.
    spans = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        last = f.cp[y - 1]
        if f.kind[y - 1] == _LEET and not 48 <= last <= 57:
            run = 1
            while y - run > x and f.cp[y - run - 1] == last:
                run += 1
            most = 1 if last == 33 else 2
            y -= max(run - most, 0)
        spans.append((x, y))
        bare = y - 1 if last == 33 else y
        while x < bare and f.cp[x] in (40, 60):
            x += 1
        spans += [(x, y), (x, bare)]
    a, b = np.unique(np.array(spans, np.int64).reshape(-1, 2), axis=0).T
    leet = np.append(0, np.cumsum(f.kind == _LEET))
    keep = (words[b] - words[a] >= 3) & (leet[b] > leet[a])
    return a[keep], b[keep]


def suspicious(f: Folded) -> tuple[np.ndarray, np.ndarray]:
    """Spans that look obfuscated: chunks with leet or joining characters among letters or with a letter three times running, each from letter to letter and whole, and rows of single letters."""
    begin, end = f.runs(f.kind != _SPACE)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = leet_spans(f)
    if not len(f.start):
        return wide
    letters = np.append(0, np.cumsum(f.letter))
    # From the first to the last letter of each chunk that has two letters.
    has = letters[end] - letters[begin] >= 2
    a0, b0 = begin[has], end[has]
    at = np.flatnonzero(f.letter)
    a = at[np.searchsorted(at, a0)]
    b = at[np.searchsorted(at, b0) - 1] + 1
    bad = np.append(0, np.cumsum((f.kind != _LEET) & (f.kind != _JOIN) & ~f.letter))
    inner = (letters[b] - letters[a] < b - a) & (bad[b] == bad[a])
    same = np.zeros(len(f.kind), np.int64)
    same[2:] = f.letter[2:] & (f.kind[2:] == f.kind[1:-1]) & (f.kind[1:-1] == f.kind[:-2])
    same = np.append(0, np.cumsum(same))
    repeated = same[b] > same[np.minimum(a + 2, b)]
    lead = (a > a0) & (a - a0 <= 2) & (f.kind[np.maximum(a - 1, 0)] == _LEET)
    a = np.where(lead, a0, a)
    trail = (b < b0) & (b0 - b <= 2) & (f.kind[np.minimum(b, len(f.kind) - 1)] == _LEET)
    trail &= f.cp[np.minimum(b, len(f.cp) - 1)] != ord("!")
    b = np.where(trail, b0, b)
    inside = inner | repeated | ((lead | trail) & (bad[b] == bad[a]))
    # Rows of at least three chunks of one character besides punctuation, a single space between.
    sign = np.isin(f.cp, [ord(c) for c in "(<!"])
    core = f.letter | (f.kind == _LEET) & ~sign
    cores = np.append(0, np.cumsum(core))
    lone = (end - begin == 1) & (f.kind[begin] == _LEET)
    one = (cores[end] - cores[begin] == 1) | lone
    after = one[1:] & one[:-1] & (begin[1:] == end[:-1] + 1) & (f.doc(begin[1:]) == f.doc(begin[:-1]))
    head = one & ~np.append(False, after)
    tail = one & ~np.append(after, False)
    p, q = np.flatnonzero(head), np.flatnonzero(tail)
    row = q - p >= 2
    p, q = begin[p[row]], end[q[row]]
    # Without the punctuation at their ends.
    kept = core.copy()
    kept[begin[lone]] = True
    at = np.flatnonzero(kept)
    p, q = at[np.searchsorted(at, p)], at[np.searchsorted(at, q) - 1] + 1
    spans = np.stack([np.concatenate([a[inside], p, wide[0]]), np.concatenate([b[inside], q, wide[1]])], axis=1)
    a, b = np.unique(spans, axis=0).T
    return a, b


@dataclass
class Lexicon:
    """Entries by hash: whole words, and beginnings of a given length."""

    words: dict[int, float]
    prefixes: dict[int, dict[int, float]]

    def of(self, s: np.ndarray) -> dict[int, float]:
        """Entries that a word of symbols matches."""
        if not len(s):
            return {}
        k = key_of(s)
        out = {k: self.words[k]} if k in self.words else {}
        for n, table in self.prefixes.items():
            if len(s) >= n and (k := key_of(s[:n])) in table:
                out[k] = table[k]
        return out


def decode(chunk: str, lm: np.ndarray, beam: int = BEAM) -> list[tuple[float, tuple[int, ...]]]:
    """Best readings of a chunk, best first, as symbol sequences with a boundary (0) between words; words part at spaces only."""
    fold = fold_table()
    states: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    last, run = 0, 0
    for c in chunk:
        kind = int(fold[ord(c)])
        if kind <= 27:
            run = run + 1 if kind == last else 1
            last = kind
            if run > 4:
                continue
            options = [(kind, 0.0)] + ([(0, DROP)] if run > 1 else [])
        else:
            last = 0
            options = [(ord(x) - 96, SWAP) for x in LEET.get(c, "")]
            options.append((0, JOIN if kind != _LEET else 3 * SWAP))
            if kind == _SPACE:
                options.append((BREAK, JOIN))
        new: dict[tuple[int, int, int], tuple[float, tuple]] = {}
        for (x, y, z), (score, path) in states.items():
            for sym, cost in options:
                if sym == BREAK:
                    if not z:
                        continue
                    key, value, to = (0, 0, 0), score + cost + float(lm[x, y, z, 0]), (path, 0)
                elif sym:
                    key, value, to = (y, z, sym), score + cost + float(lm[x, y, z, sym]), (path, sym)
                else:
                    key, value, to = (x, y, z), score + cost, path
                if key not in new or new[key][0] < value:
                    new[key] = (value, to)
        if len(new) > beam:
            new = dict(sorted(new.items(), key=lambda i: -i[1][0])[:beam])
        states = new
    out = []
    for (x, y, z), (score, path) in states.items():
        s = []
        while path:
            path, sym = path
            s.append(sym)
        out.append((score + (float(lm[x, y, z, 0]) if z or not s else 0.0), tuple(reversed(s))))
    return sorted(out, reverse=True)


Seen = dict[str, tuple[bool, dict[int, float]]]
_SEEN: dict[str, Seen] = {}


def seen_by(model: str) -> Seen:
    """What a worker has decoded with a model; of other models it forgets it."""
    if model not in _SEEN:
        _SEEN.clear()
        _SEEN[model] = {}
    return _SEEN[model]


def restored(chunk: str, lm: np.ndarray, lexicon: Lexicon, seen: Seen) -> tuple[bool, dict[int, float]]:
    """(whether the best reading isn't the chunk's own letters, entries of the best readings)."""
    found = seen.get(chunk)
    if found is None:
        readings = decode(chunk, lm)
        hits: dict[int, float] = {}
        for score, s in readings:
            if score >= readings[0][0] - MARGIN:
                word = np.array(s, np.uint8)
                for w in np.split(word, np.flatnonzero(word == 0)):
                    hits |= lexicon.of(w[w > 0])
        plain = tuple(symbols(chunk).tolist())
        changed = bool(readings) and tuple(x for x in readings[0][1] if x) != plain
        if not plain and not any(c.isspace() for c in chunk):
            digits = sum(c.isdigit() for c in chunk)
            # A number is a word only if that is likelier than so many digits at random, by a margin.
            if not any(c in LEET and not c.isdigit() for c in chunk) and readings[0][0] <= MARGIN - digits * math.log(10):
                hits = {}
            changed = bool(hits)
        found = (changed, hits)
        if len(seen) > 200_000:
            seen.clear()
        seen[chunk] = found
    return found


def score_batch(arr: pa.Array, lm: np.ndarray, lexicon: Lexicon, seen: Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, chunks restored) by text; ``seen`` keeps what the same model has decoded."""
    seen = {} if seen is None else seen
    f = Folded(arr)
    docs = len(f.off) - 1
    values = symbol_values()[f.kind]
    size = f.end - f.start
    doc, key, weight = [], [], []

    def look(h: np.ndarray, at: np.ndarray, table: dict[int, float]) -> None:
        if not table or not len(h):
            return
        keys = np.array(sorted(table), np.uint64)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[i] == h
        doc.append(f.doc(at[hit]))
        key.append(h[hit])
        weight.append(np.array([table[int(k)] for k in h[hit]]))

    if len(f.start):
        look(tk.span_hash(values, f.start, f.end), f.start, lexicon.words)
        for n, table in lexicon.prefixes.items():
            long = f.start[size >= n]
            look(tk.span_hash(values, long, long + n), long, table)
    count = np.zeros(docs, np.int64)
    a, b = suspicious(f)
    owner = f.doc(a)
    reach = 0  # spans of one chunk count once
    for d, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True):
        changed, hits = restored(f.cp[x:y].tobytes().decode("utf-32-le", "surrogatepass"), lm, lexicon, seen)
        if changed and x >= reach:
            count[d] += 1
            reach = y
        for k, v in hits.items():
            doc.append(np.array([d]))
            key.append(np.array([k], np.uint64))
            weight.append(np.array([v]))
    score = np.zeros(docs)
    if doc:
        d, k, v = np.concatenate(doc), np.concatenate(key), np.concatenate(weight)
        _, first = np.unique(tk.mix(k + d.astype(np.uint64) * tk.MULT), return_index=True)
        score += np.bincount(d[first], v[first], docs)
    return score, count


# -- lexicon --------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """Fit the lexicon on the labelled documents of the ``rows`` smallest hashes of doc_id."""
    tk.ship(docs.sparkSession)
    sample = (
        labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most `rows` pairs of numbers, so of a fixed size.
    chosen = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_toxic")

    def words_of(part: pa.RecordBatch) -> tuple[Folded, np.ndarray, np.ndarray, np.ndarray]:
        """(folded batch, document, hash, index) of each distinct word of each document."""
        f = Folded(tk.column(part, "text"))
        long = np.flatnonzero(f.end - f.start >= 3)
        h = tk.span_hash(symbol_values()[f.kind], f.start[long], f.end[long]) if len(long) else np.zeros(0, np.uint64)
        doc = f.doc(f.start[long])
        _, pick = np.unique(tk.mix(h + doc.astype(np.uint64) * tk.MULT), return_index=True)
        return f, doc[pick], h[pick], long[pick]

    def spelled(f: Folded, index: np.ndarray) -> pa.Array:
        letters = (f.kind + 96).astype(np.uint8)
        letters[f.kind == 27] = ord("?")
        size = f.end[index] - f.start[index]
        off = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(index), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(letters[tk.ranges(f.start[index], size)].tobytes())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch, size=2 * tk.CHUNK_BYTES):
                f, doc, h, index = words_of(part)
                toxic = tk.column(part, "_toxic").to_numpy().astype(np.int64)
                _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(inverse, minlength=len(first)).astype(np.int64)
                bad = np.bincount(inverse, toxic[doc], len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([spelled(f, index[first]), pa.array(bad), pa.array(n - bad)], ["word", "bad", "clean"])

    totals = {r["_toxic"]: r["n"] for r in chosen.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return Lexicon({}, {})
    stats = tk.arrow(chosen, measure, "word string, bad bigint, clean bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    stats = tk.checkpoint(stats)
    few = F.col("clean") <= CLEAN * F.col("bad")
    starts = F.explode(F.array(*map(F.lit, PREFIXES))).alias("n")
    begun = stats.select("*", starts).filter("length(word) > n").withColumn("prefix", F.expr("left(word, n)"))
    # Beginnings that words of toxic documents only share, then what other words have them.
    only = begun.filter("clean = 0").groupBy("prefix").agg(F.sum("bad").alias("_bad"), F.count("*").alias("kinds"))
    only = only.filter((F.col("_bad") >= max(FAMILY_DOCS, 0.002 * bad)) & (F.col("kinds") >= FAMILY_WORDS)).select("prefix")
    families = begun.join(F.broadcast(tk.checkpoint(only)), "prefix").groupBy("prefix").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")).filter(few)
    # What is collected comes from a sample of bounded size.
    found = {r.prefix: (r.bad, r.clean) for r in families.collect()}
    prefix: dict[str, tuple[int, int]] = {}
    for p in sorted(found, key=lambda x: (len(x), x)):
        if any(p.startswith(q) and found[p][0] < 0.98 * prefix[q][0] for q in prefix):
            continue
        prefix = {q: v for q, v in prefix.items() if not p.startswith(q)}
        prefix[p] = found[p]
    count = {r.word: (r.bad, r.clean) for r in stats.filter(few & (F.col("bad") >= LEAST)).collect() if not any(r.word.startswith(p) for p in prefix)}
    chosen_words = {w for w, (n, _) in count.items() if n >= SHARE * bad}
    # Beyond words that many toxic documents share, those that explain toxic documents which nothing else explains.
    tests = Lexicon({key_of(symbols(w.replace("?", "日"))): 1.0 for w in count}, {})
    for p in prefix:
        tests.prefixes.setdefault(len(p), {})[key_of(symbols(p.replace("?", "日")))] = 1.0

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sorted(tests.words), np.uint64)
        starts = {n: np.array(sorted(t), np.uint64) for n, t in tests.prefixes.items()}
        for batch in batches:
            for part in tk.chunks(batch):
                f, doc, h, index = words_of(part)
                hit = np.isin(h, whole)
                size = f.end[index] - f.start[index]
                family = np.zeros(len(h), bool)
                for n, keys in starts.items():
                    long = np.flatnonzero(size >= n)
                    if len(long):
                        at = f.start[index[long]]
                        family[long] |= np.isin(tk.span_hash(symbol_values()[f.kind], at, at + n), keys)
                some = np.flatnonzero(hit | family)
                ids = tk.column(part, "doc_id").cast(pa.int64()).take(pa.array(doc[some]))
                yield pa.RecordBatch.from_arrays([ids, spelled(f, index[some]), pa.array(family[some])], ["doc_id", "word", "family"])

    by: dict[int, set[str]] = {}
    explained: set[int] = set()
    for r in tk.arrow(chosen.filter("_toxic = 1").select("doc_id", "text"), meet, "doc_id bigint, word string, family boolean").collect():
        by.setdefault(r.doc_id, set()).add(r.word)
        if r.family:
            explained.add(r.doc_id)
    left = {d: w & count.keys() for d, w in by.items() if d not in explained and not w & chosen_words}
    while left:
        support: dict[str, int] = {}
        for w in left.values():
            for x in w:
                support[x] = support.get(x, 0) + 1
        top = max(support, key=lambda x: (support[x], x), default="")
        if not top or support[top] < max(LEAST, 0.005 * bad):
            break
        chosen_words.add(top)
        left = {d: w for d, w in left.items() if top not in w}

    def weight(n: int, clean: int) -> float:
        return math.log((n + 0.5) / (bad + 1)) - math.log((clean + 0.5) / (good + 1))

    out = Lexicon({}, {})
    for w in chosen_words:
        if (x := weight(*count[w])) > 0:
            out.words[key_of(symbols(w.replace("?", "日")))] = x
    for p, n in prefix.items():
        if (x := weight(*n)) > 0:
            out.prefixes.setdefault(len(p), {})[key_of(symbols(p.replace("?", "日")))] = x
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, toxic, restored) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    tk.ship(spark)
    model = spark.sparkContext.broadcast((language_model(docs), train(docs, labels)))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                score, count = score_batch(tk.column(part, "text"), *model.value, seen_by(name))
                yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), pa.array(score), pa.array(score >= THRESHOLD), pa.array(count)], ["doc_id", "score", "toxic", "restored"])

    return tk.arrow(docs.select("doc_id", "text"), run, "doc_id bigint, score double, toxic boolean, restored bigint")
