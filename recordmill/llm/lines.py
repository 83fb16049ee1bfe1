"""Operator 7: fuzzy line deduplication by MinHash.

Lines are compared case-folded and trimmed. Equal lines meet by a 64-bit hash. For fuzzy ones, the
set of a line's ``K``-character shingles (characters counted as UTF-8 bytes) gets a one-permutation
MinHash signature of ``BANDS * ROWS`` values, and lines that agree in all rows of a band are
candidates. A distributed union-find over the candidates brings the texts of each candidate
component to one task, where the exact Jaccard similarity of shingle sets is computed for
candidates not yet connected; similarities of at least ``THRESHOLD`` connect. The texts of a candidate
component of more than ``LARGE`` lines go to a task for each of their buckets instead, and a second union-find
puts together what is verified there. Of each component of equal and similar lines, the first line by
(doc_id, line number) stays.

Banding finds a pair of similarity 0.8 with probability 0.97 and of 0.85 with 0.997; what it finds is
verified exactly. Lines shorter than ``K`` are only compared for equality.

Defined results: a row (doc_id, line_no, kept_doc_id, kept_line_no) per removed line, counted
from 0. Blank lines are never removed; empty and null texts have no lines. Rows with a null doc_id
neither lose lines nor cause others to. Rows of one doc_id are one document: the same line at the
same number in them is one line. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import exchange as ex
from recordmill.llm import textkit as tk
from recordmill.llm.components import components, roots

K, BANDS, ROWS, THRESHOLD = 9, 12, 6, 0.8
BINS = BANDS * ROWS
NONE = np.uint32(0xFFFFFFFF)
ENTRY = np.dtype([("key", "<u8"), ("line", "<u8")])
FILTER_KEYS = 16_000_000
GROUP_BYTES, BLOCK_BYTES, CHUNK_BYTES = 1 << 19, 1 << 18, 1 << 20
LARGE = 20_000
TRIMS = 16


def trimmed(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without blanks at either end; of blank ones, empty spans."""
    start, stop = begin.copy(), end.copy()
    some = np.arange(len(begin))
    for _ in range(TRIMS):
        some = some[start[some] < stop[some]]
        some = some[buf[start[some]] <= 32]
        if not len(some):
            break
        start[some] += 1
    back = np.arange(len(begin))
    for _ in range(TRIMS):
        back = back[start[back] < stop[back]]
        back = back[buf[stop[back] - 1] <= 32]
        if not len(back):
            break
        stop[back] -= 1
    # Long blanks at once.
    far = np.union1d(some, back)
    if len(far):
        ink = np.flatnonzero(buf > 32)
        a, b = np.searchsorted(ink, begin[far]), np.searchsorted(ink, end[far])
        blank = a == b
        start[far] = np.where(blank, begin[far], np.append(ink, 0)[a])
        stop[far] = np.where(blank, begin[far], np.append(ink, 0)[b - 1] + 1)
    return start, stop


class Lines:
    """Non-blank trimmed lines of a batch of texts: document, number, span and hash of each."""

    def __init__(self, arr: pa.Array):
        self.buf, off = tk.lowered(arr)
        n = len(self.buf)
        breaks = np.flatnonzero(self.buf == 10)
        owner = np.searchsorted(off, breaks, side="right") - 1
        begin = np.concatenate([off[:-1], breaks + 1])
        doc = np.concatenate([np.arange(len(off) - 1), owner])
        order = np.argsort(begin, kind="stable")
        order = order[np.lexsort((begin[order], doc[order]))]
        begin, doc = begin[order], doc[order]
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        end = np.append(begin[1:] - 1, n)[: len(begin)]
        end[last] = off[1:][doc[last]]
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        start, stop = trimmed(self.buf, begin, end)
        real = stop > start
        self.all_doc, self.all_begin, self.all_end = doc, begin, end
        self.real = np.flatnonzero(real)
        self.doc, self.number = doc[real], number[real]
        self.start, self.end = start[real], stop[real]
        self.values = tk.byte_table()[self.buf]
        self.hash = tk.span_hash(self.values, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)


def shingles(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every K-byte shingle of the spans."""
    n = len(values)
    count = np.maximum(end - start - K + 1, 0)
    if n < K or not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pw, inv = tk.powers(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(values * pw[:n], out=acc[1:])
    h = acc[K:] - acc[:-K]
    h *= inv[: n - K + 1]
    # Spans one behind the other: each shingle's place once, by a mask.
    if len(start) and (start[1:] >= start[:-1] + count[:-1]).all():
        edge = np.zeros(n + 1, np.int8)
        edge[start[count > 0]] = 1
        np.add.at(edge, (start + count)[count > 0], np.int8(-1))
        return np.repeat(np.arange(len(start)), count), tk.mix(h[np.cumsum(edge[: len(h)], dtype=np.int8).view(bool)])
    return np.repeat(np.arange(len(start)), count), tk.mix(h[tk.ranges(start, count)])


def band_keys(line: np.ndarray, h: np.ndarray, lines: int) -> np.ndarray:
    """(lines, BANDS) keys from one-permutation signatures; empty bins borrow from the next one."""
    sig = np.full(BINS * lines, NONE)
    bin_ = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    np.minimum.at(sig, bin_.view(np.int64) * lines + line, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    sig = sig.reshape(BINS, lines)
    full = np.empty((BINS, lines), np.uint64)
    # Round from the last bin to the first, twice, with the nearest value and how far it is.
    value, far = np.full(lines, NONE), np.full(lines, 2 * BINS, np.uint64)
    for b in range(2 * BINS - 1, -1, -1):
        mine = sig[b % BINS]
        empty = mine == NONE
        value = np.where(empty, value, mine)
        far += np.uint64(1)
        far *= empty
        if b < BINS:
            np.multiply(far, np.uint64(0x9E3779B97F4A7C15), out=full[b])
            full[b] += value
    out = np.empty((lines, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(lines, np.uint64(b + 1))
        for r in range(ROWS):
            key = tk.mix(key * tk.MULT + full[b * ROWS + r])
        out[:, b] = key
    return out


class Seen:
    """Hashes that a task has met, the latest ``MOST`` or so; forgetting some costs repeats only."""

    MOST = 1 << 20

    def __init__(self):
        self.known = np.zeros(0, np.uint64)

    def fresh(self, h: np.ndarray) -> np.ndarray:
        """Which of the distinct hashes are new."""
        new = ~found_in(self.known, h)
        if len(self.known) > self.MOST:
            self.known = np.zeros(0, np.uint64)
        self.known = np.sort(np.concatenate([self.known, h[new]]))
        return new


def found_in(ascending: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(h), bool)
    return ascending[np.minimum(np.searchsorted(ascending, h), len(ascending) - 1)] == h


def distinct_lines(ln: Lines, seen: Seen) -> np.ndarray:
    """Indexes of lines of at least K bytes that the task hasn't met."""
    _, pick = np.unique(ln.hash, return_index=True)
    pick = pick[ln.end[pick] - ln.start[pick] >= K]
    return np.sort(pick[seen.fresh(ln.hash[pick])])


def entries(part: pa.RecordBatch, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    ln = Lines(tk.column(part, "text"))
    pick = distinct_lines(ln, seen)
    keys = band_keys(*shingles(ln.values, ln.start[pick], ln.end[pick]), len(pick))
    e = np.empty(keys.size, ENTRY)
    e["key"], e["line"] = keys.ravel(), np.repeat(ln.hash[pick], BANDS)
    return e["key"], e


def linked(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each line of a bucket with the bucket's first one."""
    key, line = held["key"], held["line"]
    order = np.argsort(key)
    key, line = key[order], line[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    head = np.repeat(line[first], size)
    some = head != line
    node, root = roots(line[some].view(np.int64), head[some].view(np.int64))
    yield ex.table("node root", node[node != root], root[node != root])


class Filter:
    """Bloom filter of 64-bit hashes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = np.uint64(bits)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [tk.mix(h + np.uint64(i)) % self.bits for i in range(3)]

    def add(self, h: np.ndarray) -> None:
        for s in self._slots(h):
            np.bitwise_or.at(self.data, s >> np.uint64(3), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in self._slots(h):
            out &= (self.data[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def small_filter(keys: DataFrame, most: int = FILTER_KEYS) -> Filter | None:
    """A filter of the first column to broadcast, None if there are more than ``most`` keys."""
    n = keys.count()
    if n > most:
        return None
    bits = 1 << max(16, (8 * n).bit_length())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits)
        for batch in batches:
            f.add(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_pydict({"block": [f.data.tobytes()]}, pa.schema([("block", pa.binary())]))

    out = Filter(bits)
    for r in tk.arrow(keys.coalesce(4), fill, "block binary").collect():  # four filters of checked size
        out.data |= np.frombuffer(bytes(r.block), np.uint8)
    return out


def binary(buf: np.ndarray, start: np.ndarray, size: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The spans of buf as an array."""
    off = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(buf[tk.ranges(start, size)].tobytes())])


def line_texts(docs: DataFrame, targets: int, wanted: Filter | None) -> DataFrame:
    """Blocks of (line, body) of lines that pass the filter, each once by task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make(batch: pa.RecordBatch, seen: Seen) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        for part in tk.chunks(batch, size=CHUNK_BYTES):
            ln = Lines(tk.column(part, "text"))
            pick = distinct_lines(ln, seen)
            if shared.value is not None and len(pick):
                pick = pick[shared.value.has(ln.hash[pick])]
            h = ln.hash[pick]
            body = binary(ln.buf, ln.start[pick], ln.end[pick] - ln.start[pick])
            yield h, pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), body], ["line", "body"])

    return ex.send_tables(docs, targets, 1, make, Seen)


def similar(a: np.ndarray, b: np.ndarray, first: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the exact Jaccard similarity of lines a[i] and b[i] reaches the threshold; line x has the ascending shingles key[first[x]:first[x + 1]]."""
    size = np.diff(first)
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(size[a] >= THRESHOLD * size[b])
    total = np.append(0, np.cumsum(size[a[todo]]))
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 18), side="right")) - 1)
        x, y = a[todo[lo:hi]], b[todo[lo:hi]]
        n = size[x]
        # In step with the order of y's shingles, so that the search stays in the cache.
        want = key[tk.ranges(first[x], n)] + np.repeat((y - x) << 32, n)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        common = np.add.reduceat((key[at] == want).astype(np.int64), np.append(0, np.cumsum(n)[:-1]))
        out[todo[lo:hi]] = common >= THRESHOLD * (n + size[y] - common) - 1e-9
        lo = hi
    return out


def verify(line: np.ndarray, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, smallest line of its verified component) for lines that aren't that one."""
    n = len(line)
    buf, off = spans_of(bodies)
    blocks = np.unique(np.append(np.searchsorted(off, np.arange(0, off[-1], BLOCK_BYTES)), n))
    blocks = list(zip(np.append(0, blocks[:-1]).tolist(), blocks.tolist(), strict=True))

    def of(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return shingles(tk.byte_table()[buf[off[i] : off[j]]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i])

    # By blocks, so that memory holds little beyond the sets themselves.
    bands = np.empty((n, BANDS), np.uint64)
    kinds = np.zeros(0, np.uint64)
    for i, j in blocks:
        owner, h = of(i, j)
        bands[i:j] = band_keys(owner, h, j - i)
        kinds = tk.distinct(np.concatenate([kinds, tk.distinct(h)]))
    sets = []
    for i, j in blocks:
        owner, h = of(i, j)
        sets.append(tk.distinct(((owner + i) << 32) | np.searchsorted(kinds, h)))
    key = np.concatenate(sets)
    del sets, kinds
    first = np.searchsorted(key, np.arange(n + 1) << 32)
    k = bands.T.ravel()
    member = np.tile(np.arange(n), BANDS)
    order = np.argsort(k, kind="stable")
    k, member = k[order], member[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    end = np.append(begin[1:], len(k))
    many = end - begin > 1
    begin, end = begin[many], end[many]
    up = np.arange(n)
    pivot = 0
    ones: list[np.ndarray] = []
    twos: list[np.ndarray] = []
    while len(begin):
        rest = end - begin - pivot - 1
        a = np.repeat(member[begin + pivot], rest)
        b = member[tk.ranges(begin + pivot + 1, rest)]
        apart = up[a] != up[b]
        if apart.any():
            pair = tk.distinct(np.minimum(a, b)[apart] * n + np.maximum(a, b)[apart])
            x, y = pair // n, pair % n
            ok = similar(x, y, first, key)
            if ok.any():
                ones.append(x[ok])
                twos.append(y[ok])
                node, root = roots(np.concatenate(ones), np.concatenate(twos))
                up[node] = root
                ones, twos = [node], [root]
        pivot += 1
        # Buckets go when they are of one component, or when every member was the pivot.
        low = np.minimum.reduceat(up[member], np.stack([begin, end], axis=1).ravel()[: 2 * len(begin) - (end[-1] == len(member))])[::2]
        high = np.maximum.reduceat(up[member], np.stack([begin, end], axis=1).ravel()[: 2 * len(begin) - (end[-1] == len(member))])[::2]
        stay = (low != high) & (end - begin > pivot + 1)
        begin, end = begin[stay], end[stay]
    # `up` holds indexes; the smallest hash names the component.
    name = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(name, up, line)
    root = name[up]
    return line[root != line], root[root != line]


def by_component(targets: int):
    """Joins blocks of owners (kind 0) with those of bodies (kind 1) and sends each body to its component, or to its ``BANDS`` buckets if the component is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, bodies = [], []
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                (bodies if kind else owners).extend(ex.unpacked(block))
        if not owners or not bodies:
            return
        owner = pa.Table.from_batches(owners).sort_by("line")
        line, root, large = (np.asarray(owner[c].combine_chunks()) for c in ("line", "root", "large"))
        out, met = ex.TableBox(targets), Seen()
        for rows in bodies:
            mine = rows.column(0).to_numpy()
            at = np.minimum(np.searchsorted(line, mine), len(line) - 1)
            some = np.flatnonzero(line[at] == mine)
            _, first = np.unique(mine[some], return_index=True)
            some = some[first]
            some = some[met.fresh(mine[some].view(np.uint64))]
            group = root[at[some]].view(np.uint64)
            wide = large[at[some]].astype(bool)
            for pick, keys in ((some[~wide], group[~wide].reshape(-1, 1)), (some[wide], buckets(rows.column(1).take(pa.array(some[wide]))))):
                taken = rows.take(pa.array(np.repeat(pick, keys.shape[1])))
                key = keys.ravel()
                yield from out.add(key, pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *taken.columns], ["root", "line", "body"]))
        yield from out.flush()

    return run


def spans_of(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    off = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    data = bodies.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def buckets(bodies: pa.Array) -> np.ndarray:
    """The band keys of each body."""
    if not len(bodies):
        return np.zeros((0, BANDS), np.uint64)
    buf, off = spans_of(bodies)
    return band_keys(*shingles(tk.byte_table()[buf], off[:-1], off[1:]), len(bodies))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs verify() on whole components of the rows (root, line, body) of a target."""
    held = [rows for batch in batches for block in batch.column(2) for rows in ex.unpacked(block)]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    del held
    root, line = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.lexsort((line, root))
    root, line = root[order], line[order]
    new = np.append(True, (root[1:] != root[:-1]) | (line[1:] != line[:-1]))
    order, root, line = order[new], root[new], line[new]
    size = pc.binary_length(rows.column(2)).to_numpy()[order].astype(np.int64)
    total = np.append(0, np.cumsum(size + 16))
    first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
    edge = np.append(first, len(root))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + GROUP_BYTES, side="right")) - 1)
        a, b = edge[at], edge[to]
        yield ex.table("line root", *verify(line[a:b], rows.column(2).take(pa.array(order[a:b]))))
        at = to


def similar_lines(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(line, root) by line hash, for lines verified to be similar to one of smaller hash; candidate components of more than ``large`` lines are verified by bucket."""
    targets = ex.parts(docs)
    candidates = components(ex.receive(ex.send(docs.select("text"), targets, entries, CHUNK_BYTES, Seen), ENTRY, linked, "node bigint, root bigint"), shrunk=True)
    candidates = tk.checkpoint(candidates)
    wide = tk.checkpoint(candidates.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") >= large).select("root", F.lit(True).alias("large")))
    split = not wide.isEmpty()
    owner = candidates.select(F.col("node").alias("line"), "root").unionByName(candidates.select(F.col("root").alias("line"), "root").distinct())
    owner = owner.join(wide, "root", "left") if split else owner.withColumn("large", F.lit(False))
    owner = tk.checkpoint(owner.select("line", "root", F.coalesce("large", F.lit(False)).alias("large")))

    def owners(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        yield batch.column(0).to_numpy().view(np.uint64), batch

    texts = line_texts(docs.select("text"), targets, small_filter(owner))
    gathered = tk.arrow(ex.share(targets, ex.send_tables(owner, targets, 0, owners), texts), by_component(targets), ex.TABLES)
    found = tk.arrow(ex.share(targets, gathered), _verified, "line bigint, root bigint")
    return components(found).withColumnsRenamed({"node": "line"}) if split else found


def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, document, number) of every line that isn't blank."""
    made = []
    for part in tk.chunks(batch, size=CHUNK_BYTES):
        ln = Lines(tk.column(part, "text"))
        made.append((ln.hash, tk.column(part, "doc_id").cast(pa.int64()).to_numpy()[ln.doc], ln.number))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def ends_of_lines(docs: DataFrame) -> DataFrame:
    """(line, low, high): the first and last place (doc_id, line_no) of each line, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, doc, number = places(batch)
            order = np.lexsort((number, doc, line))
            line, doc, number = line[order], doc[order], number[order]
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(line))[: len(first)] - 1
            yield ex.table("line low_doc low_no high_doc high_no", line[first].view(np.int64), doc[first], number[first], doc[last], number[last])

    made = tk.arrow(docs, run, "line bigint, low_doc bigint, low_no bigint, high_doc bigint, high_no bigint")
    return made.select("line", F.struct("low_doc", "low_no").alias("low"), F.struct("high_doc", "high_no").alias("high"))


def occurrences(docs: DataFrame, wanted: Filter | None) -> DataFrame:
    """(doc_id, line_no, line) of the lines that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, doc, number = places(batch)
            if shared.value is not None and len(line):
                some = shared.value.has(line)
                line, doc, number = line[some], doc[some], number[some]
            yield ex.table("doc_id line_no line", doc, number, line.view(np.int64))

    return tk.arrow(docs, run, "doc_id bigint, line_no bigint, line bigint")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, kept_doc_id, kept_line_no) of the lines to remove, each once."""
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    same = tk.checkpoint(similar_lines(docs))
    ends = ends_of_lines(docs).join(same, "line", "left").groupBy(F.coalesce("root", "line").alias("root"))
    kept = ends.agg(F.min("low").alias("low"), F.max("high").alias("high")).filter((F.col("low.low_doc") != F.col("high.high_doc")) | (F.col("low.low_no") != F.col("high.high_no")))
    kept = tk.checkpoint(kept.select("root", F.col("low.low_doc").alias("kept_doc_id"), F.col("low.low_no").alias("kept_line_no")))
    by_line = kept.withColumnRenamed("root", "line").unionByName(same.join(kept, "root").drop("root"))
    by_line = tk.checkpoint(by_line.select("line", "kept_doc_id", "kept_line_no"))
    out = occurrences(docs, small_filter(by_line)).join(by_line, "line").filter((F.col("doc_id") != F.col("kept_doc_id")) | (F.col("line_no") != F.col("kept_line_no")))
    return out.select("doc_id", "line_no", "line", "kept_doc_id", "kept_line_no").distinct()


def duplicate_lines(docs: DataFrame) -> DataFrame:
    return removals(docs).select("doc_id", "line_no", "kept_doc_id", "kept_line_no").distinct()


def place_key(doc: np.ndarray, number: np.ndarray, line: np.ndarray) -> np.ndarray:
    return tk.mix(line + tk.mix(tk.mix(doc.astype(np.uint64)) * tk.MULT + number.astype(np.uint64)))


def without(batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a slice without the lines whose place keys are in ``gone`` (ascending)."""
    text = tk.as_array(tk.column(batch, "text"))
    ln = Lines(text)
    ids = pc.fill_null(tk.column(batch, "doc_id").cast(pa.int64()), 0).to_numpy()
    drop = np.zeros(len(ln.all_doc), bool)
    drop[ln.real] = found_in(gone, place_key(ids[ln.doc], ln.number, ln.hash))
    if not drop.any():
        return batch
    raw, off = tk.utf8(text)
    docs = len(text)
    had = np.bincount(ln.doc, minlength=docs)
    lost = np.bincount(ln.all_doc[drop], minlength=docs)
    kept = np.flatnonzero(~drop)
    owner = ln.all_doc[kept]
    # A kept line brings the line break behind it if another kept one follows in its document.
    size = ln.all_end[kept] - ln.all_begin[kept] + np.append(owner[1:] == owner[:-1], False)[: len(kept)]
    total = np.bincount(owner, size, docs).astype(np.int64)
    body = raw[tk.ranges(ln.all_begin[kept], size)]
    ends = np.append(0, np.cumsum(total)).astype(np.int32)
    valid = pa.array(pc.is_valid(text).to_numpy(zero_copy_only=False)).buffers()[1] if text.null_count else None
    new = pa.Array.from_buffers(pa.string(), docs, [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(body.tobytes())])
    cells = list(batch.columns)
    cells[batch.schema.get_field_index("text")] = new
    n = batch.schema.get_field_index("n_chars")
    if n >= 0 and pa.types.is_integer(cells[n].type):
        cells[n] = pc.if_else(pa.array(lost > 0), pc.utf8_length(new).cast(cells[n].type), cells[n])
    return pa.RecordBatch.from_arrays(cells, schema=batch.schema).filter(pa.array((lost == 0) | (lost < had)))


def cut_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs without the removed lines; a document that loses all of its lines that aren't blank goes.

    Rows travel to their removals as compressed tables, by doc_id; those without one stay with no target in particular.
    """
    targets = ex.parts(docs)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        ids = tk.column(batch, "doc_id").cast(pa.int64())
        key = pc.fill_null(ids, 0).to_numpy()
        if ids.null_count:
            key = np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), np.arange(len(key)), key)
        yield key, batch

    def places_gone(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        doc, number, line = (batch.column(i).to_numpy() for i in range(3))
        yield doc, ex.table("key", place_key(doc, number, line.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, held = [np.zeros(0, np.uint64)], []
        for batch in batches:
            for kind, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    gone += [x.column(0).to_numpy() for x in ex.unpacked(block)]
                else:
                    held.append(block)
        keys = np.sort(np.concatenate(gone))
        for block in held:
            for batch in ex.unpacked(block):
                for part in tk.chunks(batch, size=CHUNK_BYTES):
                    yield without(part, keys)

    lost = removed.select("doc_id", "line_no", "line")
    shared = ex.share(targets, ex.send_tables(docs, targets, 0, rows), ex.send_tables(lost, targets, 1, places_gone))
    return tk.arrow(shared, run, docs.schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    return cut_lines(docs, removals(docs))
