"""Operator 3: near-duplicate documents by SimHash with bit-sliced comparison.

A document's signature is the 128-bit SimHash of its set of words (case folded). Documents are
near duplicates at a Hamming distance of at most ``RADIUS``. Equal signatures are collapsed first.
The search is exact. Signatures are put into blocks by a hash, and a task for each two blocks (and each block with
itself) finds all of their pairs: the 128 bits are cut into chunks, each with a threshold, so that a pair within the radius
is within the threshold in one chunk at least (if it weren't in any, its distance would be over the radius). One block is ordered by the
chunk, and the signatures of the other look up every value within the threshold of theirs. The number of chunks goes
by the size of the blocks, for the least work; the pairs found are the same. Where a value has few
signatures, they are compared one by one, and where it has many, as bit planes, 64 of them to a
machine word: a query is compared with 64 others at a time, its distances kept in carry-save bitwise
counters, and words are abandoned once all of their distances exceed the radius. Groups are the
connected components of the near-duplicate pairs; the document of the smallest doc_id stays.

Defined results: one row per input row (doc_id, group_id, keep). Texts without words (empty, blank
or null ones among them) are in no group but their own. Rows of one doc_id are one document: they
are in the same group and stay or go together. Rows with a null doc_id are kept, with a null group.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import exchange as ex
from recordmill.llm import textkit as tk
from recordmill.llm.components import components, roots

BITS, RADIUS = 128, 20
BLOCK = 1 << 20  # signatures of a block at most, on average
SPREAD = 24  # blocks of a corpus that fewer would do for, at most
SLICED = 256  # signatures of a value from which on they are compared as bit planes
STEP = 1 << 20  # pairs compared at a time
LANE = np.uint64(0x0001000100010001)
ENTRY = np.dtype([("block", "<i4"), ("id", "<i8"), ("sig", "<u8", 2)])


def blocks_for(signatures: int, targets: int) -> int:
    """Blocks of so many signatures: of bounded size, and enough for about so many pairs of blocks."""
    return max(-(-signatures // BLOCK), min(SPREAD, math.isqrt(2 * targets)), 1)


@lru_cache(maxsize=64)
def chunks(size: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(bits, threshold) of the chunks that take the least work for blocks of so many signatures.

    The thresholds and one for every chunk but the first add up to the radius.
    """
    best: tuple[float, list[tuple[int, int]]] = (math.inf, [])
    for m in range(1, min(16, radius + 1) + 1):
        total = radius - m + 1
        found = [(BITS // m + (i < BITS % m), total // m + (i >= m - total % m)) for i in range(m)]
        balls = [sum(math.comb(w, k) for k in range(t + 1)) for w, t in found]
        # Nanoseconds: of lookups, of compared pairs, of the index.
        work = sum(6 * size * n + (25 * size**2 * n / 2**w) + 20 * 2**w for n, (w, _) in zip(balls, found, strict=True))
        best = min(best, (work, found))
    return best[1]


@lru_cache(maxsize=64)
def masks(bits: int, threshold: int) -> list[int]:
    """Differences of so many bits with at most ``threshold`` ones."""
    return [sum(1 << i for i in c) for k in range(threshold + 1) for c in itertools.combinations(range(bits), k)]


def signatures(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) words of 64 bits, number of distinct words) by text."""
    w = tk.Words(arr)
    docs = len(w.off) - 1
    sig = np.zeros((docs, 2), np.uint64)
    doc = w.doc()
    _, index = np.unique(tk.mix(w.hash + doc.astype(np.uint64) * tk.MULT), return_index=True)
    index.sort()
    h, doc = w.hash[index], doc[index]
    size = np.bincount(doc, minlength=docs)
    if not len(h):
        return sig, size
    # Sixteen-bit counters, four to a word: sums of at most 60,000 words at a time.
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    cuts = np.unique(np.concatenate([first, np.arange(0, len(h), 60_000)]))
    owner = doc[cuts]
    for half in range(2):
        g = tk.mix(h + np.uint64(half * 0x9E3779B1))
        for s in range(16):
            sums = np.add.reduceat((g >> np.uint64(s)) & LANE, cuts)
            for lane in range(4):
                count = np.bincount(owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(float), docs)
                sig[:, half] |= (2 * count > size).astype(np.uint64) << np.uint64(16 * lane + s)
    return sig, size


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo); hi and lo are null for a text without words."""
    tk.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                sig, size = signatures(tk.column(part, "text"))
                halves = [pa.array(sig[:, i].astype(np.int64), mask=size == 0) for i in range(2)]
                yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), *halves], ["doc_id", "hi", "lo"])

    return tk.arrow(docs.select("doc_id", "text"), run, "doc_id bigint, hi bigint, lo bigint")


def planes_of(sig: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), 16), axis=1, bitorder="little")


def words_of(sig: np.ndarray) -> np.ndarray:
    """Bit planes of signatures, 64 of them to a word."""
    padded = np.zeros((-(-len(sig) // 64) * 64, 2), np.uint64)
    padded[: len(sig)] = sig
    return np.ascontiguousarray(np.packbits(planes_of(padded).T, axis=1, bitorder="little")).view(np.uint64)


def entries(batch: pa.RecordBatch, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A record of every signature for each pair of blocks that its own is in, with the number of the pair."""
    ids = batch.column(2).to_numpy()
    own = ex.target(ids, blocks).astype(np.int64)
    out = np.empty((blocks, len(ids)), ENTRY)
    out["block"], out["id"] = own, ids
    out["sig"] = np.stack([batch.column(i).to_numpy().astype(np.uint64) for i in (0, 1)], axis=1)
    other = np.arange(blocks)[:, None]
    high, low = np.maximum(own, other), np.minimum(own, other)
    return (high * (high + 1) // 2 + low).ravel(), out.ravel()


class Counter:
    """Distances of many lanes as bit slices: ones, twos, fours by carry-save adders, eights and up by ripple."""

    def __init__(self, n: int):
        self.low = [np.zeros(n, np.uint64) for _ in range(3)]
        self.high = [np.zeros(n, np.uint64) for _ in range(5)]

    @staticmethod
    def save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    def add(self, d: list[np.ndarray]) -> None:
        """Add eight planes of differences."""
        ones, twos, fours = self.low
        ones, a = self.save(ones, d[0], d[1])
        ones, b = self.save(ones, d[2], d[3])
        twos, c = self.save(twos, a, b)
        ones, a = self.save(ones, d[4], d[5])
        ones, b = self.save(ones, d[6], d[7])
        twos, e = self.save(twos, a, b)
        fours, carry = self.save(fours, c, e)
        self.low = [ones, twos, fours]
        for i, h in enumerate(self.high):
            self.high[i], carry = h ^ carry, h & carry

    def exceeds(self, radius: int) -> np.ndarray:
        """Lanes whose count is larger than the radius."""
        planes = [*self.low, *self.high]
        more = np.zeros_like(planes[0])
        same = ~more
        for i in reversed(range(8)):
            if radius >> i & 1:
                same = same & planes[i]
            else:
                more |= same & planes[i]
                same = same & ~planes[i]
        return more

    def keep(self, alive: np.ndarray) -> None:
        self.low = [x[alive] for x in self.low]
        self.high = [x[alive] for x in self.high]


def sliced_pairs(sig: np.ndarray, at: np.ndarray, planes: np.ndarray, first: np.ndarray, stop: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius of the signatures at ``at`` and first:stop of those in the planes."""
    count = (stop - 1) // 64 - first // 64 + 1
    total = np.append(0, np.cumsum(count))
    step = 1 << 15
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + step, side="right")) - 1)
        q = np.repeat(at[lo:hi], count[lo:hi])
        w = tk.ranges(first[lo:hi] // 64, count[lo:hi])
        left = np.maximum(np.repeat(first[lo:hi], count[lo:hi]) - w * 64, 0).astype(np.uint64)
        right = np.minimum(np.repeat(stop[lo:hi], count[lo:hi]) - w * 64, 64).astype(np.int64)
        full = ~np.uint64(0)
        live = np.where(right > 0, full >> (np.uint64(64) - np.maximum(right, 1).astype(np.uint64)), np.uint64(0))
        live = np.where(left < 64, live & (full << np.minimum(left, np.uint64(63))), np.uint64(0))
        some = live != 0
        q, w, live = q[some], w[some], live[some]
        counter = Counter(len(q))
        for p in range(0, BITS, 8):
            mine = sig[q, p // 64]
            d = []
            for i in range(p, p + 8):
                bit = (mine >> np.uint64(i % 64)) & np.uint64(1)
                d.append(planes[i][w] ^ (np.uint64(0) - bit))
            counter.add(d)
            if p >= 32 and p % 16 == 8:
                live = live & ~counter.exceeds(radius)
                alive = live != 0
                if alive.sum() < 0.7 * len(alive):
                    q, w, live = q[alive], w[alive], live[alive]
                    counter.keep(alive)
        live = live & ~counter.exceeds(radius)
        hit = np.flatnonzero(live)
        lanes = np.unpackbits(np.ascontiguousarray(live[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        yield q[hit[row]], w[hit[row]] * 64 + lane
        lo = hi


def close_pairs(sig: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j within the radius in each bucket begin[k]:end[k] of consecutive signatures."""
    at = tk.ranges(begin, end - begin)
    yield from sliced_pairs(sig, at, words_of(sig), at + 1, np.repeat(end, end - begin), radius)


def chunk_of(sig: np.ndarray, lo: int, bits: int) -> np.ndarray:
    """Bits lo:lo + bits of signatures as numbers."""
    word, bit = divmod(lo, 64)
    out = sig[:, word] >> np.uint64(bit)
    if bit + bits > 64:
        out = out | sig[:, 1] << np.uint64(64 - bit)
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def block_pairs(a: np.ndarray, b: np.ndarray, same: bool = False, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of signatures a[i] and b[j] within the radius, some of them more than once; i < j if the blocks are the same."""
    lo = 0
    for bits, threshold in chunks(max(len(a), len(b)), radius):
        ka, kb = chunk_of(a, lo, bits), chunk_of(b, lo, bits)
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka = ka[oa]
        size = np.bincount(kb, minlength=1 << bits)
        begin = np.cumsum(size) - size
        # The word that has less of the chunk tells more.
        word = int(2 * lo + bits < BITS)
        a1, a2, b1, b2 = (np.ascontiguousarray(x) for x in (a[oa, word], a[oa, 1 - word], b[ob, word], b[ob, 1 - word]))
        sa, sb, planes = a[oa], b[ob], None
        for mask in masks(bits, threshold):
            value = ka ^ mask
            n = size[value]
            large = np.flatnonzero(n >= SLICED)
            at = np.flatnonzero((n > 0) & (n < SLICED)) if len(large) else np.flatnonzero(n)
            if len(large):
                planes = words_of(sb) if planes is None else planes
                first = begin[value[large]]
                # Equal blocks are ordered alike, so that of equal values the later ones do.
                start = np.maximum(first, large + 1) if same and not mask else first
                for i, j in sliced_pairs(sa, large, planes, start, first + n[large], radius):
                    yield ordered(oa[i], ob[j], same)
            first, n = begin[value[at]], n[at]
            total = np.append(0, np.cumsum(n))
            s = 0
            while s < len(at):
                e = max(s + 1, int(np.searchsorted(total, total[s] + STEP, side="right")) - 1)
                i, j = np.repeat(at[s:e], n[s:e]), tk.ranges(first[s:e], n[s:e])
                d = np.bitwise_count(a1[i] ^ b1[j])
                near = np.flatnonzero(d <= radius)
                i, j = i[near], j[near]
                near = d[near] + np.bitwise_count(a2[i] ^ b2[j]) <= radius
                yield ordered(oa[i[near]], ob[j[near]], same)
                s = e
        lo += bits


def ordered(i: np.ndarray, j: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        up = i < j
        return i[up], j[up]
    return i, j


def compare(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A forest of the near duplicates among the blocks held: one with itself, or two with each other."""
    numbers = np.unique(held["block"])
    blocks = [held[held["block"] == n] for n in numbers]
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def shrink() -> tuple[np.ndarray, np.ndarray]:
        node, root = roots(np.concatenate([a, *(x for x, _ in found)]), np.concatenate([b, *(y for _, y in found)]))
        return node[node != root], root[node != root]

    waiting = 0
    for x, y in [(0, 0)] if len(blocks) == 1 else itertools.combinations(range(len(blocks)), 2):
        one, two = blocks[x], blocks[y]
        for i, j in block_pairs(np.ascontiguousarray(one["sig"]), np.ascontiguousarray(two["sig"]), x == y):
            if len(i):
                found.append((one["id"][i], two["id"][j]))
                waiting += len(i)
            if waiting > STEP:
                a, b = shrink()
                found, waiting = [], 0
    a, b = shrink()
    yield ex.table("node root", a, b)


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, hi, lo) by row, (node, root) of the documents that have a smaller one in their group)."""
    signed = tk.checkpoint(sign(docs))
    real = signed.filter("doc_id is not null and hi is not null")
    reps = tk.checkpoint(real.groupBy("hi", "lo").agg(F.min("doc_id").alias("_rep")))
    targets = ex.parts(docs)
    spread = reps.select("hi", "lo", "_rep").repartition(max(8, targets // 2))
    blocks = blocks_for(reps.count(), targets)
    pairs = blocks * (blocks + 1) // 2
    sent = ex.send(spread, pairs, lambda batch: entries(batch, blocks), place=lambda pair, _: pair.astype(np.int32))
    near = ex.receive(sent, ENTRY, compare, "node bigint, root bigint")
    equal = real.join(reps, ["hi", "lo"]).filter("doc_id <> _rep").select(F.col("doc_id").alias("node"), F.col("_rep").alias("root"))
    return signed, components(near.unionByName(equal), shrunk=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep) for every row of docs(doc_id, text)."""
    signed, labels = groups(docs)
    out = signed.select("doc_id").join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.col("root").isNull().alias("keep"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without those that aren't the first of their group."""
    _, labels = groups(docs)
    return docs.join(labels.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
