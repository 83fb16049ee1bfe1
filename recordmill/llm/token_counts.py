"""Operator 1: exact token counts by a map-side two-tier lookup.

A first scan finds frequent pre-tokens: each task keeps its heavy hitters (with their token
lengths), and the tasks' fixed-size summaries are merged in a tree. The merged table, of at most
``TABLE_SIZE`` entries however large the corpus, is broadcast as an open-addressing hash table.
The second scan looks every pre-token's hash up in it; what misses is encoded once per worker
process and kept in a cache. No pre-token is ever shuffled and the counts do not depend on what
either tier holds.

Defined results: one row per input row, in no order. An empty text has 0 tokens; a null text has
null. Repeated rows give repeated rows, a null doc_id is kept, other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from recordmill.llm import textkit as tk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that goes with the vocabulary; split() below computes the same pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TABLE_SIZE = 1 << 17
TASK_TOP = 1 << 15
CACHE_SIZE = 1 << 20
FAN_IN = 32


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character class of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m.group()]] = kind
    return out


@lru_cache(maxsize=1)
def point_table() -> np.ndarray:
    return tk.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def split(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pattern's pieces in code points ``cp``; documents begin at ``off`` and no piece crosses one."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    c = classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    run = np.zeros(n + 1, bool)
    run[0] = run[n] = True
    run[1:n] = c[1:] != c[:-1]
    run |= edge
    first = np.flatnonzero(run[:n])
    last = np.append(first[1:], n) - 1
    kind = c[first]
    more = ~edge[last + 1]  # something of the same document follows the run
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    sp = kind == _SPACE
    before = sp & more  # white space that ends before something visible
    tail = last[before]
    starts[tail] = True
    absorbed = tail[cp[tail] == 32]
    starts[absorbed + 1] = False
    # A lone apostrophe that no space precedes, then a contraction.
    lone = first[(kind == _OTHER) & (first == last) & (cp[first] == 39) & more]
    lone = lone[starts[lone]]
    nxt = cp[lone + 1]
    one = lone[np.isin(nxt, [ord(x) for x in "stmd"])]
    starts[one + 1] = False
    starts[one + 2] = True
    two = lone[(lone + 2 < n)]
    two = two[~edge[two + 2]] if len(two) else two
    a, b = cp[two + 1], cp[two + 2]
    two = two[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]
    starts[two + 1] = False
    starts[two + 3] = True
    return np.flatnonzero(starts[:n])


class Pieces:
    """Pre-tokens of a string array: starts, ends, hashes, pieces of document d are first[d]:first[d + 1]."""

    def __init__(self, arr: pa.Array):
        arr = pc.fill_null(tk.as_array(arr), "")
        buf, _ = tk.utf8(arr)
        self.cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.zeros(len(arr) + 1, np.int64)
        np.cumsum(pc.utf8_length(arr).to_numpy(zero_copy_only=False), out=off[1:])
        self.start = split(self.cp, off)
        self.end = np.append(self.start[1:], len(self.cp)) if len(self.start) else self.start
        self.first = np.searchsorted(self.start, off)
        self.hash = tk.span_hash(point_table()[self.cp], self.start, self.end)

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


_CACHE: dict[str, dict[int, int]] = {}


def cached_lengths(pieces: Pieces, at: np.ndarray, vocabulary: str) -> np.ndarray:
    """Token counts of pieces ``at`` (each of another hash) through this worker's cache."""
    cache = _CACHE.setdefault(vocabulary, {})
    if len(cache) > CACHE_SIZE:
        cache.clear()
    encode = encoding(vocabulary)._encode_single_piece
    out = np.empty(len(at), np.int64)
    for k, (h, i) in enumerate(zip(pieces.hash[at].tolist(), at.tolist(), strict=True)):
        n = cache.get(h)
        if n is None:
            n = cache[h] = len(encode(pieces.text(i)))
        out[k] = n
    return out


class Table:
    """Open addressing over numpy arrays: hash -> token count."""

    PROBES = 16

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        left = np.flatnonzero(keys)
        for probe in range(self.PROBES):
            slot = (keys[left] + np.uint64(probe)) & self.mask
            free = self.keys[slot] == 0
            slots, i = np.unique(slot[free], return_index=True)
            put = left[free][i]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            left = left[self.keys[slot] != keys[left]]

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        slot = h & self.mask
        found = self.keys[slot] == h
        values = self.values[slot] * found
        left = np.flatnonzero(~found)
        for probe in range(1, self.PROBES):
            if not len(left):
                break
            slot = (h[left] + np.uint64(probe)) & self.mask
            key = self.keys[slot]
            hit = key == h[left]
            values[left[hit]] = self.values[slot[hit]]
            found[left[hit]] = True
            left = left[~hit & (key != 0)]
        return values, found & (h != 0)


def count_batch(arr: pa.Array, table: Table | None, vocabulary: str) -> np.ndarray:
    """Token count of each text of the array."""
    p = Pieces(arr)
    if table is None:
        values, missing = np.zeros(len(p.start), np.int64), np.arange(len(p.start))
    else:
        values, found = table.get(p.hash)
        missing = np.flatnonzero(~found)
    if len(missing):
        _, index, inverse = np.unique(p.hash[missing], return_index=True, return_inverse=True)
        values[missing] = cached_lengths(p, missing[index], vocabulary)[inverse]
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[p.first])


def _pack(keys: np.ndarray, counts: np.ndarray, lens: np.ndarray) -> bytes:
    return np.concatenate([keys, counts.astype(np.uint64), lens.astype(np.uint64)]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64).reshape(3, -1)


def _merge(blobs: list[bytes], top: int) -> bytes:
    """Sum of summaries, the ``top`` most frequent kept (ties: smaller hash)."""
    keys, counts, lens = np.concatenate([_unpack(b) for b in blobs], axis=1) if blobs else np.zeros((3, 0), np.uint64)
    keys, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, counts.astype(float), len(keys)).astype(np.int64)
    keep = np.lexsort((keys, -counts))[:top]
    return _pack(keys[keep], counts[keep], lens[index][keep])


def frequent(docs: DataFrame, vocabulary: str = VOCABULARY) -> Table:
    """The table of frequent pre-tokens, from a scan of all documents."""
    tk.ship(docs.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for part in tk.chunks(batch):
                p = Pieces(tk.column(part, "text"))
                keys, index, counts = np.unique(p.hash, return_index=True, return_counts=True)
                top = np.lexsort((keys, -counts))[:TASK_TOP]
                held.append(_pack(keys[top], counts[top], cached_lengths(p, index[top], vocabulary)))
                if len(held) >= 8:
                    held = [_merge(held, 4 * TASK_TOP)]
        if held:
            blob = _merge(held, TASK_TOP)
            yield pa.RecordBatch.from_pydict({"blob": [blob]}, pa.schema([("blob", pa.binary())]))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(blob)
                if len(held) >= 8:
                    held = [_merge(held, 2 * TABLE_SIZE)]
        if held:
            yield pa.RecordBatch.from_pydict({"blob": [_merge(held, TABLE_SIZE)]}, pa.schema([("blob", pa.binary())]))

    found = tk.arrow(docs.select("text"), summarise, "blob binary")
    tasks = docs.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        found = tk.arrow(found.repartition(tasks), combine, "blob binary")
    blobs = [bytes(r.blob) for r in found.collect()]  # at most FAN_IN summaries of fixed size
    keys, _, lens = _unpack(_merge(blobs, TABLE_SIZE))
    return Table(keys, lens.astype(np.int64))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    tk.ship(spark)
    table = spark.sparkContext.broadcast(frequent(docs, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                text = tk.column(part, "text")
                n = pa.array(count_batch(text, table.value, vocabulary), pa.int64())
                n = pc.if_else(pc.is_valid(text), n, pa.scalar(None, pa.int64()))
                yield pa.RecordBatch.from_arrays([tk.column(part, "doc_id").cast(pa.int64()), n], ["doc_id", "n_tokens"])

    return tk.arrow(docs.select("doc_id", "text"), count, "doc_id bigint, n_tokens bigint")
