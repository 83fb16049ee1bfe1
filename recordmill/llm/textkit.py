"""Vectorised text primitives shared by the corpus operators (numpy over Arrow buffers).

Texts never become per-row Python strings on the hot path: a batch's UTF-8 buffer is
tokenised, hashed and windowed as one array, and document boundaries are kept as offsets.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
MIX_BLOCK = 1 << 14
#: Letters whose lower case takes another number of bytes; they stay as they are. Two bytes long, and three.
UNEVEN = ("\u0130\u023a\u023e", "\u1e9e\u2126\u212a\u212b\u2c62\u2c64\u2c6d\u2c6e\u2c6f\u2c70\u2c7e\u2c7f\ua78d\ua7aa\ua7ab\ua7ac\ua7ad\ua7ae\ua7b0\ua7b1\ua7b2\ua7c5\ua7cb\ua7dc")
_CASELESS = ("\u00bf", "\u3007")  # what stands for them meanwhile, of as many bytes


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a source checkout, and bound Arrow batches by bytes, not by rows alone.

    The bound is a setting of the session (``spark.sql.execution.arrow.maxBytesPerBatch``); one that the session has set stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, and the checkpoint directory set from it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file:///tmp/recordmill-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free back to the system; workers are kept for later tasks, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of a function that may use this package, memory given back at the end of each task."""
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wraps around)."""
    if np.ndim(h) == 1 and len(h) > MIX_BLOCK:
        # By blocks, so that what is in between stays in the cache.
        out = np.empty(len(h), U64)
        for lo in range(0, len(h), MIX_BLOCK):
            out[lo : lo + MIX_BLOCK] = mix(h[lo : lo + MIX_BLOCK])
        return out
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = int(MULT)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = -(-max(n, 1 << 18) // (1 << 18)) << 18
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size <= 1 << 22:
            _POW[base] = (out[0], out[1])
        have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(MULT)) -> np.ndarray:
    """Rolling polynomial hash of values[s:e] for each span, equal for equal contents anywhere."""
    n = len(values)
    pw, inv = powers(n + 1, base)
    acc = np.zeros(n + 1, U64)
    np.cumsum(values * pw[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(U64))


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    arr = as_array(arr)
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """utf8() with lower case, byte positions unchanged.

    Character by character, whatever else the text holds; the letters of ``UNEVEN`` keep their case.
    """
    arr = as_array(arr)
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    raw, off = utf8(arr)
    if not len(raw) or raw.max() < 128:
        return utf8(pc.utf8_lower(arr))
    plain = arr
    for letters, caseless in zip(UNEVEN, _CASELESS, strict=True):
        if pc.any(pc.match_substring_regex(plain, f"[{letters}]")).as_py():
            plain = pc.replace_substring_regex(plain, f"[{letters}]", caseless)
    low, low_off = utf8(pc.utf8_lower(plain))
    if plain is not arr:
        covered = utf8(plain)[0] != raw
        low = np.where(covered, raw, low)
    return low, low_off


@lru_cache(maxsize=1)
def _word_lut() -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        lut[ord(a) : ord(b) + 1] = True
    lut[128:] = True
    return lut


def word_mask(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and every character beyond ASCII
    but U+0080-U+00BF, general punctuation (U+2000-U+203F) and CJK punctuation (U+3000-U+303F)."""
    m = _word_lut()[buf]
    if len(buf) and buf.max() >= 128:
        c2 = np.flatnonzero(buf == 0xC2)
        if len(c2):
            m[c2] = False
            m[np.minimum(c2 + 1, len(buf) - 1)] = False
        for lead in (0xE2, 0xE3):
            at = np.flatnonzero(buf[:-2] == lead) if len(buf) > 2 else np.zeros(0, int)
            at = at[buf[at + 1] == 0x80]
            for k in range(3):
                m[at + k] = False
    return m


class Words:
    """Words of a batch: byte spans, document of each, 64-bit hashes; doc d has words first[d]:first[d + 1]."""

    def __init__(self, arr: pa.Array, hashes: bool = True):
        self.buf, self.off = lowered(arr)
        n = len(self.buf)
        m = np.zeros(n + 1, bool)
        if n:
            m[:n] = word_mask(self.buf)
        start = m.copy()
        start[1:] &= ~m[:-1]
        inner = self.off[(self.off > 0) & (self.off < n)]
        start[inner] |= m[inner]
        self.start = np.flatnonzero(start)
        stop = ~m
        stop[0] = False
        stop[1:] &= m[:-1]
        cut = inner[m[inner] & m[inner - 1]]
        stop[cut] = True
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, self.off)
        if hashes:
            self.hash = span_hash(byte_table()[self.buf], self.start, self.end)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every k-word window that stays in its document."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        doc = self.doc()
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return at, span_hash(self.hash, at, at + k, 0xD1342543DE82EF95)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting (numpy's own way of hashing is slower here)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated first[i] .. first[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(first, counts)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the minimum of each window values[i:i + w], the rightmost one of equals (doubling)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    arg = np.arange(len(values))
    size = 1
    while size < w:
        step = min(size, w - size)
        left, right = arg[: len(arg) - step], arg[step:]
        arg = np.where(values[right] <= values[left], right, left)
        size += step
    return arg[:n]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``size`` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
