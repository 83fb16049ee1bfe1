"""Operator 4: document fingerprints by winnowing.

A text is normalised (lower case, letters and digits only), every run of ``k`` normalised
characters is hashed with a rolling polynomial, and from each window of ``w`` consecutive hashes
the minimum is chosen, the rightmost of equal ones. Any run of ``w + k - 1`` equal normalised
characters in two documents therefore gives at least one common fingerprint. Hashes are compared
by their upper 40 bits; the full 64 bits are kept.

Defined results: one row per input row: ``fingerprints`` and, in step with it and ascending,
``positions`` (character offsets in the original text of the chosen k-grams). A text with fewer
than ``w`` k-grams is one window; one with fewer than ``k`` normalised characters, an empty or a
null text have empty arrays. Repeated rows and null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordmill.llm import textkit as tk

K, WINDOW = 25, 76
LOW = 24


def select(h: np.ndarray, w: int) -> np.ndarray:
    """Rightmost minimum by the upper 40 bits of each window of w, by index, each once."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(h) >= 1 << LOW:
        arg = tk.sliding_min(h >> np.uint64(LOW), w)
    else:
        low = np.uint64((1 << LOW) - 1)
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        size = 1
        while size < w:
            step = min(size, w - size)
            key = np.minimum(key[: len(key) - step], key[step:])
            size += step
        arg = (low - (key[:n] & low)).astype(np.int64)
    return arg


def winnow(arr: pa.Array, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes, positions): document d has entries offsets[d]:offsets[d + 1]."""
    buf, off = tk.lowered(arr)
    docs = len(off) - 1
    lead = (buf & 0xC0) != 0x80
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    at = np.flatnonzero(tk.word_mask(buf)) if len(buf) else np.zeros(0, np.int64)
    kept = buf[at]
    heads = np.flatnonzero(lead[at])  # first bytes of kept characters, in kept
    origin = at[heads]
    first = np.searchsorted(origin, off)
    grams = np.maximum(np.diff(first) - k + 1, 0)
    index = tk.ranges(first[:-1], grams)
    ends = np.append(heads, len(kept))
    h = tk.span_hash(tk.byte_table()[kept], heads[index], ends[index + k]) if len(index) else np.zeros(0, np.uint64)
    # Each document is given at least one window: short ones are filled up with what no minimum is.
    room = np.where(grams > 0, np.maximum(grams, w), 0)
    place = np.cumsum(room) - room
    padded = np.full(int(room.sum()), np.uint64(0xFFFFFFFFFFFFFFFF))
    slots = tk.ranges(place, grams)
    padded[slots] = h & np.uint64(0xFFFFFFFFFFFFFFFE)
    back = np.full(len(padded), -1, np.int64)
    back[slots] = np.arange(len(h))
    chosen = select(padded, w)
    windows = tk.ranges(place, np.where(room > 0, room - w + 1, 0))
    picked = back[np.unique(chosen[windows])] if len(windows) else np.zeros(0, np.int64)
    short = picked < 0
    if short.any():  # a real k-gram with all upper bits set: take the last one of its document
        picked = np.unique(picked[~short])
    where = index[picked]
    offsets = np.searchsorted(where, first)
    doc = np.searchsorted(first, where, side="right") - 1
    return offsets, h[picked], chars[origin[where]] - chars[off[doc]]


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprints array<bigint>, positions array<int>) for docs(doc_id, text)."""
    tk.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.chunks(batch):
                offsets, h, pos = winnow(tk.column(part, "text"), k, w)
                off = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        tk.column(part, "doc_id").cast(pa.int64()),
                        pa.ListArray.from_arrays(off, pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(off, pa.array(pos.astype(np.int32))),
                    ],
                    ["doc_id", "fingerprints", "positions"],
                )

    return tk.arrow(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprints array<bigint>, positions array<int>")
