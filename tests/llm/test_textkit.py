from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from recordmill.llm import fingerprints as fp
from recordmill.llm import lines, passages, simhash
from recordmill.llm import textkit as tk

UNEVEN = "".join(tk.UNEVEN)
TEXT = st.text(alphabet="aB \n.İȺẞKÉèßΣΩω中😀1", max_size=40)


def lower(text: str) -> str:
    return "".join(c if c in UNEVEN else pc.utf8_lower(pa.scalar(c)).as_py() for c in text)


def test_the_letters_of_uneven_lower_case_are_all_listed():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    size = [pc.binary_length(x).to_numpy() for x in (pa.array(every), pc.utf8_lower(pa.array(every)))]
    assert sorted(np.array(every)[size[0] != size[1]]) == sorted(UNEVEN)
    assert all(len(c.encode()) == n for n, letters in zip((2, 3), tk.UNEVEN, strict=True) for c in letters)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=5))
def test_lowered_is_by_character_and_keeps_positions(texts):
    buf, off = tk.lowered(pa.array(texts, pa.string()))
    raw, raw_off = tk.utf8(pa.array(texts, pa.string()))
    assert off.tolist() == raw_off.tolist() and len(buf) == len(raw)
    assert [buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)] == [lower(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(TEXT, TEXT)
def test_equal_lines_have_equal_hashes_whatever_else_the_text_holds(line, other):
    line = line.replace("\n", " ").strip() or "x"
    ln = lines.Lines(pa.array([line, other + "\n" + line, line + "\nİ"]))
    assert len({ln.hash[np.flatnonzero(ln.doc == d)[-1 if d < 2 else 0]] for d in range(3)}) == 1


@settings(max_examples=60, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_a_shared_run_has_a_common_fingerprint(run, a, b):
    run = "".join(c for c in run if c.isalnum()) * 8
    k, w = 4, 5
    if len(run) < k + w - 1:
        return
    off, h, _ = fp.winnow(pa.array([a + run + b, b + " " + run + "İ" + a]), k, w)
    assert set(h[off[0] : off[1]].tolist()) & set(h[off[1] : off[2]].tolist())


def test_words_and_signatures_and_seeds_beside_uneven_letters():
    text = " ".join(f"mot{i} Élan{i * 7}" for i in range(60))
    arr = pa.array([text, text.upper() + " İ", "ẞ Ⱥ " + text])
    sig, _ = simhash.signatures(arr)
    assert int(np.bitwise_count(sig[0] ^ sig[1]).sum()) < simhash.RADIUS and int(np.bitwise_count(sig[0] ^ sig[2]).sum()) < simhash.RADIUS
    w = tk.Words(arr)
    _, h, doc = passages.minimizers(w)
    seeds = [set(h[doc == d].tolist()) for d in range(3)]
    assert len(seeds[0] & seeds[1]) > 10 and len(seeds[0] & seeds[2]) > 10
