from __future__ import annotations

import hashlib
import re
from pathlib import Path

import duckdb
import pytest
import regex

from recordmill.llm import licenses as lc


def canonical(t):
    t = t.lower()
    for p, r in lc.RULES:
        t = regex.sub(p, r.replace("{1}", r"\1"), t)
    return t.strip()


def test_registry_is_consistent():
    seen = {}
    for i, t in lc.registry():
        c = canonical(t)
        assert c and any(m in c for m in lc.MARKERS), t
        assert seen.setdefault(c, i) == i, t


def brute(rows):
    """Every unit, and every run of blocks with an anchor at its place, looked up by its digest."""
    known = {}
    for i, d in lc.digests():
        known.setdefault(d, []).append(i)
    digest = lambda u: hashlib.md5(canonical(u).encode()).hexdigest()
    want = []
    for i, t in rows:
        if t is None:
            continue
        blocks = re.split(r"\n[ \t\r]*\n", t)
        units = [("text", 0, t), *(("block", k, u) for k, u in enumerate(blocks)), *(("line", k, u) for k, u in enumerate(t.split("\n")))]
        at = {}
        for k, u in enumerate(blocks):
            at.setdefault(digest(u), []).append(k)
        runs = [(k - place, n) for anchor, place, n in lc.anchors() for k in at.get(anchor, []) if k >= place and k - place + n <= len(blocks) and n < len(blocks)]
        units += [("run", k, "\n\n".join(blocks[k : k + n])) for k, n in runs]
        for scope, k, u in units:
            c = canonical(u)
            want += [(i, scope, k, x) for x in known.get(hashlib.md5(c.encode()).hexdigest(), []) if c]
    return want


def test_every_known_text_is_found_alone_and_inside_others(spark):
    texts = lc.registry()
    rows = [(k, t) for k, (_, t) in enumerate(texts)] + [(1000 + k, "Read me first.\n\n" + t + "\n\nThe end.") for k, (_, t) in enumerate(texts)]
    found = {}
    for r in lc.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.license_id)
    for k, (i, _) in enumerate(texts):
        assert i in found.get(k, ()) and i in found.get(1000 + k, ()), i


def test_long_texts_by_digest(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    if not all((folder / n).exists() for n in names):
        pytest.skip("no licence texts on this machine")
    rows = []
    for n in names:
        text = (folder / n).read_text()
        rows += [(len(rows), text), (len(rows) + 1, "intro\n\n" + text.strip("\n") + "\n\nmore prose"), (len(rows) + 2, text.replace("the", "teh", 1))]
    got = [(r.doc_id, r.scope, r.unit, r.license_id) for r in lc.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(brute(rows))
    for k, i in enumerate(names.values()):
        assert (3 * k, "text", 0, i) in got and (3 * k + 1, "run", 1, i) in got


def test_sql_agrees(spark):
    mit = next(t for i, t in lc.registry() if i == "MIT")
    rows = [(1, mit), (2, "a\n\n" + mit + "\n\n" + mit), (2, "a\n\n" + mit + "\n\n" + mit), (None, "Licensed under the MIT License."), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = [(r.doc_id, r.scope, r.unit, r.license_id) for r in lc.license_scan(docs).collect()]
    assert sorted(map(str, con.execute(lc.ORACLE).fetchall())) == sorted(map(str, got)) and len(got) == 8


def test_scan_against_brute_force(spark):
    mit = next(t for i, t in lc.registry() if i == "MIT")
    rows = [
        (1, mit), (2, "MIT LICENCE\n\nCopyright (c) 2020 Someone & Others\n\n" + mit.upper().replace(",", " ;")), (3, "prose\nLicenced under the Apache License, version 2.0!\nmore"),
        (4, "intro\n \nReleased under the MIT License.\n\nend"), (5, "The license of this is unknown."), (6, ""), (7, None), (None, "SPDX-License-Identifier: GPL-3.0"),
        (8, "Copyright 2001 license holder"), (9, "x " * 100_000 + "\nThis work is licensed under the GNU General Public License, v3"), (4, "intro\n \nReleased under the MIT License.\n\nend"),
    ]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id bigint, text string, digest string")
    want = brute(rows)
    got = [(r.doc_id, r.scope, r.unit, r.license_id) for r in lc.license_scan(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(1, "text", 0, "MIT"), (2, "text", 0, "MIT"), (3, "line", 1, "Apache-2.0"), (9, "line", 1, "GPL-3.0")} <= set(got)
    assert lc.license_scan(docs.limit(0)).collect() == []


def test_notices_without_the_word_license(spark):
    rows = {1: "Released under CC BY 4.0", 2: "Distributed under CC0 1.0", 3: "Available under the GNU GPL v3", 4: "some\nReleased  under the\tCC BY-SA 4.0.\nmore", 5: "according to GPL and CC"}
    got = {(r.doc_id, r.license_id) for r in lc.license_scan(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")).collect()}
    assert got == {(1, "CC-BY-4.0"), (2, "CC0-1.0"), (3, "GPL-3.0"), (4, "CC-BY-SA-4.0")}
