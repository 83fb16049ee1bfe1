"""Operator 5: licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, equivalent spellings made one (licence and
license, sub-license and sublicense, version 2.0 and v2.0, & and and), copyright lines dropped, every run of
what isn't a letter or digit made one space. The MD5 digest of the whole canonical form is joined by
hash with the digests of known licence texts and notices. Looked up are entire units: the document,
each of its blocks (between blank lines), each of its lines, and every run of blocks that may be a known text of
several blocks: one that has as many blocks as it and, at the same place, its ``ANCHORS`` block.

Units in which no word occurs that every known text has one of (``MARKERS``) can't match, so they
aren't normalised; neither are blocks that aren't anchors looked at as parts of runs. The registry is a constant of
this module, so broadcasting its digests is safe. Texts too long to write out here are known by their digests
(``DIGESTS``: as their publishers distribute them, and cut behind the end of their terms).

Defined results: a row (doc_id, scope, unit, license_id) per matching unit of each input row; scope is
text, block, run or line, units count from 0; a run's unit is its first block. A block that is the whole document, or a line that is
the whole block, is reported at each scope; a run that is the whole document isn't reported as a run. Null and empty texts, and texts of copyright lines only, match nothing. Repeated rows
are reported each, a null doc_id is kept, other columns are ignored.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (pattern, replacement), applied in order to lower case; {1} is the first group.
RULES = (
    (r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", " "),
    (r"\bsub-licen", "sublicen"),
    (r"licence", "license"),
    (r"licencing", "licensing"),
    (r"\borganisation", "organization"),
    (r"\bauthoris", "authoriz"),
    (r"\bwhilst\b", "while"),
    (r"&", " and "),
    (r"\bversion\s+([0-9])", "v{1}"),
    (r"\bv\.?\s*([0-9])", "v{1}"),
    (r"[^\p{L}\p{N}]+", " "),
)
MARKERS = ("licen", "permission", "redistribution", "public domain", "cc", "gpl")

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n" + _WARRANTY
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
    "the License for the specific language governing permissions and limitations under the License."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSL = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a "
    'copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
    "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
    "subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
    "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
    "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
    "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_TEXTS = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "The MIT License\n\n" + _MIT),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("ISC", "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", _ISC + ".\n\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB), ("Apache-2.0", _APACHE_HEADER), ("BSL-1.0", _BSL),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("CC0-1.0", "Released into the public domain."),
)
#: (license_id, digest of the canonical text, blocks, place of the first block with a marker, its digest) of long texts.
DIGESTS = (
    ("Apache-2.0", "0a7cfb69bda2b67d9bf6f62a30e853db", 27, 0, "85fc81c63256b9ed0b4d4653a7cafaf2"),
    ("Apache-2.0", "efeae1030266875b7f9676ca2720f5e5", 33, 0, "85fc81c63256b9ed0b4d4653a7cafaf2"),
    ("Artistic-1.0-Perl", "6f45651e3e829ff0f6d4fc9f04384095", 29, 0, "b63a1804b8b968a2def685031de081cf"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48", 13, 1, "d7014884a4ae8685a2cdd7e8e2d83bef"),
    ("GFDL-1.2", "4fbeafe831dc7df305fe523cae19b962", 57, 0, "55202c78bb99b70b461f3c8a4ab78378"),
    ("GFDL-1.3", "b55e2fa5d90c24490bfef2dbfcfa40ca", 67, 0, "884213a7d3a3c888a5ff9b5ce19ed51e"),
    ("GPL-1.0", "a68b8bf72d3b2d59136e045bf16cc43a", 32, 0, "a0944f7b5802fa7f99a8115907c6c20e"),
    ("GPL-1.0", "920b672fb8e7b2f8d089b16c305c1904", 46, 0, "a0944f7b5802fa7f99a8115907c6c20e"),
    ("GPL-2.0", "795b189b85684d92b5c3268bb31bf61d", 44, 0, "7445a1536c4fca0faefb52a33a64f983"),
    ("GPL-2.0", "07fbbe11bbe66c8d15d2c5916d6a3510", 59, 0, "7445a1536c4fca0faefb52a33a64f983"),
    ("GPL-3.0", "4d37c2e1ef74fedcd3eb27b7eb5b2d38", 109, 0, "42e50467e62986597e200c39e6187c88"),
    ("GPL-3.0", "41c264213dd4c4b2b5f1490d3dce3c77", 122, 0, "42e50467e62986597e200c39e6187c88"),
    ("LGPL-2.0", "4629b37586307208750985cf65fda687", 63, 0, "a31a491f6a9a048c6fed697212d1832d"),
    ("LGPL-2.0", "df697dc0db2e5f78e65a94682ab9f796", 74, 0, "a31a491f6a9a048c6fed697212d1832d"),
    ("LGPL-2.1", "35732169c0c12645d60ea0a4c0869824", 65, 0, "5e84996dc7c8ec676ad43eddf96605e1"),
    ("LGPL-2.1", "de144495b48f57a60d47d39cb6ba2fcf", 76, 0, "5e84996dc7c8ec676ad43eddf96605e1"),
    ("LGPL-3.0", "148b473852f0e3b14ba500ebbd2e8f9c", 37, 0, "3971ff1e84c7b7b5cfea24808cc7859e"),
    ("MPL-1.1", "706628ce3a42cd47153fffcefe2b3048", 74, 0, "32649f71dc056ab0f05528365f5874a4"),
    ("MPL-2.0", "85f3f6c99d20a7ecf8594ec639b0ab1a", 81, 0, "4b5f6755a1ce6c78947c33067bb2d6f9"),
    ("Apache-2.0", "dafd5f5eef81121825bf62385b190adf", 27, 0, "85fc81c63256b9ed0b4d4653a7cafaf2"),
    ("Apache-2.0", "29685729a56cc2de5c8f1e3f0800023e", 33, 0, "85fc81c63256b9ed0b4d4653a7cafaf2"),
    ("CC-BY-SA-4.0", "256004a576bd2515ee6917ebf67865d8", 89, 2, "d7eb46df37f12d4b60989c964c477369"),
    ("GPL-2.0", "1290c8c87f945096d0192ef6f82f4508", 40, 0, "daf5353290c2fd97c3deb5963ce90e05"),
    ("GPL-2.0", "f07591871077fa8bb74bf149e8a91cee", 54, 0, "daf5353290c2fd97c3deb5963ce90e05"),
    ("GPL-3.0", "4102b9706c20c194db920a472d2872d3", 63, 0, "daf5353290c2fd97c3deb5963ce90e05"),
    ("GPL-3.0", "2aa485a2453dc0db3b149a4d8002d800", 76, 0, "daf5353290c2fd97c3deb5963ce90e05"),
    ("OFL-1.1", "0118e45ad353ddb344fbd2077e705a22", 22, 0, "36fc879e909a4788ac7cf3936d39a629"),
    ("NCSA", "a0da08a3467e8127a21d756a5ed37ea9", 4, 2, "922f2634ababef9ec618d2320a2336ee"),
    ("Unicode-3.0", "d326f8dc2f927ff26ec5b185e795fda5", 8, 0, "6235f848d10387c817d77c6c682ddaf9"),
)
_NAMES = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",), "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",), "BSL-1.0": ("Boost Software License, Version 1.0",), "Zlib": ("zlib License",), "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0",), "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",), "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",), "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
_FRAMES = tuple(
    f"{start} under {article}{{}}"
    for start in ("Licensed", "Released", "Available", "Distributed", "This work is licensed", "This software is licensed", "This software is released", "This project is licensed", "This file is licensed")
    for article in ("", "the ")
)


def registry() -> list[tuple[str, str]]:
    """(license_id, text) of every known text and notice."""
    out = list(_TEXTS)
    for spdx, names in _NAMES.items():
        out.append((spdx, f"SPDX-License-Identifier: {spdx}"))
        for name in names:
            for frame in _FRAMES:
                notice = frame.format(name)
                out.append((spdx, notice))
                if "licen" not in name.lower():
                    out.append((spdx, notice + " license"))
    return out


_BLOCKS = r"\n[ \t\r]*\n"


def _plain(text: str) -> str:
    """canonical() in Python, for the registry's own texts."""
    out = text.lower()
    for pattern, replacement in RULES:
        out = regex.sub(pattern, replacement.replace("{1}", r"\1"), out)
    return out.strip()


def _md5(text: str) -> str:
    return hashlib.md5(_plain(text).encode()).hexdigest()


def digests() -> list[tuple[str, str]]:
    """(license_id, digest) of every known text."""
    return sorted({(i, _md5(t)) for i, t in registry()} | {(i, d) for i, d, *_ in DIGESTS})


def anchors() -> list[tuple[str, int, int]]:
    """(digest of a block, its place, blocks) of the known texts of several blocks."""
    out = {(anchor, at, n) for _, _, n, at, anchor in DIGESTS}
    for _, text in registry():
        blocks = regex.split(_BLOCKS, text)
        if len(blocks) > 1:
            at = next(i for i, b in enumerate(blocks) if any(m in b.lower() for m in MARKERS))
            out.add((_md5(blocks[at]), at, len(blocks)))
    return sorted(out)


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, replacement in RULES:
        out = F.regexp_replace(out, pattern, replacement.replace("{1}", "$1"))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    out = f"lower({text})"
    for pattern, replacement in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('{1}', chr(92) + '1')}', 'g')"
    return f"trim({out})"


def _marked(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(MARKERS))


def known(spark) -> DataFrame:
    return spark.createDataFrame(digests(), "license_id string, digest string")


def _digest(text: Column) -> Column:
    made = canonical(text)
    return F.when(made != "", F.md5(made))


def _unit(scope: str, unit: Column, digest: Column) -> Column:
    return F.struct(F.lit(scope).alias("scope"), unit.cast("bigint").alias("unit"), digest.alias("digest"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, scope, unit, license_id) for docs(doc_id, text), in one scan."""
    spark = docs.sparkSession
    some = docs.select("doc_id", F.col("text").alias("_text")).filter(_marked(F.col("_text")))
    places: dict[str, list[tuple[int, int]]] = {}
    for digest, at, n in anchors():
        places.setdefault(digest, []).append((at, n))
    # A constant map: digest of an anchor -> its places and the blocks of the texts.
    table = F.create_map(*(x for d, v in places.items() for x in (F.lit(d), F.array(*(F.struct(F.lit(a).alias("at"), F.lit(n).alias("n")) for a, n in v)))))
    by_block = lambda x, i: _unit("block", i, F.when(_marked(x), _digest(x)))
    split = some.select("doc_id", "_text", F.split("_text", _BLOCKS, -1).alias("_parts")).withColumn("_blocks", F.transform("_parts", by_block))
    starts = F.flatten(F.transform(F.filter("_blocks", lambda u: F.map_contains_key(table, F.coalesce(u["digest"], F.lit("")))), lambda u: F.transform(table[u["digest"]], lambda p: F.struct((u["unit"] - p["at"]).cast("int").alias("first"), p["n"].alias("n")))))
    inside = F.filter(starts, lambda r: (r["first"] >= 0) & (r["first"] + r["n"] <= F.size("_parts")) & (r["n"] < F.size("_parts")))
    runs = F.transform(inside, lambda r: _unit("run", r["first"], _digest(F.array_join(F.slice("_parts", r["first"] + 1, r["n"]), "\n\n"))))
    lines = F.transform(F.split("_text", r"\n", -1), lambda x, i: _unit("line", i, F.when(_marked(x), _digest(x))))
    whole = F.array(_unit("text", F.lit(0), _digest(F.col("_text"))))
    units = F.filter(F.concat(whole, "_blocks", runs, lines), lambda u: u["digest"].isNotNull())
    every = split.select("doc_id", F.explode(units).alias("_unit")).select("doc_id", "_unit.*")
    # The registry is a constant of a few hundred digests.
    return every.join(F.broadcast(known(spark)), "digest").select("doc_id", "scope", "unit", "license_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKED = " OR ".join(f"contains(lower({{0}}), '{m}')" for m in MARKERS)

ORACLE = f"""
WITH known(license_id, digest) AS (VALUES {", ".join(f"({_quoted(i)}, '{d}')" for i, d in digests())}),
anchors(anchor, place, n) AS (VALUES {", ".join(f"('{d}', {a}, {n})" for d, a, n in anchors())}),
some_docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE {_MARKED.format("text")}),
parts AS (SELECT r, doc_id, b, unnest(range(1, len(b) + 1)) AS k FROM (SELECT r, doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS b FROM some_docs)),
blocks AS (SELECT r, doc_id, k - 1 AS unit, len(b) AS blocks, {canonical_sql("b[k]")} AS c FROM parts WHERE {_MARKED.format("b[k]")}),
runs AS (
  SELECT p.r, p.doc_id, s.first, array_to_string(p.b[s.first + 1:s.first + s.n], chr(10) || chr(10)) AS u
  FROM (SELECT r, unit - place AS first, n FROM blocks JOIN anchors ON md5(c) = anchor WHERE unit >= place AND unit - place + n <= blocks AND n < blocks) s
  JOIN (SELECT DISTINCT r, doc_id, b FROM parts WHERE k = 1) p ON p.r = s.r),
units AS (
  SELECT doc_id, 'text' AS scope, 0::BIGINT AS unit, text AS u FROM some_docs
  UNION ALL
  SELECT doc_id, 'run', first, u FROM runs
  UNION ALL
  SELECT doc_id, 'line', k - 1, b[k] FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM some_docs))),
canon AS (SELECT doc_id, 'block' AS scope, unit, c FROM blocks UNION ALL SELECT doc_id, scope, unit, {canonical_sql("u")} FROM units WHERE {_MARKED.format("u")})
SELECT doc_id, scope, unit, license_id FROM canon JOIN known ON md5(c) = digest WHERE c <> ''
"""
