"""Pooled text form of record tables: a pool line, a typed header, columns written inline where values repeat, and tab-separated rows.

Readers go by the header's types, so text that looks like a number or a null stays text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recordmill import schema
from recordmill.operators.codec import bounded, build_pool, list_columns, strategy

_PLAIN, _CODED = "\\\t\n\r,;", "\\tnrcs"


def escape(s: str) -> str:
    """Backslashes, separators and line ends as two characters; a text that would read as something else is marked."""
    out = "".join("\\" + _CODED[_PLAIN.index(c)] if c in _PLAIN else c for c in s)
    return "\\_" + out if s in ("N", "$0=") or s.startswith(("#", "@")) else out


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out, i = [], 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s):
            if s[i + 1] in _CODED:
                out.append(_PLAIN[_CODED.index(s[i + 1])])
            elif s[i + 1] != "_":
                out.append(s[i : i + 2])
            i += 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def kind_of(values: list) -> str:
    some = [v for v in values if v is not None]
    for letter, t in (("b", bool), ("d", int), ("f", float), ("s", str)):
        if some and all(type(v) is t for v in some):
            return letter
    return "m" if some else "n"


def token(v, kind: str, pool: dict[str, int]) -> str:
    if v is None:
        return "N"
    if kind == "b":
        return "T" if v else "F"
    if kind == "d":
        return str(v)
    if kind == "f":
        return "nan" if math.isnan(v) else repr(v)
    if kind == "m":
        return escape(json.dumps(v, separators=(",", ":")))
    if v == "":
        return "$0="
    return f"#{pool[v]}" if v in pool else escape(v)


def value(tok: str, kind: str, pool: list[str]):
    if tok == "N":
        return None
    if kind == "b":
        return tok == "T"
    if kind in "df":
        return int(tok) if kind == "d" else float(tok)
    if kind == "m":
        return json.loads(unescape(tok))
    if tok == "$0=":
        return ""
    return pool[int(tok[1:])] if tok.startswith("#") else unescape(tok)


def encode_text(records: list[dict], most: int = 64) -> str:
    pool = build_pool(records, most)
    index = {s: i for i, s in enumerate(pool)}
    names = list(dict.fromkeys(k for r in records for k in r))
    columns = {k: [r.get(k) for r in records] for k in names}
    kinds = {k: kind_of(c) for k, c in columns.items()}
    inline = [k for k in names if strategy(columns[k]) in ("rle", "pool")]
    lines = ["POOL:" + ",".join(map(escape, pool))] if pool else []
    lines.append(f"records[{len(records)}]:" + ",".join(f"{escape(k)}:{kinds[k]}" for k in names))
    lines += [f"@{names.index(k)}=" + ";".join(token(v, kinds[k], index) for v in columns[k]) for k in inline]
    rest = [k for k in names if k not in inline]
    if rest:
        lines += ["\t".join(token(columns[k][i], kinds[k], index) for k in rest) for i in range(len(records))]
    return "\n".join(lines)


def decode_text(text: str) -> list[dict]:
    lines = text.split("\n")
    pool: list[str] = []
    if lines and lines[0].startswith("POOL:"):
        pool = [unescape(x) for x in lines.pop(0)[5:].split(",")]
    if not lines or not lines[0].startswith("records["):
        raise ValueError("header missing")
    head, _, specs = lines.pop(0).partition("]:")
    n = int(head[8:])
    fields = [(unescape(k), t) for k, _, t in (x.rpartition(":") for x in specs.split(",") if x)]
    cells: dict[int, list] = {}
    while lines and lines[0].startswith("@"):
        at, _, body = lines.pop(0)[1:].partition("=")
        cells[int(at)] = [value(x, fields[int(at)][1], pool) for x in body.split(";")]
    rest = [i for i in range(len(fields)) if i not in cells]
    rows = [x.split("\t") for x in lines[:n]] if rest else []
    if rest and (len(rows) != n or any(len(r) != len(rest) for r in rows)):
        raise ValueError("rows missing")
    for j, i in enumerate(rest):
        cells[i] = [value(r[j], fields[i][1], pool) for r in rows]
    return [{k: cells[i][r] for i, (k, _) in enumerate(fields)} for r in range(n)]


def encode_tables(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """(group, text) of each group's rows in order."""
    packed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *(F.col(f"`{c}`") for c in columns)))).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([encode_text([dict(zip(columns, row, strict=True)) for row in zip(*cells, strict=True)]) for cells in list_columns(b.column(1), columns)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], [group, "text"])

    return bounded(packed).mapInArrow(run, f"`{group}` {df.schema[group].dataType.simpleString()}, text string")


def decode_tables(texts: DataFrame, group: str, fields: T.StructType) -> DataFrame:
    """Rows of texts(group, text) with their number ``row``, from 1."""
    names = [f.name for f in fields]

    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                records = decode_text(b.column(1)[k].as_py())
                cells = [pa.array([r.get(c) for r in records], t) for c, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[k], len(records)), pa.array(range(1, len(records) + 1), pa.int64()), *cells], [group, "row", *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return bounded(texts.select(group, "text")).mapInArrow(run, f"`{group}` {texts.schema[group].dataType.simpleString()}, row bigint, {ddl}")


def system_prompt(examples: bool = True, checks: bool = True, magic: str = schema.MAGIC) -> str:
    """Instructions for a model that is to write payloads, made from the schema."""
    out = [f"Answer with one payload in the format {magic} and nothing else.", "", f"Line 1: {magic}", "Then header lines (thread: ..., records: N), N being the number of rows that follow, one to a line.", "", "Rows (cells separated by |):"]
    for t, fields in schema.FIELDS.items():
        out.append("  " + "|".join([t, "id", "thread_id", "step", *(f"{k}?" if (t, k) in schema.OPTIONAL else k for k in fields)]))
    out += ["", "N is null, T and F are true and false, $0= is an empty text. A cell with |, \", \\ or a line end is put in double quotes, inner quotes doubled, line ends as \\n."]
    for (t, k), allowed in schema.ENUMS.items():
        out.append(f"  {t}.{k}: {', '.join(allowed)}")
    if checks:
        out += ["", "Before you answer, check that:", "- every row has exactly the cells of its type", "- ids and threads are not empty, steps start at 1 and never go back within a thread", "- every res has the id of a tool row", "- the number of rows is the one in the header"]
    if examples:
        out += ["", "Example:", magic, "thread: t1", "records: 2", "tool|c1|t1|1|search|{}|pending", "res|c1|t1|2|search|found|done|12"]
    return "\n".join(out)
