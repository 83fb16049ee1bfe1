"""Column functions: token counts, hashing, integer coding, row encoding and decoding. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import schema

_BACKSLASH = "\\"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up; 0 for an empty text, null for null."""
    n = F.length(_col(text))
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.floor((n + 3) / 4).cast("bigint"))


#: Pre-token pieces: contractions, Latin words, up to three digits, symbols, white space.
PIECES = r"(?U)('(?:s|t|re|ve|m|ll|d)|[A-Za-zÀ-ɏ]+|\d{1,3}|[^\s\w]+|\s+)"


#: Texts of these characters only (ASCII and Latin letters of two bytes) are counted by groups of up to four bytes.
_SIMPLE = r"\A[\x00-\x7FÀ-ÖØ-öø-ɏ]*\z"
_GROUPS = r"(?<![^\s\w])'(?:s|t|re|ve|m|ll|d)|[A-Za-z]{1,4}|\d{1,3}|[^\s\w]{1,4}|\s{1,4}"


def count_tokens(text: Column | str) -> Column:
    """Pieces cost 1 token up to 4 bytes, 2 up to 8, else a quarter of their bytes; a text without pieces a quarter of its characters."""
    t = _col(text)
    # A piece costs as much as it has groups of four bytes, the last one being shorter perhaps; what is in no piece of a simple text are underscores.
    groups = F.length(F.regexp_replace(F.regexp_replace(t, "[À-ɏ]", "aa"), _GROUPS, "+"))
    simple = (groups - (F.length(t) - F.length(F.replace(t, F.lit("_"), F.lit(""))))).cast("bigint")
    pieces = F.regexp_extract_all(t, F.lit(PIECES), F.lit(1))
    total = F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, p: a + F.floor((F.octet_length(p) + 3) / 4).cast("bigint"))
    found = F.when(t.rlike(_SIMPLE), simple).otherwise(total)
    return F.when(F.length(t) == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce(F.nullif(found, F.lit(0).cast("bigint")), estimate_tokens(t)))


def count_tokens_records(text: Column | str, overhead: int = 3) -> Column:
    """count_tokens() plus an overhead for every line break beyond the third."""
    t = _col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return count_tokens(t) + F.greatest(F.lit(0), breaks - 3) * overhead


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    h = F.hex(F.encode(_col(text), "UTF-8"))
    n = F.length(h) / 2
    at = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(h, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
        return (acc.bitwiseXOR(byte) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    return F.aggregate(at, F.lit(2166136261).cast("bigint"), step)


def zigzag(n: Column | str) -> Column:
    """Signed to unsigned by alternation: 0, -1, 1, -2 become 0, 1, 2, 3."""
    c = _col(n).cast("bigint")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(z: Column | str) -> Column:
    c = _col(z)
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def varint_length(n: Column | str) -> Column:
    """Bytes of a non-negative integer at 7 bits a byte."""
    c = _col(n)
    out = F.lit(10)
    for size in range(9, 0, -1):
        out = F.when((c >= 0) & (c < (1 << (7 * size)) if size < 9 else c >= 0), F.lit(size)).otherwise(out)
    return F.when(c.isNotNull(), out).cast("bigint")


def zigzag_length(n: Column | str) -> Column:
    return varint_length(zigzag(n))


def varint_bytes(n: Column | str) -> Column:
    """The bytes of a non-negative integer as hexadecimal text, lowest group first."""
    c = _col(n).cast("bigint")
    size = varint_length(c).cast("int")

    def byte(i: Column) -> Column:
        group = F.expr("0").cast("bigint")
        for k in range(9):
            group = F.when(i == k, F.shiftright(c, 7 * k).bitwiseAND(F.lit(127))).otherwise(group)
        return F.lpad(F.hex(F.when(i < size - 1, group.bitwiseOR(F.lit(128))).otherwise(group)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")


def float_text(x: Column | str) -> Column:
    """Round-trip text of a double (the JVM's shortest digits): plain notation within [1e-4, 1e16), exponents like 1e-05, nan, inf."""
    c = _col(x).cast("double")
    raw, size = c.cast("string"), F.abs(c)
    # Spark switches to exponents at 1e7 and below 1e-3; all digits of a number in between fit a decimal.
    plain = F.regexp_replace(raw.cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E([0-9])", "E+$1"), r"E([+-])([0-9])$", "E$10$2")
    named = F.when(raw == "NaN", "nan").when(raw == "Infinity", "inf").when(raw == "-Infinity", "-inf").otherwise(raw)
    return F.when(~F.contains(raw, F.lit("E")), named).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.lower(power))


def escaped(c: Column) -> Column:
    """A text as a cell: $0= if empty, in quotes where needed."""
    safe = F.replace(c, F.lit(_BACKSLASH), F.lit(_BACKSLASH * 2))
    for a, b in (('"', '""'), ("\n", _BACKSLASH + "n"), ("\r", _BACKSLASH + "r")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.when(c == "", "$0=").when(c.rlike(r'[|"\\\n\r]'), F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(c)


def encode_field(value: Column | str, kind: str) -> Column:
    """One cell of a payload row: N for null, T or F, numbers, $0= for an empty text, quotes where needed."""
    c = _col(value)
    texts = {"boolean": lambda: F.when(c, "T").when(~c, "F"), "double": lambda: float_text(c), "bigint": lambda: c.cast("string"), "string": lambda: escaped(c)}
    return F.coalesce(texts[kind](), F.lit("N"))


def _slots() -> list[dict[str, dict[str, list[str]]]]:
    """For each place behind the common cells, by kind of value: the fields that records have there, with their types."""
    out: list[dict[str, dict[str, list[str]]]] = [{} for _ in range(max(map(len, schema.FIELDS.values())))]
    for t, fields in schema.FIELDS.items():
        for i, (k, kind) in enumerate(fields.items()):
            out[i].setdefault(kind, {}).setdefault(k, []).append(t)
    return out


def _in(types: list[str], column: str = "type") -> str:
    return f"`{column}` IN ({', '.join(repr(t) for t in types)})"


def _by_type(choices: dict[str, list[str]], value: Callable[[str], str]) -> str:
    """SQL: of ``choices`` (name -> record types), value(name) of the one that has the row's type."""
    return "CASE " + " ".join(f"WHEN {_in(types)} THEN {value(name)}" for name, types in choices.items()) + " END"


def _plain(name: str, kind: str) -> str:
    return f"CASE WHEN `{name}` THEN 'T' WHEN NOT `{name}` THEN 'F' END" if kind == "boolean" else f"CAST(`{name}` AS STRING)"


def with_line(df: DataFrame, meta: tuple[str, ...] = (), name: str = "line") -> DataFrame:
    """Adds each record's payload row; null for unknown types.

    Values are chosen by type and place first and written as cells then, in steps that refer to each other by column, so that generated code stays small.
    """
    slots = _slots()
    doubles = {k: [t for t, f in schema.FIELDS.items() if f.get(k) == "double"] for k in dict.fromkeys(k for f in schema.FIELDS.values() for k, v in f.items() if v == "double")}
    chosen = {"__x": F.expr(_by_type(doubles, lambda k: f"`{k}`"))}
    for i, slot in enumerate(slots):
        if "string" in slot:
            chosen[f"__s{i}"] = F.expr(_by_type(slot["string"], lambda k: f"`{k}`"))
        plain = {k: types for kind in ("bigint", "boolean") for k, types in slot.get(kind, {}).items()}
        if plain:
            kinds = {k: kind for kind in ("bigint", "boolean") for k in slot.get(kind, {})}
            chosen[f"__n{i}"] = F.expr(_by_type(plain, lambda k, kinds=kinds: _plain(k, kinds[k])))
    out = df.withColumns(chosen).withColumn("__f", float_text("__x"))
    texts = {"__id": escaped(F.col("id")), "__thread": escaped(F.col("thread_id"))} | {k: escaped(F.col(k)) for k in chosen if k.startswith("__s")}
    tail = {f"__m{i}": encode_field(m, schema.META[m]) for i, m in enumerate(meta)}
    out = out.withColumns(texts | tail)
    cells = ["type", "coalesce(__id, 'N')", "coalesce(__thread, 'N')", "coalesce(CAST(step AS STRING), 'N')"]
    for i, slot in enumerate(slots):
        every = [t for choices in slot.values() for types in choices.values() for t in types]
        found = [k for k in (f"__s{i}", f"__n{i}") if k in chosen]
        if "double" in slot:
            found.append(f"CASE WHEN {_in([t for types in slot['double'].values() for t in types])} THEN __f END")
        cells.append(f"CASE WHEN {_in(every)} THEN coalesce({', '.join(found)}, 'N') END")
    line = F.expr(f"CASE WHEN {_in(list(schema.FIELDS))} THEN concat_ws('|', {', '.join([*cells, *tail])}) END")
    return out.withColumn(name, line).drop("__f", *chosen, *texts, *tail)


#: Cells of a row: quoted ones may hold separators and doubled quotes; the last match is the empty one at the end.
_CELL = r'("[^"]*+(?:""[^"]*+)*+"|[^|]*)(?:\||$)'


def split_row(line: Column | str) -> Column:
    """Cells of a payload row, still encoded."""
    c = _col(line)
    quoted = F.regexp_extract_all(c, F.lit(_CELL), F.lit(1))
    # A match ends at each separator, and one more at the end unless the row's last cell took it.
    quoted = F.when(c.endswith("|"), quoted).otherwise(F.slice(quoted, F.lit(1), F.greatest(F.size(quoted) - 1, F.lit(1))))
    return F.when(F.contains(c, F.lit('"')), quoted).otherwise(F.split(c, r"\|", -1))


def unescape(cell: Column | str) -> Column:
    """Inside of a quoted cell, read from left to right."""
    c = _col(cell)
    breaks = lambda x: F.replace(F.replace(x, F.lit(_BACKSLASH + "n"), F.lit("\n")), F.lit(_BACKSLASH + "r"), F.lit("\r"))
    pairs = F.array_join(F.transform(F.split(c, r"\\\\", -1), breaks), _BACKSLASH)
    return F.replace(F.when(F.contains(c, F.lit(_BACKSLASH * 2)), pairs).otherwise(breaks(c)), F.lit('""'), F.lit('"'))


def decode_field(cell: Column, kind: str) -> Column:
    """The value of a cell; null for N and for what isn't of the kind."""
    if kind == "boolean":
        return F.when(cell == "T", True).when(cell == "F", False)
    if kind == "bigint":
        return F.when(cell.rlike(r"^[+-]?[0-9]+$"), cell.try_cast("bigint"))
    if kind == "double":
        text = F.when(cell == "inf", "Infinity").when(cell == "-inf", "-Infinity").when(cell == "nan", "NaN").otherwise(cell)
        return F.when(cell != "N", text.try_cast("double"))
    quoted = cell.startswith('"') & cell.endswith('"') & (F.length(cell) >= 2)
    return F.when(cell == "N", None).when(cell == "$0=", "").when(quoted, unescape(F.substring(cell, F.lit(2), F.length(cell) - 2))).otherwise(cell)


# Quoted texts are matched without recursion: cells may be very long.
_PATTERNS = {"string": r'(?:"[^"]*+(?:""[^"]*+)*+"|[^|]*)', "bigint": r"[+-]?[0-9]{1,19}", "double": r"(?:nan|-?inf|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", "boolean": "[TF]"}


def row_pattern(meta: tuple[str, ...] = ()) -> str:
    """A pattern that rows of a known type, its arity, all required fields and readable numbers and booleans match."""

    def cell(kind: str, optional: bool) -> str:
        return f"(?:N|{_PATTERNS[kind]})" if optional else r"(?!N(?:\||$))" + _PATTERNS[kind]

    out = []
    for t, fields in schema.FIELDS.items():
        cells = [cell(v, (t, k) in schema.OPTIONAL) for k, v in (schema.COMMON | fields).items() if k != "type"]
        out.append(r"\|".join([t, *cells, *(cell(schema.META[m], True) for m in meta)]))
    return r"(?s)\A(?:" + "|".join(out) + r")\z"


def well_formed(line: Column | str, meta: tuple[str, ...] = ()) -> Column:
    return _col(line).rlike(row_pattern(meta))


def well_formed_with(line: Column, extra: int) -> Column:
    """Rows with so many cells of any kind behind those of their type: the fields that a header names."""
    more = rf"(?:\|{_PATTERNS['string']}){{{extra}}}" if extra else ""
    return line.rlike(row_pattern().removesuffix(r"\z") + more + r"\z")


def _reads(extra: int) -> Callable[[Column], Column]:
    return lambda x: well_formed_with(x, extra)


def row_marks(rows: str, meta: str) -> Column:
    """1 for each row that can't be read, 0 for others."""
    out = F.transform(rows, lambda x: F.lit(1))
    for n in range(len(schema.META) + 1):
        reads = _reads(n)
        out = F.when(F.size(meta) == n, F.transform(rows, lambda x: F.when(reads(x), 0).otherwise(1))).otherwise(out)
    return out


def all_well_formed(rows: str, meta: str) -> Column:
    """Whether all rows are well formed, ``meta`` being the array of a header's extra fields."""
    out = F.lit(False)
    for n in range(len(schema.META) + 1):
        out = F.when(F.size(meta) == n, F.forall(rows, _reads(n))).otherwise(out)
    return out


def readable_rows(rows: str, meta: str) -> Column:
    out = F.array().cast("array<string>")
    for n in range(len(schema.META) + 1):
        out = F.when(F.size(meta) == n, F.filter(rows, _reads(n))).otherwise(out)
    return out


def json_or_raw(text: Column | str) -> Column:
    """A JSON object's text as it is; anything else as an object with the text as ``_raw``, null as an empty object."""
    c = _col(text)
    whole = F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull()
    return F.when(c.isNull() | (F.trim(c) == ""), "{}").when(whole, c).otherwise(F.to_json(F.struct(c.alias("_raw"))))


def decoded_rows(rows: DataFrame, keys: list[str], cells: str, meta: tuple[str, ...] | str = ()) -> DataFrame:
    """Key columns and the columns of the wide schema (without payload_id and pos) of rows whose ``cells`` are those of well-formed rows.

    ``meta``: the fields behind those of the type, or the column that has an array of their names.
    """
    if isinstance(meta, str):
        behind = {m: F.when(F.array_contains(meta, m), F.get(cells, (F.size(cells) - F.size(meta) + F.array_position(meta, m) - 1).cast("int"))) for m in schema.META}
        meta = tuple(schema.META)
    else:
        behind = {m: F.get(cells, F.size(cells) - (len(meta) - i)) for i, m in enumerate(meta)}
    slots = _slots()
    texts = ["id", "thread", *(str(i) for i in range(len(slots)))]
    raw = {f"__r_{n}": F.get(cells, i) for n, i in zip(texts, (1, 2, *range(4, 4 + len(slots))), strict=True)}
    # The text of each place is read once, and fields take it from there.
    out = rows.select(*keys, F.get(cells, 0).alias("__kind"), F.get(cells, 3).alias("__step"), *(c.alias(n) for n, c in raw.items()), *(behind[m].alias(f"__m{i}") for i, m in enumerate(meta)))
    inner = {f"__q_{n}": F.expr(f"CASE WHEN startswith(__r_{n}, '\"') AND endswith(__r_{n}, '\"') AND length(__r_{n}) >= 2 THEN substring(__r_{n}, 2, length(__r_{n}) - 2) END") for n in texts}
    out = out.withColumns(inner)
    read = {f"__t_{n}": F.when(F.col(f"__r_{n}") == "N", None).when(F.col(f"__r_{n}") == "$0=", "").otherwise(F.coalesce(unescape(f"__q_{n}"), F.col(f"__r_{n}"))) for n in texts}
    out = out.withColumns(read)
    columns = {"type": "__kind", "id": "__t_id", "thread_id": "__t_thread", "step": "try_cast(__step AS BIGINT)"}
    for k, v in schema.WIDE.items():
        if k in columns or k in keys:
            continue
        if k in schema.META:
            columns[k] = "NULL"
            continue
        whens = []
        for i, slot in enumerate(slots):
            for kind, choices in slot.items():
                if k in choices:
                    whens.append(f"WHEN {_in(choices[k], '__kind')} THEN {f'__t_{i}' if kind == 'string' else f'__r_{i}'}")
        value = f"CASE {' '.join(whens)} END"
        if v == "boolean":
            value = f"CASE {value} WHEN 'T' THEN true WHEN 'F' THEN false END"
        elif v == "double":
            value = f"try_cast(CASE {value} WHEN 'inf' THEN 'Infinity' WHEN '-inf' THEN '-Infinity' WHEN 'nan' THEN 'NaN' ELSE {value} END AS DOUBLE)"
        elif v == "bigint":
            value = f"try_cast({value} AS BIGINT)"
        columns[k] = value
    made = [F.expr(f"CAST({c} AS {schema.WIDE[k]})").alias(k) if k not in meta else decode_field(F.col(f"__m{meta.index(k)}"), schema.WIDE[k]).alias(k) for k, c in columns.items()]
    return out.select(*keys, *made)


def same_value(a: Column | str, b: Column | str) -> Column:
    """Deep equality: nulls and NaNs are equal to themselves, whole numbers to doubles of the same value."""
    return _col(a).eqNullSafe(_col(b))


def truncated(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)
