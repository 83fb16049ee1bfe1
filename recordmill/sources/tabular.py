"""Header-typed CSV for language models, JSON records, and replay logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill import schema
from recordmill.functions.scalar import float_text

CSV_MAGIC = "L|"
_CHARS = {"bigint": "d", "int": "d", "double": "f", "boolean": "b", "string": "s"}
_TYPES = {"d": "bigint", "f": "double", "b": "boolean", "s": "string", "n": "string", "m": "string"}


def csv_header(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, kind, ordinal): the type letter of each column; n where all values are null."""
    kinds = {f.name: _CHARS.get(f.dataType.simpleString(), "m") for f in df.schema}
    counts = df.agg(*(F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("name"), F.when(F.col(f"_{i}") > 0, kinds[c]).otherwise("n").alias("kind"), F.lit(i).cast("bigint").alias("ordinal")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*rows)))


def csv_cell(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "b":
        out = F.when(c, "T").otherwise("F")
    elif kind == "f":
        out = float_text(c)
    elif kind == "d":
        out = c.cast("string")
    else:
        text = c.cast("string") if kind == "s" else F.to_json(F.struct(c.alias("v")))
        out = F.when(text == "", "$0=").when(text.rlike(r'[,"\n\r:|{}\[\]]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.when(c.isNull(), "N").otherwise(out)


def csv_lines(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One line per row, cells joined by commas, beside the key columns."""
    kinds = {f.name: _CHARS.get(f.dataType.simpleString(), "m") for f in df.schema}
    return df.select(*keys, F.concat_ws(",", *(csv_cell(c, kinds[c]) for c in columns)).alias("line"))


_CSV_CELL = r'("[^"]*+(?:""[^"]*+)*+"|[^,]*)(?:,|$)'


def read_csv_lines(lines: DataFrame, header: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of lines(line) by a header like ``L|a:d,b:s``; short rows end in nulls."""
    names = [x.rsplit(":", 1) for x in header.removeprefix(CSV_MAGIC).split(",")]
    cells = F.regexp_extract_all("line", F.lit(_CSV_CELL), F.lit(1))
    cells = F.when(F.col("line").contains('"'), cells).otherwise(F.split("line", ",", -1))
    rows = lines.select(*keys, cells.alias("_c"))

    def value(i: int, kind: str) -> Column:
        c = F.try_element_at("_c", F.lit(i + 1))
        c = F.when(c == "N", None).otherwise(c)
        if kind == "b":
            return F.when(c == "T", True).when(c == "F", False)
        if kind in "df":
            text = F.when(c == "inf", "Infinity").when(c == "-inf", "-Infinity").when(c == "nan", "NaN").otherwise(c)
            return text.try_cast(_TYPES[kind])
        quoted = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
        return F.when(c == "$0=", "").when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)

    return rows.select(*keys, *(value(i, k).alias(n) for i, (n, k) in enumerate(names)))


def csv_to_records(df: DataFrame, thread_id: str = "t1") -> DataFrame:
    """Wide records from rows(payload_id, pos, type, ...): unknown types dropped, missing threads, ids and steps filled in order."""
    some = df.filter(F.col("type").isin(list(schema.FIELDS)))
    lists = some.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("step", F.lit(0)).alias("step")))).alias("_r"))
    start = F.struct(F.lit(1).cast("bigint").alias("next"), F.array().cast("array<struct<pos bigint, had bigint, step bigint>>").alias("out"))

    def fill(a: Column, r: Column) -> Column:
        step = F.when(r["step"] != 0, r["step"]).otherwise(a["next"])
        return F.struct(F.greatest(a["next"] + 1, step + 1).alias("next"), F.concat(a["out"], F.array(F.struct(r["pos"].alias("pos"), a["next"].alias("had"), step.alias("step")))).alias("out"))

    steps = lists.select("payload_id", F.inline(F.aggregate("_r", start, fill)["out"])).withColumnsRenamed({"step": "_step", "had": "_had"})
    out = some.join(steps, ["payload_id", "pos"])
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return schema.widen(out.withColumns({"thread_id": F.coalesce(blank("thread_id"), F.lit(thread_id)), "id": F.coalesce(blank("id"), F.concat("type", F.format_string("_%03d", "_had"))), "step": F.col("_step")}))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Wide records of (payload_id, json), an array of records each."""
    fields = T.StructType([f for f in schema.RECORD.fields if f.name not in ("payload_id", "pos")])
    rows = df.select("payload_id", F.posexplode(F.from_json(F.col(column), T.ArrayType(fields))).alias("_i", "_r"))
    return schema.widen(rows.select("payload_id", (F.col("_i") + 1).cast("bigint").alias("pos"), "_r.*"))


def to_json(df: DataFrame) -> DataFrame:
    """(payload_id, json): an array by payload, nulls kept, NaN and infinities as null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    names = [c for c in schema.WIDE if c not in ("payload_id", "pos")]
    cells = [(finite(c) if schema.WIDE[c] == "double" else F.col(f"`{c}`")).alias(c) for c in names]
    lists = df.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*cells).alias("r")))).alias("_l"))
    return lists.select("payload_id", F.to_json(F.transform("_l", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def size_compare(df: DataFrame) -> DataFrame:
    """(payload_id, json_chars, payload_chars, saving_pct) of both forms."""
    from recordmill.sources.payload import encode_payloads

    both = to_json(df).join(encode_payloads(df), "payload_id")
    sizes = both.select("payload_id", F.length("json").cast("bigint").alias("json_chars"), F.length("payload").cast("bigint").alias("payload_chars"))
    return sizes.withColumn("saving_pct", F.round(100.0 * (F.col("json_chars") - F.col("payload_chars")) / F.col("json_chars"), 1))


# -- replay logs ----------------------------------------------------------------------------

LOG = "seq bigint, timestamp double, meta map<string,string>, payload string"


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Entries (seq, timestamp, meta, payload) as JSON lines, payloads in base64."""
    log.select("seq", "timestamp", "meta", F.base64(F.encode("payload", "UTF-8")).alias("payload")).write.mode(mode).json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).json(path).withColumn("payload", F.decode(F.unbase64("payload"), "UTF-8"))


def replay(log: DataFrame, from_seq: int = 0) -> DataFrame:
    """Entries from a number on, in order."""
    return log.filter(F.col("seq") >= from_seq).orderBy("seq")


def entry(log: DataFrame, seq: int) -> DataFrame:
    """The entry of a number, or no row."""
    return log.filter(F.col("seq") == seq)


def replay_records(log: DataFrame) -> DataFrame:
    """Records of all entries that can be decoded, each identity from the first entry that has it."""
    from recordmill.operators.select import first_by_identity
    from recordmill.sources.payload import decode_payloads

    decoded = decode_payloads(log.select(F.col("seq").cast("string").alias("source"), "payload"), key="source")
    order = log.select(F.regexp_extract("payload", r"payload_id: (.*)", 1).alias("payload_id"), "seq")
    return first_by_identity(decoded.join(order, "payload_id"), (), ("seq", "pos"))


def union(*frames: DataFrame) -> DataFrame:
    """All rows; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
