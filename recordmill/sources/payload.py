"""Payload text: writing records as payloads, reading them back, and repairing what a model wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import schema
from recordmill.functions.scalar import all_well_formed, decoded_rows, encode_field, estimate_tokens, readable_rows, row_marks, split_row, well_formed, with_line
from recordmill.operators.validate import first_violations

_HEADER = ("thread", "context_window", "context_used", "payload_id", "parent_payload_id", "agent_id", "session_id", "schema_version", "meta", "records")
_INTEGERS = ("context_window", "context_used", "records")


def header_lines(values: dict[str, Column]) -> Column:
    """Header lines in their fixed order; null ones are left out."""
    lines = [F.concat(F.lit(f"{k}: "), values[k].cast("string")) for k in _HEADER if k in values]
    return F.concat_ws("\n", *lines)


def encode_payloads(df: DataFrame, meta: tuple[str, ...] = (), headers: DataFrame | None = None, context_window: int | None = None, enforce_budget: bool = False, magic: str = schema.MAGIC, new_ids: bool = False) -> DataFrame:
    """(payload_id, payload): one text by payload, rows in order of pos. ``headers`` may give header values by payload_id; with ``new_ids`` headers name a generated id, the same whenever the same records are written."""
    lines = with_line(df, meta).select("payload_id", "pos", "line")
    body = lines.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    out = body.select("payload_id", text.alias("_body"), F.size("_l").alias("_n")).withColumn("_used", estimate_tokens("_body"))
    if headers is not None:
        extra = [c for c in headers.columns if c in _HEADER and c != "payload_id"]
        out = out.join(headers.select("payload_id", *(F.col(c).alias(f"_h_{c}") for c in extra)), "payload_id", "left")
        values = {c: F.col(f"_h_{c}") for c in extra}
    else:
        values = {}
    if context_window is not None:
        values |= {"context_window": F.lit(context_window), "context_used": F.col("_used")}
    digest = F.md5(F.concat("payload_id", F.lit("\n"), "_body"))
    made = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    values |= {"payload_id": made if new_ids else F.col("payload_id"), "meta": F.lit(",".join(meta) or None).cast("string"), "records": F.col("_n")}
    payload = F.concat(F.lit(magic + "\n"), header_lines(values), F.lit("\n"), F.when(F.length("_body") > 0, F.concat("_body", F.lit("\n"))).otherwise(""))
    if enforce_budget and context_window is not None:
        payload = F.when(F.col("_used") > context_window, F.raise_error(F.format_string("context budget of %d exceeded: %d", F.lit(context_window), "_used"))).otherwise(payload)
    return out.select("payload_id", payload.alias("payload"))


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, payload) of text files, one payload each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload"))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def parse_headers(payloads: DataFrame, magic: str = schema.MAGIC, key: str = "source") -> DataFrame:
    """Header of each payload as columns, the rows after it as ``rows``, and ``problem`` where it can't be read."""
    # Generated columns are computed once, however many columns read them.
    df = payloads.select(key, F.explode(F.array(_lines(F.col("payload")))).alias("_l"))
    at = F.array_position(F.transform("_l", lambda x: F.when(x.startswith("records: "), 1).otherwise(0)), 1)
    head = F.transform(F.array(at), lambda n: F.struct(n.alias("at"), F.when(n > 0, F.slice("_l", 1, n)).otherwise(F.array().cast("array<string>")).alias("head")))
    df = df.select(key, "_l", F.inline(head).alias("_at", "_head"))

    def value(name: str) -> Column:
        prefix = name + ": "
        hits = F.filter("_head", lambda x: x.startswith(prefix))
        return F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 1 << 30)

    values = {k: value(k) for k in _HEADER}
    numbers = {k: values[k].try_cast("bigint") for k in _INTEGERS}
    meta = F.filter(F.transform(F.split(F.coalesce(values["meta"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.slice("_l", F.col("_at") + 1, F.greatest(F.size("_l") - F.col("_at"), F.lit(0)))
    problem = F.when(F.element_at("_l", 1) != magic, "magic line missing").when(F.col("_at") == 0, "records line missing")
    for k in _INTEGERS:
        problem = problem.when(values[k].isNotNull() & numbers[k].isNull(), f"{k} is not a number")
    problem = problem.when(F.size(F.array_except(meta, F.array(*map(F.lit, schema.META)))) > 0, "unknown meta field")
    problem = problem.when(F.size(rows) != numbers["records"], "wrong number of records")
    renamed = {"thread": "thread_id", "meta": "meta_fields", "records": "record_count"}
    columns = [(meta if k == "meta" else numbers.get(k, values[k])).alias(renamed.get(k, k)) for k in _HEADER]
    return df.select(key, *columns, F.when(problem.isNull(), rows).otherwise(F.array().cast("array<string>")).alias("rows"), problem.alias("problem"))


def decode_payloads(payloads: DataFrame, meta: tuple[str, ...] = (), magic: str = schema.MAGIC, key: str = "source") -> DataFrame:
    """Wide records of payloads(source, payload), all or nothing: a payload with an unreadable header, a wrong count or a bad row gives none (see unreadable()). Extra fields are those that the payload's header names, ``meta`` where it names none."""
    head = parse_headers(payloads, magic, key).filter("problem is null")
    if meta:
        head = head.withColumn("meta_fields", F.when(F.size("meta_fields") == 0, F.array(*map(F.lit, meta))).otherwise(F.col("meta_fields")))
    good = head.filter(all_well_formed("rows", "meta_fields"))
    lines = good.select(F.coalesce("payload_id", F.col(key)).alias("payload_id"), F.col("meta_fields").alias("_meta"), F.posexplode("rows").alias("_i", "line"))
    return _decoded(lines.withColumn("pos", (F.col("_i") + 1).cast("bigint")), "_meta")


def unreadable(payloads: DataFrame, magic: str = schema.MAGIC, key: str = "source") -> DataFrame:
    """(source, problem) of the payloads that decode_payloads() leaves out: what is wrong with the header, else the first row that can't be read."""
    head = parse_headers(payloads, magic, key)
    bad = F.array_position(row_marks("rows", "meta_fields"), 1)
    problem = F.coalesce("problem", F.when(bad > 0, F.format_string("row %d can't be read", bad)))
    return head.select(key, problem.alias("problem")).filter("problem is not null")


def _decoded(lines: DataFrame, meta: tuple[str, ...] | str) -> DataFrame:
    # A generated column is computed once, however many columns read it.
    extra = [meta] if isinstance(meta, str) else []
    cells = lines.select("payload_id", "pos", *extra, F.explode(F.array(split_row("line"))).alias("_c"))
    return schema.widen(decoded_rows(cells, ["payload_id", "pos"], "_c", meta))


def decode_rows(lines: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """Wide records of well-formed rows among lines(payload_id, pos, line)."""
    return _decoded(lines.filter(well_formed("line", meta)), meta)


def error_payload(message: Column, thread_id: str = "INVALID", magic: str = schema.MAGIC) -> Column:
    """A payload of one err record."""
    row = F.concat_ws("|", F.lit("err"), F.lit("er_val_001"), F.lit(thread_id), F.lit("1"), F.lit("VALIDATION_FAILED"), encode_field(message, "string"), F.lit("validator"), F.lit("F"))
    return F.concat(F.lit(f"{magic}\nrecords: 1\n"), row, F.lit("\n"))


def repaired_lines(raw: DataFrame, magic: str = schema.MAGIC) -> DataFrame:
    """(source, header, meta, count, rows, problem) of raw(source, raw): fences, text before the magic line, blank lines and unknown rows dropped."""
    lines = F.filter(F.transform(F.split("raw", r"\r?\n", -1), lambda x: F.trim(x)), lambda x: ~x.startswith("```"))
    df = raw.select("source", F.explode(F.array(lines)).alias("_l"))
    at = F.array_position("_l", magic)
    after = F.filter(F.slice("_l", F.col("_at") + 1, F.greatest(F.size("_l") - F.col("_at"), F.lit(0))), lambda x: x != "")
    known = list(schema.FIELDS)
    is_row = lambda x: F.split(x, r"\|", 2)[0].isin(known) & ~x.startswith("thread: ") & ~x.startswith("context")
    df = df.select("source", "_l", F.explode(F.array(at)).alias("_at"))
    df = df.select("source", "_at", F.explode(F.array(F.when(F.col("_at") > 0, after).otherwise(F.array().cast("array<string>")))).alias("_a"))
    end = F.array_position(F.transform("_a", lambda x: F.when(x.startswith("records: "), 1).otherwise(0)), 1)
    head = F.when(end > 0, F.slice("_a", 1, end)).otherwise(F.col("_a"))
    rows = F.filter("_a", is_row)
    header = F.filter(head, lambda x: ~is_row(x) & ~x.startswith("records: "))
    named = F.substring(F.try_element_at(F.filter(header, lambda x: x.startswith("meta: ")), F.lit(-1)), 7, 1 << 30)
    meta = F.filter(F.transform(F.split(F.coalesce(named, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.isin(list(schema.META)))
    count = F.when(end > 0, F.substring(F.get("_a", (end - 1).cast("int")), 10, 20).try_cast("bigint"))
    return df.select("source", header.alias("header"), meta.alias("meta"), count.alias("count"), rows.alias("rows"), F.when(F.col("_at") == 0, F.lit(f"no '{magic}' line found")).alias("problem"))


def repair(raw: DataFrame, magic: str = schema.MAGIC, thread_id: str = "REPAIR", strict: bool = False) -> DataFrame:
    """(source, payload, repaired): a valid payload from each model output, keeping the rows that can be read, with the extra fields that its header names; else an error payload. ``strict``: a row that can't be read, or another number of rows than the header says, is an error."""
    df = repaired_lines(raw, magic)
    df = df.select("*", F.explode(F.array(readable_rows("rows", "meta"))).alias("good"))
    if strict:
        lost = F.when(F.size("good") < F.size("rows"), F.format_string("%d rows can't be read", F.size("rows") - F.size("good")))
        df = df.withColumn("problem", F.coalesce("problem", lost, F.when(F.col("count").isNull() | (F.col("count") != F.size("rows")), "wrong number of records")))
    lines = df.select("source", "meta", F.posexplode("good").alias("_i", "line")).select(F.col("source").alias("payload_id"), (F.col("_i") + 1).cast("bigint").alias("pos"), F.col("meta").alias("_meta"), "line")
    bad = first_violations(_decoded(lines, "_meta")).select(F.col("payload_id").alias("source"), F.col("violation.message").alias("_v"))
    df = df.join(bad, "source", "left")
    problem = F.coalesce("problem", F.when(F.size("good") == 0, "no readable row"), F.col("_v"))
    text = F.concat(F.lit(magic + "\n"), F.array_join(F.concat("header", F.array(F.concat(F.lit("records: "), F.size("good").cast("string"))), "good"), "\n"), F.lit("\n"))
    return df.select("source", F.when(problem.isNull(), text).otherwise(error_payload(problem, thread_id, magic)).alias("payload"), problem.isNull().alias("repaired"))


def slices(payloads: DataFrame, size: int = 65536) -> DataFrame:
    """(payload_id, slice_no, data): each payload's bytes in slices of ``size``, numbered from 0, to be sent one after the other; join_slices() is the inverse."""
    data = payloads.select("payload_id", F.encode("payload", "UTF-8").alias("_b"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / size))
    each = data.select("payload_id", "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"))).alias("slice_no"))
    return each.select("payload_id", "slice_no", F.substring("_b", (F.col("slice_no") * size + 1).cast("int"), F.lit(size)).alias("data"))


def join_slices(parts: DataFrame) -> DataFrame:
    """(payload_id, payload) from slices."""
    lists = parts.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("slice_no", "data"))).alias("_l"))
    whole = F.aggregate("_l", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return lists.select("payload_id", F.decode(whole, "UTF-8").alias("payload"))
