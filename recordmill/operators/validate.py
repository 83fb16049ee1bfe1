"""Validation of records: row checks, enums, step order, orphan results, routing; the first violation by payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill import schema


def _problem(rank: int, field: str, message: Column, expected: Column | str, got: Column, hint: str) -> Column:
    row = F.col("pos")
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rank).alias("rank"), F.struct(message.alias("message"), row.alias("row"), F.lit(field).alias("field"), text(expected).alias("expected"), got.alias("got"), F.lit(hint).alias("suggestion")).alias("violation"))


def _row(text: str, *args) -> Column:
    return F.format_string("Row %d: " + text, F.col("pos"), *args)


def empty_fields() -> Column:
    """Thread, id and step checks of a row, in this order; null if all hold."""
    return (
        F.when(F.coalesce("thread_id", F.lit("")) == "", _problem(0, "thread_id", _row("thread_id is empty"), "non-empty string", F.lit("empty string"), "give every record a thread"))
        .when(F.coalesce("id", F.lit("")) == "", _problem(1, "id", _row("id is empty"), "non-empty string", F.lit("empty string"), "give every record an id"))
        .when(F.coalesce("step", F.lit(0)) < 1, _problem(2, "step", _row("step must be a positive integer, got %s", F.coalesce(F.col("step").cast("string"), F.lit("null"))), "integer >= 1", F.coalesce(F.col("step").cast("string"), F.lit("null")), "count steps from 1"))
    )


def backward_step(previous: str = "_previous") -> Column:
    p, s = F.col(previous), F.col("step")
    return F.when(s < p, _problem(3, "step", _row("step %d is less than previous step %d in thread '%s'", s, p, F.col("thread_id")), F.concat(F.lit(">= "), p.cast("string")), s.cast("string"), "steps of a thread must not go back"))


def wrong_enum() -> Column:
    out = F.lit(None)
    for kind, field in reversed(schema.ENUMS):
        allowed = schema.ENUMS[kind, field]
        value = F.col(field)
        bad = (F.col("type") == kind) & value.isNotNull() & ~value.isin(list(allowed))
        listed = ", ".join(allowed)
        out = F.when(bad, _problem(4, field, _row(f"field '{field}' value '%s' not in [{listed}]", value), f"[{listed}]", value, f"use one of: {listed}")).otherwise(out)
    return out


def with_previous(df: DataFrame) -> DataFrame:
    """The previous step of the same thread and payload."""
    w = Window.partitionBy("payload_id", "thread_id").orderBy("pos")
    return df.withColumn("_previous", F.lag("step").over(w))


def row_violations(df: DataFrame) -> DataFrame:
    """(payload_id, pos, violation) of rows with an empty thread, id or step."""
    return df.withColumn("_p", empty_fields()).filter("_p is not null").select("payload_id", "pos", "_p.violation.*")


def enum_violations(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", wrong_enum()).filter("_p is not null").select("payload_id", "pos", "_p.violation.*")


def step_violations(df: DataFrame) -> DataFrame:
    return with_previous(df).withColumn("_p", backward_step()).filter("_p is not null").select("payload_id", "pos", "_p.violation.*")


def _tool_positions() -> Column:
    """First position of a tool with a row's id; by payload and id, so whatever clusters payloads serves."""
    return F.min(F.when(F.col("type") == "tool", F.col("pos"))).over(Window.partitionBy("payload_id", "id"))


def orphan_results(df: DataFrame, strict_order: bool = False) -> DataFrame:
    """Results whose id no tool of the payload has (none before it, if the order counts)."""
    calls = df.filter("type in ('tool', 'res')").withColumn("_tool", _tool_positions())
    lone = F.col("_tool").isNull() | (F.col("_tool") > F.col("pos")) if strict_order else F.col("_tool").isNull()
    return calls.filter((F.col("type") == "res") & lone).drop("_tool")


def validate(df: DataFrame) -> DataFrame:
    """(payload_id, ok, violation) of every payload: its first violation, row checks in row order before results without tools. One pass over windows by payload."""
    got = F.format_string("row %d: res id '%s' has no matching tool row", "pos", "id")
    late = _problem(5, "id", got, F.concat(F.lit("tool row with id="), "id"), F.lit("no matching tool row"), "add the tool row or correct the id")
    rows = with_previous(df).withColumn("_tool", _tool_positions())
    checked = rows.withColumn("_p", F.coalesce(empty_fields(), backward_step(), wrong_enum())).withColumn("_q", F.when((F.col("type") == "res") & F.col("_tool").isNull(), late))
    at = F.when(F.col("_p").isNotNull(), F.struct(F.lit(0).alias("phase"), "pos", F.col("_p.rank").alias("rank"))).when(F.col("_q").isNotNull(), F.struct(F.lit(1).alias("phase"), "pos", F.lit(5).alias("rank")))
    checked = checked.select("payload_id", F.coalesce("_p", "_q")["violation"].alias("violation"), at.alias("_at"))
    first = checked.groupBy("payload_id").agg(F.min_by("violation", "_at").alias("violation"))
    return first.select("payload_id", F.col("violation").isNull().alias("ok"), "violation")


def first_violations(df: DataFrame) -> DataFrame:
    """(payload_id, violation) of the payloads that have one."""
    return validate(df).filter("not ok").drop("ok")


def schema_compliance(df: DataFrame, keys: str = "keys", kind: str = "type") -> DataFrame:
    """The first problem of each raw record, given the names of the fields it has: unknown type, missing fields, extra fields."""
    problem = F.lit("unknown type")
    for t, fields in schema.FIELDS.items():
        required = [k for k in (*schema.COMMON, *fields) if (t, k) not in schema.OPTIONAL]
        allowed = [*schema.COMMON, *fields, *schema.META]
        missing = F.array_except(F.array(*map(F.lit, required)), keys)
        extra = F.array_except(F.col(keys), F.array(*map(F.lit, allowed)))
        found = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_min(missing))).when(F.size(extra) > 0, F.concat(F.lit("extra "), F.array_min(extra)))
        problem = F.when(F.col(kind) == t, found).otherwise(problem)
    return df.withColumn("problem", problem)


def routing_violation(known_agents: list[str] | None = None) -> Column:
    a, b = F.col("from_agent"), F.col("to_agent")
    out = F.when(a.isNull() != b.isNull(), "from_agent and to_agent must both be set or both absent").when(a == b, "self-loop")
    if known_agents:
        for c, name in ((a, "from_agent"), (b, "to_agent")):
            out = out.when(c.isNotNull() & ~c.isin(list(known_agents)), F.concat(F.lit(name + " not known: "), c))
    return out


def routing_consistency(df: DataFrame, known_agents: list[str] | None = None) -> DataFrame:
    """(payload_id, ok, row, reason): the first inconsistent row of each payload."""
    marked = df.select("payload_id", "pos", routing_violation(known_agents).alias("reason"))
    at = F.when(F.col("reason").isNotNull(), F.struct("pos", "reason"))
    first = marked.groupBy("payload_id").agg(F.min(at).alias("_first"))
    return first.select("payload_id", F.col("_first").isNull().alias("ok"), F.col("_first.pos").alias("row"), F.col("_first.reason").alias("reason"))


def budget_overage(usage: DataFrame, window: int) -> DataFrame:
    """Payloads that use more tokens than their window, and by how many."""
    return usage.filter(F.col("tokens") > window).withColumn("overage", F.col("tokens") - window)
