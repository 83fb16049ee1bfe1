"""Column profiles: the cheapest encoding of each column, string pools, delta, run-length and bit packing with their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.functions.scalar import varint_length, zigzag_length

STRATEGIES = ("raw", "delta", "rle", "bits", "pool")


def column_profile(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """(group, name, n, nulls, kinds, runs, raw_cost, delta_cost, strategy) of each column in each group, values taken in order."""
    types = dict(df.dtypes)
    w = Window.partitionBy(group).orderBy(order)
    lagged, measures = df, []
    numeric = [c for c in columns if types[c] in ("bigint", "int")]
    for c in columns:
        lagged = lagged.withColumn(f"_p_{c}", F.lag(F.struct(F.col(f"`{c}`").alias("v"))).over(w))
    for c in numeric:  # the previous value that isn't null
        lagged = lagged.withColumn(f"_d_{c}", F.last(F.col(f"`{c}`"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    for c in columns:
        v, p = F.col(f"`{c}`"), F.col(f"_p_{c}")
        new = p.isNull() | ~v.eqNullSafe(p["v"])
        zero = F.lit(0).cast("bigint")
        raw = F.sum(zigzag_length(v)) if c in numeric else zero
        delta = F.sum(zigzag_length(F.when(v.isNotNull(), v - F.coalesce(F.col(f"_d_{c}"), F.lit(0))))) if c in numeric else zero
        kinds = F.countDistinct(v) if types[c] == "string" else zero
        measures.append(F.struct(F.lit(c).alias("name"), F.lit(types[c]).alias("type"), F.count("*").alias("n"), F.sum(v.isNull().cast("bigint")).alias("nulls"), kinds.alias("kinds"), F.sum(new.cast("bigint")).alias("runs"), raw.alias("raw_cost"), delta.alias("delta_cost")))
    long = lagged.groupBy(group).agg(F.array(*measures).alias("_m")).select(group, F.inline("_m"))
    some = F.col("n") - F.col("nulls")
    strategy = (
        F.when(some == 0, "rle").when(F.col("type") == "boolean", "bits")
        .when(F.col("type").isin("bigint", "int"), F.when((some >= 2) & (F.col("delta_cost") < F.col("raw_cost")), "delta").otherwise("raw"))
        .when((F.col("type") == "string") & (F.col("kinds") <= F.greatest(F.lit(8), F.floor(some / 10))) & (some > 4), "pool")
        .when(F.col("runs") < F.col("n") * 0.6, "rle").otherwise("raw")
    )
    return long.withColumn("strategy", strategy).drop("type")


def string_pool(df: DataFrame, columns: list[str], order: list[str], most: int = 64) -> DataFrame:
    """(value, frequency, score, index) of the strings that save most as references, column names counted once a row."""
    n = df.select(F.struct(*order).alias("_o"), *columns)
    names = F.array(*(F.struct(F.lit(c).alias("value"), F.lit(2 * i).alias("k")) for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.col(c).alias("value"), F.lit(2 * i + 1).alias("k")) for i, c in enumerate(columns)))
    each = n.select("_o", F.inline(F.concat(names, cells))).filter("value is not null and length(value) > 1")
    freq = each.groupBy("value").agg(F.count("*").alias("frequency"), F.min(F.struct("_o", "k")).alias("_first"))
    kinds = freq.agg(F.count("*").alias("_kinds"))
    score = F.col("frequency") * (F.length("value") - F.when(F.col("_kinds") <= 9, 2).otherwise(4))
    top = freq.crossJoin(F.broadcast(kinds)).withColumn("score", score.cast("bigint")).filter("frequency >= 2 and score > 0")
    top = top.orderBy(F.col("score").desc(), "_first").limit(most)
    w = Window.orderBy(F.col("score").desc(), "_first")  # over the limited rows only
    return top.select("value", "frequency", "score", (F.row_number().over(w) - 1).cast("bigint").alias("index"))


def delta_encode(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Adds ``delta``: the value itself first, then differences."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0)))


def delta_decode(df: DataFrame, group: str, order: str, name: str = "value") -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("delta").over(w))


def delta_savings(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """(group, raw, delta, saving): bytes as tagged integers against one delta block."""
    each = delta_encode(df, group, order, column)
    out = each.groupBy(group).agg(F.count("*").alias("_n"), F.sum(zigzag_length(column) + 1).alias("raw"), F.sum(zigzag_length("delta")).alias("_d"))
    out = out.select(group, "raw", (1 + varint_length("_n") + F.col("_d")).alias("delta"))
    return out.withColumn("saving", F.col("raw") - F.col("delta"))


def run_lengths(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """(group, run, value, length): consecutive equal values, nulls being equal."""
    w = Window.partitionBy(group).orderBy(order)
    new = (F.row_number().over(w) == 1) | ~F.col(column).eqNullSafe(F.lag(column).over(w))
    marked = df.withColumn("_new", new.cast("bigint"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.first(column).alias("value"), F.count("*").alias("length"))


def run_expand(runs: DataFrame, group: str) -> DataFrame:
    """(group, pos, value): the values of runs again, counted from 1."""
    w = Window.partitionBy(group).orderBy("run")
    before = runs.withColumn("_before", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return before.select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), "length")).alias("_i"), "value", "_before").select(group, (F.col("_before") + F.col("_i")).alias("pos"), "value")


def string_size(text: Column) -> Column:
    """Bytes of a string with its tag and length."""
    n = F.octet_length(text)
    return F.when(n <= 3, n + 2).otherwise(n + 1 + varint_length(n)).cast("bigint")


def rle_savings(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """(group, raw, rle, saving) of a string column: bytes joined by tabs against run-length coding."""
    raw = df.groupBy(group).agg((F.sum(F.octet_length(F.coalesce(column, F.lit("None")))) + F.count("*") - 1).alias("raw"))
    runs = run_lengths(df, group, order, column)
    size = F.coalesce(string_size(F.col("value")), F.lit(1)) + varint_length("length")
    coded = runs.groupBy(group).agg((1 + varint_length(F.count("*")) + F.sum(size)).alias("rle"))
    return raw.join(coded, group).withColumn("saving", F.col("raw") - F.col("rle"))


def bits_savings(df: DataFrame, group: str) -> DataFrame:
    """(group, raw, bits, saving): two bytes a boolean against a bit each."""
    out = df.groupBy(group).agg(F.count("*").alias("_n"))
    out = out.select(group, (2 * F.col("_n")).alias("raw"), (1 + varint_length("_n") + F.floor((F.col("_n") + 7) / 8)).cast("bigint").alias("bits"))
    return out.withColumn("saving", F.col("raw") - F.col("bits"))


def pack_bits(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """(group, byte_no, byte): booleans by order from 1, eight to a byte, the first in the lowest bit."""
    i = F.col(order) - 1
    bit = F.when(F.col(column), F.expr(f"shiftleft(1, int(({order} - 1) % 8))")).otherwise(0)
    return df.groupBy(group, F.floor(i / 8).cast("bigint").alias("byte_no")).agg(F.sum(bit).cast("bigint").alias("byte"))


def unpack_bits(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """The inverse, given (group, byte_no, byte, n): (group, order, column) for the first ``n`` places."""
    bits = df.select(group, "byte_no", "byte", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_i"))
    at = (F.col("byte_no") * 8 + F.col("_i") + 1).cast("bigint")
    return bits.select(group, at.alias(order), (F.getbit("byte", "_i") == 1).alias(column), "n").filter(F.col(order) <= F.col("n")).drop("n")


def window_blocks(df: DataFrame, group: str, order: str, size: int = 1000) -> DataFrame:
    """Adds ``block``: windows of ``size`` rows in order."""
    return df.withColumn("block", F.floor((F.col(order) - 1) / size).cast("bigint"))
