"""Routing of records to handlers by (from_agent, to_agent), with wildcards and a default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"
BROADCAST_ROUTES = 100_000


def route(df: DataFrame, routes: DataFrame, default: str | None = None) -> DataFrame:
    """Adds ``handler``: of routes(from_agent, to_agent, handler) the exact one, else from/*, else */to, else */*, else the default."""
    pairs = routes.groupBy(F.col("from_agent").alias("_a"), F.col("to_agent").alias("_b")).agg(F.max("handler").alias("_h"))
    # A routing table is small configuration and is broadcast if it is; a larger one is joined, its hot pairs split by adaptive execution.
    few = routes.limit(BROADCAST_ROUTES + 1).count() <= BROADCAST_ROUTES
    out, a, b = df, F.coalesce("from_agent", F.lit("")), F.coalesce("to_agent", F.lit(""))
    found: list[Column] = []
    for i, (x, y) in enumerate(((a, b), (a, F.lit(ANY)), (F.lit(ANY), b), (F.lit(ANY), F.lit(ANY)))):
        named = pairs.select(F.col("_a").alias(f"_a{i}"), F.col("_b").alias(f"_b{i}"), F.col("_h").alias(f"_h{i}"))
        out = out.join(F.broadcast(named) if few else named, (x == F.col(f"_a{i}")) & (y == F.col(f"_b{i}")), "left").drop(f"_a{i}", f"_b{i}")
        found.append(F.col(f"_h{i}"))
    return out.withColumn("handler", F.coalesce(*found, F.lit(default).cast("string"))).drop(*(f"_h{i}" for i in range(4)))


def dispatch(df: DataFrame, handlers: dict[tuple[str, str], Callable[[DataFrame], Column]], default: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Adds ``result`` by column expressions registered for (from, to) pairs; null where none fits."""
    a, b = F.coalesce("from_agent", F.lit("")), F.coalesce("to_agent", F.lit(""))
    ranked = sorted(handlers, key=lambda p: (p[0] == ANY, p[1] == ANY))
    out = default(df).cast("string") if default else F.lit(None).cast("string")
    for x, y in reversed(ranked):
        test = (F.lit(True) if x == ANY else a == x) & (F.lit(True) if y == ANY else b == y)
        out = F.when(test, handlers[x, y](df).cast("string")).otherwise(out)
    return df.withColumn("result", out)
