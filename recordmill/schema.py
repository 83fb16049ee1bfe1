"""Agent record model: the ten record types, their fields, enums, and the wide Spark schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = "1.0.0"
#: First line of a payload; readers and writers take another one as a parameter.
MAGIC = "AGENT-RECORDS v1"

_S, _D, _F, _B = "string", "bigint", "double", "boolean"
COMMON = {"type": _S, "id": _S, "thread_id": _S, "step": _D}
META = {"parent_id": _S, "from_agent": _S, "to_agent": _S, "priority": _D}
#: Fields of each record type beyond the common ones, in wire order.
FIELDS: dict[str, dict[str, str]] = {
    "msg": {"role": _S, "turn": _D, "content": _S, "tokens": _D, "flagged": _B},
    "tool": {"name": _S, "args": _S, "status": _S},
    "res": {"name": _S, "data": _S, "status": _S, "latency_ms": _D},
    "plan": {"index": _D, "description": _S, "status": _S},
    "obs": {"source": _S, "content": _S, "confidence": _F},
    "err": {"code": _S, "message": _S, "source": _S, "recoverable": _B},
    "mem": {"key": _S, "value": _S, "confidence": _F, "ttl": _D},
    "rag": {"rank": _D, "score": _F, "source": _S, "chunk": _S, "used": _B},
    "hyp": {"statement": _S, "evidence": _S, "score": _F, "accepted": _B},
    "cot": {"index": _D, "cot_type": _S, "text": _S, "confidence": _F},
}
OPTIONAL = {("res", "data"), ("mem", "ttl")}
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("msg", "role"): ("assistant", "system", "user"),
    ("tool", "status"): ("done", "error", "pending", "running"),
    ("res", "status"): ("done", "error", "timeout"),
    ("plan", "status"): ("active", "done", "pending", "skipped"),
    ("cot", "cot_type"): ("compute", "conclude", "observe", "plan", "verify"),
}
ARITY = {t: len(COMMON) + len(f) for t, f in FIELDS.items()}
WIDE: dict[str, str] = {"payload_id": _S, "pos": _D} | COMMON | {k: v for f in FIELDS.values() for k, v in f.items()} | META
_SPARK = {_S: T.StringType(), _D: T.LongType(), _F: T.DoubleType(), _B: T.BooleanType()}
RECORD = T.StructType([T.StructField(k, _SPARK[v]) for k, v in WIDE.items()])
HEADER = {
    "payload_id": _S, "parent_payload_id": _S, "thread_id": _S, "context_window": _D, "context_used": _D, "agent_id": _S, "session_id": _S,
    "schema_version": _S, "meta_fields": "array<string>", "record_count": _D,
}
VIOLATION = "struct<message string, row bigint, field string, expected string, got string, suggestion string>"

#: (from, to) -> transform; versions without an entry can't be migrated.
MIGRATIONS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {}


def widen(df: DataFrame) -> DataFrame:
    """All columns of the wide schema in order, missing ones as nulls of their type; others are dropped."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(f"`{k}`") if k in have else F.lit(None)).cast(v).alias(k) for k, v in WIDE.items()))


def migrate(df: DataFrame, from_version: str, to_version: str) -> DataFrame:
    """Rows of one schema version as another's; the same version changes nothing."""
    if from_version == to_version:
        return df
    if (from_version, to_version) not in MIGRATIONS:
        raise ValueError(f"no migration from {from_version} to {to_version}")
    return df.transform(MIGRATIONS[from_version, to_version])


def info() -> dict[str, object]:
    """Versions and limits of the format, for a driver's log."""
    import pyspark

    return {"format": MAGIC, "schema_version": VERSION, "types": list(FIELDS), "meta": list(META), "pyspark": pyspark.__version__}
