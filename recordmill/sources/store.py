"""Record store: records are kept as Parquet, a folder for each kind, bucketed by payload_id and sorted by position.

Windows and aggregates by payload then need no shuffle, and filters on kind, type and step reach the scan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
ROWS = 300_000  # records of a bucket or a shuffle's partition, about
ADVISORY = "8m"  # shuffled bytes, that compression makes a tenth of what a task sorts


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one; a temporary one of this machine only for local sessions without ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="recordmill-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut and what is read twice is computed once."""
    path = folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(spark: SparkSession, rows: int, each: int = ROWS) -> int:
    """Partitions for so many rows, so that a task's share doesn't grow with the input; shuffles of the session get no fewer from now on, and put no more than ADVISORY bytes together unless the session has set its own size."""
    key, first = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    n = max(int(spark.conf.get(key)), -(-rows // each))
    for k in (key, first):
        if (have := spark.conf.get(k, None)) is not None and int(have) < n:
            spark.conf.set(k, str(n))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if rows > each and spark.conf.get(size, None) is None:
        spark.conf.set(size, ADVISORY)
    return n


def save(df: DataFrame, kind: str = "kind", key: str = "payload_id", order: str = "pos", buckets: int | None = None, placed: bool = False) -> str:
    """Store records with a column ``kind`` as a table of the session's catalog, in as many buckets as shuffles have partitions by default; its name.

    ``placed``: rows are partitioned by ``key`` into as many partitions as there are buckets, and sorted. They are written as they come then.
    """
    spark = df.sparkSession
    name = f"records_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.partitionBy(kind).option("path", folder(spark, "records"))
    if not placed:
        writer.bucketBy(n, key).sortBy(key, order).saveAsTable(name)
        return name
    at = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(at, None)
    spark.conf.set(at, "64")  # a file for each kind of a task's bucket is open at once, so that they need no sort
    try:
        writer.bucketBy(n, key).saveAsTable(name)
    finally:
        spark.conf.unset(at) if before is None else spark.conf.set(at, before)
    return name
