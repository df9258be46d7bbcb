"""Session helpers: configuration, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024
#: Most blocks in which a table of vectors is broadcast, and so most scans of the rows that it is joined with.
BLOCKS = 16


def build_session(
    master: str = "local[*]", *, scratch: str, shuffle_partitions: int = 8, memory: str = "8g", **config: str
) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller brings a configured one.

    ``scratch`` becomes ``spark.checkpoint.dir``; ``config`` holds further settings with ``_`` for ``.``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("dosewise")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for name, value in config.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, as named by ``spark.checkpoint.dir`` or by ``setCheckpointDir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the scratch folder and read it back.

    The result has true size statistics, so the planner decides by them whether to broadcast it, and a lost
    executor re-reads files instead of recomputing the lineage. ``remove_stored`` deletes all such tables.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has stored in the scratch folder; results built on them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def vectors_size(directions: DataFrame, vec: str = "direction") -> int:
    """Bytes of a stored vector table as doubles."""
    return directions.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0)).cast("long").alias("n")).first()["n"] * 8


def broadcast_vectors(directions: DataFrame, vec: str = "direction", limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a materialised vector table for broadcast if its measured size is below the limit, else leave it."""
    return F.broadcast(directions) if vectors_size(directions, vec) <= limit else directions


def join_vectors(
    rows: DataFrame, directions: DataFrame, keys: Sequence[str], vec: str = "direction", limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``rows`` inner-joined with a stored table of one vector per group, without moving the rows.

    A table above the limit is broadcast in blocks of groups, each measured to be below it, and each block meets the rows
    of its groups in a scan of its own. Only beyond ``BLOCKS`` blocks, where one shuffle costs less than so many scans, or for
    a single vector above the limit, is the rest joined by shuffle.
    """
    keys = list(keys)
    if vectors_size(directions, vec) <= limit:
        return rows.join(F.broadcast(directions), keys)
    n, sizes = 1, {}
    while n < BLOCKS and (not sizes or max(sizes.values()) > limit):
        n *= 2
        block = F.pmod(F.xxhash64(*keys), F.lit(n))
        sizes = {r["b"]: r["n"] for r in directions.groupBy(block.alias("b")).agg((F.sum(F.size(vec)) * 8).alias("n")).collect()}
    block = F.pmod(F.xxhash64(*keys), F.lit(n))
    small = sorted(b for b, size in sizes.items() if size <= limit)
    parts = [rows.filter(block == b).join(F.broadcast(directions.filter(block == b)), keys) for b in small]
    large = sorted(set(sizes) - set(small))
    if large:
        parts.append(rows.filter(block.isin(large)).join(directions.filter(block.isin(large)), keys))
    return reduce(DataFrame.unionByName, parts)


def broadcast_rows(stored: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Hint a stored table of narrow rows for broadcast if its measured number of rows is below the limit, else leave it."""
    return F.broadcast(stored) if stored.count() <= limit else stored
