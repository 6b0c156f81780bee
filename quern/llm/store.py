"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine has none, a temporary folder. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_PATHS: list[str] = []  # of tables that were written and not deleted, oldest first


def written(df: DataFrame, name: str, **seen: Column) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts lineage, and survives lost executors.

    seen: aggregates over all rows, taken while they are written; seen_in() has them without a query of their own, as each
    query leaves plans, classes and threads in the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    counts = Observation() if seen else None
    (df.observe(counts, *[c.alias(k) for k, c in seen.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    out._seen = counts.get if seen else {}
    _PATHS.append(path)
    return out


def seen_in(table: DataFrame) -> dict:
    """What was seen while a table of written() was written."""
    return table._seen


def mark() -> int:
    """A place in the list of written tables, for clear()."""
    return len(_PATHS)


def clear(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written after mark() gave `since`, but for kept ones; nothing may read them any more."""
    free(spark, *[p for p in _PATHS[since:] if p not in {getattr(d, "_written_to", None) for d in kept}])


def free(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables of written() that nothing will read any more."""
    for table in tables:
        path = table if isinstance(table, str) else table._written_to
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _PATHS:
            _PATHS.remove(path)
