"""Writing results: Parquet, CSV, JSON and Markdown, and documents that are frozen by their digest."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session on one machine has none, a temporary folder. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="quern-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once into the shared folder and read again: cuts lineage, works nothing out twice, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write df as parquet, csv (with a header; null and the empty text are empty fields) or json (nulls are written)."""
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("emptyValue", "").csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def markdown(df: DataFrame, digits: int = 3, most: int = 200) -> str:
    """A report's table as Markdown, the first `most` rows: a feature of reports, which people read."""
    told = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    rows = [[told(x) for x in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def canonical(payload: object) -> str:
    return json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def digest(payload: object) -> str:
    """SHA-256 of the canonical text, without the frozen_at and sha256 fields."""
    body = {k: v for k, v in payload.items() if k not in ("frozen_at", "sha256")} if isinstance(payload, dict) else payload
    return hashlib.sha256(canonical(body).encode()).hexdigest()


def frozen(spark: SparkSession, path: str) -> dict | None:
    """The document that was frozen at path, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small document


def freeze(spark: SparkSession, payload: dict, path: str, now: str) -> dict:
    """Write payload with its digest and the time; if the same content is frozen there already, nothing changes, not even the time."""
    old = frozen(spark, path)
    if old is not None and old.get("sha256") == digest(payload) == digest(old):
        return old
    document = {**payload, "sha256": digest(payload), "frozen_at": now}
    spark.createDataFrame([(canonical(document).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return document


def read_blocks(document: dict) -> list[tuple[str, str, str]]:
    """(block, begin, end) of a frozen splits document."""
    return [(name, b["begin"], b["end"]) for name, b in document["blocks"].items()]


def synthetic_series(spark: SparkSession, stations: list[str], begin: str, hours: int, seed: int = 0) -> DataFrame:
    """(station_id, ts, value): a daily cycle times a yearly one times log-normal noise, made in place by Spark; for fixtures."""
    h = F.col("id")
    names = spark.createDataFrame([(s, i) for i, s in enumerate(stations)], "station_id string, i int")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(begin).cast("timestamp")) + h * 3600)
    daily = 1 + 0.4 * F.cos((F.hour(ts) - 7) * 3.141592653589793 / 12)
    yearly = 1 + 0.6 * F.cos(F.dayofyear(ts) * 2 * 3.141592653589793 / 365.25)
    grid = spark.range(hours).crossJoin(F.broadcast(names))  # stations are a parameter
    return grid.select("station_id", ts.cast("timestamp_ntz").alias("ts"), (30 * daily * yearly * F.exp(0.3 * F.randn(seed))).alias("value"))
