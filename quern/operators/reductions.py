"""Reductions of gridded images at stations: requests that can be recorded, their answers as tidy rows, and the same on a table."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.operators import rasters, specs
from quern.operators.specs import REDUCERS
from quern.sources.sinks import kept

T = TypeVar("T")
FEATURES = "struct<features:array<struct<properties:struct<station_id:string,date:string,value:double,count:long>>>>"


def requests(stations: DataFrame, feature: Column, buffer_m: int, statistic: str, date_from: str, date_to: str, limit: int = 5000) -> DataFrame:
    """(request_no, n_stations, n_elements, request, fingerprint): requests of at most `limit` stations x days, in order of id.

    request is canonical JSON (keys sorted), fingerprint 16 hex digits of its SHA-256, so that values can be traced to it.
    """
    if statistic not in REDUCERS:
        raise ValueError(f"unknown statistic {statistic!r}")
    days = (pd.Timestamp(date_to) - pd.Timestamp(date_from)).days + 1
    if days < 1:
        raise ValueError(f"{date_to} is before {date_from}")
    size = max(1, limit // days)
    rows = stations.withColumn("request_no", F.floor((F.row_number().over(Window.orderBy("station_id")) - 1) / size))  # stations are a dimension
    point = F.struct("latitude", "longitude", "station_id")
    by = rows.groupBy("request_no", feature.alias("feature")).agg(F.array_sort(F.collect_list(F.struct("station_id", point.alias("p")))).alias("_s"))  # at most `size`
    body = F.struct(F.lit(buffer_m).alias("buffer_m"), F.lit(date_from).alias("date_from"), F.lit(date_to).alias("date_to"), "feature", F.transform("_s", lambda x: x["p"]).alias("stations"), F.lit(statistic).alias("statistic"))
    text = by.select("request_no", F.size("_s").cast("long").alias("n_stations"), F.to_json(body).alias("request"))
    return text.select("request_no", "n_stations", (F.col("n_stations") * days).alias("n_elements"), "request", F.substring(F.sha2("request", 256), 1, 16).alias("fingerprint"))


def tidy(answers: DataFrame, scale: float = 1.0, fixture: bool = False, json_col: str = "json") -> DataFrame:
    """(station_id, date, value, valid_px, fixture) from answers of a service, a JSON document each: value times the scale.

    Nulls stay null; fixture marks rows that come from a recording, so that no finding rests on them unseen. A document that
    can't be read is an error.
    """
    read = answers.select(F.from_json(json_col, FEATURES, {"mode": "FAILFAST"}).alias("d")).select(F.explode("d.features.properties").alias("p"))
    return read.select("p.station_id", F.to_date("p.date").alias("date"), (F.col("p.value") * scale).alias("value"), F.col("p.count").alias("valid_px"), F.lit(fixture).alias("fixture"))


#: Statistics of cells of one position, from which those of more cells follow.
MERGED = {"mean", "count", "max", "min", "stdDev"}


def reduce_at(stations: DataFrame, cells: DataFrame, buffer_km: float, keys: list[str], value: str, statistics: list[str]) -> DataFrame:
    """(station_id, *keys, <statistic>, ...) over the cells within a buffer around each station, for each image (keys).

    A station without a cell in an image has no row. Cells and stations meet through the spatial index; stations of one position
    meet the cells once, and cells of one position and image are merged before, except for a median. Deviations are from the mean
    of a first pass, so a large mean takes no digits from them.
    """
    at, by = rasters.spots(stations), ["at_lat", "at_lon", *keys]
    if not MERGED.issuperset(statistics):
        return rasters.at_stations(stations, specs.reduced(rasters.near_cells(at, cells, buffer_km), by, value, statistics), "inner")
    v = F.col(value)
    merged = cells.groupBy("latitude", "longitude", *keys).agg(F.sum(v).alias("_s"), F.count(v).alias("_n"), F.max(v).alias("_max"), F.min(v).alias("_min"), F.avg(v).alias("_m"), F.var_pop(v).alias("_var"))
    sums = rasters.near_cells(at, merged, buffer_km).groupBy(*by).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("count"), F.max("_max").alias("max"), F.min("_min").alias("min"))
    found = sums.withColumn("mean", F.col("_s") / F.nullif(F.col("count"), F.lit(0)))
    if "stdDev" in statistics:
        found = kept(found, "sums")
        off = F.col("_m") - F.col("mean")
        met = rasters.near_cells(found.select(*by, "mean"), merged, buffer_km, tuple(keys))
        sd = met.groupBy(F.struct(*by).alias("_by")).agg(F.sum(F.col("_n") * (F.col("_var") + off * off)).alias("_d"))  # structs: a null key is one, too
        found = found.withColumn("_by", F.struct(*by)).join(sd, "_by").withColumn("stdDev", F.sqrt(F.col("_d") / F.nullif(F.col("count"), F.lit(0))))
    return rasters.at_stations(stations, found.select(*by, *statistics), "inner")


def unzipped(archives: DataFrame, suffix: str = ".nc") -> DataFrame:
    """(path, member, content) of the archives' members with a suffix; archives has path and content, as the binaryFile source gives.

    A file that is no archive is its own only member: some services send a single file as it is.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    yield pd.DataFrame({"path": [path], "member": [path.rsplit("/", 1)[-1]], "content": [content]})
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        yield pd.DataFrame({"path": [path], "member": [name], "content": [z.read(name)]})

    return archives.select("path", "content").mapInPandas(members, "path string, member string, content binary")


def retry(task: Callable[[], T], tries: int = 5, base: float = 3.0, pause: Callable[[float], None] = time.sleep) -> T:
    """task(), tried again after 3, 6, 12, ... seconds; the last error is raised."""
    for k in range(tries):
        try:
            return task()
        except Exception:
            if k + 1 == tries:
                raise
            pause(base * 2**k)
    raise ValueError("tries must be at least 1")


def require_inputs(spark: SparkSession, inputs: dict[str, str]) -> None:
    """Raise if paths are missing, with what to do about each (path to instruction)."""
    missing = []
    for path, how in inputs.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            missing.append(f"{path}: {how}")
    if missing:
        raise FileNotFoundError("missing inputs\n" + "\n".join(missing))
