"""Baselines as Spark ML estimators: fit on the training block, then transform, save, load, and stand in a Pipeline.

A model exists only after fit, so nothing can be predicted before. What a fit learns is a table (and a few numbers), saved as
Parquet beside the metadata. `deterministic` says that the seed doesn't matter.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from quern.operators import forecast as fc, nowcast as nc

FORECASTERS = ("persistence", "diurnal_persistence", "same_hour_mean", "climatology_mean")
NOWCASTERS = ("training_pool_mean", "nearest_monitor", "idw", "ordinary_kriging")


class _Baseline(Params):
    method = Param(Params._dummy(), "method", "which baseline", typeConverter=TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "for models that draw; no baseline does", typeConverter=TypeConverters.toInt)
    deterministic = True

    def getMethod(self) -> str:
        return self.getOrDefault(self.method)


class _ForecastParams(_Baseline):
    horizons = Param(Params._dummy(), "horizons", "hours ahead", typeConverter=TypeConverters.toListInt)
    days = Param(Params._dummy(), "days", "days of same-hour means", typeConverter=TypeConverters.toInt)


class _NowcastParams(_Baseline):
    k = Param(Params._dummy(), "k", "nearest donors", typeConverter=TypeConverters.toInt)
    power = Param(Params._dummy(), "power", "of the inverse distance", typeConverter=TypeConverters.toFloat)


class Forecaster(Estimator, _ForecastParams, DefaultParamsReadable, DefaultParamsWritable):
    """A station's own future from its own past. Fits on rows (station_id, ts, value) of the training block."""

    @keyword_only
    def __init__(self, method: str = "persistence", horizons: list[int] | None = None, days: int = 7, seed: int = 0):
        super().__init__()
        self._setDefault(method="persistence", horizons=[24], days=7, seed=0)
        if method not in FORECASTERS:
            raise ValueError(f"unknown forecaster {method!r}")
        self._set(method=method, horizons=horizons or [24], days=days, seed=seed)

    def _fit(self, dataset: DataFrame) -> ForecasterModel:
        cells = fc.climatology_cells(dataset) if self.getMethod() == "climatology_mean" else None
        return self._copyValues(ForecasterModel({} if cells is None else {"cells": cells}))


class Nowcaster(Estimator, _NowcastParams, DefaultParamsReadable, DefaultParamsWritable):
    """A place's value from other stations at the same hour. Fits on rows (station_id, city, latitude, longitude, ts, value) of
    the training stations only; whatever isn't among them is a target, and gives no value to any prediction.
    """

    @keyword_only
    def __init__(self, method: str = "idw", k: int = 5, power: float = 2.0, seed: int = 0):
        super().__init__()
        self._setDefault(method="idw", k=5, power=2.0, seed=0)
        if method not in NOWCASTERS:
            raise ValueError(f"unknown nowcaster {method!r}")
        if k < 1 or power <= 0:
            raise ValueError("k must be at least 1 and power above 0")
        self._set(method=method, k=k, power=power, seed=seed)

    def _fit(self, dataset: DataFrame) -> NowcasterModel:
        places = dataset.select("station_id", "city", "latitude", "longitude").distinct()
        state, numbers = {"places": places}, {}
        if self.getMethod() == "training_pool_mean":
            r = dataset.agg(F.avg("value").alias("mean"), F.count("value").alias("n")).first()
            numbers = {"mean": r["mean"], "n": r["n"]}
        elif self.getMethod() == "ordinary_kriging":
            pairs = [(x["km"], x["gamma"]) for x in nc.variogram(dataset.select("station_id", "ts", "value"), places).collect()]  # pairs of stations
            numbers = {"variogram": nc.fit_exponential(pairs)}
        return self._copyValues(NowcasterModel(state, numbers))


class _Fitted(Model, MLWritable, MLReadable):
    """state: the learned tables, by name; numbers: what else was learned."""

    def __init__(self, state: dict[str, DataFrame] | None = None, numbers: dict | None = None):
        super().__init__()
        self.state, self.numbers = state or {}, numbers or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class ForecasterModel(_Fitted, _ForecastParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(station_id, ts, value, model, horizon_h, pred): dataset is a complete hourly grid, of which no row after ts - h counts."""
        method, out = self.getMethod(), None
        for h in self.getOrDefault(self.horizons):
            rows = {
                "persistence": lambda h=h: fc.persistence(dataset, h),
                "diurnal_persistence": lambda h=h: fc.diurnal_persistence(dataset, h),
                "same_hour_mean": lambda h=h: fc.same_hour(dataset, h, self.getOrDefault(self.days)),
                "climatology_mean": lambda: fc.climatology_of(dataset, self.state["cells"]),
            }[method]()
            one = rows.select("station_id", "ts", "value", F.lit(method).alias("model"), F.lit(h).alias("horizon_h"), "pred")
            out = one if out is None else out.unionByName(one)
        return out


class NowcasterModel(_Fitted, _NowcastParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(station_id, ts, value, model, pred) of the targets: stations of dataset that were not fitted on; null where nothing is known."""
        method, places = self.getMethod(), self.state["places"]
        target = dataset.join(places.select("station_id"), "station_id", "left_anti")
        donors = dataset.join(places.select("station_id"), "station_id", "left_semi").select("station_id", "ts", "value")
        rows = target.select("station_id", "ts", "value")
        if method == "training_pool_mean":
            return rows.select("*", F.lit(method).alias("model"), F.lit(self.numbers["mean"]).cast("double").alias("pred"))
        spots = target.select("station_id", "city", "latitude", "longitude").distinct()
        k, power = self.getOrDefault(self.k), self.getOrDefault(self.power)
        if method == "nearest_monitor":
            pred = nc.nearest(nc.nearest_usable(donors, spots, places, 1, other_city=False))
        elif method == "idw":
            pred = nc.idw(nc.nearest_usable(donors, spots, places, k, other_city=False), k, power)
        else:
            params = self.numbers["variogram"]
            pred = nc.kriging_from(donors, spots, places, tuple(params) if params else None, k, power).drop("fallback")
        return rows.join(pred, ["station_id", "ts"], "left").select("station_id", "ts", "value", F.lit(method).alias("model"), "pred")


class _Writer(MLWriter):
    def __init__(self, instance: _Fitted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"numbers": self.instance.numbers, "tables": sorted(self.instance.state)})
        for name, table in self.instance.state.items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[_Fitted]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _Fitted:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls({t: self.sparkSession.read.parquet(f"{path}/{t}") for t in about["tables"]}, about["numbers"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model
