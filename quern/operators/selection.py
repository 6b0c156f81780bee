"""Choosing settings on a fixed validation block, and many fits at once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

T = TypeVar("T")


def at_once(tasks: list[Callable[[], T]], most: int = 8) -> list[T]:
    """The tasks' results in their order; up to `most` run at the same time, so that small jobs share the executors."""
    session = SparkSession.getActiveSession()
    own = inheritable_thread_target(session) if session is not None else (lambda task: task)  # a pool inside of a task of another
    with ThreadPoolExecutor(max_workers=max(1, min(most, len(tasks)))) as pool:
        return list(pool.map(lambda task: own(task)(), tasks))


class FixedSplit(Estimator):
    """Fits each setting on the training rows, chooses the one with the least error on the validation rows, refits on both.

    Rows are told apart by a column that was frozen before: `splitCol` is 'train' or 'val', and all other rows, test rows among
    them, are never read. Of equal errors the first setting wins. An estimator with a validation indicator (boosted trees) stops
    early on the validation rows; the refit has as many rounds as the chosen fit kept.
    """

    splitCol = Param(Params._dummy(), "splitCol", "column with the rows' block", typeConverter=TypeConverters.toString)
    parallelism = Param(Params._dummy(), "parallelism", "fits at the same time", typeConverter=TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "the error: rmse or mae", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, estimator: Estimator | None = None, settings: list[dict] | None = None, splitCol: str = "block", parallelism: int = 8, metric: str = "rmse"):
        super().__init__()
        self.estimator, self.settings = estimator, settings or [{}]
        self._setDefault(splitCol="block", parallelism=8, metric="rmse")
        self._set(splitCol=splitCol, parallelism=parallelism, metric=metric)

    def _fit(self, dataset: DataFrame) -> FixedSplitModel:
        own, block = self.estimator, F.col(self.getOrDefault("splitCol"))
        train, val = dataset.where(block == "train"), dataset.where(block == "val")
        early = own.hasParam("validationIndicatorCol")
        measure = RegressionEvaluator(labelCol=own.getLabelCol(), predictionCol=own.getPredictionCol(), metricName=self.getOrDefault("metric"))
        both = dataset.where(block.isin("train", "val"))

        def trial(setting: dict) -> tuple[float, int | None]:
            now = own.copy({own.getParam(k): v for k, v in setting.items()})
            if early:
                now.set(now.getParam("validationIndicatorCol"), "_is_val")
                model = now.fit(both.withColumn("_is_val", block == "val"))
                return measure.evaluate(model.transform(val)), model.getNumTrees
            return measure.evaluate(now.fit(train).transform(val)), None

        tried = at_once([lambda s=s: trial(s) for s in self.settings], self.getOrDefault("parallelism"))
        errors = [e for e, _ in tried]
        best = min(range(len(errors)), key=lambda i: (errors[i] != errors[i], errors[i], i))  # an error that isn't a number loses
        chosen = {**self.settings[best], **({"maxIter": max(1, tried[best][1])} if early else {})}
        fitted = own.copy({own.getParam(k): v for k, v in chosen.items()}).fit(both)
        return FixedSplitModel(fitted, chosen, errors)


class FixedSplitModel(Model, MLWritable, MLReadable):
    """model: the refitted one; chosen: its settings; errors: each setting's validation error, in the order given."""

    def __init__(self, model: Model | None = None, chosen: dict | None = None, errors: list[float] | None = None):
        super().__init__()
        self.model, self.chosen, self.errors = model, chosen or {}, errors or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: FixedSplitModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        kind = type(self.instance.model)
        about = {"chosen": self.instance.chosen, "errors": self.instance.errors, "kind": f"{kind.__module__}:{kind.__name__}"}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=about)
        self.instance.model.write().save(f"{path}/model")


class _Reader(MLReader):
    def __init__(self, cls: type[FixedSplitModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FixedSplitModel:
        import importlib

        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        module, name = about["kind"].split(":")
        model = getattr(importlib.import_module(module), name).load(f"{path}/model")
        return self.cls(model, about["chosen"], about["errors"])
