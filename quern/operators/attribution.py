"""Attribution of boosted trees' predictions to features: path-dependent Shapley values, exact.

A leaf's value counts for a set of known features by the product of its conditions on them (0 or 1) and, for unknown ones, of
the shares of training rows that went the leaf's way. So a leaf's Shapley values depend on a row only through which of the
leaf's conditions it meets, and they follow from the coefficients of a product of one linear factor for each feature of the path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.sources.sinks import new_path


@dataclass(frozen=True)
class Leaf:
    """value: weighted prediction; for each feature on the path the interval (low, high] that leads here, and the rows' share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def nodes(spark: SparkSession, model: GBTRegressionModel) -> DataFrame:
    """(tree, weight, id, prediction, n, left, right, feature, threshold, categories) of a fitted model; leaves have left -1."""
    path = new_path(spark, "trees")
    model.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "_about", "weight").select("tree", "weight")
    d = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    split = F.col("split")
    flat = d.select("tree", "id", "prediction", F.col("rawCount").alias("n"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold"), split["numCategories"].alias("categories"))
    return flat.join(F.broadcast(trees), "tree")  # a row for each tree


def leaves(spark: SparkSession, model: GBTRegressionModel) -> list[Leaf]:
    """All leaves of a model: the number of trees times two to the depth, a bound set by its parameters."""
    by: dict[int, dict[int, dict]] = {}
    for r in nodes(spark, model).collect():
        by.setdefault(r["tree"], {})[r["id"]] = r
    out: list[Leaf] = []
    for _, own in sorted(by.items()):
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            i, path = todo.pop()
            node = own[i]
            if node["left"] < 0:
                f = sorted(path)
                low, high, share = (np.array([path[x][k] for x in f], float) for k in range(3))
                out.append(Leaf(node["weight"] * node["prediction"], np.array(f, np.int64), low, high, share))
                continue
            if node["categories"] is not None and node["categories"] >= 0:
                raise ValueError("features must be continuous")
            f, t = node["feature"], node["threshold"]
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            total = own[node["left"]]["n"] + own[node["right"]]["n"]
            todo.append((node["left"], path | {f: (low, min(high, t), share * own[node["left"]]["n"] / total)}))
            todo.append((node["right"], path | {f: (max(low, t), high, share * own[node["right"]]["n"] / total)}))
    return out


def base_value(found: list[Leaf]) -> float:
    """The prediction where no feature is known: the training rows' mean by the trees' own counts."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in found))


def values(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """The Shapley value of each row's each feature."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        met = (own > leaf.low) & (own <= leaf.high)
        kinds, at = np.unique(met, axis=0, return_inverse=True)
        o, z = kinds.astype(float), leaf.share
        weights = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
        phi = np.zeros(o.shape)
        for j in range(d):
            poly = np.ones((len(o), 1))  # coefficients by how many of the other features are known
            for i in range(d):
                if i != j:
                    grown = np.zeros((len(o), poly.shape[1] + 1))
                    grown[:, :-1] += poly * z[i]
                    grown[:, 1:] += poly * o[:, i : i + 1]
                    poly = grown
            phi[:, j] = leaf.value * (o[:, j] - z[j]) * (poly @ weights)
        out[:, leaf.features] += phi[at.reshape(-1)]
    return out


def explain(model: GBTRegressionModel, rows: DataFrame, keys: list[str], features_col: str = "x") -> DataFrame:
    """(*keys, base, shap): for each row an array of a value for each feature; with base they add up to the prediction.

    One pass over the rows, without a shuffle; the leaves are sent to the tasks once.
    """
    found = leaves(rows.sparkSession, model)
    sent, base = rows.sparkSession.sparkContext.broadcast(found), base_value(found)

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["_x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                shap = values(x, sent.value)
                listed = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(shap.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], listed], names=[*keys, "shap"])

    flat = rows.select(*keys, vector_to_array(features_col).alias("_x"))
    schema = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys)
    return flat.mapInArrow(attribute, f"{schema}, shap array<double>").withColumn("base", F.lit(base))


def by_feature(explained: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(*keys, feature, mean_abs): the mean size of each feature's values."""
    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("shap").alias("value"))
    flat = explained.select(*keys, F.explode(named).alias("p")).select(*keys, F.col("p.feature").alias("feature"), F.col("p.value").alias("value"))
    return flat.groupBy(*keys, "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))


def by_family(importance: DataFrame, family) -> DataFrame:
    """(family, mean_abs, share): summed by family(feature column), and per cent of all."""
    by = importance.groupBy(family(F.col("feature")).alias("family")).agg(F.sum("mean_abs").alias("mean_abs"))
    total = by.agg(F.sum("mean_abs").alias("_total"))
    return by.crossJoin(F.broadcast(total)).select("family", "mean_abs", (100 * F.col("mean_abs") / F.col("_total")).alias("share"))
