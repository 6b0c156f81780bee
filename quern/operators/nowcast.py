"""Spatial nowcasting: a target station's hour from the others'. The target is never its own donor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quern.functions.geo import haversine
from quern.sources.sinks import kept

SAME_PLACE_KM = 1e-6
RADIUS_KM = 6371.0088


def distances(stations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(station_id, city, donor, donor_city, km) of every station and other source. Stations are a small dimension."""
    b = (stations if sources is None else sources).select(F.col("station_id").alias("donor"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), F.col("city").alias("donor_city"))
    km = haversine(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    return stations.crossJoin(b).where("station_id <> donor").select("station_id", "city", "donor", "donor_city", km.alias("km"))


def donors(panel: DataFrame, stations: DataFrame, other_city: bool = True) -> DataFrame:
    """(station_id, city, ts, donor, km, v, rank): usable donors of each hour, nearest first."""
    d = distances(stations)
    d = d.where("city <> donor_city") if other_city else d
    usable = panel.where("value is not null").select(F.col("station_id").alias("donor"), "ts", F.col("value").alias("v"))
    rank = F.row_number().over(Window.partitionBy("station_id", "ts").orderBy("km", "donor"))
    return usable.join(d, "donor").withColumn("rank", rank)


def nearest_usable(panel: DataFrame, targets: DataFrame, sources: DataFrame, k: int, other_city: bool = True, width: int | None = None) -> DataFrame:
    """(station_id, city, ts, donor, km, v, rank): each target's k nearest sources with a value in an hour, nearest first.

    Every target has its list of sources by distance. A round takes the next ones of the list (at first `width`, four times k,
    then twice as many), and only hours that are still short of k go on, so rows follow targets times k. Hours are those of the
    panel; ties of distance go by donor. targets and sources: (station_id, city, latitude, longitude), a small dimension.
    """
    d = distances(targets, sources)
    d = d.where("city <> donor_city") if other_city else d
    lists = d.withColumn("place", F.row_number().over(Window.partitionBy("station_id").orderBy("km", "donor"))).drop("donor_city")
    longest = lists.agg(F.max("place")).first()[0] or 0
    usable = panel.where("value is not null").select(F.col("station_id").alias("donor"), "ts", F.col("value").alias("v"))
    low, high, found = 0, max(width or 4 * k, 1), None
    open_hours = None
    while True:
        step = usable.join(lists.where((F.col("place") > low) & (F.col("place") <= high)), "donor")
        step = step if open_hours is None else step.join(open_hours, ["station_id", "ts"], "left_semi")
        last = high >= longest
        step = step if last and found is None else kept(step, "donors")
        found = step if found is None else found.unionByName(step)
        if last:
            break
        have = found.groupBy("station_id", "ts").agg(F.count("*").alias("_n"))
        every = panel.select("ts").distinct().crossJoin(F.broadcast(targets.select("station_id")) if longest <= 10_000 else targets.select("station_id")) if open_hours is None else open_hours
        open_hours = kept(every.join(have, ["station_id", "ts"], "left").where(F.coalesce("_n", F.lit(0)) < k).select("station_id", "ts"), "short-hours")
        if open_hours.isEmpty():
            break
        low, high = high, high + 2 * (high - low)
    rank = F.row_number().over(Window.partitionBy("station_id", "ts").orderBy("place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("place")


def nearest(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").select("station_id", "ts", F.col("v").alias("pred"))


def idw(ranked: DataFrame, k: int = 5, power: float = 2.0) -> DataFrame:
    """Inverse-distance mean of the k nearest; donors at the same place decide alone."""
    if k < 1 or power <= 0:
        raise ValueError("k must be at least 1 and power above 0")
    w, here = F.pow("km", F.lit(-power)), F.col("km") <= SAME_PLACE_KM
    mean = F.sum(F.when(~here, F.col("v") * w)) / F.sum(F.when(~here, w))
    return ranked.where(F.col("rank") <= k).groupBy("station_id", "ts").agg(F.coalesce(F.avg(F.when(here, F.col("v"))), mean).alias("pred"))


def pool_mean(train: DataFrame, folds: DataFrame) -> DataFrame:
    """(held_out_city, mean, median) over all training values of the other cities."""
    t = train.where("value is not null").join(folds.where("role = 'train'"), "station_id")
    return t.groupBy("held_out_city").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.count("*").alias("n"))


def variogram(panel: DataFrame, stations: DataFrame, least: int = 10) -> DataFrame:
    """(a, b, km, gamma, n): half the mean squared difference of each pair's common hours."""
    p = panel.where("value is not null").select("ts", "station_id", "value")
    q = p.select("ts", F.col("station_id").alias("b"), F.col("value").alias("vb"))
    pairs = p.join(q, "ts").where("station_id < b").groupBy(F.col("station_id").alias("a"), "b").agg((0.5 * F.avg(F.pow(F.col("value") - F.col("vb"), 2))).alias("gamma"), F.count("*").alias("n")).where(F.col("n") >= least)
    return pairs.join(distances(stations).select(F.col("station_id").alias("a"), F.col("donor").alias("b"), "km"), ["a", "b"])


def exponential(d: np.ndarray, nugget: float, sill: float, reach: float) -> np.ndarray:
    """nugget + sill (1 - exp(-d / range)), and 0 at no distance."""
    d = np.asarray(d, float)
    return np.where(d == 0, 0.0, nugget + sill * (1 - np.exp(-d / max(reach, 1e-9))))


def arcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between places (latitude, longitude) of a and of b."""
    (lat1, lon1), (lat2, lon2) = np.radians(a).T[:, :, None], np.radians(b).T[:, None, :]
    half = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(half))


def bounded_least_squares(residual, jacobian, start, lower, upper, stride, rounds: int = 2000, tolerance: float = 1e-15) -> np.ndarray:
    """The parameters within bounds that make the sum of squares least, by damped Gauss-Newton steps projected onto the bounds.

    A parameter that stands on a bound and would leave it is held there for the step; steps that don't lessen the sum are
    damped more. Parameters are scaled by their columns, so their units don't matter; stride is how far each may go in a step.
    """
    lower, upper = np.asarray(lower, float), np.asarray(upper, float)
    x = np.clip(np.asarray(start, float), lower, upper)
    r, damping = residual(x), 1e-3
    for _ in range(rounds):
        j = jacobian(x)
        slope = j.T @ r
        free = ~(((x <= lower) & (slope > 0)) | ((x >= upper) & (slope < 0)))
        if not free.any() or r @ r == 0:
            break
        a = j[:, free].T @ j[:, free]
        scale = np.maximum(np.diag(a), 1e-30)
        step = np.zeros_like(x)
        step[free] = np.linalg.lstsq(a + damping * np.diag(scale), -slope[free], rcond=None)[0]
        new = np.clip(x + step * min(1.0, (stride / np.maximum(np.abs(step), 1e-300)).min()), lower, upper)
        if np.all(np.abs(new - x) <= tolerance * (np.abs(x) + tolerance)):
            break
        now = residual(new)
        if now @ now < r @ r:
            x, r, damping = new, now, max(damping / 5, 1e-12)
        elif damping > 1e12:
            break
        else:
            damping *= 4
    return x


def fit_exponential(pairs: list[tuple[float, float]]) -> tuple[float, float, float] | None:
    """(nugget, sill, range) of a least-squares exponential variogram from (distance, gamma) of pairs; None for under 3 pairs.

    It starts from no nugget, the largest gamma and a third of the largest distance. The nugget lies between 0 and twice the
    largest gamma, the sill below ten times it, the range above a metre.
    """
    if len(pairs) < 3:
        return None
    d, g = np.array(sorted(pairs), float).T
    if not (np.isfinite(d).all() and np.isfinite(g).all()):
        return None
    top, third = float(g.max()) or 1.0, float(d.max()) / 3 or 1.0
    apart = d > 0

    def jacobian(p: np.ndarray) -> np.ndarray:
        fall = np.exp(-d / np.exp(p[2]))
        return np.c_[np.ones_like(d), 1 - fall, -p[1] * fall * d / np.exp(p[2])] * apart[:, None]

    # The range goes by its logarithm, half a unit a step, as a straight step may lead past 0.
    residual = lambda p: exponential(d, p[0], p[1], np.exp(p[2])) - g
    stride = np.array([np.inf, np.inf, 0.5])
    x = bounded_least_squares(residual, jacobian, [0.0, top, np.log(max(third, 1e-3))], [0.0, 1e-9, np.log(1e-3)], [2 * top + 1e-9, 10 * top + 1e-9, np.inf], stride)
    return float(x[0]), float(x[1]), float(np.exp(x[2]))


def kriging(panel: DataFrame, stations: DataFrame, params: tuple[float, float, float] | None, k: int = 5, power: float = 2.0) -> DataFrame:
    """(station_id, ts, pred, fallback): ordinary kriging from other cities' stations, else IDW."""
    return kriging_from(panel, stations, stations, params, k, power, other_city=True)


def kriging_from(panel: DataFrame, targets: DataFrame, sources: DataFrame, params: tuple[float, float, float] | None, k: int = 5, power: float = 2.0, other_city: bool = False) -> DataFrame:
    """(station_id, ts, pred, fallback) of the targets from the sources' hours.

    Weights depend only on which donors there are, so they are solved once for each target and pattern.
    """
    d = distances(targets, sources)
    d = d.where("city <> donor_city") if other_city else d
    usable = panel.where("value is not null").select(F.col("station_id").alias("donor"), "ts", F.col("value").alias("v"))
    ranked = usable.join(d, "donor").withColumn("rank", F.row_number().over(Window.partitionBy("station_id", "ts").orderBy("km", "donor")))
    sets = ranked.groupBy("station_id", "ts").agg(F.array_join(F.sort_array(F.collect_list("donor")), ",").alias("pattern"))  # at most the stations
    spots = {r.station_id: (r.latitude, r.longitude) for r in sources.select("station_id", "latitude", "longitude").unionByName(targets.select("station_id", "latitude", "longitude")).collect()}  # a small dimension

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for target, pattern in zip(pdf.station_id, pdf.pattern, strict=True):
                names = pattern.split(",")
                if params is None or len(names) < 2:
                    continue
                n, at = len(names), np.array([spots[x] for x in names])
                a = np.ones((n + 1, n + 1))
                a[n, n] = 0
                a[:n, :n] = exponential(arcs(at, at), *params)
                if np.linalg.cond(a) > 1e12:
                    continue
                w = np.linalg.solve(a, np.r_[exponential(arcs(np.array([spots[target]]), at)[0], *params), 1.0])[:n]
                out += [(target, pattern, x, float(v)) for x, v in zip(names, w, strict=True)]
            yield pd.DataFrame(out, columns=["station_id", "pattern", "donor", "w"])

    weights = sets.select("station_id", "pattern").distinct().mapInPandas(solve, "station_id string, pattern string, donor string, w double")
    krige = sets.join(weights, ["station_id", "pattern"]).join(ranked.select("station_id", "ts", "donor", "v"), ["station_id", "ts", "donor"]).groupBy("station_id", "ts").agg(F.sum(F.col("w") * F.col("v")).alias("k"))
    both = idw(ranked, k, power).join(krige, ["station_id", "ts"], "left")
    return both.select("station_id", "ts", F.coalesce("k", "pred").alias("pred"), F.col("k").isNull().alias("fallback"))
