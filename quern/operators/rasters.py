"""Gridded sources: chunks of requests, daily composites, rings around stations, and the collapse of split rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.geo import haversine

RADIUS_KM = 6371.0088
SHARES = 16  # tasks that share a cube's stations


def bounding_box(places: DataFrame, pad: float = 0.5) -> DataFrame:
    """north, west, south, east."""
    return places.agg((F.max("latitude") + pad).alias("north"), (F.min("longitude") - pad).alias("west"), (F.min("latitude") - pad).alias("south"), (F.max("longitude") + pad).alias("east"))


def date_chunks(span: DataFrame, n_stations: int, limit: int = 5000) -> DataFrame:
    """(date_from, date_to) of at most limit elements, from one row (a, z) of dates."""
    days = max(1, limit // n_stations)
    begin = span.select(F.explode(F.sequence("a", "z", F.expr(f"interval {days} days"))).alias("date_from"), "z")
    return begin.select("date_from", F.least(F.date_add("date_from", days - 1), "z").alias("date_to"))


def year_blocks(months: DataFrame, size: int) -> DataFrame:
    """(year, block, n): months in blocks of a size that never span a year."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(F.year("m")).orderBy("m"))
    return months.select(F.year("m").alias("year"), F.floor((rn - 1) / size).cast("long").alias("block")).groupBy("year", "block").agg(F.count("*").alias("n"))


def nearest_on(axis: list[float], value: Column) -> Column:
    """The axis's value that is nearest, the first of equals. An axis is a parameter of a grid's file."""
    each = F.array(*[F.struct(F.abs(F.lit(float(x)) - value).alias("gap"), F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(axis)])
    return F.array_min(each)["x"]


def extract_points(grid: DataFrame, stations: DataFrame, value: str, factor: float = 1.0) -> DataFrame:
    """(station_id, time, value): each station's own cell of a grid (time, cell_lat, cell_lon, value), times a factor of units.

    stations has station_id, cell_lat and cell_lon, as nearest_on gives them. A cell without a value stays null.
    """
    return stations.select("station_id", "cell_lat", "cell_lon").join(grid, ["cell_lat", "cell_lon"], "left").select("station_id", "time", (F.col(value) * factor).alias(value))


def request_sizes(requests: DataFrame, limit: int = 5000) -> DataFrame:
    """requests (n_stations, n_days, n_variables) with n_elements, over_limit, and n_requests that stay within the limit."""
    n = F.col("n_stations") * F.col("n_days") * F.col("n_variables")
    return requests.withColumn("n_elements", n).withColumns({"over_limit": n > limit, "n_requests": F.ceil(n / limit)})


def daily_composite(slices: DataFrame, keys: list[str], cell: str, value: str) -> DataFrame:
    """(*keys, value, valid_cells): the mean of a day's slices for each cell first, then the mean over cells.

    A day without any value keeps its row: null, and 0 cells.
    """
    by_cell = slices.groupBy(*keys, cell).agg(F.avg(value).alias("_v"))
    return by_cell.groupBy(*keys).agg(F.avg("_v").alias("value"), F.count("_v").alias("valid_cells"))


def spots(stations: DataFrame) -> DataFrame:
    """(at_lat, at_lon): the stations' different positions."""
    return stations.select(F.col("latitude").alias("at_lat"), F.col("longitude").alias("at_lon")).distinct()


def near_cells(at: DataFrame, cells: DataFrame, most_km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """cells with the columns of `at` (at_lat, at_lon, ...) and km, for each position of it within most_km of a cell; columns of `on` must be equal (or both null).

    The globe is cut into cubes with edges of most_km; a position is filed under the 27 around it and a cell under its own, so
    only neighbours meet. Arcs are never shorter than chords, so no cell within reach is missed. A cube's positions are dealt to
    SHARES tasks, and each has the cube's cells: wide buffers give few cubes. Products of unit vectors leave out most pairs before the arc is taken.
    """
    edge = lambda x: F.floor(RADIUS_KM * x / most_km).cast("long")

    def unit(latitude: str, longitude: str) -> tuple[Column, Column, Column]:
        lat, lon = F.radians(latitude), F.radians(longitude)
        return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)

    spark = cells.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # by number: little data, much work
    keys = ["_x", "_y", "_z", "_share", *(["_on"] if on else [])]
    image = {"_on": F.struct(*on)} if on else {}
    u, v, w = unit("at_lat", "at_lon")
    around = F.array(*[F.struct((edge(u) + i).alias("_x"), (edge(v) + j).alias("_y"), (edge(w) + k).alias("_z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    own = at.withColumns({"_u": u, "_v": v, "_w": w, "_share": F.pmod(F.xxhash64("at_lat", "at_lon"), F.lit(SHARES)), **image, "_c": F.explode(around)}).select("*", "_c.*").drop("_c", *on).repartition(tasks, *keys)
    p, q, r = unit("latitude", "longitude")
    there = cells.withColumns({**image, "_p": p, "_q": q, "_r": r, "_x": edge(p), "_y": edge(q), "_z": edge(r), "_share": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))}).repartition(tasks, *keys)
    least = math.cos(min(most_km / RADIUS_KM, math.pi)) - 1e-9  # more than the products' error
    met = there.join(own, keys).where(F.col("_u") * F.col("_p") + F.col("_v") * F.col("_q") + F.col("_w") * F.col("_r") >= least)
    met = met.withColumn("km", haversine(F.col("at_lat"), F.col("at_lon"), F.col("latitude"), F.col("longitude"))).where(F.col("km") <= most_km)
    return met.drop(*keys, "_u", "_v", "_w", "_p", "_q", "_r")


def at_stations(stations: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """(station_id, ...): what was found at positions (at_lat, at_lon), for each station there."""
    where = [F.col("latitude") == F.col("at_lat"), F.col("longitude") == F.col("at_lon")]
    return stations.select("station_id", "latitude", "longitude").join(found, where, how).drop("latitude", "longitude", "at_lat", "at_lon")


def rings(stations: DataFrame, cells: DataFrame, value: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(station_id, <name>, n_<name>, ...): mean and count of the cells in each ring (inner, outer] of km; an inner bound below 0
    makes a disc. All rings come from one scan of the cells; stations without a cell in a ring have a null mean and 0.

    Cells of one position are summed before they meet stations, and stations of one position meet them once.
    """
    summed = cells.groupBy("latitude", "longitude").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    met = near_cells(spots(stations), summed, max(outer for _, outer in bounds.values()))
    inside = {name: (F.col("km") > inner) & (F.col("km") <= outer) for name, (inner, outer) in bounds.items()}
    sums = met.groupBy("at_lat", "at_lon").agg(*[F.sum(F.when(i, F.col(c))).alias(f"{c}_{name}") for name, i in inside.items() for c in ("_s", "_n")])
    found = sums.select("at_lat", "at_lon", *[c for name in bounds for c in ((F.col(f"_s_{name}") / F.nullif(F.col(f"_n_{name}"), F.lit(0))).alias(name), F.col(f"_n_{name}").alias(f"n_{name}"))])
    return at_stations(stations, found, "left").fillna(0, [f"n_{name}" for name in bounds])


def ring_mean(stations: DataFrame, cells: DataFrame, inner_km: float, outer_km: float, value: str) -> DataFrame:
    """(station_id, mean, n) of the cells in one ring."""
    return rings(stations, cells, value, {"mean": (inner_km, outer_km)}).withColumnRenamed("n_mean", "n")


def static_features(stations: DataFrame, terrain: DataFrame, people: DataFrame, lights: DataFrame, epoch: int, train: tuple[str, str], disc_km: float, inner_km: float, outer_km: list[float], density: float = 100.0) -> DataFrame:
    """(station_id, elevation, for each radius annulus_<km> and basin_<km>, population, lights): what doesn't change at a place.

    terrain (latitude, longitude, value); people also epoch: one epoch is chosen, counts become a density; lights also date: only
    the training window counts, so nothing of the test is in them. basin is the elevation less the ring's: below 0 in a basin.
    A station without a cell of terrain, of the epoch or of the window drops out; a window without any lights is an error.
    """
    lit = lights.where(F.col("date").between(*[F.lit(t).cast("date") for t in train]))
    if lit.isEmpty():
        raise ValueError(f"no lights in {train}")
    names = {r: f"{r:g}km" for r in outer_km}
    ground = rings(stations, terrain, "value", {"elevation": (-1.0, disc_km), **{f"annulus_{n}": (inner_km, r) for r, n in names.items()}})
    ground = ground.where(" and ".join(f"n_{c} > 0" for c in ["elevation", *[f"annulus_{n}" for n in names.values()]]))
    ground = ground.withColumns({f"basin_{n}": F.col("elevation") - F.col(f"annulus_{n}") for n in names.values()})
    own = rings(stations, people.where(F.col("epoch") == epoch), "value", {"population": (-1.0, disc_km)}).where("n_population > 0")
    bright = rings(stations, lit, "value", {"lights": (-1.0, disc_km)}).where("n_lights > 0")
    out = ground.join(own.select("station_id", (F.col("population") * density).alias("population")), "station_id").join(bright.select("station_id", "lights"), "station_id")
    return out.select("station_id", "elevation", *[f"{kind}_{n}" for kind in ("annulus", "basin") for n in names.values()], "population", "lights")


def collapse(rows: DataFrame, keys: list[str], columns: dict[str, Column], order: str | None = None) -> DataFrame:
    """One row for each key from rows that hold a part of the columns each: the first value there is by `order`, else the largest."""
    one = (lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))) if order else F.max
    return rows.groupBy(*keys).agg(*[one(c).alias(name) for name, c in columns.items()])
