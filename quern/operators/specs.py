"""What features are and may be used for: composites' rules, tiers, invariants, families and resolutions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Composite:
    """A daily composite: radius and resolution in metres, factor of the stored values, and what values can be."""

    name: str
    band: str
    buffer_m: int
    scale_m: int
    scale_factor: float = 1.0
    non_negative: bool = True
    plausible_max: float = 10.0


# The five composites; only the first is stored scaled and can't be negative.
COMPOSITES = [
    Composite("aod_055", "Optical_Depth_055", 3_000, 1_000, 0.001, True, 6.0),
    Composite("absorbing_aerosol_index", "absorbing_aerosol_index", 7_000, 7_000, 1.0, False, 8.0),
    Composite("no2_tropospheric", "tropospheric_NO2_column_number_density", 7_000, 7_000, 1.0, False, 1e-3),
    Composite("so2_column", "SO2_column_number_density", 7_000, 7_000, 1.0, False, 1e-2),
    Composite("co_column", "CO_column_number_density", 7_000, 7_000, 1.0, False, 1.0),
]
# Columns of the feature table.
STATIC = ["elevation", "ghsl_population_density", "viirs_nighttime_lights", "terrain_basin_index_25km", "terrain_basin_index_50km", "terrain_basin_index_100km", "distance_to_aralkum"]
CALENDAR = ["doy_sin", "doy_cos", "month", "dow", "is_heating_season"]
FORECAST = ["cams_pm25_forecast"]
#: Names of reductions; the deviation is that of the population.
REDUCERS = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "count": F.count, "stdDev": F.stddev_pop}


def reduced(rows: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """(*keys, <name>, ...): reductions by their names; an unknown name is an error."""
    unknown = [n for n in names if n not in REDUCERS]
    if unknown:
        raise ValueError(f"unknown reductions {unknown}")
    return rows.groupBy(*keys).agg(*[REDUCERS[n](value).alias(n) for n in names])


def scaled(raw: Column, spec: Composite) -> Column:
    """A stored value in units; null stays null, a negative one stays negative."""
    return raw.cast("double") * spec.scale_factor


def implausible(value: Column, spec: Composite) -> Column:
    """Above what the spec allows, or below 0 where it can't be; null is not."""
    low = value < 0 if spec.non_negative else F.lit(False)
    return F.coalesce(low | (value > spec.plausible_max), F.lit(False))


def tier_columns(columns: list[str], tier: str) -> list[str]:
    """The columns of a tier, in a fixed order. deployable has only what is at hand when a forecast is issued."""
    have = set(columns)
    calendar, static, forecast = CALENDAR, [c for c in STATIC if c in have], [c for c in FORECAST if c in have]
    satellite = [s.name for s in COMPOSITES if s.name in have]
    pixels = [f"{s.name}_valid_px" for s in COMPOSITES if f"{s.name}_valid_px" in have]
    if tier == "static_only":
        return static + calendar
    if tier == "deployable":
        absorbing = [c for c in satellite if "absorbing" in c] + [c for c in pixels if "absorbing" in c]
        return absorbing + forecast + static + calendar
    if tier == "retrospective":
        return satellite + pixels + forecast + static + calendar
    raise ValueError(f"unknown tier {tier!r}")


def tier(features: DataFrame, name: str, keys: list[str], target: str = "target") -> DataFrame:
    """The keys, the target and a tier's columns; calendar columns have to be there."""
    return features.select(*keys, target, *tier_columns(features.columns, name))


def spec_problems(specs: DataFrame) -> DataFrame:
    """specs with `problems`: what contradicts itself in a feature's description.

    specs has name, source, available_at_runtime, latency_hours, has_reduction, requires_raster.
    """
    at_hand, latency = F.col("available_at_runtime"), F.col("latency_hours")
    found = F.array(
        F.when(at_hand & latency.isNull(), "available without a latency"),
        F.when(~at_hand & latency.isNotNull(), "latency without availability"),
        F.when(~F.col("has_reduction") & (F.col("source") != "derived") & ~F.col("requires_raster"), "gridded without a reduction"),
    )
    return specs.withColumn("problems", F.array_compact(found))


def set_summary(sets: DataFrame) -> DataFrame:
    """(set_name, n, deployable, max_latency_hours, credentials, n_raster, n_unverified, oracle_features, valid) by feature set.

    A deployable set must hold no feature that is not at hand at runtime. sets has a row for each set and feature.
    """
    oracle = F.array_sort(F.collect_list(F.when(~F.col("available_at_runtime"), F.col("name"))))  # a set's features: a few dozen
    credentials = F.array_sort(F.collect_set(F.nullif("credential", F.lit(""))))
    by = sets.groupBy("set_name").agg(
        F.count("*").alias("n"), F.bool_or("deployable").alias("deployable"), F.coalesce(F.max("latency_hours"), F.lit(0.0)).alias("max_latency_hours"),
        F.array_join(credentials, ",").alias("credentials"), F.count_if("requires_raster").alias("n_raster"), F.count_if(~F.col("verified")).alias("n_unverified"),
        F.array_join(oracle, ",").alias("oracle_features"),
    )
    return by.withColumn("valid", ~F.col("deployable") | (F.col("oracle_features") == ""))


def native_scale_m(resolution: Column) -> Column:
    """Metres at which a product is reduced, from what its resolution says; the first rule that fits."""
    said = F.lower(F.coalesce(resolution, F.lit("")))
    rules = [("1 km", 1000), ("1km", 1000), ("500 m", 500), ("375 m", 375), ("100 m", 100), ("30 m", 30), ("km", 7000)]  # Fixed values, in order.
    return F.coalesce(*[F.when(F.contains(said, F.lit(part)), F.lit(metres)) for part, metres in rules], F.lit(1000))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def inversion_strength(t_925hpa_k: Column, t_2m_k: Column) -> Column:
    """Above 0: warmer aloft than at the surface."""
    return t_925hpa_k - t_2m_k


def micrograms(kilograms: Column) -> Column:
    """From kg to µg per m³."""
    return kilograms * 1e9
