"""Numbers as text, templates filled with them, and a check of highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: How many highlights there may be, their length, and acronyms that they shouldn't hold.
LEAST_BULLETS, MOST_BULLETS, MOST_CHARS = 3, 5, 85
ACRONYMS = ["RMSE", "MAE", "SHAP", "CAMS", "LOCO", "LSO", "AOD", "DM test", "R²"]
PLACE = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"
MOST_NAMES = 100_000


def fixed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def signed(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", value.cast("double"))


def percent(share: Column, digits: int = 1) -> Column:
    """A share of 1 as per cent."""
    return F.format_string(f"%.{digits}f%%", 100 * share.cast("double"))


def thousands(value: Column) -> Column:
    return F.format_string("%,d", value.cast("long"))


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value) of a table of texts: `<column>_<keys>` for each column and row; numbers have to be texts by now."""
    values = [c for c in rows.columns if c not in keys]
    each = F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit(c), *keys).alias("key"), F.col(c).alias("value")) for c in values]))
    return rows.select(each.alias("e")).select("e.key", "e.value")


def fill(templates: DataFrame, numbers: DataFrame, text_col: str = "text") -> DataFrame:
    """templates with `filled`: each {{name}} replaced by its value. A name without a value is an error, not an empty place.

    numbers (key, value) is the small table of a report; its size is checked.
    """
    n = numbers.count()
    if n > MOST_NAMES:
        raise ValueError(f"{n} names are more than a report has")
    known = F.broadcast(numbers.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_known")))  # one row of at most MOST_NAMES
    names = F.regexp_extract_all(text_col, F.lit(PLACE), 1)
    between = F.split(F.col(text_col), PLACE, -1)
    missing = F.array_distinct(F.filter(names, lambda k: F.try_element_at("_known", k).isNull()))
    parts = F.zip_with(between, F.transform(names, lambda k: F.try_element_at("_known", k)), lambda t, v: F.concat(t, F.coalesce(v, F.lit(""))))
    whole = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("no value for "), F.array_join(missing, ", ")))).otherwise(F.array_join(parts, ""))
    return templates.crossJoin(known).withColumn("filled", whole).drop("_known")


def lint(bullets: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, n_bullets, n_over, n_acronyms, ok) of highlights, a row for each bullet; a word is an acronym in capitals alone."""
    bad = F.greatest(*[F.col(text_col).rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{a}\E(?![\p{{L}}\p{{N}}_])").cast("int") for a in ACRONYMS])
    by = bullets.groupBy(key).agg(F.count("*").alias("n_bullets"), F.count_if(F.length(text_col) > MOST_CHARS).alias("n_over"), F.coalesce(F.sum(bad), F.lit(0)).alias("n_acronyms"))
    return by.withColumn("ok", F.col("n_bullets").between(LEAST_BULLETS, MOST_BULLETS) & (F.col("n_over") == 0) & (F.col("n_acronyms") == 0))
