"""Tokens, title matching and clean-up of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words that don't count in titles, what stands before place names, and texts that mean a missing value.
STOPWORDS = ["a", "an", "and", "the", "of", "for", "in", "on", "to", "with", "using", "from", "its", "at", "by", "or", "as", "is", "are", "be"]
PREFIXES = ["US Diplomatic Post:", "US Embassy", "US Consulate", "StateAir"]
MISSING = ["n/a", "na", "n.a.", "none", "null", "nil", "unknown", "-", "--", "?"]


def title_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def recall(query: Column, title: Column) -> Column:
    """Share of the query's tokens that the title has."""
    return F.size(F.array_intersect(query, title)) / F.nullif(F.size(query), F.lit(0))


def recall_join(queries: DataFrame, titles: DataFrame, query_id: str, title_id: str, share: float) -> DataFrame:
    """(query_id, title_id, share) of all pairs where the query has share or more of the title's tokens; both have `tokens`.

    An inverted index: a query with share of n tokens has one of any n - ceil(share * n) + 1 of them, so a title is filed under so
    many of its rarest tokens only, with their places in the order from rare to common. The first token that a pair shares in
    that order leaves no more common ones than follow it on either side: pairs for which that is too few are dropped in the
    join, and so are queries shorter than a title needs. Each pair left is verified once. Rows without tokens match nothing.
    """
    counts = titles.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def placed(rows: DataFrame, key: str, size: str, rank: str) -> DataFrame:
        own = Window.partitionBy(key)
        flat = rows.select(key, F.explode("tokens").alias("t")).join(counts, "t")
        return flat.withColumns({size: F.count("*").over(own), rank: F.row_number().over(own.orderBy("n", "t"))}).drop("n")

    need = F.ceil(share * F.col("_size") - 1e-9)
    prefix = placed(titles, title_id, "_size", "_rank").where(F.col("_rank") <= F.col("_size") - need + 1)
    follow = F.least(F.col("_size") - F.col("_rank"), F.col("_qsize") - F.col("_qrank")) + 1
    pairs = placed(queries, query_id, "_qsize", "_qrank").join(prefix, "t").where(follow >= need).select(query_id, title_id).distinct()
    both = pairs.join(queries.select(query_id, F.col("tokens").alias("q")), query_id).join(titles.select(title_id, F.col("tokens").alias("d")), title_id)
    return both.select(query_id, title_id, recall(F.col("d"), F.col("q")).alias("share")).where(F.col("share") >= share)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def city_of(locality: Column, name: Column) -> Column:
    """The locality, or the name without known prefixes (whatever their case); null if what is left means a missing value."""
    out = F.trim(name)
    for p in PREFIXES:
        out = F.when(F.startswith(F.lower(out), F.lit(p.lower())), F.trim(F.ltrim(F.substring(out, len(p) + 1, 2**30), F.lit(": ")))).otherwise(out)
    label = F.when(~is_missing(name) & ~is_missing(out), out)
    return F.when(is_missing(locality), label).otherwise(F.trim(locality))


def is_missing(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | F.lower(F.trim(text)).isin(MISSING)
