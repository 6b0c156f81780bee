"""Records of published works: abstracts from word positions, merging of records of one work, and how much of a work there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import jaccard, title_tokens

FIELDS = ["title", "year", "doi", "venue", "abstract", "pmcid", "arxiv", "oa_pdf"]


def text_of_positions(index: Column) -> Column:
    """The text of a map from words to their positions; null for a null or empty one."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " "), F.lit(""))


def same_work(a: Column, b: Column, share: float = 0.85) -> Column:
    """Titles of one work: their words are alike in both directions; false without words."""
    return F.coalesce(jaccard(title_tokens(a), title_tokens(b)) >= share, F.lit(False))


def merge_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, *FIELDS, apis, merge_conflicts): the records of a work, in order; the first one is the spine.

    A later record fills what the spine lacks, but only if both have the same DOI, or not both have one and their titles are of
    the same work; else it is named among the conflicts. Empty texts count as missing. A work has a few records.
    """
    clean = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS]
    rows = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("source_api").alias("api"), *clean))).alias("_r"))
    first = F.get("_r", F.lit(0))
    begin = F.struct(*[first[c].alias(c) for c in FIELDS], F.array(first["api"]).alias("apis"), F.array().cast("array<string>").alias("conflicts"))

    def step(s: Column, r: Column) -> Column:
        same_doi = F.coalesce(F.lower(r["doi"]) == F.lower(s["doi"]), F.lit(False))
        fits = same_doi | ((r["doi"].isNull() | s["doi"].isNull()) & same_work(s["title"], r["title"]))
        told = F.concat(r["api"], F.lit(":"), F.substring(F.coalesce(r["title"], F.lit("?")), 1, 40))
        return F.struct(
            *[F.when(fits, F.coalesce(s[c], r[c])).otherwise(s[c]).alias(c) for c in FIELDS],
            F.when(fits, F.array_append(s["apis"], r["api"])).otherwise(s["apis"]).alias("apis"),
            F.when(fits, s["conflicts"]).otherwise(F.array_append(s["conflicts"], told)).alias("conflicts"),
        )

    merged = F.aggregate(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), begin, step)
    out = rows.select(key, merged.alias("m"))
    return out.select(key, *[F.col(f"m.{c}").alias(c) for c in FIELDS], F.array_join("m.apis", ",").alias("apis"), F.array_join("m.conflicts", "; ").alias("merge_conflicts"))


def depth() -> Column:
    """FULL, ABSTRACT, SNIPPET or UNRESOLVED, by what a record has."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.when(has("pmcid") | has("arxiv") | has("oa_pdf"), "FULL").when(has("abstract"), "ABSTRACT").when(has("title"), "SNIPPET").otherwise("UNRESOLVED")


def depth_counts(records: DataFrame) -> DataFrame:
    """(depth, n, n_doi, usable): usable are those with an abstract or more."""
    by = records.groupBy(depth().alias("depth")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("doi") != "", F.lit(False))).alias("n_doi"))
    return by.withColumn("usable", F.col("depth").isin("FULL", "ABSTRACT"))


def authors_short(authors: Column) -> Column:
    """One name, up to three joined, else the first one et al.; empty without names."""
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "").when(F.size(authors) <= 3, F.array_join(authors, ", ")).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
