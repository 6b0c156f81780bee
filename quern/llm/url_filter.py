"""URL filter: domain and path rules first, gradient-boosted trees on lexical features for the rest.

Everything stays in DataFrame expressions and Spark ML's JVM transformers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.store import written

BROADCAST_SUFFIXES = 200_000  # rows of a suffix table; a longer one is joined by shuffle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEXICAL = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio",
    "hyphens", "host_hyphens", "entropy", "host_entropy", "params", "query_length", "suffix2_rate", "suffix3_rate",
]


@dataclass(frozen=True)
class Rule:
    """host with its subdomains, and paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or no '://'."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; empty for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls. The rules are a parameter, so one CASE holds them."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; 0 for the empty string."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")),
        F.lit(0.0),
        lambda total, c: total - share(c) * F.log2(share(c)),
    )


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical columns; the suffix columns come from suffix_rates."""
    u, host, path = F.coalesce(F.col(url), F.lit("")), host_of(F.col(url)), path_of(F.col(url))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    digits = lambda text: (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.greatest(F.length(text), F.lit(1))
    return df.withColumns(
        {
            "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": count(path, "/"), "labels": count(host, ".") + F.when(host == "", 0.0).otherwise(1.0),
            "digit_ratio": digits(u), "host_digit_ratio": digits(host), "hyphens": count(u, "-"), "host_hyphens": count(host, "-"),
            "entropy": entropy(u), "host_entropy": entropy(host),
            "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0), "query_length": F.length(query).cast("double"),
            "suffix2": last_labels(host, 2), "suffix3": last_labels(host, 3),
        }
    )


SMOOTH = 8.0  # URLs of the overall share that each suffix has besides its own


def rate(ones: Column, n: Column, prior: float) -> Column:
    return (ones + SMOOTH * prior) / (n + SMOOTH)


def suffix_counts(labelled: DataFrame, column: str, *by: str) -> DataFrame:
    """(column, *by, ones, n): URLs of label 1 and all URLs by suffix."""
    return labelled.groupBy(column, *by).agg(F.sum("label").alias("ones"), F.count("label").alias("n"))


def suffix_rates(labelled: DataFrame, column: str, prior: float) -> DataFrame:
    """Share of label 1 by suffix, drawn towards the overall share. At most as many rows as labelled has."""
    return suffix_counts(labelled, column).select(column, rate(F.col("ones"), F.col("n"), prior).alias(f"{column}_rate"))


def rates_of_others(rows: DataFrame, labelled: DataFrame, column: str, prior: float) -> DataFrame:
    """rows with column_rate from the suffix's URLs on other hosts, so that trees can't learn a host's label by its name."""
    whole = suffix_counts(labelled, column)
    own = suffix_counts(labelled, column, "host").withColumnsRenamed({"ones": "_ones", "n": "_n"})
    joined = rows.join(whole, column, "left").join(own, [column, "host"], "left")
    rest = lambda c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))
    return joined.withColumn(f"{column}_rate", F.coalesce(rate(rest("ones"), rest("n"), prior), F.lit(prior))).drop("ones", "n", "_ones", "_n")


@dataclass
class UrlModel:
    """A fitted filter. constant is the answer where the labels had a single class or no rows."""

    pipeline: PipelineModel | None
    rates: dict[str, DataFrame]
    prior: float
    constant: str = "allow"
    sizes: dict[str, int] = field(default_factory=dict)

    def with_features(self, df: DataFrame) -> DataFrame:
        for column, rates in self.rates.items():
            few = self.sizes.get(column, 0) <= BROADCAST_SUFFIXES
            df = df.join(F.broadcast(rates) if few else rates, column, "left").fillna({f"{column}_rate": self.prior})
        return df


def fit(labelled: DataFrame, max_labelled: int = 4000, iterations: int = 12, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on labelled (url, label 0/1; 1 means block).

    Suffix statistics, the prior and whether there are two classes come from all distinct URLs (1 wins over 0). Only the trees
    are fitted on at most max_labelled of them, of each label the first in the order of their hash, weighted by the label's
    share of all. While they are fitted, a URL's suffixes are judged by other hosts' URLs. Null URLs or labels take no part;
    repeated rows count once; an empty table gives a model that allows all.
    """
    known = labelled.select("url", F.col("label").cast("double").alias("label")).where(F.col("url").isNotNull() & F.col("label").isNotNull())
    host = host_of(F.col("url"))
    known = known.groupBy("url").agg(F.max("label").alias("label"))
    known = written(known.withColumns({"host": host, "suffix2": last_labels(host, 2), "suffix3": last_labels(host, 3)}), "labelled-urls")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    ones = int(ones)
    prior = ones / n if n else 0.0
    if ones in (0, n):
        return UrlModel(None, {}, prior, "block" if n and ones else "allow")
    rates = {c: written(suffix_rates(known, c, prior), "suffix-rates") for c in ("suffix2", "suffix3")}
    sizes = {c: r.count() for c, r in rates.items()}
    # Half of the bound for each label; what one doesn't need goes to the other.
    zeros, half = n - ones, max(1, max_labelled // 2)
    takes = {1.0: min(ones, max(half, max_labelled - zeros)), 0.0: min(zeros, max(half, max_labelled - ones))}
    total = sum(takes.values())
    parts = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(take).withColumn("weight", F.lit(have / take * total / n))
        for (label, take), have in zip(takes.items(), (ones, zeros), strict=True)
    ]
    rows = written(lexical_features(parts[0].unionByName(parts[1]).select("url", "label", "weight")).withColumn("host", host).coalesce(1), "tree-sample")
    model = UrlModel(None, rates, prior, sizes=sizes)
    assembler = VectorAssembler(inputCols=LEXICAL, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=iterations, maxDepth=depth, maxBins=32, seed=seed, minInstancesPerNode=5)
    ready = rows
    for c in rates:
        ready = rates_of_others(ready, known, c, prior)
    model.pipeline = PipelineModel([assembler, trees.fit(assembler.transform(ready).select("features", "label", "weight"))])
    return model


def held_out_scores(labelled: DataFrame, folds: int = 5, **how) -> DataFrame:
    """(n, n_block, n_said, precision, recall) on the hosts of one fold, by the hash of the host, of a model fitted on the other hosts."""
    known = labelled.select("url", "label").where(F.col("url").isNotNull() & F.col("label").isNotNull())
    out = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(folds)) == 0
    judged = filter_urls(known.where(out).withColumn("page_id", F.struct("url", "label")), [], fit(known.where(~out), **how))
    said, true = F.col("verdict") == "block", F.col("page_id.label") > 0
    both = F.count_if(said & true)
    return judged.agg(F.count("*").alias("n"), F.count_if(true).alias("n_block"), F.count_if(said).alias("n_said"), (both / F.nullif(F.count_if(said), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if(true), F.lit(0))).alias("recall"))


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row: (id_col, host, path, rule, verdict, block_score).

    A rule that fits decides; the longest wins. Else the trees do. Null and empty URLs have empty host and path and are
    judged by the trees like any other; repeated rows are judged each; an empty table gives an empty one; other input columns
    are not carried.
    """
    df = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    df = lexical_features(df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
    rule, fixed = rule_for(F.col("host"), F.col("path"), rules)
    if model.pipeline is None:
        learned, score = F.lit(model.constant), F.lit(model.prior)
    else:
        from pyspark.ml.functions import vector_to_array

        df = model.pipeline.transform(model.with_features(df))
        learned, score = F.when(F.col("prediction") >= 0.5, "block").otherwise("allow"), vector_to_array("probability")[1]
    return df.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(fixed, learned).alias("verdict"), score.alias("block_score"))
