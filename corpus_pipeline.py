"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go; of each group of near duplicates one document stays; contaminated documents go; personal data is replaced
by its kind; what is left is encoded. Documents whose doc_id is null stay in play: they are told apart by their text.

For all stages: an empty table gives an empty one; texts may have any length; columns other than those of documents, whatever
their names, are not carried. Each stage keeps rows with null columns unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm import decontaminate, jaccard, pieces, pii, toxicity
from quern.llm.queries import PIECES, held_out, table
from quern.llm.store import clear, mark, seen_in, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SENT = 1_000_000  # keys that are broadcast; more are joined by shuffle


def without(docs: DataFrame, key: Column, gone: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """The documents whose key isn't among gone's (column k)."""
    gone = written(gone.distinct(), "gone", rows=F.count(F.lit(1)))
    gone = F.broadcast(gone) if seen_in(gone)["rows"] <= SENT else gone
    return docs.withColumn("_k", key).join(gone, F.col("_k") == F.col("k"), "left_anti").select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on the labels, doesn't reject.

    Texts decide, so null and empty ones stay and repeated rows go or stay together. Without labels of both kinds among these
    documents the model says what the labels say: with none, nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score_documents(docs, model, others=tuple(COLUMNS[1:]), with_spans=False)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id.

    Rows with one id and the same text, but for empty ones, are one document; different texts under one id are judged each.
    Documents without words have no duplicates and stay. Null ids come after all others, in the order of their texts' hash.
    """
    known = F.coalesce("doc_id", F.lit(2**62) + F.pmod(F.xxhash64("text"), F.lit(2**62)))
    n, ids = docs.select(known.alias("k")).groupBy("k").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if n == ids:
        return without(docs, known, _near(docs.select(known.alias("doc_id"), "text")))
    # Ids repeat: rows are told apart by id and text; numbers in the order of the ids stand for both.
    said = {"_id": known, "_hash": F.coalesce(F.md5("text"), F.lit("")), "_size": F.coalesce(F.length("text"), F.lit(-1))}
    keyed = docs.withColumns(said)
    numbers = written(keyed.groupBy(*said).agg(F.min("text").alias("text")).orderBy(*said).withColumn("_row", F.monotonically_increasing_id()), "numbers")
    gone = _near(numbers.select(F.col("_row").alias("doc_id"), "text"))
    kept = written(without(keyed.join(numbers.drop("text"), list(said)), F.col("_row"), gone, (*COLUMNS, "_row")), "kept")
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return kept.where(~empty).dropDuplicates(["_row"]).select(*COLUMNS).unionByName(kept.where(empty).select(*COLUMNS))


def _near(docs: DataFrame) -> DataFrame:
    """k of the documents that aren't the first of their component."""
    return jaccard.near_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("k"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't made of benchmark passages to a twentieth or more; texts decide, so their digests are the keys.

    Documents without words stay; repeated rows go or stay together.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, key, found.where("contaminated").select(F.col("doc_id").alias("k")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows where a text changes. Null and empty texts stay."""
    found = pii.find(docs, trusted=pii.patterns(docs), others=("lang", "source", "n_chars"))
    found = found.withColumns({"text": pii.redacted(F.col("text"), F.col("spans")), "changed": F.size("spans") > 0})
    return found.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, checked by decoding them. A null text has null ids, an empty one none."""
    vocabulary = pieces.Vocabulary.load(PIECES)
    done = pieces.encode(docs, vocabulary, others=("lang", "source", "n_chars"), checked=True)
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("tokens", encode),
]

ORACLE_SQL = None  # fitted models and automata aren't SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written; what a stage wrote besides its result is deleted when it is done."""
    docs, begin = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, begin, docs)
    return docs
