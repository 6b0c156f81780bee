"""Benchmark decontamination with a positional inverted index that is distributed by documents.

build_index makes shards: each holds the postings of every token of some whole documents, ordered by term and position.
search sends the test windows to each shard. There a window's terms are taken from the rarest on: the first list, moved back
by its term's offset, gives the possible starts, and each further list keeps those at which its term stands too. A document
lies in one shard, so nothing is shuffled but the small results. Shards have a bounded number of text bytes (a longer text
is a shard of its own), so a hot source or a large group of copies only makes more shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quern.llm.store import written
from quern.llm.tokens import BATCH, TERMS, WordClass, slices, small_batches, words_of

BLOCK_CHARS = 1_000_000  # of test texts that go to a task at once

SPANS = "array<struct<start:int,end:int>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: WordClass = TERMS) -> DataFrame:
    """A row for each shard: ids array, first (word offsets of its documents), terms, term_starts, positions as packed integers.

    Null and empty texts have no words; null ids and repeated rows stay, each document for itself.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                words = words_of(part.column("text"), kind)
                order = np.argsort(words.hashes, kind="stable")
                terms = words.hashes[order]
                starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
                packed = [words.first.astype(np.int32), terms[starts], np.r_[starts, len(terms)].astype(np.int32), order.astype(np.int32)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["ids", "first", "terms", "term_starts", "positions"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(df.schema["id"].dataType))] + [T.StructField(n, T.BinaryType()) for n in ("first", "terms", "term_starts", "positions")])
    return small_batches(df).mapInArrow(shards, schema)


class Windows:
    """The windows of a block of test items: distinct sequences of term numbers, and the items that have each."""

    def __init__(self, items: list[tuple], window: int, kind: WordClass = TERMS):
        words = words_of(pa.array([text for _, text in items], pa.string()), kind)
        self.terms, numbers = np.unique(words.hashes, return_inverse=True)
        found: dict[tuple[int, ...], set] = {}
        for i, (item, _) in enumerate(items):
            own = numbers[words.first[i] : words.first[i + 1]].tolist()
            for a in range(max(1, len(own) - window + 1)) if own else ():
                found.setdefault(tuple(own[a : a + window]), set()).add(item)
        self.sequences, self.items = [np.array(x) for x in found], [sorted(y for y in x if y is not None) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.flat = np.concatenate(self.sequences) if found else np.zeros(0, np.int64)

    def search(self, first: np.ndarray, terms: np.ndarray, term_starts: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of a window, begins, ends) for each window that occurs within one document of the shard."""
        if not len(terms) or not self.sequences:
            return
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        here = terms[at] == self.terms
        low, high = np.where(here, term_starts[at], 0), np.where(here, term_starts[at + 1], 0)
        size = high - low
        heads = np.r_[0, np.cumsum(self.lengths)[:-1]]
        for w in np.flatnonzero(np.minimum.reduceat(size[self.flat], heads) > 0):
            own = self.sequences[w]
            by_rarity = np.argsort(size[own], kind="stable")
            starts = None
            for k in by_rarity:
                listed = positions[low[own[k]] : high[own[k]]]
                if starts is None:
                    starts = listed - np.int32(k)
                    doc = np.searchsorted(first, listed, "right")
                    begin, end = first[doc - 1], first[doc]
                else:  # a posting of the same document, near its place
                    near = np.searchsorted(listed, np.maximum(starts + np.int32(k - slop), begin))
                    kept = (near < len(listed)) & (listed[np.minimum(near, len(listed) - 1)] <= np.minimum(starts + np.int32(k + slop), end - 1))
                    starts, begin, end = starts[kept], begin[kept], end[kept]
                if not len(starts):
                    break
            if len(starts):
                yield int(w), np.maximum(starts, begin), np.minimum(starts + np.int32(len(own)), end)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def merge_spans(spans: Column) -> Column:
    """Disjoint spans that cover the same words, from sorted ones; the JVM's counterpart of merged()."""
    return F.aggregate(
        spans,
        F.array().cast(SPANS),
        lambda out, s: F.when(
            (F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.array_append(out, s)),
    )


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, kind: WordClass = TERMS) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for each document of the index.

    spans: disjoint ranges of words that lie in an occurrence of a window; item_ids: sorted, of items with such windows. With
    slop, a term may stand up to so many words from its place (proximity). An item with fewer words than window is one
    window; one without words or text has none; the windows of one without id count, but give no id. Test texts go to the
    tasks in blocks of about block_chars, each against all shards; the blocks' results are merged by document. An empty index
    gives no rows, an empty benchmark no spans; other columns are not carried; texts may have any length.
    """
    spark = index.sparkSession
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    item_type = tests.schema["item"].dataType
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T._parse_datatype_string(SPANS)), T.StructField("item_ids", T.ArrayType(item_type)),
    ])
    keyed = index.withColumn("shard", F.monotonically_increasing_id())  # the index is stored, so each block sees the same numbers

    def one(block: int) -> DataFrame:
        own = Windows([tuple(r) for r in tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()], window, kind)
        sent = spark.sparkContext.broadcast(own)  # at most about block_chars of text

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            out = to_arrow_schema(schema)
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column("ids")[row].values
                    first, term_starts, positions = (np.frombuffer(batch.column(n)[row].as_buffer(), np.int32) for n in ("first", "term_starts", "positions"))
                    terms = np.frombuffer(batch.column("terms")[row].as_buffer(), np.uint64)
                    spans: dict[int, list[tuple[int, int]]] = {}
                    items: dict[int, set] = {}
                    for w, begins, ends in sent.value.search(first, terms, term_starts, positions, slop):
                        for doc, a, b in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
                            spans.setdefault(doc, []).append((a - int(first[doc]), b - int(first[doc])))
                            items.setdefault(doc, set()).update(sent.value.items[w])
                    n, shard = len(ids), batch.column("shard")[row].as_py()
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{shard}:{i}" for i in range(n)] if blocks > 1 else [None] * n, out.field(0).type), ids.cast(out.field(1).type), pa.array(np.diff(first).astype(np.int64)),
                        pa.array([merged(spans.get(i, [])) for i in range(n)], out.field(3).type), pa.array([sorted(items.get(i, ())) for i in range(n)], out.field(4).type),
                    ], names=out.names)

        return small_batches(keyed).mapInArrow(answers, schema)

    if blocks == 1:
        return one(0).drop("key")
    found = one(0)
    for block in range(1, blocks):
        found = found.unionByName(one(block))
    by_key = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return by_key.select("doc_id", "n_words", merge_spans(F.col("spans")).alias("spans"), "item_ids")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """search() over a stored index, with n_hit (words in spans) and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    index = written(build_index(docs, id_col, text_col), "postings")
    found = search(index, benchmark, window).withColumn("n_hit", n_hit(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
