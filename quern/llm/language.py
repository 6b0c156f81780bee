"""Language by rank-order profiles: a document's most frequent n-grams against those of each language.

Texts are read as letters, lower-cased, with one separator for whatever stands between them. Their n-grams of one to three
symbols, none with a separator inside, are counted over the whole text. A profile is the list of a language's most frequent
n-grams, by rank. A document goes to the language whose profile its own list is least out of place in: the sum, over the
document's n-grams, of how far their rank is from their rank there, and of the full length for those that aren't there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.store import written
from quern.llm.tokens import slices, small_batches

RANKS = 400  # n-grams of a profile
MOST = 20_000  # documents of a language that give its profile
SALTS = 64
PIECE = 1 << 18  # characters that are held as n-grams at once
_BITS = np.uint64(21)  # of a code point; three fit into 64
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """By code point: the letter in lower case, 0 for other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a text's n-grams, codes ascending; a code is the n-gram's symbols, 21 bits each, filled with ones before.

    Words are set off by separators, which belong to n-grams as first or last symbol.
    """
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = np.zeros(1, np.uint32)  # a separator, or the last two symbols before a piece
    for i in range(0, max(len(text), 1), PIECE):
        new = symbols(text[i : i + PIECE])
        done = len(kept)
        s = np.concatenate([kept, new, np.zeros(1 if i + PIECE >= len(text) else 0, np.uint32)])
        s = s[np.flatnonzero(np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)]))]  # one separator for each run of them
        w, end = s.astype(np.uint64), len(s)
        first = min(done, end)
        one = w[first:][w[first:] != 0]
        two_at, three_at = max(first - 1, 0), max(first - 2, 0)
        a, b = w[two_at : end - 1], w[two_at + 1 :]
        two = ((a << _BITS) | b)[(a != 0) | (b != 0)]
        x, y, z = w[three_at : max(end - 2, three_at)], w[three_at + 1 : max(end - 1, three_at + 1)], w[three_at + 2 :]
        three = ((x << (_BITS + _BITS)) | (y << _BITS) | z)[(y != 0)]
        # A code tells its length: n-grams of one and two symbols have 1s in front, which no code point has.
        fill = np.uint64((1 << 21) - 1)
        some = np.concatenate([one | (fill << (_BITS + _BITS)) | (fill << _BITS), two | (fill << (_BITS + _BITS)), three])
        got, n = np.unique(some, return_counts=True)
        if len(codes):
            codes, at = np.unique(np.concatenate([codes, got]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        else:
            codes, counts = got, n
        kept = s[-2:]
    return codes, counts


def most_frequent(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The codes with the highest counts, in that order; of equals the smaller first."""
    if len(codes) > ranks:
        floor = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        kept = counts >= floor
        codes, counts = codes[kept], counts[kept]
    return codes[np.argsort(-counts, kind="stable")][:ranks]


@dataclass(frozen=True)
class Profiles:
    """Languages, and each known n-gram's rank in each of them (`ranks` where a language has it not)."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray
    ranks: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, code, n), added up over a slice of texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS, most: int = MOST) -> Profiles:
    """Profiles from the whole texts of labelled documents for which `learn` holds.

    Of a language with more than `most` documents, a share of about so many is taken by a hash of id and text; of others, all.
    Rows with a null language, a null text or a text without letters teach nothing; repeated rows count each. The number of
    languages is that of the labels: their profiles are held by the driver and sent to the tasks (3 KB for each).
    """
    rows = docs.where(learn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    sizes = docs.where(learn).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) * F.col("count") < F.lit(most) * F.lit(1 << 32)
    taken = rows.join(F.broadcast(sizes), "lang").where((F.col("count") <= most) | drawn)
    counted = small_batches(taken.select("lang", "text")).mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The first of each language in two steps, so that no task holds all n-grams of one. Codes are compared as unsigned numbers.
    order = [F.desc("n"), (F.col("code") < 0), F.col("code")]
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= ranks)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < ranks)
    got = written(first.select("lang", "code", "rank"), "language-profiles").toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    codes, at = np.unique(got["code"].to_numpy().view(np.uint64), return_inverse=True)
    places = np.full((len(codes), len(languages)), ranks, np.int32)
    if languages:
        places[at, np.searchsorted(languages, got["lang"].to_pylist())] = got["rank"].to_numpy()
    return Profiles(languages, codes, places, ranks)


def judged(text: str | None, p: Profiles) -> tuple[str, float]:
    """The language that a text is least out of place in (of equals the first by name), and how near it is, 0 to 1."""
    mine = most_frequent(*grams(text), p.ranks) if text else np.zeros(0, np.uint64)
    if not len(mine):
        return UNKNOWN, 0.0
    if not p.languages:
        return UNKNOWN, 0.0
    at = np.minimum(np.searchsorted(p.codes, mine), len(p.codes) - 1)
    there = np.where((p.codes[at] == mine)[:, None], p.places[at], p.ranks)
    rank = np.arange(len(mine))[:, None]
    away = np.where(there < p.ranks, np.abs(there - rank), p.ranks).sum(axis=0)
    best = int(np.argmin(away))
    return p.languages[best], float(1 - away[best] / (p.ranks * len(mine)))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row, by its whole text; one pass, no shuffle.

    lang_pred is a learned language, `und` for texts that are null or have no letter, or where nothing was learned; score is 1
    less the share of the greatest possible distance, 0 for `und`. Repeated rows are judged each; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [judged(t, sent.value) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
