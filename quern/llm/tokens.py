"""Word hashes of whole texts, over Arrow batches, with numpy.

Texts are read as the UTF-8 bytes of a batch. A word is a run of bytes that a WordClass counts as word bytes; its hash is 64
bits of a polynomial over its (folded) bytes, the same on every executor. Slices bound the memory, not the text: a text
longer than a slice is a slice of its own and is hashed piece by piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 20  # bytes of text that are held as words at once
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 2 << 20  # bytes of a batch that goes to a Python worker, a longer row alone
PIECE = 1 << 18  # bytes that are held as 64-bit values at once

_ROOT = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of a splittable generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ROOT, PIECE), _powers(_INVERSE, PIECE)


@dataclass(frozen=True)
class WordClass:
    """word[b]: whether byte b belongs to words; value[b]: its value in hashes, 0 where it doesn't."""

    word: np.ndarray
    value: np.ndarray


def word_class(separators: bytes, lower: bool) -> WordClass:
    """All bytes but separators; lower folds A-Z."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    to = np.arange(256)
    if lower:
        to[65:91] += 32
        word[65:91] = word[97:123]
    return WordClass(word, np.where(word, _BYTE[to], np.uint64(0)))


SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: [^\x20\x09-\x0D]+ unchanged, the same lower-cased, and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ lower-cased.
RAW = word_class(SPACES, False)
LOWERED = word_class(SPACES, True)
TERMS = word_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), True)
#: Letters, digits and whatever is beyond ASCII, lower-cased.
ALNUM = word_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes too: 10,000 whole texts may be gigabytes."""
    now = str(df.sparkSession.conf.get(ARROW_BYTES, str(2**31 - 2))).rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        df.sparkSession.conf.set(ARROW_BYTES, str(BATCH))
    return df


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most so many bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system, as workers are kept for later tasks; where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, joined, and where each begins (and the last ends); null texts are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


@dataclass
class Words:
    """hashes by word; first[i]:first[i + 1] are text i's words; begin, end: each word's bytes."""

    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray


def words_of(column: pa.Array, kind: WordClass) -> Words:
    data, at = text_bytes(column)
    inside = kind.word[data]
    heads, tails = inside.copy(), inside.copy()
    heads[1:] &= ~inside[:-1]
    tails[:-1] &= ~inside[1:]
    cuts = np.unique(at[(at > 0) & (at < len(data))])  # no word reaches from one text into the next
    heads[cuts] = inside[cuts]
    tails[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    return Words(_hashes(data, begin, end, kind), np.searchsorted(begin, at), begin, end, data)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: WordClass) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(end, begin[i] + PIECE, "right"))
        if j <= i:  # one word is longer than a piece
            total, factor = np.uint64(0), 1
            for a in range(begin[i], end[i], PIECE):
                b = min(a + PIECE, end[i])
                with np.errstate(over="ignore"):
                    total += np.sum(kind.value[data[a:b]] * _UP[: b - a]) * np.uint64(factor)
                factor = factor * pow(_ROOT, PIECE, 1 << 64) % (1 << 64)
            out[i] = total
            i += 1
            continue
        a, b = begin[i], end[j - 1]
        values = kind.value[data[a:b]]
        values *= _UP[: b - a]
        out[i:j] = np.add.reduceat(values, begin[i:j] - a) * _DOWN[begin[i:j] - a]
        i = j
    return mix(out + (end - begin).astype(np.uint64))


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of each n consecutive hashes, whatever text they belong to; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.full(size, salt, np.uint64)
    for k in range(n):
        total *= np.uint64(_ROOT)
        total += hashes[k : k + size]
    return mix(total)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """As grams, in time that doesn't grow with n: for long windows."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(hashes) - n + 1, np.uint64)
    for a in range(0, len(out), PIECE // 2):
        b = min(a + PIECE // 2, len(out))
        sums = np.zeros(b - a + n, np.uint64)
        part = hashes[a : b + n - 1]
        up = _UP if len(part) <= PIECE else _powers(_ROOT, len(part))
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[a:b] = (sums[n:] - sums[: b - a]) * (_DOWN[: b - a])
    return mix(out + np.uint64(n))
