"""Substring dedup by recompression: words covered by a passage that also stands elsewhere are removed.

Rounds of naming turn a text's words into symbols: first runs of one word get a name, then, in each further round, pairs of a
symbol from one half of the alphabet and a next one from the other half. Names are hashes of what they stand for and the
halves a bit of them, so each round names alike on all executors. Equal passages get equal symbols inside; a symbol carries
the range of words that decided it, so it is known which symbols any equal window must have too.

Each window of consecutive words is filed under its anchor: the longest symbol that the window alone decides (the window
itself, if there is none). Spark counts anchors; only windows under an anchor that occurs again are compared. Neighbouring
windows under one anchor make a segment; segments are compared by hash, and the windows of those that stay single one by
one. So long repeats are settled by a few high-level symbols and every word at their edges by exact windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.store import written
from quern.llm.tokens import RAW, Words, mix, rolling, slices, small_batches, words_of

ROUNDS = 4
LONGEST = 64  # windows of a segment
MOST_BITS = 1 << 26  # of the filter of repeated anchors: 8 MB at most
OUTSIDE = np.int32(1 << 30)
PACKED = np.dtype([("win", "<u8"), ("win2", "<u4")])

_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_HALVES = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


class Symbols:
    """names; start, end: a symbol's words; low, high: the words that decide it (beyond the text, if its ends do)."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        head = np.zeros(n + 1, bool)
        head[words.first] = True  # the first word of a text
        self.head = head
        self.names = words.hashes
        self.start = np.arange(n, dtype=np.int32)
        self.end = self.start + np.int32(1)
        self.low, self.high = self.start, self.end

    def runs(self) -> None:
        """Name each run of one word; whether it is one depends on both neighbours."""
        n = len(self.names)
        if not n:
            return
        first = np.flatnonzero(np.r_[True, (self.names[1:] != self.names[:-1]) | self.head[1:n]])
        size = np.diff(np.r_[first, n])
        names = self.names[first]
        self.names = np.where(size > 1, mix(names * _FIRST + size.astype(np.uint64) * _SECOND), names)
        self.start = first.astype(np.int32)
        self.end = (first + size).astype(np.int32)
        self.low = np.where(self.head[self.start], -OUTSIDE, self.start - np.int32(1))
        self.high = np.where(self.head[self.end], OUTSIDE, self.end + np.int32(1))

    def pairs(self, turn: int) -> None:
        """Name each pair of a left-half and a right-half symbol. A symbol that stays alone does so because of one neighbour."""
        n = len(self.names)
        if not n:
            return
        right = (self.names * _HALVES[turn]) >> np.uint64(63) == 1
        begins, ends = self.head[self.start], self.head[self.end]
        joined = np.zeros(n, bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~ends[:-1]
        second = np.r_[False, joined[:-1]]
        # What decides: the partner; or the right neighbour of a left-half symbol, the left one of a right-half symbol.
        other = np.clip(np.arange(n) + np.where(right, -1, 1), 0, n - 1)
        low, high = np.minimum(self.low, self.low[other]), np.maximum(self.high, self.high[other])
        low = np.where(right & begins, -OUTSIDE, np.where(~right & ends, self.low, low))
        high = np.where(~right & ends, OUTSIDE, np.where(right & begins, self.high, high))
        at = np.flatnonzero(joined)
        names, end = self.names.copy(), self.end.copy()
        names[at] = mix(self.names[at] * _FIRST + self.names[at + 1] * _SECOND + np.uint64(turn))
        end[at] = self.end[at + 1]
        kept = ~second
        self.names, self.start, self.end, self.low, self.high = names[kept], self.start[kept], end[kept], low[kept], high[kept]


def _highest(values: np.ndarray, width: int) -> np.ndarray:
    """[i]: the highest of values[i : i + width]."""
    done = 1
    while done < width:
        step = min(done, width - done)
        out = values.copy()
        np.maximum(out[:-step], values[step:], out=out[:-step])
        values, done = out, done + step
    return values


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, hash, 32 further bits) of the window that starts at each word; meaningless where it would reach beyond its text."""
    n = len(words.hashes)
    hashes = np.zeros(n, np.uint64)
    own = rolling(words.hashes, window)
    hashes[: len(own)] = own
    others = np.zeros(n, np.uint32)
    others[: len(own)] = rolling(mix(words.hashes ^ _SECOND), window) >> np.uint64(32)
    symbols = Symbols(words)
    symbols.runs()
    for turn in range(ROUNDS):
        symbols.pairs(turn)
    # Symbols by the size of what decides them: one of at most `size` words lies in each window that starts up to
    # window - size words before it.
    extent = symbols.high.astype(np.int64) - symbols.low
    length = np.minimum(symbols.end - symbols.start, 255).astype(np.uint64)
    value = (length << np.uint64(56)) | (symbols.names >> np.uint64(8))
    found, smaller = np.zeros(n, np.uint64), 0
    for size in sorted({window * k // 8 for k in range(2, 9)}):
        mine = np.flatnonzero((extent > smaller) & (extent <= size) & (symbols.low >= 0))
        smaller = size
        if len(mine):
            at = np.zeros(n, np.uint64)
            np.maximum.at(at, symbols.low[mine], value[mine])
            np.maximum(found, _highest(at, window - size + 1), out=found)
    return np.where(found == 0, hashes >> np.uint64(8), found), hashes, others


def segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, hash, 2 if a window repeats inside else 1) by segment, and the windows' hashes, of 96 bits."""
    anchor, hashes, others = anchors(words, window)
    n = len(hashes)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    real = np.arange(n) + window <= words.first[1:][text] if n else np.zeros(0, bool)
    at = np.flatnonzero(real)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6 + (hashes, others)
    new = np.r_[True, (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])]
    place = np.arange(len(at))
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    first = np.flatnonzero(since % LONGEST == 0)
    size = np.diff(np.r_[first, len(at)])
    weight = (hashes[at] ^ others[at].astype(np.uint64)) * (_FIRST + (since % LONGEST).astype(np.uint64) * _SECOND * np.uint64(2))
    whole = mix(np.add.reduceat(weight, first) + size.astype(np.uint64))
    start = at[first]
    return text[start], start - words.first[text[start]], size, anchor[start], whole, np.where(_inner(hashes[at], first, size), 2, 1), hashes, others


def _inner(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a hash comes twice in first[i] : first[i] + size[i]."""
    owner = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((hashes, owner))
    twice = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(first), bool)
    out[owner[order][1:][twice]] = True
    return out


def _segments(texts: DataFrame, window: int, bitmap: np.ndarray | None, hashes: bool) -> DataFrame:
    """(anchor, seg, weight, tkey, pos, n[, hashes]) of all segments, or of those whose anchor is in the bitmap.

    hashes: each segment's windows as packed integers of 64 and 32 bits. Without the bitmap, anchors and weights only.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)
    fields = "anchor long, weight int" if bitmap is None else "anchor long, seg long, tkey binary, pos int, n int" + ", hashes binary" * hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                text, pos, size, anchor, whole, weight, all_hashes, all_others = segments(words := words_of(part.column("text"), RAW), window)
                if filled is None:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(weight.astype(np.int32))], names=["anchor", "weight"])
                    continue
                bit = anchor.astype(np.int64) & (len(filled) * 64 - 1)
                kept = np.flatnonzero(filled[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                keys = part.column("tkey").take(pa.array(text[kept]))
                names = ["anchor", "seg", "tkey", "pos", "n"]
                cols = [pa.array(anchor[kept].astype(np.int64)), pa.array(whole[kept].astype(np.int64)), keys, pa.array(pos[kept].astype(np.int32)), pa.array(size[kept].astype(np.int32))]
                if hashes:
                    begin = words.first[text[kept]] + pos[kept]
                    sizes = size[kept]
                    index = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(kept) else np.zeros(0, np.int64)
                    ends = np.r_[0, np.cumsum(sizes) * PACKED.itemsize].astype(np.int32)
                    packed = np.empty(len(index), PACKED)
                    packed["win"], packed["win2"] = all_hashes[index], all_others[index]
                    cols.append(pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())]))
                    names.append("hashes")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return small_batches(texts).mapInArrow(run, fields)


def _windows(segs: DataFrame) -> DataFrame:
    """(anchor, seg, c, i, win, win2): a row for each window of each distinct segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                packed = [x.as_buffer() for x in part.column("hashes")]
                sizes = np.array([x.size // PACKED.itemsize for x in packed])
                win = np.frombuffer(b"".join(packed), PACKED)
                i = np.arange(len(win)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                cols = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("anchor", "seg", "c")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(i.astype(np.int32)), pa.array(win["win"].astype(np.int64)), pa.array(win["win2"].astype(np.int32))], names=["anchor", "seg", "c", "i", "win", "win2"])

    return segs.select("anchor", "seg", "c", "hashes").mapInArrow(run, "anchor long, seg long, c long, i int, win long, win2 int")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key (its low bits); of a size that follows the number of keys up to MOST_BITS."""
    bits = min(MOST_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    out, found = np.zeros(bits // 64, np.uint64), words.toArrow()
    out[found["w"].to_numpy()] = found["x"].to_numpy().astype(np.uint64)
    return out


def repeated(texts: DataFrame, window: int) -> DataFrame:
    """(tkey, spans array<struct<pos,n>>): windows pos .. pos + n - 1 that also start elsewhere, by text key."""
    again = _segments(texts, window, None, False).groupBy("anchor").agg(F.sum("weight").alias("c")).where("c > 1").select("anchor")
    bitmap = _bitmap(written(again, "anchors"))
    segs = _segments(texts, window, bitmap, True).groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.first("hashes").alias("hashes"))
    segs = written(segs, "segments")
    windows = _windows(segs)
    twice = windows.groupBy("win", "win2").agg(F.sum(F.least("c", F.lit(2))).alias("c")).where("c > 1").select("win", "win2")
    edges = windows.where("c = 1").join(twice, ["win", "win2"]).select("anchor", "seg", F.col("i").alias("pos0"), F.lit(1).alias("n0"))
    parts = edges.groupBy("anchor", "seg").agg(F.sort_array(F.collect_list(F.struct("pos0", "n0"))).alias("parts"))  # at most LONGEST
    whole = segs.where("c > 1").select("anchor", "seg", F.lit(None).cast("array<struct<pos0:int,n0:int>>").alias("parts"))
    flagged = written(whole.unionByName(parts), "flagged")
    places = _segments(texts, window, bitmap, False).select("anchor", "seg", "tkey", "pos", "n").distinct().join(flagged, ["anchor", "seg"])
    spans = F.coalesce(F.transform("parts", lambda p: F.struct((F.col("pos") + p["pos0"]).alias("pos"), p["n0"].alias("n"))), F.array(F.struct("pos", "n")))
    return places.select("tkey", spans.alias("spans")).groupBy("tkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) for every row.

    A word (a run of other characters than white space) is removed if a window of so many consecutive words that covers it
    also starts anywhere else, in the same text too. kept: the words that stay, joined by single spaces. Null and empty
    texts, and texts of fewer words than the window, keep all they have. Copies remove each other, repeated rows too; null
    ids stay; an empty table gives an empty one. Other columns are not carried. Windows are compared by 96 bits, texts by 128.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("tkey"))  # 128 bits
    found = written(repeated(df.select("tkey", "text"), window), "repeats")
    schema = T.StructType([df.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), RAW)
                spans, data = part.column("spans"), words.data.tobytes()
                gone, digests, texts = [], [], []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    begin, end = words.begin[a:b], words.end[a:b]
                    out = np.zeros(b - a + 1, np.int64)
                    if spans[i].is_valid and b > a:
                        own = spans[i].values
                        pos, n = own.field("pos").to_numpy().astype(np.int64), own.field("n").to_numpy()
                        np.add.at(out, pos, 1)
                        np.add.at(out, pos + n + window - 1, -1)
                    stays = np.flatnonzero(np.cumsum(out)[:-1] == 0)
                    kept = b" ".join([data[x:y] for x, y in zip(begin[stays].tolist(), end[stays].tolist(), strict=True)])
                    gone.append(b - a - len(stays))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if keep_text else None)
                cols = [part.column(id_col), pa.array(np.diff(words.first)), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * keep_text, names=schema.names)

    return df.join(found, "tkey", "left").select(id_col, "text", "spans").mapInArrow(run, schema)
