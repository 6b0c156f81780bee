"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reads a text once. At each position it gives the pieces that end there, longest first, by following output
links; each relaxes the best score of that position. A character that is no piece costs the worst score less 10 and is
written as byte pieces. Spaces are written into pieces as the marker U+2581; one stands before the text. A literal U+2581 is
written as bytes, so that decoding always gives the text back.

Where no piece has a space after another character, the best split of a text is made of the best splits of its units (a run
of spaces and what follows up to the next space). Units are then split once and remembered in a bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quern.llm.tokens import slices, small_batches

MARK = "▁"
PENALTY = 10.0
REMEMBERED = 100_000  # units of at most LONG characters
LONG = 48


@dataclass(frozen=True)
class Vocabulary:
    """texts: each id's text with spaces for markers, or None for control and byte pieces; byte_ids[b]: byte b's id."""

    texts: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file with byte pieces, on the driver; its size is the vocabulary's."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = lambda i: not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        at = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
        if len(at) < 256:
            raise ValueError("the model has no byte pieces, so not every text can be decoded")
        return cls(tuple(sp.id_to_piece(i).replace(MARK, " ") if plain(i) else None for i in ids), tuple(sp.get_score(i) for i in ids), tuple(at[f"<0x{b:02X}>"] for b in range(256)))


class Codec:
    """Built once in each worker process."""

    _built: dict[Vocabulary, Codec] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Codec:
        if vocabulary not in cls._built:
            cls._built[vocabulary] = cls(vocabulary)
        return cls._built[vocabulary]

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        kept = [(t, i) for i, t in enumerate(vocabulary.texts) if t]
        self.single = {t for t, _ in kept if len(t) == 1}
        self.unknown = min(vocabulary.scores[i] for _, i in kept) - PENALTY
        self.units = None if any(" " in t.lstrip(" ") for t, _ in kept) else re.compile(" +[^ ]*|[^ ]+")
        self.memory: dict[str, bytes] = {}

    @cached_property
    def automaton(self):
        """Over the pieces; decoding needs none."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i, text in enumerate(self.v.texts):
            if text:
                out.add_word(text, (i, len(text), self.v.scores[i]))
        out.make_automaton()
        return out

    def split(self, text: str) -> bytes:
        """The best split's ids, as packed 32-bit integers."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        at, single, unknown = 0, self.single, self.unknown

        def skip(to: int) -> None:
            """Relax every position up to `to` by a character that is no piece."""
            nonlocal at
            while at < to:
                if text[at] not in single and best[at] + unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + unknown, (at, -1)
                at += 1

        for last, (piece, size, score) in self.automaton.iter(text):
            if last > at:
                skip(last)
            start, end = last + 1 - size, last + 1
            if (new := best[start] + score) > best[end]:
                best[end], back[end] = new, (start, piece)
        skip(n)
        ids: list[int] = []
        while n:
            start, piece = back[n]
            if piece < 0:
                ids += [self.v.byte_ids[b] for b in reversed(text[start:n].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(piece)
            n = start
        return np.array(ids[::-1], np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = " " + text
        if self.units is None:
            return self.split(text)
        out, memory = [], self.memory
        for unit in self.units.findall(text):
            ids = memory.get(unit)
            if ids is None:
                ids = self.split(unit)
                if len(unit) <= LONG:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[unit] = ids
            out.append(ids)
        return b"".join(out)

    @cached_property
    def written(self) -> list[bytes]:
        out = [(t or "").encode() for t in self.v.texts]
        for b, i in enumerate(self.v.byte_ids):
            out[i] = bytes([b])
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _added(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(column, kind)])


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), checked: bool = False) -> DataFrame:
    """(id_col, text_col, *others, ids array<int>, ids_sha256): ids of every whole text.

    checked: instead of the text, round_trip says whether the ids, decoded in the same pass, give the text (true for null).

    ids_sha256 is the hex digest of the ids as little-endian 32-bit integers. A null text has null ids and digest, an empty
    one no ids. Repeated rows are encoded each; an empty table gives an empty one; columns that others doesn't list are not
    carried.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col), *others)
    kept = [f for f in df.schema.fields if not checked or f.name != text_col or f.name == id_col]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType())])
    if checked:
        schema = schema.add("round_trip", T.BooleanType())
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                packed = [None if t is None else codec.encode(t) for t in texts]
                ends = np.r_[0, np.cumsum([len(p or b"") // 4 for p in packed])].astype(np.int32)
                nulls = pa.array([p is None for p in packed])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32)), mask=nulls)
                digests = pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in packed], pa.string())
                out = [*[part.column(f.name) for f in kept], ids, digests]
                if checked:
                    out.append(pa.array([p is None or codec.decode(np.frombuffer(p, np.int32).tolist()) == t for t, p in zip(texts, packed, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return small_batches(df).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with a column `to`: the text that the ids stand for; null for null ids. Ids outside the vocabulary are an error."""
    schema = _added(encoded, to, T.StringType())
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(sent.value)
        for batch in batches:
            batch = batch.select([n for n in batch.schema.names if n != to])
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if not x.is_valid else codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to])

    return small_batches(encoded).mapInArrow(run, schema)
