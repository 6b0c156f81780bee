import random

import sentencepiece

from quern.llm import pieces as P

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [
    "", " ", "  a", "a  b ", "The quick brown fox.", "é▁x ▁", "\U0001f600\U0001f600 日本語 \x00\n\t", "naïve café", "zzzzqqqq" * 20,
    " ".join(["word"] * 300), "a" * 5000, "1 2 3 " * 40, "\r\n\n", "x" * 47 + " " + "y" * 60,
]


def fields(data):
    """(number, wire type, value, whole bytes) of a serialized message's fields."""
    i = 0

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        begin = i
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 2:
            n = varint()
            value = data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value = data[i : i + n]
            i += n
        yield key >> 3, key & 7, value, data[begin:i]


def message(number, body):
    n, size = len(body), b""
    while True:
        size += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return bytes([number << 3 | 2]) + size + body


def as_unigram():
    """The library's own Viterbi over the same pieces: the model with its type field set to unigram."""
    out = b""
    for number, _, value, whole in fields(open(PATH, "rb").read()):
        if number == 2:
            whole = message(2, b"".join(w for n, _, _, w in fields(value) if n != 3) + bytes([3 << 3, 1]))
        out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_same_ids_as_the_librarys_viterbi():
    codec, other = P.Codec(P.Vocabulary.load(PATH)), as_unigram()
    rng = random.Random(1)
    texts = [t for t in TEXTS if "▁" not in t and len(t) < 400] + ["".join(rng.choice("aeinst hr.É9") for _ in range(60)) for _ in range(300)]
    import numpy as np

    for t in texts:
        assert np.frombuffer(codec.encode(t), np.int32).tolist() == other.encode(t), t


def test_round_trip(spark):
    v = P.Vocabulary.load(PATH)
    rows = [(i, t, i) for i, t in enumerate([*TEXTS, None, TEXTS[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int")
    out = {r.doc_id: r for r in P.decode(P.encode(df, v), v).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        assert out[i].decoded == t and (out[i].ids is None) == (t is None)
    assert out[0].ids == []
    checked = {r.doc_id: r for r in P.encode(df, v, others=("decoded",), checked=True).collect()}
    assert all(checked[i].ids == out[i].ids and checked[i].round_trip and checked[i].decoded == i for i, _, _ in rows) and "text" not in P.encode(df, v, checked=True).columns
    assert P.decode(P.encode(df.limit(0), v), v).count() == 0


def test_units_do_not_change_the_result():
    codec = P.Codec(P.Vocabulary.load(PATH))
    for t in TEXTS[:12]:
        assert codec.encode(t) == (codec.split(" " + t) if t else b"")


def test_op10_on_the_tables(spark):
    from quern.llm.queries import op10_sentencepiece

    out = op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and all(r.round_trip for r in out)
