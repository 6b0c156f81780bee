import random

import numpy as np
import pyarrow as pa

from quern.llm import recompress as R, tokens as K
from tests.llm import brute


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiouRST") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [words(n) for n in (34, 35, 36, 50, 90, 200)] + [["a"] * 50, ["a", "b"] * 40]
    texts = []
    for _ in range(60):
        own = words(rng.choice([5, 40, 150, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(shared)
        texts.append(own)
    texts += [texts[0], texts[1][:-1], texts[2][3:], ["x"] * 34, ["y"] * 35, ["z"] * 36, ["z"] * 20 + words(30), ["q"] * 300, ["p"] * 70 + words(40) + ["p"] * 90]
    base = words(300)
    for _ in range(8):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = rng.choice(vocabulary)
        texts.append(copy)
    gaps = [" ", "\n", "  ", "\t\x0b", "\x0c\r"]
    docs = [rng.choice(gaps) + "".join(w + rng.choice(gaps) for w in t) for t in texts]
    return list(enumerate([*docs, None, "", " ", "é" * 300_000, "é\x00 a"]))


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = cases(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as tkey", "2 as spans").repartition(5)
        got = sorted(tuple(r) for r in R.dedup_substrings(df).collect())
        assert got == sorted(brute.substrings(docs))
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "b c d")], "doc_id long, text string")
    got = R.dedup_substrings(df, window=2, keep_text=True).collect()
    assert sorted((r.kept, r.n_removed) for r in got) == [("", 3), ("", 3), ("d", 2)]
    assert R.dedup_substrings(df.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    shared = " ".join(map(str, rng.integers(0, 9, 80)))
    texts = [" ".join(map(str, rng.integers(0, 9, n))) + " " + shared + " " + " ".join(map(str, rng.integers(0, 9, m))) for n, m in rng.integers(0, 90, (40, 2))]
    words = K.words_of(pa.array(texts), K.RAW)
    anchor, hashes, _ = R.anchors(words, 35)
    seen = {}
    for i in range(len(texts)):
        for w in range(words.first[i], words.first[i + 1] - 34):
            assert seen.setdefault(hashes[w], anchor[w]) == anchor[w]
    assert len(seen) < len(hashes) - 40 * 40


def test_op6_on_the_tables(spark):
    from quern.llm.queries import op6_substring_dedup

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op6_substring_dedup(spark, sf).collect()) == sorted(brute.substrings(docs))
