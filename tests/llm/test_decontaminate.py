import random

import pyarrow as pa

from quern.llm import decontaminate as D, tokens as K
from tests.llm import brute

ODD = [None, "", " ", "...", "A", "É é\x00b", "x" * 600_000, "a b " * 30_000, "a b"]


def test_words_are_those_of_the_pattern():
    texts = [*ODD, "one Two\ttwo\x0bONE", "tail", "é É"]
    for kind, find in ((K.TERMS, lambda t: brute.TERM.findall(brute.lower(t))), (K.LOWERED, lambda t: brute.WORD.findall(brute.lower(t))), (K.RAW, lambda t: brute.WORD.findall(t or ""))):
        w = K.words_of(pa.array(texts), kind)
        want = [x for t in texts for x in find(t)]
        assert [w.first[i + 1] - w.first[i] for i in range(len(texts))] == [len(find(t)) for t in texts]
        seen = {}
        for h, x in zip(w.hashes.tolist(), want, strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)
    h = K.words_of(pa.array(["a b c d " * 90_000]), K.RAW).hashes
    r = K.rolling(h, 35)
    assert len(r) == len(h) - 34 and len(set(r.tolist())) == 4 and (r[:4] == r[-4 - (len(r) % 4) : len(r) - (len(r) % 4)]).all()


def cases(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 13, 14, 30])))) for i in range(20)]
    items += [(20, items[4][1]), (21, None), (22, "..."), (None, items[5][1]), (None, items[2][1])]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        w = [word() for _ in range(rng.choice([3, 40, 300]))]
        if i % 3 == 0:
            w[2:2] = (rng.choice(items)[1] or "").split()
        docs.append((100 + i, " ".join(w).upper() if i % 2 else "-".join(w)))
    docs += [docs[-1], docs[-1], (None, "a b")]
    return docs, items


def test_contamination_against_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as id", "3 as shard")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item")
    want = sorted(brute.contamination(docs, items), key=repr)
    for chars in (10_000, 150):  # one block, and several that are merged
        found = D.search(D.written(D.build_index(d), "p"), b, block_chars=chars).collect()
        got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r.item_ids), brute.sha(",".join(sorted(map(str, r.item_ids))))) for r in found]
        assert sorted(got, key=repr) == sorted((w[:5] for w in want), key=repr)
    assert D.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in D.contamination(d, b.limit(0)).collect()} == {0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "the red cat sat"), (2, "the red big cat sat"), (3, "cat red the sat")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "the red cat sat")], "item_id long, text string")
    index = D.written(D.build_index(d), "p")
    hits = lambda slop: sorted(r.doc_id for r in D.search(index, b, slop=slop).collect() if r.item_ids)
    assert (hits(0), hits(1), hits(2)) == ([1], [1, 2], [1, 2])
    assert hits(4) == [1, 2, 3]


def test_op4_on_the_tables(spark):
    from quern.llm.queries import op4_decontamination

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op4_decontamination(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(brute.contamination(docs, items))
    assert any(r.contaminated for r in got)
