import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import tokens as K, toxicity as X


def test_marginals_equal_those_of_all_taggings():
    text = ["bad x x bad y", "x y", "", "y bad bad"]
    words = K.words_of(pa.array(text), K.TERMS)
    bad = K.words_of(pa.array(["bad"]), K.TERMS).hashes
    model = X.Field(X.Table(bad, np.array([2.0])), -1.0, np.array([[0.1, -0.4], [-0.2, 0.7]]))
    at, w = model.events(words)
    got = dict(zip(at.tolist(), model.marginals(words, at, w).tolist(), strict=True))
    for d, t in enumerate(text):
        own = t.split()
        total, ones = 0.0, np.zeros(len(own))
        for tags in np.ndindex(*[2] * len(own)):
            path = [0, *tags, 0]
            s = sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            s += sum((-1.0 + 2.0 * (x == "bad")) * y for x, y in zip(own, tags, strict=True))
            total += np.exp(s)
            ones += np.exp(s) * np.array(tags)
        for i, x in enumerate(own):
            if x == "bad":
                assert abs(got[words.first[d] + i] - ones[i] / total) < 1e-9


def test_learns_and_gives_offsets(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if y := i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["Scum", "moron", "Édiot"]) + rng.choice(["", "ly", "s"]))
        rows.append((i, " ".join(w), int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = X.fit(df, df.select("doc_id", "toxic"), learn, least=4)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "..."), (903, "x" * 500_000), (None, "scum moron scum"), (904, "é scum, moron é")], "doc_id long, text string")
    out = X.score_documents(df.select("doc_id", "text", F.lit(1).alias("score")).unionByName(odd.withColumn("score", F.lit(1))), model).collect()
    by = {r.doc_id: r for r in out}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(by[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    assert len(out) == len(rows) + 6 and all(0 <= r.score <= 1 for r in out)
    assert by[900].score == by[901].score == by[902].score < 0.5
    found = [(s.start, s.end) for s in by[904].spans]
    assert found == [(2, 13)] or found == [(2, 6), (8, 13)]
    assert X.score_documents(df.limit(0), model).count() == 0
    one = X.fit(df, df.select("doc_id", "toxic").where("toxic = 0"), learn)
    assert {r.score for r in X.score_documents(df.limit(5), one).collect()} == {0.0}
    assert X.fit(df.limit(0), df.select("doc_id", "toxic").limit(0), learn).field is None


def test_op1_on_the_tables(spark):
    from quern.llm.queries import op1_toxicity

    sf = "/root/testdata/sf0.1"
    got = op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    ranks = sorted((r.score, r.toxic) for r in got)
    ones = [i for i, (_, y) in enumerate(ranks) if y]
    auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(ranks) - len(ones)))
    print(f"held out: {len(got)} rows, {right:.4f} right, AUC {auc:.4f}")
    assert right > 0.97 and auc > 0.95


def test_score_fit_stays_sane_on_separable_rows_of_any_weight():
    rng = np.random.default_rng(0)
    y = (np.arange(400) < 200).astype(float)
    x = np.c_[np.ones(400), rng.normal(0, 0.1, 400) + 2 * y, rng.normal(5, 1, 400)]
    for share in (np.ones(400), np.where(y == 1, 7.0, 60.0), np.where(y == 1, 7e5, 6e6)):
        p = 1 / (1 + np.exp(-(x @ X._logistic(x, y, share))))
        assert ((p >= 0.5) == y).all()
