import math
import random

from pyspark.sql import functions as F

from quern.llm import top_k as K


def brute(rows, queries, k, scale=1024.0):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and sound(v)]
    out = []
    for i, v in ints:
        if i in queries:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 40)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    monkeypatch.setattr(K, "SEEDS", 30)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.uniform(-1, 1.5) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(100)]
    base = [rng.gauss(0, 1) for _ in range(6)]
    rows += [(700 + i, [x + rng.gauss(0, 0.02) for x in base]) for i in range(150)]
    rows += [(1000, None), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, [0.0] * 6), (1500, [2.0, 1.0]), (1501, [1.0, 1.0]), (None, [1.0] * 6), (1600, [])]
    rows += [(1700, [3e5] * 6), (1701, [-3e5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as norm")
    got = K.top_k(df, F.col("vec_id") % 100 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, {i for i, _ in rows if i is not None and i % 100 == 0}, 7)
    assert K.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_op8_on_the_tables(spark):
    from quern.llm.queries import op8_top_k

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op8_top_k(spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
