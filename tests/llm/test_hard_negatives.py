import math
import random

import pytest

pytest.importorskip("quern.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from quern.llm import hard_negatives as hn  # noqa: E402


def plain(rows, least=80, most=100, k=5):
    """Over (vec_id, embedding, label) rows; anchors: ids that 5 divides."""
    fit = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in fit:
        if i % 5 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in fit if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            near = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p]
            out += [(a, i, r + 1, s[1], -p, -s[0]) for r, s in enumerate(near[:k])]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell int, v string")
    done = hn.mine(df, F.col("vec_id") % 5 == 0, **how)
    return sorted(map(tuple, done.collect()))


def cloud(draw, n, dim, centres=6):
    at = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    as_float = lambda x: float.fromhex(float(x).hex()) if x is None else round(x * 64) / 64  # noqa: E731  exact in 32 bits
    return [(i, [as_float(x + draw.gauss(0, 0.3)) for x in draw.choice(at)], draw.randrange(3)) for i in range(n)]


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL", 20)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "ASKED", 7)
    monkeypatch.setattr(hn, "FIRST", 2)
    rows = cloud(random.Random(3), 400, 5)
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, least=95, most=130) == plain(rows, 95, 130)


def test_later_waves_leave_cells_out(spark, monkeypatch):
    """In two dimensions the tree spares most cells."""
    monkeypatch.setattr(hn, "CELL", 10)
    monkeypatch.setattr(hn, "FIRST", 2)
    rows = cloud(random.Random(4), 300, 2, 12)
    seen = []
    wave = hn.Index._wave
    monkeypatch.setattr(hn.Index, "_wave", lambda self, a, n, k, b: seen.append((self, a, n, b)) or wave(self, a, n, k, b))
    assert got(spark, rows) == plain(rows)
    cells = seen[0][0].sizes.count()
    assert cells > 20 and len(seen) == 4


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(0, v, 1), (None, v, 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 2), (4, [float("inf"), 1.0], 2), (5, v, None), (6, v, 1), (6, v, 1), (7, v, 2), (7, v, 2)]
    rows += [(10, [-1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0], 2), (15, [0.0, 0.0], 3), (16, [0.0, 0.0], 3), (17, [0.0, 0.0], 4), (20, [], 1), (21, [], 1), (22, [], 2), (25, [1.0, 2.0, 3.0], 1), (26, [1.0, 2.0, 3.0], 1), (27, [1.0, 2.0, 2.75], 2)]
    rows += [(100 + i, [0.75, 0.75], 2) for i in range(60)]  # a hot vector, ties by id
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:1]) == [] and got(spark, []) == []
    wide = [(i, [(i % 3 + j % 5) / 4 for j in range(3000)], i % 2) for i in range(12)]
    assert got(spark, wide) == plain(wide)
