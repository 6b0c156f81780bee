import hashlib
import random
import zlib

import pytest

pytest.importorskip("quern.llm.queries")
from quern.llm import merkle, queries  # noqa: E402

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def climb(nodes):
    """The root of nodes, and for each its siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            a = k // 16 * 16
            paths[i].append((k - a, nodes[a:k], nodes[k + 1 : a + 16]))
        nodes, at = [H(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars) rows."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text, lang, source, n: H("".join(map(part, (d, source, lang, n, text))))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        shown = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), shown))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in groups}
    root, tops = climb([trees[s][0] for s in groups])
    out = []
    for s, top in zip(groups, tops, strict=True):
        for (known, d, own, shown), path in zip(sorted(by[s]), trees[s][1], strict=True):
            at = shown
            for _, left, right in path + top:
                at = H(*left, at, *right)
            proof = H(*[x for _, left, right in path + top for x in left + right])
            out.append((d if known else None, own, trees[s][0], root, proof, at, at == root))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", g string")
    from pyspark.sql import functions as F

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    done = merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.when(queries.held_out(), lowered)})
    return sorted(map(tuple, done.collect()), key=repr)


def test_sizes_around_runs_and_blocks(spark):
    draw = random.Random(1)
    rows, d = [], 0
    for s, n in enumerate([1, 2, 15, 16, 17, 255, 256, 257, 273, 600, 1]):
        for _ in range(n):
            rows.append((d, draw.choice(["Some Text", "low", "", "é Ü"]) + str(d), "en", f"s{s}", d))
            d += 1
    draw.shuffle(rows)
    assert got(spark, rows) == sorted(plain(rows), key=repr)


def test_more_leaves_than_two_passes_hold(spark):
    rows = [(i, None, None, "big" if i % 70 else "small", i) for i in range(67_000)]
    docs = spark.range(67_000, numPartitions=7).selectExpr("id as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "if(id % 70 > 0, 'big', 'small') as source", "id as n_chars")
    done = merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"])
    want = {(r[0], *r[1:5]) for r in plain(rows)}
    seen = [tuple(r) for r in done.collect()]
    assert {r[:5] for r in seen} == want and len(seen) == len(rows) and all(r[6] and r[5] == r[3] for r in seen)


def test_odd_rows(spark):
    long = "Word " * 400_000
    rows = [(None, None, None, None, None), (None, "A", None, None, None), (3, "", "en", "", 0), (3, "", "en", "", 0), (5, "Same", "en", "é", 1), (5, "Same", "en", "é", 1), (5, "Other", None, "z", None), (7, long, "en", "z", 1), (-4, "x", "en", "z", 1), (10**15, "Q", "en", "é", 2)]
    rows += [(12, "Copy", "en", "hot", 4)] * 300
    assert got(spark, rows) == sorted(plain(rows), key=repr)
    assert got(spark, []) == []
    assert got(spark, rows[-1:]) == plain(rows[-1:])


def test_op11_against_plain_trees(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    done = [tuple(r) for r in queries.op11_merkle_manifest(spark, "/root/testdata/sf0.01").collect()]
    assert sorted(done) == sorted(plain([tuple(r) for r in docs.collect()]))
    assert {r[-1] for r in done} == {True, False}
