from collections import Counter

import pytest

pytest.importorskip("quern.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from quern.llm import language, queries  # noqa: E402

SF = "/root/testdata/sf0.01"


def counted(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "").split()
    s = " " + " ".join(low) + " " if low else ""
    grams = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    return {g: k for g, k in grams.items() if g.strip() and not (len(g) == 3 and g[1] == " ")}


def first(counts, ranks):
    """n-grams by count; of equals, by their symbols, shorter ones after longer ones."""
    key = lambda g: [0x1FFFFF] * (3 - len(g)) + [0 if c == " " else ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], key(g)))[:ranks]


def plain(rows, learn, ranks=language.RANKS):
    """{id: (lang_pred, score)} of (id, text, lang) rows."""
    by = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and learn(i):
            by.setdefault(lang, Counter()).update(counted(text))
    profiles = {lang: {g: r for r, g in enumerate(first(c, ranks))} for lang, c in sorted(by.items()) if c}
    out = []
    for i, text, _ in rows:
        mine = first(counted(text), ranks)
        if not mine or not profiles:
            out.append((i, "und", 0.0))
            continue
        away = {lang: sum(abs(p[g] - r) if g in p else ranks for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(away, key=lambda x: (away[x], x))
        out.append((i, best, 1 - away[best] / (ranks * len(mine))))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-12)


def test_odd_rows(spark):
    rows = [(1, "The cat sat on the mat and the hat", "en"), (2, "Der Hund und die Katze sind müde", "de"), (2, "Der Hund und die Katze sind müde", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !?", "en"), (None, "the hat", "en"), (7, "die Katze", None), (8, "İstanbul ǅ 日本語 кошка", "xx"), (9, "the cat " * 120_000, "en")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, n string, code int")
    for ranks in (language.RANKS, 7):
        found = language.identify(df, language.fit(df, F.lit(True), ranks=ranks))
        same([tuple(r) for r in found.collect()], plain(rows, lambda i: True, ranks))
    none = language.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"} and language.identify(df.limit(0), none).count() == 0


def test_most_bounds_the_sample(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "concat('word', id) as text", "'en' as lang")
    whole, some = language.fit(df, F.lit(True)), language.fit(df, F.lit(True), most=100)
    assert len(some.codes) <= len(whole.codes) and some.languages == ["en"]


def test_op12_against_plain_profiles_and_held_out(spark):
    import zlib

    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    got = queries.op12_language_id(spark, SF).collect()
    same([(r.doc_id, r.lang_pred, r.score) for r in got], plain(rows, learn))
    assert all(r.held_out != learn(r.doc_id) for r in got)
    said = {i: lang for i, _, lang in rows}
    judged = [r.lang_pred == said[r.doc_id] for r in got if r.held_out and said[r.doc_id] is not None]
    assert sum(judged) / len(judged) > 0.97
