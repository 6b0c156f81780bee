import hashlib
import re

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as P  # noqa: E402

from quern.llm import pieces, pii, toxicity  # noqa: E402
from quern.llm.queries import held_out, table  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    start = [tuple(r) for r in docs.collect()]
    step = dict(P.STAGES)
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, toxicity.fit(docs, table(spark, SF, "labels"), ~held_out())).collect()}
    clean = P.written(step["toxicity"](spark, docs, SF), "t")
    now = [r for r in start if not scores[r[0]]]
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(now)

    single = P.written(step["near_duplicates"](spark, clean, SF), "n")
    now = [r for r, (doc, _, component) in zip(now, brute.jaccard_components([r[:2] for r in now]), strict=True) if doc == component]
    assert single.columns == docs.columns and sorted(map(tuple, single.collect())) == sorted(now)

    fair = P.written(step["decontamination"](spark, single, SF), "d")
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    now = [r for r, c in zip(now, brute.contamination([r[:2] for r in now], items), strict=True) if not c[-1]]
    assert fair.columns == docs.columns and sorted(map(tuple, fair.collect())) == sorted(now)

    private = P.written(step["pii"](spark, fair, SF), "p")
    assert private.columns == docs.columns
    by = {r.doc_id: r for r in private.collect()}
    assert len(by) == len(now)
    for doc, text, lang, source, n in now:
        keys = [(m.start(1), 4, m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', text or "")]
        spans = sorted(brute.personal(text) + keys)
        out, at = "", 0
        for a, kind, b in spans:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, b)
        assert by[doc].text == out + text[at:] and by[doc].n_chars == (len(by[doc].text) if spans else n)

    codec = pieces.Codec(pieces.Vocabulary.load(P.PIECES))
    for r in step["tokens"](spark, private, SF).collect():
        want = codec.encode(by[r.doc_id].text)
        assert r.ids == np.frombuffer(want, np.int32).tolist() and r.ids_sha256 == hashlib.sha256(want).hexdigest() and r.round_trip


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, text, None, None, None), (5, text, None, None, None), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _k string, spans string")
    for rows, n in ((docs, 4), (docs.limit(0), 0)):
        at = rows
        for name, stage in P.STAGES:
            at = P.written(stage(spark, at, SF), name)
        assert at.count() == n


def test_different_texts_under_one_id(spark):
    words = lambda a: " ".join(f"w{a}x{i}" for i in range(30))
    rows = [(1, words(1)), (2, words(1) + " end"), (2, words(2)), (3, words(3)), (3, words(4)), (3, words(4)), (None, None), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in dict(P.STAGES)["near_duplicates"](spark, docs, SF).collect()]
    want = [rows[0], *rows[2:5], *rows[6:]]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_long_texts_and_names(spark):
    long = " ".join(f"w{i % 3000}" for i in range(300_000)) + " "
    rows = [(1, long, "en", "s", 1), (2, long + "x", "en", "s", 1), (3, "mail a@b.org", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int")
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), name)
    got = {r.doc_id: (r.n_chars, r.round_trip) for r in docs.collect()}
    assert got == {1: (1, True), 3: (len("mail [EMAIL]"), True)}
