import random

from quern.llm import jaccard as J
from quern.llm.store import seen_in
from tests.llm import brute

ODD = [None, "", " \n", "one", "ONE", "one two three", "one Two three", "a b c d e", "x " * 40_000, "y" * 400_000]


def cases(seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiourst") for _ in range(3)) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, docs = words(30), []
    for base in range(12):
        origin = words(rng.choice([8, 30, 120, 250]))
        for _ in range(rng.choice([1, 3, 25])):
            own = list(origin)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(" ".join(own))
    chain = words(60)
    for i in range(10):  # each alike to the next, the ends not
        docs.append(" ".join(chain))
        chain[i * 6] = rng.choice(vocabulary)
    docs += [" ".join(words(20) + passage + words(10)) for _ in range(30)]
    docs = [d.upper() if rng.random() < 0.2 else d for d in docs]
    rng.shuffle(docs)
    return list(enumerate([*docs, *ODD, docs[0]], 10))


def test_against_brute_force(spark):
    for seed in (6, 7):
        docs = cases(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as key").repartition(5)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_components(df).collect())
        assert got == sorted(brute.jaccard_components(docs))


def test_groups_across_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = cases(9)[:90]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.near_components(df).collect())
        assert got == sorted(brute.jaccard_components(docs))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nulls_and_empty_table(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (5, text), (3, text), (3, text), (None, "q"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.near_components(df).collect()), key=repr)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (3, 3), (None, None), (None, None)], key=repr)
    assert J.near_components(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (-5, 200), (200, -5)]
    got = {r.node: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), -5: -5, 200: -5}


def test_op9_on_the_tables(spark):
    from quern.llm.queries import op9_jaccard_join

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op9_jaccard_join(spark, sf).collect())
    assert got == sorted(brute.jaccard_components(docs))


def test_rows_are_counted_while_they_are_written(spark):
    """Each query leaves plans, classes and threads in the driver: counts of written tables have none of their own."""
    context = spark.sparkContext
    docs = spark.createDataFrame(cases(9)[:60], "doc_id long, text string")
    context.setJobGroup("near", "near")
    try:
        J.near_components(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("near")) <= 106  # 118 with queries for the counts
    few, none = J.counted(spark.range(7), "few"), J.counted(spark.range(7).where("id > 9"), "none")
    assert J.small(few).count() == 7 and seen_in(few) == {"rows": 7} and seen_in(none) == {"rows": 0}
