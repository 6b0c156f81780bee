"""Exact top-k inner products with norm buckets.

Vectors are grouped by length, each group cut into blocks of bounded size. A query first meets the longest vectors, which
gives a floor under its k-th best score. It is then sent only to blocks of groups whose longest vector could reach the
floor. In a group, floor / (|query| * longest) is the least cosine that can matter: if it is high, candidates are pruned by
the query's largest coordinates, else by length alone. What is left is verified by exact integer products, and the blocks'
best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192  # vectors of a block
QUERY_BLOCK = 16_384  # queries that meet a block in one task
TOGETHER = 64  # queries whose products with a block are one product of matrices
SEEDS = 2048  # longest vectors that give the floors
SEED_VALUES = 1 << 20  # and their components in all
STEPS = 4  # length groups for each doubling
COSINE = 0.5  # least local cosine at which coordinates prune
FOCUS = 3  # coordinates that prune
SLACK = 1 + 1e-9


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v, norm, dim, bucket): floor(scale * x) by component. Null vectors and null or non-finite components drop out."""
    sound = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    v = df.where(F.col(vector_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = v.where("id is not null").withColumns({"norm": norm, "dim": F.size("v")})
    return v.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(F.lit(-1)).cast("int"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where they hold every partial sum. Beyond a long they are cut to its range."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= floor)
        return kept[np.lexsort((ids[kept], np.negative(scores[kept])))][:k]
    return np.lexsort((ids, np.negative(scores)))[:k]


def candidates(q: np.ndarray, length: float, floor: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places in a block (longest first) that can reach the floor."""
    if floor <= 0 or length == 0:
        return np.arange(len(norms))
    n = int(np.searchsorted(-norms, -floor / (length * SLACK), "right"))  # shorter ones can't
    if not n:
        return np.zeros(0, np.int64)
    local = floor / (length * norms[0] * SLACK)
    if local < COSINE:
        return np.arange(n)
    direction = q / length
    kept = np.ones(n, bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:  # a cosine of local or more bounds each coordinate
        spread = np.sqrt(max(0.0, (1 - local**2) * (1 - direction[f] ** 2))) + 1e-9
        kept &= np.abs(unit[:n, f] - local * direction[f]) <= spread + (1 - local) * abs(direction[f])
    return np.flatnonzero(kept)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer products over all rows but its own id's.

    All, if there are fewer; ties go to the smaller id. Rows with a null id, a null vector, or a null or non-finite component
    take no part. Vectors meet only those of their own number of components. Of several query rows with one id the one with
    the smallest vector counts; repeated candidate rows count each. An empty table, or none of queries, gives no rows; columns
    besides the two and what is_query needs are not read. Scores beyond 64 bits are cut to the range of a long.
    """
    spark = vectors.sparkSession
    marked = vectors.select(F.col(id_col).alias("id_"), F.col(vector_col).alias("v_"), is_query.alias("q_"))
    rows = integer_vectors(marked, "id_", "v_", scale)
    queries = integer_vectors(marked.where("q_"), "id_", "v_", scale).groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("v", "norm", "dim")).alias("m")).select("qid", "m.*")
    groups = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    groups = groups.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # A row for each length group: a few for each doubling of the lengths and each number of components.
    small = F.broadcast if groups.count() <= 50_000 else (lambda df: df)
    widest = rows.agg(F.max("dim")).first()[0] or 1
    seeds = rows.orderBy(F.desc("norm"), "id").limit(max(k + 1, min(SEEDS, SEED_VALUES // widest))).select("id", "v", "dim").toArrow()
    sent = spark.sparkContext.broadcast({d.as_py(): (t["id"].to_numpy(), matrix(t["v"])) for d in seeds["dim"].unique() if d.as_py() for t in [seeds.filter(pa.compute.equal(seeds["dim"], d))]})  # at most SEED_VALUES components

    def floors(batches):
        for batch in batches:
            out = []
            for qid, v, dim in zip(batch["qid"].to_pylist(), batch["v"].to_pylist(), batch["dim"].to_pylist(), strict=True):
                ids, long_ones = sent.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                scores = products(np.array([v], np.int64).reshape(1, dim), long_ones)[0][ids != qid]
                out.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "floor"])

    queries = queries.mapInArrow(floors, "qid long, v array<long>, norm double, dim int, floor double")
    n_queries = marked.where("q_").count()
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    reach = F.col("floor").isNull() | (F.col("floor") <= 0) | (F.col("norm") * F.col("longest") * SLACK >= F.col("floor"))
    asked = queries.join(small(groups), "dim").where(reach).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    asked = asked.select(F.col("dim").alias("a1"), F.col("bucket").alias("a2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a3"), F.col("part").alias("a4"), "qid", "v", "norm", "floor")
    # Vectors go to the query blocks that ask for their group, and to no others.
    wanted = asked.select(F.col("a1").alias("dim"), F.col("a2").alias("bucket"), F.col("a4").alias("part")).distinct().groupBy("dim", "bucket").agg(F.collect_list("part").alias("parts"))
    dealt = rows.join(small(groups.select("dim", "bucket", "blocks").join(wanted, ["dim", "bucket"])), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("blocks")).cast("int"))
    dealt = dealt.select(F.col("dim").alias("b1"), F.col("bucket").alias("b2"), F.col("block").alias("b3"), F.explode("parts").alias("b4"), "id", "v", "norm")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            order = np.argsort(-right["norm"].to_numpy(), kind="stable")
            norms, ids, c = right["norm"].to_numpy()[order], right["id"].to_numpy()[order], matrix(right["v"])[order]
            unit = c / np.maximum(norms, 1e-300)[:, None]
            for a in range(0, len(left), TOGETHER):
                part = left.slice(a, TOGETHER)
                q, qids, floors = matrix(part["v"]), part["qid"].to_pylist(), part["floor"].to_pylist()
                near = [candidates(v, length, floor if floor is not None else 0.0, unit, norms) for v, length, floor in zip(q, part["norm"].to_pylist(), floors, strict=True)]
                # One product of matrices over what any of these queries has left; each then takes its own.
                some = np.zeros(len(norms), bool)
                for own in near:
                    some[own] = True
                kept = np.flatnonzero(some)
                together = products(q, c[kept])
                for i, (qid, own) in enumerate(zip(qids, near, strict=True)):
                    own = own[ids[own] != qid]
                    scores = together[i, np.searchsorted(kept, own)]
                    first = best(scores, ids[own], k)
                    out.append((np.full(len(first), qid, np.int64), ids[own][first], scores[first]))
        qids, found, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": qids, "vec_id": found, "score": scores})

    found = asked.groupBy("a1", "a2", "a3", "a4").cogroup(dealt.groupBy("b1", "b2", "b3", "b4")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
