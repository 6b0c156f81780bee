"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With one more component, sqrt(M^2 - |x|^2) for rows and 0 for anchors, M being the greatest length, an anchor's distance to a
row falls as their product grows: |a|^2 + M^2 - 2 a.x. So a window of scores is an annulus of distances, and going from the
nearest row outward meets the highest scores first.

A vantage-point tree, built on a bounded sample, cuts the space into cells: a row goes to the side of each vantage point's
radius that it is on. Every row is filed under its cell, large cells in blocks. A vantage point's distance bounds an anchor's
distance to all rows of a cell from both sides. Anchors visit cells nearest first, in waves: the first wave the few nearest
ones in the annulus, which gives the k-th best score so far; the later ones only cells that can still reach it. In a block,
products are exact integers. Positives are found the same way, with all scores as their window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.store import written
from quern.llm.top_k import best, matrix, products

SAMPLE = 4096  # rows that the tree is built on
SAMPLE_VALUES = 1 << 20  # and their components in all
CELL = 4096  # rows of a cell that the tree aims at
CELLS = 512  # at most
BLOCK = 16_384  # rows of a cell that meet anchors in one task
ASKED = 4096  # anchors that meet a block in one task
FIRST = 4  # cells of the first wave
SLACK = 1e-9  # of distances, which are doubles

LOW, HIGH = -(2**63), 2**63 - 1
WINDOWS = "array<struct<w:int,lo:bigint,hi:bigint>>"
ASKING = f"qid bigint, label int, v array<bigint>, norm double, dim int, same boolean, windows {WINDOWS}"
FOUND = "qid bigint, w int, id bigint, score bigint"


@dataclass(frozen=True)
class Tree:
    """Vantage points (augmented), their radii, and for each cell its path: (vantage point, whether inside of the radius)."""

    points: np.ndarray
    radii: np.ndarray
    cells: list[list[tuple[int, bool]]]
    longest: float

    def distances(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of vectors with their additional component to all vantage points."""
        own = np.concatenate([v.astype(np.float64), extra[:, None]], axis=1)
        squares = (own**2).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * own @ self.points.T
        return np.sqrt(np.maximum(squares, 0))

    def slack(self) -> float:
        """What a distance may be off by: squares are sums of this size, and the root makes the error of small ones larger."""
        return SLACK * (1 + self.longest) + 1e-6 * self.longest

    def cell_of(self, far: np.ndarray) -> np.ndarray:
        """The cell of each row, from its distances."""
        out = np.zeros(len(far), np.int32)
        for c, path in enumerate(self.cells):
            inside = np.ones(len(far), bool)
            for p, near in path:
                inside &= (far[:, p] <= self.radii[p]) == near
            out[inside] = c
        return out

    def bounds(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distances of anchors, from theirs to the vantage points, to any row of each cell."""
        least, most = np.zeros((len(far), len(self.cells))), np.full((len(far), len(self.cells)), np.inf)
        for c, path in enumerate(self.cells):
            for p, near in path:
                if near:
                    least[:, c] = np.maximum(least[:, c], far[:, p] - self.radii[p])
                    most[:, c] = np.minimum(most[:, c], far[:, p] + self.radii[p])
                else:
                    least[:, c] = np.maximum(least[:, c], self.radii[p] - far[:, p])
        return least - self.slack(), most + self.slack()


def extra_of(norms: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest**2 - norms**2, 0))


def tree_of(sample: np.ndarray, longest: float, n_cells: int) -> Tree:
    """A tree over a sample; halves each part at the median distance to its vantage point, the row farthest from its first."""
    norms = np.sqrt((sample.astype(np.float64) ** 2).sum(1))
    rows = np.concatenate([sample.astype(np.float64), extra_of(norms, longest)[:, None]], axis=1)
    points: list[np.ndarray] = []
    radii: list[float] = []
    cells: list[list[tuple[int, bool]]] = []
    open_parts = [(np.arange(len(rows)), [])]
    while open_parts:
        part, path = open_parts.pop(0)
        if len(cells) + len(open_parts) + 1 < n_cells and len(part) > 1:
            point = rows[part[np.argmax(((rows[part] - rows[part[0]]) ** 2).sum(1))]]
            far = np.sqrt(((rows[part] - point) ** 2).sum(1))
            radius = float(np.median(far))
            near = far <= radius
            if 0 < near.sum() < len(part):
                points.append(point)
                radii.append(radius)
                open_parts += [(part[near], [*path, (len(points) - 1, True)]), (part[~near], [*path, (len(points) - 1, False)])]
                continue
        cells.append(path)
    return Tree(np.array(points).reshape(len(points), rows.shape[1] if len(rows) else 0), np.array(radii), cells, longest)


def sound_rows(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: float, is_anchor: Column) -> DataFrame:
    """(id, label, v, norm, dim, anchor) of rows with an id, a label and only finite components; v is floor(scale * x)."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumns({"norm": norm, "dim": F.size("v")})


class Index:
    """Rows of sound_rows() by cell of a tree over a bounded sample, one tree for each number of components in it."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n")).limit(CELLS).collect()
        widest = max((d["dim"] for d in dims), default=1) or 1
        sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(max(2, min(SAMPLE, SAMPLE_VALUES // widest))).select("v", "dim").toArrow()
        trees = {}
        for d in dims:
            own = sample.filter(pa.compute.equal(sample["dim"], d["dim"]))
            if len(own) and d["dim"]:
                trees[d["dim"]] = tree_of(matrix(own["v"]), d["longest"], max(1, min(CELLS, -(-d["n"] // CELL), len(own) // 4)))
        self.trees = spark.sparkContext.broadcast(trees)  # at most SAMPLE_VALUES components; other dimensions are one cell each
        held = self.trees

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, dim = np.zeros(batch.num_rows, np.int32), batch["dim"].to_numpy()
                for d in np.unique(dim):
                    if tree := held.value.get(int(d)):
                        at = np.flatnonzero(dim == d)
                        v, norms = matrix(batch["v"].take(pa.array(at))), batch["norm"].to_numpy()[at]
                        cell[at] = tree.cell_of(tree.distances(v, extra_of(norms, tree.longest)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        filed = rows.select("id", "label", "v", "norm", "dim").mapInArrow(file, "id bigint, label int, v array<bigint>, norm double, dim int, cell int")
        self.rows = written(filed, "negatives-filed")
        sizes = self.rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        self.sizes = written(sizes, "negatives-cells")

    def search(self, asking: DataFrame, n_asking: int, k: int) -> DataFrame:
        """FOUND: for each anchor and window the k highest scores in it among rows of its own label (same) or of others, but for
        rows with its own id; all, if there are fewer; ties to the smaller id. asking: ASKING.
        """
        asking = written(asking.select([c.split()[0] for c in ASKING.split(", ")]), "negatives-asking")
        first = written(self._wave(asking, n_asking, k, None), "negatives-first")
        order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), "id")
        kth = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_kth"))
        raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["lo"], F.coalesce(F.try_element_at("_kth", x["w"]), x["lo"])).alias("lo"), x["hi"].alias("hi")))
        rest = self._wave(asking.join(kth, "qid", "left").withColumn("windows", raised).drop("_kth"), n_asking, k, asking)
        both = first.unionByName(rest)
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _wave(self, asking: DataFrame, n_asking: int, k: int, before: DataFrame | None) -> DataFrame:
        """Hits in each anchor's FIRST nearest cells, or with `before` (the anchors as they went there) in all others that count."""
        spark, held, later = asking.sparkSession, self.trees, before is not None
        names = ["qid", "label", "v", "norm", "dim", "same", "windows", *(["was"] if later else [])]
        if later:
            asking = asking.join(before.select("qid", F.col("windows").alias("was")), "qid")

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dim, norms = batch["dim"].to_numpy(), batch["norm"].to_numpy()
                rows, cells = [], []
                for d in np.unique(dim):
                    at, tree = np.flatnonzero(dim == d), held.value.get(int(d))
                    if tree is None or not len(tree.radii):
                        if not later:
                            rows += at.tolist()
                            cells += [0] * len(at)
                        continue
                    v = matrix(batch["v"].take(pa.array(at)))
                    least, most = tree.bounds(tree.distances(v, np.zeros(len(at))))
                    # Distances that windows span: from the highest score's to the lowest score's.
                    whole = norms[at] ** 2 + tree.longest**2

                    def reach(name):
                        spans = batch[name].take(pa.array(at)).to_pylist()
                        lo = np.array([min((x["lo"] for x in s), default=0) for s in spans], np.float64)
                        hi = np.array([max((x["hi"] for x in s), default=0) for s in spans], np.float64)
                        size = tree.slack() + SLACK * np.sqrt(whole)
                        near, far = (np.sqrt(np.maximum(whole - 2 * s, 0)) for s in (hi, np.maximum(lo, -whole * 4)))
                        near, far = near - size, np.where(lo <= -whole * 4, np.inf, far + size)
                        return near, far, (least <= far[:, None]) & (most >= near[:, None])

                    def nearest(near, fits):
                        """Cells in the order in which going outward from the annulus' inner side meets them."""
                        order = np.argsort(np.where(fits, np.maximum(least, near[:, None]), np.inf), axis=1, kind="stable")
                        rank = np.empty_like(order)
                        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
                        return rank

                    near, _, fits = reach("was" if later else "windows")
                    early = fits & (nearest(near, fits) < FIRST)
                    wanted = reach("windows")[2] & ~early if later else early
                    i, c = np.nonzero(wanted)
                    rows += at[i].tolist()
                    cells += c.tolist()
                for a in range(0, max(len(rows), 1), 1024):
                    out = batch.take(pa.array(rows[a : a + 1024], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns[:7], pa.array(cells[a : a + 1024], pa.int32())], names=[*names[:7], "cell"])

        asked = asking.select(*names).mapInArrow(visit, f"{ASKING}, cell int").join(self.sizes, ["dim", "cell"])
        parts = max(1, -(-n_asking // ASKED))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = written(asked.select(F.col("dim").alias("a1"), F.col("cell").alias("a2"), F.col("block").alias("a3"), F.col("part").alias("a4"), "qid", "label", "v", "same", "windows"), "negatives-asked")
        # Rows go to the groups of anchors that ask for their cell, and to no others.
        wanted = asked.select(F.col("a1").alias("dim"), F.col("a2").alias("cell"), F.col("a4").alias("part")).distinct()
        block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
        dealt = self.rows.join(self.sizes, ["dim", "cell"]).withColumn("block", block).join(wanted, ["dim", "cell"])
        dealt = dealt.select(F.col("dim").alias("b1"), F.col("cell").alias("b2"), F.col("block").alias("b3"), F.col("part").alias("b4"), "id", "label", "v")

        def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
            qids, ws, ids, scores = [], [], [], []
            if len(left) and len(right):
                own, label, c = right["id"].to_numpy(), right["label"].to_numpy(), matrix(right["v"])
                for a in range(0, len(left), 256):
                    part = left.slice(a, 256)
                    for row, got in zip(part.select(["qid", "label", "same", "windows"]).to_pylist(), products(matrix(part["v"]), c), strict=True):
                        fit = np.flatnonzero(((label == row["label"]) == row["same"]) & (own != row["qid"]))
                        for x in row["windows"]:
                            inside = fit[(got[fit] >= x["lo"]) & (got[fit] <= x["hi"])]
                            first = inside[best(got[inside], own[inside], k)]
                            qids += [row["qid"]] * len(first)
                            ws += [x["w"]] * len(first)
                            ids.append(own[first])
                            scores.append(got[first])
            none = [np.zeros(0, np.int64)]
            return pa.table({"qid": pa.array(qids, pa.int64()), "w": pa.array(ws, pa.int32()), "id": np.concatenate(ids + none), "score": np.concatenate(scores + none)})

        return asked.groupBy("a1", "a2", "a3", "a4").cogroup(dealt.groupBy("b1", "b2", "b3", "b4")).applyInArrow(meet, FOUND)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each anchor, its `positives` rows of the same label with the highest products, and for each of them the `negatives` rows
    of other labels with the highest products among those from least to most percent of the positive's. Ties go to the smaller
    id. Rows without id, label or vector, or with a component that is null or not finite, take no part; vectors meet those of
    their own number of components. Of several anchor rows with one id the smallest counts; repeated candidates count each, and
    rows with the anchor's id are never its candidates. An empty table, or one without anchors, gives no rows. Products must
    stay under 2^56. Other columns, whatever their names, are not read, but by is_anchor and label.
    """
    rows = written(sound_rows(vectors, id_col, F.col("label") if label is None else label, vector_col, scale, is_anchor), "negatives-rows")
    index = Index(rows)
    anchors = rows.where("anchor").groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("label", "v", "norm", "dim")).alias("m")).select("qid", "m.*")
    everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))).cast(WINDOWS)
    anchors = written(anchors.withColumns({"same": F.lit(True), "windows": everything}), "negatives-anchors")
    n = anchors.count()
    good = index.search(anchors, n, positives).select("qid", (F.col("rank") - 1).cast("int").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    good = written(good, "negatives-positives")
    ps = F.col("positive_score")
    # In whole numbers: 100 * negative >= least * positive, and 100 * negative <= most * positive.
    low, high = F.expr(f"({least} * positive_score) div 100"), F.expr(f"({most} * positive_score) div 100")  # cut towards 0
    at_least = low + F.when(low * 100 < ps * least, 1).otherwise(0)
    at_most = high - F.when(high * 100 > ps * most, 1).otherwise(0)
    windows = good.withColumns({"lo": at_least.cast("long"), "hi": at_most.cast("long")}).where("lo <= hi").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("w", "lo", "hi"))).alias("windows"))
    asking = anchors.drop("windows").join(windows, "qid").withColumns({"same": F.lit(False), "windows": F.col("windows").cast(WINDOWS)})
    bad = index.search(asking, n, negatives)
    return good.join(bad, ["qid", "w"]).select(F.col("qid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
