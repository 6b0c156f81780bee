"""Merkle manifest of a table: trees of fan-out 16 over the rows of each group, and one over the groups' roots.

Leaves are sorted by range over all partitions and written with their place in the partition. Counts of rows by partition and
group, added up before each partition, turn that into places in the group. A place says which aligned block of 256 leaves a
leaf is in: blocks that lie whole in one task are hashed there, pieces of blocks at the borders of tasks are shuffled by
their coordinate and hashed then. The blocks' roots are the leaves of the next pass, 256 times fewer, until each group has one
node; the groups' roots go through the same passes as one group. Then paths run down: a block gets the siblings above it once,
and each leaf its proof from its run, its block and that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.store import free, written

FAN = 16
BLOCK = FAN * FAN  # leaves of a block: two levels
SIZE = 32  # bytes of a digest
ROWS = 4096  # of an Arrow batch that a task gives

MEMBER = "struct<pos:bigint,id:bigint,leaf:binary,other:binary>"
RUNS = f"g string, block long, n long, run int, members array<{MEMBER}>, beside binary, root binary"
PATH = "array<struct<at:int,beside:binary>>"

_MEMBER = pa.struct([("pos", pa.int64()), ("id", pa.int64()), ("leaf", pa.binary()), ("other", pa.binary())])
_RUNS = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("run", pa.int32()), ("members", pa.list_(_MEMBER)), ("beside", pa.binary()), ("root", pa.binary())])


def field(value: Column) -> Column:
    """A field of a leaf: - for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def digest(nodes: list[bytes]) -> bytes:
    """Of nodes as hex text, one after the other."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def levels(n: int) -> int:
    """Of those that a block of a group with n nodes has: none for a single node, one for up to FAN, else two."""
    return 0 if n == 1 else 1 if n <= FAN else 2


def hashed(g: str, block: int, n: int, members: list[dict]) -> list[dict]:
    """Runs of a whole block, its members in order; the first run carries the block's root."""
    runs = [members[i : i + FAN] for i in range(0, len(members), FAN)]
    if levels(n) == 0:
        return [{"g": g, "block": block, "n": n, "run": 0, "members": members, "beside": None, "root": members[0]["leaf"]}]
    nodes = [digest([m["leaf"] for m in run]) for run in runs]
    root = nodes[0] if levels(n) == 1 else digest(nodes)
    return [{"g": g, "block": block, "n": n, "run": i, "members": run, "beside": b"".join(nodes[:i] + nodes[i + 1 :]), "root": None if i else root} for i, run in enumerate(runs)]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive leaves (g, pos, n, id, leaf, other) as runs of whole blocks; pieces of other blocks as one row, run -1."""
    held: list[dict] = []
    key: tuple = ()
    out: list[dict] = []

    def flush() -> None:
        if held:
            g, block, n = key
            whole = len(held) == min(BLOCK, n - block * BLOCK)
            out.extend(hashed(g, block, n, held) if whole else [{"g": g, "block": block, "n": n, "run": -1, "members": held, "beside": None, "root": None}])

    for batch in batches:
        for row in batch.to_pylist():
            now = (row.pop("g"), row["pos"] // BLOCK, row.pop("n"))
            if now != key or row["pos"] != held[-1]["pos"] + 1:
                flush()
                held, key = [], now
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, _RUNS)
                    out = []
            held.append(row)
    flush()
    yield pa.RecordBatch.from_pylist(out, _RUNS)


def _joined(pieces: pa.Table) -> pa.Table:
    """The runs of one block from its pieces, at most BLOCK leaves."""
    rows = pieces.to_pylist()
    members = sorted((m for r in rows for m in r["members"]), key=lambda m: m["pos"])
    return pa.Table.from_pylist(hashed(rows[0]["g"], rows[0]["block"], rows[0]["n"], members), _RUNS)


def placed(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """leaves (g, ...) with pos, their place in the group by `order`, nulls first, and n, the group's size; written.

    Equal rows share the order in which they are read. A group may span any number of partitions.
    """
    sort = ["g", *order, "_row"]
    # Rows that are equal in all of order are told apart by where they are read, so that copies spread over partitions too.
    ranged = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    at = written(numbered.select(*leaves.columns, F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(2**33 - 1).alias("_seq")), name)
    counts = at.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    by = Window.partitionBy("g").orderBy("_part")
    offsets = counts.select("g", "_part", (F.sum("_n").over(by) - F.col("_n") - F.col("_first")).alias("_offset"), F.sum("_n").over(Window.partitionBy("g")).alias("n"))
    return at.join(offsets, ["g", "_part"]).withColumn("pos", F.col("_seq") + F.col("_offset")).drop("_part", "_seq", "_offset")


def passes(leaves: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """The runs of each pass over placed leaves (g, pos, n, id, leaf, other); groups have at most `largest` leaves."""
    local = written(leaves.select("g", "pos", "n", "id", "leaf", "other").sortWithinPartitions("g", "pos").mapInArrow(_local, RUNS), f"{name}-local")
    ragged = local.where("run < 0").groupBy("g", "block").applyInArrow(_joined, RUNS)
    out = [local.where("run >= 0").unionByName(ragged)]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        up = out[-1].where(f"run = 0 and n > {BLOCK}").select("g", F.floor(F.col("block") / BLOCK).alias("block"), F.ceil(F.col("n") / BLOCK).alias("n"), F.lit(-1).alias("run"), F.array(F.struct(F.col("block").alias("pos"), F.col("block").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("other"))).alias("members"))
        out.append(written(up.groupBy("g", "block").applyInArrow(_joined, RUNS), f"{name}-upper"))
    return out


def roots(runs: list[DataFrame]) -> DataFrame:
    """(g, leaf): each group's root."""
    tops = [r.where(f"run = 0 and n <= {BLOCK}").select("g", F.col("root").alias("leaf")) for r in runs]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def steps(i: int, n: int, run: int, members: list[dict], beside: bytes | None) -> list[tuple[int, bytes]]:
    """(place in the run, siblings) of member i up to its block's root."""
    out = []
    if levels(n) > 0:
        out.append((i, b"".join(m["leaf"] for j, m in enumerate(members) if j != i)))
    if levels(n) > 1:
        out.append((run, beside))
    return out


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with the path of their block to (g, block, path): the members' own paths."""
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("beside", pa.binary())])))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for i, m in enumerate(r["members"]):
                own = [{"at": at, "beside": b} for at, b in steps(i, r["n"], r["run"], r["members"], r["beside"])]
                out.append({"g": r["g"], "block": m["pos"], "path": own + r["path"]})
        yield pa.RecordBatch.from_pylist(out, schema)


def paths(runs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, block, path): the siblings above each block of the first pass; tops (g, path) go on from the groups' roots."""
    up = None
    for r in reversed(runs):
        ends = r.where(f"run = 0 and n <= {BLOCK}").select("g", "block").join(tops, "g").select("g", "block", "path")
        above = ends if up is None else ends.unionByName(up)
        if r is runs[0]:
            return above
        up = r.select("g", "block", "n", "run", "members", "beside").join(above, ["g", "block"]).mapInArrow(_down, f"g string, block long, path {PATH}")


def folded(leaf: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, beside in path:
        leaf = digest([beside[: at * SIZE], leaf, beside[at * SIZE :]])
    return leaf


PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOFS = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in PROOFS.split(", ")])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            above = [(s["at"], s["beside"]) for s in r["path"]]
            height = next(h for h in range(64) if FAN**h >= r["n"])
            subroot = folded(r["members"][0]["leaf"], (steps(0, r["n"], r["run"], r["members"], r["beside"]) + above)[:height])
            for i, m in enumerate(r["members"]):
                path = steps(i, r["n"], r["run"], r["members"], r["beside"]) + above
                found = folded(m["other"] or m["leaf"], path)
                out.append({"id": m["id"], "leaf": m["leaf"].hex(), "subroot": subroot.hex(), "root": r["whole"].hex(), "proof_sha256": digest([b for _, b in path]).hex(), "folded_root": found.hex(), "verified": found == r["whole"]})
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, _PROOFS)
                out = []
        yield pa.RecordBatch.from_pylist(out, _PROOFS)


def manifest(rows: DataFrame, id_col: str, group_col: str, fields: list[str], presented: dict[str, Column] | None = None) -> DataFrame:
    """PROOFS, a row for each row: its leaf, its group's root, the root of all, the digest of its proof, and a check.

    Leaves are digests of `fields`; rows of a group ascend by id_col (an integer; null first), equal ids by leaf. Groups are
    ordered by name, bytewise, null first. The check folds the siblings over the leaf of the fields as `presented` (columns
    that stand in for some of the fields; null where a row is presented as it is). Repeated rows have a leaf each. An empty
    table gives no rows; a table of one row is its own root. Other columns are not read.
    """
    presented = presented or {}
    changed = [p.isNotNull() for p in presented.values()]
    other = F.when(F.array_contains(F.array(*changed), True), leaf_of([F.coalesce(presented[f], F.col(f)) if f in presented else F.col(f) for f in fields])) if changed else F.lit(None)
    g = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = written(rows.select(g.alias("g"), F.col(id_col).cast("long").alias("id"), leaf_of([F.col(f) for f in fields]).alias("leaf"), other.cast("binary").alias("other")), "merkle-leaves")
    largest = leaves.groupBy("g").count().agg(F.max("count"), F.count("*")).first()
    if not largest[1]:
        return rows.sparkSession.createDataFrame([], PROOFS)
    runs = passes(placed(leaves, ["id", "leaf"], "merkle-sorted"), largest[0], "merkle")
    free(rows.sparkSession, leaves)
    tops = written(roots(runs), "merkle-roots")
    # The groups' roots as one group, by name; their number in that order stands for the name.
    named = placed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "leaf"), ["name"], "merkle-groups").withColumnsRenamed({"pos": "id"})
    named = written(named, "merkle-named")
    whole = passes(named.select("g", F.col("id").alias("pos"), "n", "id", "leaf", F.lit(None).cast("binary").alias("other")), largest[1], "merkle-top")
    root = roots(whole).first()["leaf"]
    none = F.array().cast(PATH)
    above = whole[0].select("g", "block", "n", "run", "members", "beside").join(paths(whole, roots(whole).select("g", none.alias("path"))), ["g", "block"])
    found = above.mapInArrow(_down, f"g string, block long, path {PATH}").select(F.col("block").alias("id"), "path")
    ends = written(named.join(found, "id").select(F.col("name").alias("g"), "path"), "merkle-ends")
    ready = runs[0].join(paths(runs, ends), ["g", "block"]).withColumn("whole", F.lit(bytearray(root)))
    return ready.select("n", "run", "members", "beside", "path", "whole").mapInArrow(_proofs, PROOFS)
