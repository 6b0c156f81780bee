"""N-gram Jaccard join: which documents' shingle sets are alike, and the components that their links make.

1. One pass gives each document's number of shingles and the fingerprint of its set; documents with equal sets are one class
   and need no comparison. The same pass counts shingles in cells, over all documents; the number of cells follows the input.
2. Shingles are ordered rarest first: by their cell's count, then by hash, which is the same order for all. Two sets that are
   alike share a shingle among their first n - ceil(share * n) + 1. Those entries are dealt by shingle.
3. In each group of entries the class that has least of its own (the most common prefix) is the hub. Pairs of hub and member
   pass the length and the position filter; a pair is verified once.
4. Links make components. Then all pairs of a group that lie in different components, pass the filters and haven't been
   verified are verified as well: links inside a component can add nothing, so no link between components is lost.

Before sets are moved, pairs pass the suffix filter: each set's shingles are counted by 64 parts of the hash space, and the
parts' smaller counts bound the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.store import free, seen_in, written
from quern.llm.tokens import LOWERED, Words, grams, mix, slices, small_batches, words_of

CELLS = (1 << 19, 1 << 23)  # counters of shingles, at least and at most: a byte each where they are broadcast
CELL_BYTES = 1024  # of text for each counter, between the two
CELL_BLOCK = 1 << 14  # counters that are moved and summed together
PARTS = 64  # of the suffix filter
COUNTED = 2**15 - 1  # what a part counts at most
MOST_BITS = 1 << 26  # of the filter of wanted classes: 8 MB at most


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted by hash; the whole sequence is one if it has fewer than n words."""
    together = grams(words.hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(together[a : b - n + 1])
        elif b > a:
            yield grams(words.hashes[a:b], b - a, salt=b - a)
        else:
            yield np.zeros(0, np.uint64)


def class_key(shingles: np.ndarray, salt: int) -> int:
    """64 bits of a set, as a signed integer; another salt gives others."""
    total = np.add.reduce(mix(shingles ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))) if len(shingles) else np.uint64(0)
    return int(mix(np.array([total], np.uint64)).astype(np.int64)[0])


def cell_of(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _rows(docs: DataFrame, n: int, salt: int, n_cells: int) -> DataFrame:
    """(id, n, key, key2) by document, and in further rows (block, cells): parts of the counters. key2: 64 other bits of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "key", "key2", "block", "cells"]
        counts = np.zeros(n_cells, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, keys, others = [], [], []
                for own in shingle_sets(words_of(part.column("text"), LOWERED), n):
                    sizes.append(len(own))
                    keys.append(class_key(own, salt))
                    others.append(class_key(own, ~salt))
                    np.add.at(counts, cell_of(own, n_cells), np.uint32(1))
                none = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(x, pa.int64()) for x in (sizes, keys, others)], pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        blocks = counts.reshape(-1, min(CELL_BLOCK, n_cells))
        some = np.flatnonzero(blocks.any(axis=1))
        if len(some):
            none = [pa.nulls(len(some), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=names)

    return small_batches(docs).mapInArrow(run, "id long, n long, key long, key2 long, block int, cells binary")


def _rarity(rows: DataFrame, n_cells: int) -> np.ndarray:
    """Logarithms of the counters (four steps a doubling), a byte each, summed in streams by block; their number is bounded."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            logs = np.minimum(4 * np.log2(1 + sums.astype(np.float64)), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([logs.tobytes()], pa.binary())], names=["block", "logs"])

        for batch in batches:
            for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, sums = block, np.zeros(min(CELL_BLOCK, n_cells), np.int64)
                sums += np.frombuffer(cells.as_buffer(), np.uint32)
        if now is not None:
            yield done()

    size = min(CELL_BLOCK, n_cells)
    parts = rows.where("block is not null").select("block", "cells").repartition(n_cells // size, "block").sortWithinPartitions("block").mapInArrow(total, "block int, logs binary")
    out = np.zeros((n_cells // size, size), np.uint8)
    for r in parts.toLocalIterator():
        out[r.block] = np.frombuffer(r.logs, np.uint8)
    return out.ravel()


def _entries(docs: DataFrame, n: int, share: int, rarity: np.ndarray, salt: int) -> DataFrame:
    """(h, key, n << 32 | pos, own) for each shingle of each class's prefix; copies in one slice give one class's entries once.

    own: how much of its own a class has, from 0: less for one whose prefix is made of shingles that many have.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen: set[int] = set()
                out: list[tuple[np.ndarray, int, int, int]] = []
                for own in shingle_sets(words_of(part.column("text"), LOWERED), n):
                    if not len(own) or (key := class_key(own, salt)) in seen:
                        continue
                    seen.add(key)
                    size = len(own) - -(-len(own) * share // 100) + 1
                    logs = sent.value[cell_of(own, len(sent.value))]
                    order = np.lexsort((own, logs))[:size]
                    out.append((own[order], key, len(own), int(1000 * (64 - logs[order].mean() / 4))))
                if out:
                    sizes = np.array([len(x[0]) for x in out])
                    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    by_class = [np.repeat(np.array([x[i] for x in out], np.int64), sizes) for i in (1, 2, 3)]
                    cols = [np.concatenate([x[0] for x in out]).astype(np.int64), by_class[0], (by_class[1] << 32) | place, by_class[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "key", "place", "own"])

    return small_batches(docs).mapInArrow(run, "h long, key long, place long, own long")


def _grouped(entries: DataFrame, share: int) -> DataFrame:
    """Two kinds of rows from entries dealt by shingle.

    (key, hub): a member of a group and its hub, the class with least of its own, where they pass the filters. A class that much
    is shared with is the hub of all its groups, so its family's pairs are the same in each. (h, key, place): the members but
    the hub of groups with two such at least, for the pairs among them. Groups go by in a stream of sorted rows: a task holds
    a few rows, however large a group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = (0, 0, 0)  # h, class and place of the group that goes on
        count, first_member, last = -1, (0, 0), None  # its members so far (-1: no group), the first of them, the last class
        for batch in batches:
            h, key, place = (batch.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            new = np.r_[count < 0 or h[0] != hub[0], h[1:] != h[:-1]]
            again = ~new & np.r_[last is not None and key[0] == last, key[1:] == key[:-1]]
            member = ~new & ~again
            begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            old = begin < 0
            hub_key, hub_place = (np.where(old, hub[i], x[np.maximum(begin, 0)]) for i, x in ((1, key), (2, place)))
            total = np.cumsum(member)
            order = total - np.where(old, -max(count, 0), total[np.maximum(begin, 0)])  # 1 for a group's first member
            at = np.flatnonzero(member)
            pair = at[can_be_alike(place[at] >> 32, place[at] & LOW, hub_place[at] >> 32, hub_place[at] & LOW, share)]
            many = at[order[at] >= 2]
            second = at[order[at] == 2]  # now the first member of the group counts too
            before = np.searchsorted(at, second) - 1
            carried = (before < 0) | old[second] & (count >= 1)
            firsts = [np.where(carried, f, x[at[np.maximum(before, 0)]]) for f, x in zip(first_member, (key, place), strict=True)] if len(second) else [np.zeros(0, np.int64)] * 2
            none, size = pa.nulls(len(pair), pa.int64()), len(second) + len(many)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([none, pa.array(h[second]), pa.array(h[many])]), pa.array(np.concatenate([key[pair], firsts[0], key[many]])),
                    pa.concat_arrays([none, pa.array(firsts[1].astype(np.int64)), pa.array(place[many])]), pa.concat_arrays([pa.array(hub_key[pair]), pa.nulls(size, pa.int64())]),
                ],
                names=["h", "key", "place", "hub"],
            )
            if begin[-1] >= 0:
                hub, count = (int(h[begin[-1]]), int(key[begin[-1]]), int(place[begin[-1]])), 0
            own = at[(begin[at] == begin[-1])]
            if len(own) and count <= 0:
                first_member = (int(key[own[0]]), int(place[own[0]]))
            count += len(own)
            last = key[-1]

    dealt = entries.repartition("h").sortWithinPartitions("h", "own", "key").select("h", "key", "place")
    return dealt.mapInArrow(run, "h long, key long, place long, hub long")


LOW = (1 << 32) - 1  # of a place: the position; above: the size of the set


def can_be_alike(n, pos, m, at, share: int):
    """Length and position filter for two entries of one shingle, on columns or arrays.

    For the first common shingle nothing before is common, so what is left bounds the overlap.
    """
    if isinstance(n, Column):
        low, high, rest = F.least(n, m), F.greatest(n, m), F.least(n - pos, m - at)
    else:
        low, high, rest = np.minimum(n, m), np.maximum(n, m), np.minimum(n - pos, m - at)
    return (100 * low >= share * high) & ((100 + share) * rest >= share * (n + m))


CLASSES = 8  # of sizes, from share * n to n


def _across(places: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) that share a shingle, pass the filters and lie in different components.

    One of a pair lies outside of its group's main component, and only those are paired, with members of the sizes that what
    follows their entry leaves room for. So a large family that is tied together already costs its size, not its square.
    """
    size, at = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit(LOW))
    step = float(np.log(100 / share) / CLASSES)
    class_of = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    classes = F.sequence(class_of(size("place")) - CLASSES - 1, class_of(size("place")) + CLASSES + 1)
    room = (100.0 + share) * (size("place") - at("place")) / share - size("place")  # the largest partner
    one = places.where(F.col("component") != F.col("main")).select("h", "key", "place", "component", F.explode(F.filter(classes, lambda c: F.exp(c * step) <= room + 1)).alias("class"))
    two = places.select("h", class_of(size("place")).alias("class"), *[F.col(c).alias(f"{c}2") for c in ("key", "place", "component")])
    alike = can_be_alike(size("place"), at("place"), size("place2"), at("place2"), share)
    found = one.join(two, ["h", "class"]).where((F.col("component") != F.col("component2")) & alike)
    return found.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


SENT = 1_000_000  # rows of keys that are broadcast; more are joined by shuffle


def counted(df: DataFrame, name: str, **seen: Column) -> DataFrame:
    """written(), its rows counted meanwhile."""
    return written(df, name, rows=F.count("*"), **seen)


def small(table: DataFrame) -> DataFrame:
    """A written table whose rows were seen, to be broadcast if it has few: some pairs of integers each."""
    return F.broadcast(table) if seen_in(table)["rows"] <= SENT else table


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, n: int, share: int, salt: int) -> DataFrame:
    """Pairs (a, b) of classes that are alike, from the texts.

    docs has id and text; classes has each key's least id, so that one document of a class gives its set, not every copy. The
    result is written; sets and pairs are plain tables, so that adaptive execution can split a class that most pairs have.
    """
    spark = docs.sparkSession
    pairs = small(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = counted(classes.join(small(counted(keys, "keys")), "key").select(F.col("key").bitwiseXOR(F.coalesce("least", F.lit(0))).alias("x")), "wanted")
    bits = min(MOST_BITS, 1 << max(16, (16 * seen_in(keys)["rows"]).bit_length()))
    slot = F.pmod(F.col("x"), F.lit(bits))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("x"))
    bitmap, found = np.zeros(bits // 64, np.uint64), words.toArrow()  # at most MOST_BITS / 64 rows
    bitmap[found["w"].to_numpy()] = found["x"].to_numpy().astype(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[int, np.ndarray] = {}
                ids = pc.fill_null(part.column("id"), 0).to_pylist()
                for doc, own in zip(ids, shingle_sets(words_of(part.column("text"), LOWERED), n), strict=True):
                    if len(own):
                        at = ((key := class_key(own, salt)) ^ doc) % bits
                        if int(sent.value[at >> 6]) >> (at & 63) & 1:
                            found[key] = own
                if found:
                    counts = np.stack([np.minimum(np.bincount((x >> np.uint64(20)).astype(np.int64) % PARTS, minlength=PARTS), COUNTED) for x in found.values()])
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * PARTS), pa.array(counts.ravel().astype(np.int16)))
                    ends = np.r_[0, np.cumsum([len(x) for x in found.values()])].astype(np.int32)
                    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(found.values())).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), parts, grams], names=["key", "parts", "grams"])

    raw = small_batches(docs).mapInArrow(run, "key long, parts array<smallint>, grams array<long>")
    # Sets stay where they are written. A class may be given by more than one document: the first in the order of writing stands
    # for it, which integers alone tell, and pairs name sets by their place in that order.
    sets = written(raw.withColumn("uid", F.monotonically_increasing_id()), "shingle-sets")
    first = written(sets.groupBy("key").agg(F.min("uid").alias("uid")), "set-places")
    one, two = (first.select(F.col("key").alias(k), F.col("uid").alias(f"u{k}")) for k in "ab")
    numbered = counted(pairs.join(one, "a").join(two, "b").select("a", "b", "ua", "ub"), "numbered")

    def joined(pairs: DataFrame, column: str) -> DataFrame:
        one, two = (sets.select(F.col("uid").alias(f"u{k}"), F.col(column).alias(f"{k}_own")) for k in "ab")
        return pairs.join(two, "ub").join(one, "ua")

    counted_out = lambda c: F.array_max(c) >= COUNTED  # noqa: E731  (a part that isn't counted out bounds nothing)
    total = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x.cast("int"))
    both = total(F.zip_with("a_own", "b_own", lambda x, y: F.least(x, y)))
    possible = counted_out("a_own") | counted_out("b_own") | ((100 + share) * both >= share * (total("a_own") + total("b_own")))
    near = counted(joined(small(numbered), "parts").where(possible).select("a", "b", "ua", "ub"), "near")
    common = F.size(F.array_intersect("a_own", "b_own"))
    alike = (100 + share) * common.cast("long") >= share * (F.size("a_own") + F.size("b_own")).cast("long")
    links = written(joined(small(near), "grams").where(alike).select("a", "b"), "links")
    free(spark, sets, first, numbered, near)
    return links


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach, for every node that has an edge.

    Rounds grow with the logarithm of the longest chain; if so many aren't enough, that is an error, not a partial answer.

    Large-star and small-star rounds: each node's neighbours are tied to its least neighbour. The minimum is a partial
    aggregate and the rest a join, so a node with very many neighbours is gathered nowhere.
    """
    spark = edges.sparkSession
    known = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", sum=known)
    before = None
    for _ in range(most_rounds):
        state = seen_in(now)
        if state == before or not state["rows"]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        older, now = now, counted(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", sum=known)
        free(spark, older, large)
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    tied = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().join(tied.select("node"), "node", "left_anti")
    return tied.unionByName(roots.select("node", F.col("node").alias("component")))


def near_components(docs: DataFrame, n: int = 5, share: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, class_key, component_id) for every row.

    Two documents are linked when 100 * common >= share * all of their shingles: n-word sequences of lower-cased words, or
    the whole sequence of fewer words. component_id is the smallest id that links reach, the document's own included.
    Documents without words (null and empty texts too) are linked with nothing. Rows with a null id link like others but
    give no id; a component of such rows only has a null id. Repeated rows are each answered. class_key (64 bits of the set)
    is the same for equal sets and, in one call, for no others (128 bits are compared). Shingles are compared by 64 bits. Ids
    are integers; an empty table gives an empty one; other columns are not carried.
    """
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, spark = df.select("text"), docs.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_cells = min(CELLS[1], max(CELLS[0], 1 << (size // CELL_BYTES).bit_length()))
    salt = 0
    while True:  # until no two sets of this input share the 64 bits of their key; 64 further bits tell
        rows = written(_rows(df, n, salt, n_cells), "shingles")
        own = rows.where("block is null").select("id", "n", "key")
        found = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), (F.min(F.struct("n", "key2")) != F.max(F.struct("n", "key2"))).alias("clash"))
        classes = written(found, "classes", clashes=F.count_if("clash"))
        if not seen_in(classes)["clashes"]:
            break
        free(spark, rows, classes)
        salt += 1
    classes = classes.drop("clash")
    rarity = _rarity(rows, n_cells)
    grouped = written(_grouped(_entries(texts, n, share, rarity, salt), share), "grouped")
    a, b = F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")
    star = counted(grouped.where("hub is not null").select(a, b).distinct(), "pairs")
    links = _verified(df, star, classes, n, share, salt)
    tied = counted(components(links).withColumnRenamed("node", "key"), "components")

    # What is left: pairs of other members of a group that lie in different components.
    places = grouped.where("h is not null").select("h", "key", "place").join(small(tied), "key", "left").withColumn("component", F.coalesce("component", "key"))
    counts = places.groupBy("h", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("h", "main")
    places = written(places.join(small(counted(main, "mixed")), "h"), "places")
    free(spark, grouped)
    cross = _across(places, share)
    cross = counted(cross.join(small(star), ["a", "b"], "left_anti"), "pairs")
    free(spark, places, star)
    if seen_in(cross)["rows"]:
        tied = written(components(links.unionByName(_verified(df, cross, classes, n, share, salt))).withColumnRenamed("node", "key"), "components")
    free(spark, cross, links)

    classes = classes.join(tied, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.select("key", "component").join(least, "component").select("key", "component_id")
    linked = own.where("n > 0").join(named, "key").select("id", "n", "key", "component_id")
    alone = own.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("key"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), "component_id")
