"""Toxicity: a linear-chain conditional random field tags toxic words; marginals give document scores and offending offsets.

Features of a word (a run of letters, digits and characters beyond ASCII) are itself and its first bytes (several lengths).
Training takes a sample of labelled documents, bounded in rows and bytes (parameters of fit). From their labels the features that point to label 1 are found, and words that have one, in documents of label 1, are the
labelled tokens that the field learns from. A score is a logistic function of what the marginals sum up to; it is fitted
on marginals of documents that the field in question hasn't seen (two halves), so that it isn't overconfident.

Scoring is one pass over Arrow batches without a shuffle. Only words that have a feature differ from any other word, so the
forward and backward recursions step from one such word to the next, through powers of the plain word's matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quern.llm.store import written
from quern.llm.tokens import ALNUM, Words, mix, release, slices, small_batches, words_of, _UP

PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)  # bytes
SEGMENT = 48  # words of a training sequence

SPANS = "array<struct<start:int,end:int,probability:double>>"


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, hashes) for each kind of feature in turn: the word itself, then each prefix of words that long."""
    yield np.arange(len(words.hashes)), words.hashes
    total, size = np.zeros(len(words.hashes), np.uint64), words.end - words.begin
    live, begin = np.arange(len(words.hashes)), words.begin
    for k in range(max(PREFIXES)):
        keep = size[live] > k
        live, begin, total = live[keep], begin[keep], total[keep]
        total += ALNUM.value[words.data[begin + k]] * _UP[k]
        if k + 1 in PREFIXES:
            yield live, mix(total + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64))


@dataclass
class Table:
    """Weights by feature hash. filter: which low 16 bits occur, so that most words are ruled out by one lookup."""

    hashes: np.ndarray
    weights: np.ndarray
    filter: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.hashes)
        self.hashes, self.weights = self.hashes[order], self.weights[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in the table) of those that are in it."""
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]


@dataclass
class Field:
    """States plain (0) and toxic (1); potentials: moves[a, b], and for state 1 exp(bias + the word's weights)."""

    table: Table
    bias: float
    moves: np.ndarray  # logarithms

    def powers(self, gaps: np.ndarray) -> np.ndarray:
        """For each gap of so many plain words the product of their matrices, scaled: from both eigenvalues, so for any gap."""
        plain = np.exp(self.moves + np.array([0.0, self.bias]))
        (a, b), (c, d) = plain
        root = np.sqrt((a - d) ** 2 + 4 * b * c)  # above 0, as all entries are
        large, less = (a + d + root) / 2, (a + d - root) / 2
        first, second = (plain - less * np.eye(2)) / root, (large * np.eye(2) - plain) / root
        return first + ((less / large) ** gaps)[:, None, None] * second

    def events(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of words that have a feature of the table."""
        pairs = [(live[p], t) for live, h in features(words) for p, t in [self.table.find(h)]]
        places = np.concatenate([p for p, _ in pairs])
        if not len(places):
            return places, np.zeros(0)
        at, inverse = np.unique(places, return_inverse=True)
        return at, np.bincount(inverse, self.table.weights[np.concatenate([t for _, t in pairs])], len(at))

    def marginals(self, words: Words, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Probability of state 1 at each event. Before a document's first and after its last word stands a plain state."""
        out = np.zeros(len(at))
        if not len(at):
            return out
        doc = np.searchsorted(words.first, at, "right") - 1
        counts = np.bincount(doc, minlength=len(words.first) - 1)
        heads = np.r_[0, np.cumsum(counts)]
        start = np.r_[True, doc[1:] != doc[:-1]]
        before = np.where(start, at - words.first[doc], np.r_[0, np.diff(at)] - 1)
        after = np.where(np.r_[start[1:], True], words.first[doc + 1] - 1 - at, 0)
        step = self.powers(before) @ np.exp(self.moves)
        step[:, :, 1] *= np.exp(np.clip(self.bias + weights, -60, 60))[:, None]
        step /= step.sum(axis=(1, 2), keepdims=True)
        tail = self.powers(after) @ np.exp(self.moves)[:, 0]
        by_size = np.argsort(-counts, kind="stable")
        by_size = by_size[counts[by_size] > 0]
        live = np.searchsorted(-counts[by_size], -np.arange(counts.max()), "left")  # documents with more events than k
        ahead, back = np.empty((len(at), 2)), np.empty((len(at), 2))
        now = np.tile([1.0, 0.0], (len(by_size), 1))
        for k in range(counts.max()):
            docs = by_size[: live[k]]
            rows = heads[docs] + k
            now = np.einsum("ni,nij->nj", now[: len(docs)], step[rows])
            now /= now.sum(axis=1, keepdims=True)
            ahead[rows] = now
        now = np.zeros((len(by_size), 2))
        for k in range(counts.max() - 1, -1, -1):
            docs = by_size[: live[k]]
            rows = heads[docs] + k
            last = counts[docs] == k + 1
            value = np.where(last[:, None], tail[rows], np.einsum("nij,nj->ni", step[np.minimum(rows + 1, len(at) - 1)], now[: len(docs)]))
            value /= value.sum(axis=1, keepdims=True)
            now[: len(docs)] = value
            back[rows] = value
        both = ahead * back
        return both[:, 1] / both.sum(axis=1)


def summed(words: Words, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By document: what the score is a function of."""
    n_docs, sizes = len(words.first) - 1, np.diff(words.first)
    doc = np.searchsorted(words.first, at, "right") - 1
    total, top = np.bincount(doc, p, n_docs), np.zeros(n_docs)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(n_docs), np.log1p(total), np.log1p(1000 * total / np.maximum(sizes, 20)), top, np.log1p(sizes)], axis=1)


def _train_field(words: Words, toxic: np.ndarray, share: np.ndarray, least: int, odds: float, rounds: int, most: int) -> Field:
    """toxic, share: each document's label and weight; most: features that are kept, those that tell most."""
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(words.first))
    kinds, value, at, which, n = [], [], [], [], 0
    for places, hashes in features(words):  # documents that have a feature, by label
        seen, number = np.unique(hashes, return_inverse=True)
        pair = np.unique(number * max(len(toxic), 1) + doc[places])
        label = toxic[pair % max(len(toxic), 1)]
        pair //= max(len(toxic), 1)
        ones, zeros = np.bincount(pair, label, len(seen)), np.bincount(pair, 1 - label, len(seen))
        points = np.log((ones + 0.5) / (toxic.sum() + 1)) - np.log((zeros + 0.5) / ((1 - toxic).sum() + 1))
        good = np.flatnonzero((ones >= least) & (points >= odds))
        of = np.full(len(seen), -1)
        of[good] = n + np.arange(len(good))
        hit = of[number] >= 0
        at.append(places[hit])
        which.append(of[number[hit]])
        kinds.append(seen[good])
        value.append(points[good] * np.sqrt(ones[good]))
        n += len(good)
    kinds, value, at, which = (np.concatenate(x) for x in (kinds, value, at, which))
    best = np.argsort(-value, kind="stable")[:most]
    to = np.full(n, -1)
    to[best] = np.arange(len(best))
    kinds, at, which = kinds[best], at[to[which] >= 0], to[which][to[which] >= 0]
    tagged = np.zeros(len(doc))
    tagged[at] = 1
    tagged *= toxic[doc]
    # Sequences of equal size, and the words beyond a document's end masked.
    firsts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(words.first[:-1], words.first[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    ends = np.minimum(words.first[1:][doc[firsts]], firsts + SEGMENT) if len(firsts) else firsts
    has = np.add.reduceat(np.bincount(at, minlength=len(doc)), firsts) > 0 if len(firsts) else np.zeros(0, bool)
    # Sequences without any feature are alike but for their length: one stands for all of a length, with the sum of their weights.
    sums = np.bincount((ends - firsts)[~has], share[doc[firsts[~has]]], SEGMENT + 1)
    weight = share[doc[firsts]].astype(float)
    kept = has.copy()
    if (~has).any():
        lengths, where = np.unique((ends - firsts)[~has], return_index=True)
        plain = np.flatnonzero(~has)[where]
        kept[plain], weight[plain] = True, sums[lengths]
    weight = weight[kept]
    grid = firsts[kept][:, None] + np.arange(SEGMENT)
    inside = grid < ends[kept][:, None]
    grid = np.where(inside, grid, 0)
    row_of = np.full(len(doc), -1)
    row_of[grid[inside]] = np.flatnonzero(inside.ravel())
    use = row_of[at] >= 0
    at, which = row_of[at[use]], which[use]
    y = np.where(inside, tagged[grid], 0.0)
    w, bias, moves = np.zeros(len(kinds)), -4.0, np.zeros((2, 2))
    moves[1, 1] = 0.5
    sizes = [w.size, 1, 4]
    theta, m, v = np.concatenate([w, [bias], moves.ravel()]), np.zeros(sum(sizes)), np.zeros(sum(sizes))
    prior = np.concatenate([w, [0.0], np.zeros(4)])
    scale = 1 / max(weight.sum(), 1e-9)
    before = np.c_[np.zeros(len(y)), y[:, :-1]]
    seen = np.array([[((before == a) & (y == b) & inside).astype(float).sum(1) @ weight for b in (0, 1)] for a in (0, 1)])
    for t in range(1, rounds + 1):
        w, bias, moves = theta[: len(kinds)], theta[len(kinds)], theta[len(kinds) + 1 :].reshape(2, 2)
        local = bias + np.bincount(at, w[which], y.size).reshape(y.shape)
        p, pairs = _dense(local, moves, inside, weight)
        error = (y - p) * inside * weight[:, None]
        up = np.concatenate([np.bincount(which, error.ravel()[at], len(kinds)), [error.sum()], (seen - pairs).ravel()]) * scale * 1000
        up -= 0.02 * (theta - prior)
        m, v = 0.8 * m + 0.2 * up, 0.98 * v + 0.02 * up**2
        theta = theta + 0.25 * (m / (1 - 0.8**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return Field(Table(kinds, theta[: len(kinds)]), float(theta[len(kinds)]), theta[len(kinds) + 1 :].reshape(2, 2))


def _dense(local: np.ndarray, moves: np.ndarray, inside: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 and the weighted sums of expected moves, for sequences side by side.

    Two states need only the ratio of the second's to the first's message.
    """
    n, size = local.shape
    (m00, m01), (m10, m11) = np.exp(moves)
    own, real = np.exp(np.clip(np.ascontiguousarray(local.T), -30, 30)), np.ascontiguousarray(inside.T)
    ahead, back = np.zeros((size + 1, n)), np.ones((size + 1, n))
    for t in range(size):
        r = ahead[t]
        ahead[t + 1] = np.where(real[t], own[t] * (m01 + m11 * r) / (m00 + m10 * r), r)
    for t in range(size - 1, -1, -1):
        x = own[t] * back[t + 1]
        back[t] = np.where(real[t], (m10 + m11 * x) / (m00 + m01 * x), back[t + 1])
    odds = ahead[1:] * back[1:]
    pairs = np.zeros((2, 2))
    for t in range(size):
        x, r = own[t] * back[t + 1], ahead[t]
        w = weight * real[t] / (m00 + m01 * x + m10 * r + m11 * r * x)
        wr, wx = w * r, w * x
        pairs += [[m00 * w.sum(), m01 * wx.sum()], [m10 * wr.sum(), m11 * (wr @ x)]]
    return (odds / (1 + odds)).T, pairs


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic function, by Newton steps that are halved until the penalised loss falls.

    Columns are standardised for the penalty, and the weights sum up to the number of rows, so that neither the size of the
    sample's classes nor separable labels can drive the weights off.
    """
    share = share * len(y) / share.sum()
    mean, sd = np.average(x, axis=0, weights=share), x.std(axis=0)
    mean[0], sd[0] = 0.0, 1.0
    z = (x - mean) / np.maximum(sd, 1e-6)
    penalty = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]

    def loss(t: np.ndarray) -> float:
        m = z @ t
        return float(share @ (np.logaddexp(0, m) - y * m) + 0.5 * (penalty * t) @ t)

    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))
        up = z.T @ (share * (y - p)) - penalty * theta
        bend = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step, size = np.linalg.solve(bend, up), 1.0
        while size > 1e-6 and loss(theta + size * step) > loss(theta):
            size /= 2
        theta = theta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    out = theta / np.maximum(sd, 1e-6)
    out[0] = theta[0] - (out[1:] * mean[1:]).sum()
    return out


@dataclass
class ToxicityModel:
    field: Field | None
    theta: np.ndarray
    constant: float = 0.0

    def score(self, words: Words, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(words.first) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(summed(words, at, p) @ self.theta, -30, 30)))


def _part(words: Words, docs: np.ndarray) -> Words:
    """The words of some of the documents."""
    spans = [slice(words.first[d], words.first[d + 1]) for d in docs]
    pick = np.concatenate([np.arange(s.start, s.stop) for s in spans]) if len(spans) else np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum(np.diff(words.first)[docs])]
    return Words(words.hashes[pick], first, words.begin[pick], words.end[pick], words.data)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 1500, most_bytes: int = 8 << 20, most_features: int = 8000, least: int = 8, odds: float = 2.0, rounds: int = 50, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on documents with a label where learn (a condition on id_col) holds.

    At most `most` ids of each label are taken, the first in the order of their hash; weights make up for that. Of these, a label's
    texts of together at most most_bytes, the shortest ones first, are read by the driver (one at least). The field has at most
    most_features features, those that tell most about the labels; a feature stands in `least` documents of label 1 and
    is exp(odds) times as likely there. Null ids, labels and texts take no part; an id with both labels counts as 1, one
    with several texts has the least of them.
    """
    known = labels.select(F.col(id_col).alias(id_col), F.col(label_col).alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull() & learn)
    known = known.groupBy(id_col).agg((F.max("y") > 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(None, np.zeros(0), float(next(iter(sizes), 0)))
    spark = docs.sparkSession
    taken = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most).collect()]
    if not taken:
        return ToxicityModel(None, np.zeros(0), 0.0)
    ids = spark.createDataFrame(taken, known.schema)  # at most twice `most` rows
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = written(rows.withColumn("bytes", F.octet_length("text")), "toxicity-sample")
    bytes_so_far = F.sum("bytes").over(Window.partitionBy("y").orderBy("bytes", id_col).rowsBetween(Window.unboundedPreceding, 0))
    fits = (bytes_so_far <= most_bytes) | (F.row_number().over(Window.partitionBy("y").orderBy("bytes", id_col)) == 1)
    within = rows.select(id_col, "y", "bytes").withColumn("fits", fits).where("fits").select(id_col)  # of at most twice `most` rows
    sample = rows.join(F.broadcast(within), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).select("y", "text").toArrow()
    y = sample["y"].to_numpy().astype(float)
    n = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return ToxicityModel(None, np.zeros(0), float(y.mean()) if len(y) else 0.0)
    words = words_of(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), ALNUM)
    # Each half weighs as much as the other in the field; in the score, labels count as often as they occur.
    even, true = np.where(y == 1, 1 / n[1], 1 / n[0]) * len(y) / 2, np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    half = np.arange(len(y)) % 2
    x = np.zeros((len(y), 5))
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        model = _train_field(_part(words, own), y[own], even[own], max(3, least // 2), odds, rounds, most_features)
        seen = _part(words, other)
        at, weights = model.events(seen)
        x[other] = summed(seen, at, model.marginals(seen, at, weights))
    fitted = ToxicityModel(_train_field(words, y, even, least, odds, rounds, most_features), _logistic(x, y, true))
    del sample, words, model, seen, at, weights
    release()  # the driver goes on after the fit
    return fitted


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, others: tuple[str, ...] = (), with_spans: bool = True) -> DataFrame:
    """(id_col, *others, score, predicted[, spans]) for every row.

    score: 0 to 1, from the whole text; null and empty texts have the score of a text without words. spans: words whose
    marginal reaches the threshold, neighbours joined: code points, end exclusive, with their highest marginal. Repeated
    rows are scored each; an empty table gives an empty one. Columns that others doesn't list are not carried; the text itself
    may be among others, and goes to the tasks once.
    """
    carried = [c for c in others if c != text_col]
    df = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.col(text_col).alias("_text"))
    place = {c: f"_c{i}" for i, c in enumerate(carried)} | {text_col: "_text"}
    fields = [T.StructField(id_col, df.schema["_id"].dataType), *[T.StructField(c, docs.schema[c].dataType) for c in others], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField("spans", T._parse_datatype_string(SPANS))] * with_spans)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a bounded table of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["spans"].dataType) if with_spans else None
        own: ToxicityModel = sent.value
        for batch in batches:
            for part in slices(batch, "_text"):
                words = words_of(part.column("_text"), ALNUM)
                at, p = np.zeros(0, np.int64), np.zeros(0)
                if own.field is not None:
                    at, weights = own.field.events(words)
                    p = own.field.marginals(words, at, weights)
                scores = own.score(words, at, p)
                out = [part.column("_id"), *[part.column(place[c]) for c in others], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                if with_spans:
                    out.append(pa.array(_spans(words, at, p, threshold, text_lengths(part.column("_text"))), kind))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return small_batches(df).mapInArrow(run, schema)


def _spans(words: Words, at: np.ndarray, p: np.ndarray, threshold: float, lengths: np.ndarray) -> list[list[dict]]:
    """By text: ranges of neighbouring words whose marginal reaches the threshold."""
    spans: list[list[dict]] = [[] for _ in lengths]
    hot = np.flatnonzero(p >= threshold)
    if not len(hot):
        return spans
    points = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)]
    heads = points[np.r_[0, np.cumsum(lengths)]]
    last = -2
    for i in hot.tolist():
        w = int(at[i])
        d = int(np.searchsorted(words.first, w, "right")) - 1
        a, b = int(points[words.begin[w]] - heads[d]), int(points[words.end[w]] - heads[d])
        if spans[d] and w == last + 1:
            spans[d][-1]["end"], spans[d][-1]["probability"] = b, max(spans[d][-1]["probability"], float(p[i]))
        else:
            spans[d].append({"start": a, "end": b, "probability": float(p[i])})
        last = w
    return spans


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
