"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

A token (a run of letters and digits, or of other marks) falls into one of BUCKETS by
hash. A bucket's vector is the sum of the sparse random index vectors of the tokens
around its occurrences, over all documents; its table has a fixed size. A document is
the mean, the spread and the neighbour products of its tokens' vectors. A tanh layer
and a logistic output are trained in numpy on labelled documents; a temperature
fitted on labelled documents set aside calibrates the probability.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.session import write_once

from . import text_arrays as T
from .language_id import remainder
from .work import folder

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 32, 4, 2
#: Labelled documents that the network is fitted on (those with the smallest hash of their id).
FIT_DOCS = 20_000
HIDDEN, EPOCHS, RATE = 24, 30, 0.003
THRESHOLD = 0.7
_KIND = np.full(256, 1, np.uint8)
_KIND[T.SPACE] = 0
for _c in range(33, 128):
    if not chr(_c).isalnum():
        _KIND[_c] = 2


def index_vectors():
    """(BUCKETS, NONZERO) places and signs."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(raw, off, i, j):
    """Bucket and row number of every token of rows i..j-1."""
    data = T.LOWER[raw[off[i]: off[j]]]
    rel = (off[i: j + 1] - off[i]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[rel] = True
    cut = np.flatnonzero(edge)
    keep = kind[cut[:-1]] > 0
    start, end = cut[:-1][keep], cut[1:][keep]
    h = T.span_hash(T.prefix_hash(data), start, end)
    return (h >> np.uint64(50)).astype(np.int64), np.searchsorted(rel, start, side="right") - 1


def _contexts(batches):
    place, sign = index_vectors()
    total, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
    for batch in batches:
        raw, off = T.utf8(batch.column(0))
        for i, j in T.blocks(off):
            b, doc = tokens(raw, off, i, j)
            count += np.bincount(b, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                near = np.flatnonzero(doc[step:] == doc[:-step])
                for here, there in ((b[near], b[near + step]), (b[near + step], b[near])):
                    for k in range(NONZERO):
                        total += np.bincount(here * DIM + place[there, k], sign[there, k], BUCKETS * DIM)
    rows = np.hstack([count[:, None], total.reshape(BUCKETS, DIM)])
    for piece in range(64):
        part = rows[piece * (BUCKETS // 64): (piece + 1) * (BUCKETS // 64)]
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary())], ["piece", "v"])


def _add(batches):
    total = {}
    for batch in batches:
        for piece, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(v, "<f4").astype(float)
            total[piece] = total[piece] + v if piece in total else v
    for piece, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([v.astype("<f4").tobytes()], pa.binary())], ["piece", "v"])


def word_vectors(docs, text_col="text"):
    """(BUCKETS, DIM): unit vectors, centred and damped by frequency; from all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_contexts, "piece int, v binary")
    n = max(1, spark.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "piece").mapInArrow(_add, "piece int, v binary")
    table = np.zeros((BUCKETS, 1 + DIM))
    for piece, v in rows.collect():
        table[piece * (BUCKETS // 64): (piece + 1) * (BUCKETS // 64)] += np.frombuffer(v, "<f4").reshape(-1, 1 + DIM)
    count, vec = table[:, 0], table[:, 1:]
    vec = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    share = count / max(1.0, count.sum())
    vec = vec - (share[:, None] * vec).sum(0)
    return (vec * np.sqrt(1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pooled(vec, b, doc, rows):
    """Mean, spread, neighbour products and length of each row's vectors."""
    n = np.bincount(doc, minlength=rows).astype(float)
    first = np.concatenate(([0], np.cumsum(n))).astype(np.int64)

    def mean(x, f, m):
        c = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)))
        return (c[f[1:]] - c[f[:-1]]) / np.maximum(m, 1)[:, None]

    v = vec[b]
    m = mean(v, first, n)
    spread = np.sqrt(np.maximum(mean(v * v, first, n) - m * m, 0))
    pair = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    near = v[1:][pair] * v[:-1][pair] if len(doc) else v
    k = np.bincount(doc[1:][pair] if len(doc) else doc, minlength=rows).astype(float)
    product = mean(near, np.concatenate(([0], np.cumsum(k))).astype(np.int64), k)
    same = np.bincount(doc[1:][pair], (b[1:] == b[:-1])[pair].astype(float), rows) if len(doc) else np.zeros(rows)
    return np.hstack([m, spread, product, (same / np.maximum(k, 1))[:, None], np.log1p(n)[:, None]]).astype("<f4")


def _features(vectors):
    def run(batches):
        vec = vectors.value
        for batch in batches:
            raw, off = T.utf8(batch.column(1))
            for i, j in T.blocks(off):
                b, doc = tokens(raw, off, i, j)
                x = pooled(vec, b, doc, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())],
                                                 ["doc_id", "held_out", "x"])
    return run


class Network:
    """tanh layer and logistic output, trained with Adam; then a temperature."""

    def __init__(self, x, y, seed=3):
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        hold, fit = order[: len(x) // 5], order[len(x) // 5:]
        z = (x - self.mean) / self.std
        w = {"a": rng.normal(0, 0.2, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
        m, s, t = {k: 0 * v for k, v in w.items()}, {k: 0 * v for k, v in w.items()}, 0
        for _ in range(EPOCHS):
            for i in range(0, len(fit), 128):
                at = fit[(i + rng.integers(0, 128)) % len(fit): ][:128] if len(fit) < 128 else fit[i: i + 128]
                h = np.tanh(z[at] @ w["a"] + w["b"])
                e = (1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -30, 30))) - y[at]) / len(at)
                g = {"c": h.T @ e, "d": e.sum(keepdims=True)}
                back = np.outer(e, w["c"]) * (1 - h * h)
                g |= {"a": z[at].T @ back + 1e-4 * w["a"], "b": back.sum(0)}
                t += 1
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
            fit = rng.permutation(fit)
        self.w, self.temperature = w, 1.0
        if len(hold):
            logit, target = self.logit(x[hold]), y[hold]
            grid = np.geomspace(0.3, 5, 40)
            loss = [np.mean(np.logaddexp(0, np.where(target > 0.5, -logit, logit) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x):
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.tanh(z @ self.w["a"] + self.w["b"]) @ self.w["c"] + self.w["d"]

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _scores(model):
    def run(batches):
        net = model.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(float)
            s = net.score(x) if net and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])
    return run


def quality_scores(docs, labels, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality", fit_docs=FIT_DOCS):
    """``doc_id, held_out, score, predicted`` for every row.

    Null and empty texts are scored as texts without tokens. Contradicting labels
    count as 0, null labels are ignored, and without labels of both kinds every score
    is 0.5. Rows that repeat an id are scored each for itself; a null id is not held out.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"))
    x = write_once(src.mapInArrow(_features(vectors), f"doc_id {kind}, held_out boolean, x binary"), folder(spark, "op8-features"))
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    fit = (x.filter(~F.col("held_out")).join(known, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
           .limit(fit_docs).select("x", "y").toArrow())
    net = None
    if fit.num_rows:
        rows = np.frombuffer(b"".join(fit["x"].to_pylist()), "<f4").reshape(fit.num_rows, -1).astype(float)
        y = fit["y"].to_numpy()
        net = Network(rows, y) if 0 < y.sum() < len(y) else None
    model = spark.sparkContext.broadcast(net)
    return x.mapInArrow(_scores(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
