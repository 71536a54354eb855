"""Cosine top-k for many query vectors at once: exact, or through trained cells.

Every task multiplies a block of documents with the questions that come to it and emits
only the best k per question; pairs are never materialised, and no cross join is planned
(operators.blocks). Exact search has one cell that every question asks for. A cell index
sorts the vectors by the nearest of a bounded number of trained centroids; a question then
only goes to its nearest cells, where scores are exact again.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimlens.functions import fixed_values as fv
from claimlens.operators.blocks import meet
from claimlens.operators.catalog import top_n
from claimlens.session import write_once

DOC_BLOCK, QUERY_BLOCK = 20000, 20000
#: Cells of an index at most, vectors per cell that the centroids are trained on at most, rounds of training.
MAX_CELLS, TRAIN_ROWS, TRAIN_ROUNDS = 4096, 64, 10
#: Share of the nearest TARGET_TOP neighbours that the cells a question visits shall hold, measured on so many training rows.
TARGET, TARGET_TOP, TARGET_ROWS = 0.93, 20, 500
#: Products per step of a task.
_STEP = 1_000_000
_DIGITS = 12


def _matrix(column):
    """Rows of length one of an Arrow list column; a zero vector stays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def _row_topk(sims, k):
    """(row, column) positions of the k best per row; equal scores by column order.

    Rows are cut with a partial sort; the few with ties at the cut get a full stable one.
    """
    n_rows, n_cols = sims.shape
    if n_cols <= k:
        cols = np.argsort(-sims, axis=1, kind="stable")
        return np.repeat(np.arange(n_rows), n_cols), cols.ravel()
    cand = np.sort(np.argpartition(-sims, k - 1, axis=1)[:, :k], axis=1)
    kept = np.take_along_axis(sims, cand, axis=1)
    tied = (sims >= kept.min(axis=1, keepdims=True)).sum(axis=1) > k
    cols = np.take_along_axis(cand, np.argsort(-kept, axis=1, kind="stable"), axis=1)
    if tied.any():
        cols[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(n_rows), k), cols.ravel()


def _texts(column):
    return np.array([x or "" for x in column.to_pylist()], object)


def _block_topk(keys, filters, k):
    """The scorer of ``meet``: best k documents of a block for each question.

    Questions with the same filter values share one matrix product.
    """
    def block(parts):
        docs = pa.Table.from_batches(parts)
        unit = _matrix(docs.column("v"))
        ids = docs.column("id").combine_chunks()
        meta = {c: _texts(docs.column(f"f_{c}")) for c in filters}
        chosen = {}

        def columns(wants):
            if wants not in chosen:
                ok = np.ones(len(unit), bool)
                for c, want in zip(filters, wants, strict=True):
                    if want is not None:
                        ok &= meta[c] == want
                chosen[wants] = np.flatnonzero(ok)
            return chosen[wants]

        def ask(batch):
            wants = list(zip(*[batch.column(f"f_{c}").to_pylist() for c in filters], strict=True)) if filters else [()] * batch.num_rows
            groups = {}
            for i, w in enumerate(wants):
                groups.setdefault(w, []).append(i)
            q = _matrix(batch.column("v"))
            rows, hits, sims = [], [], []
            for w, members in groups.items():
                cols = columns(w)
                if not len(cols):
                    continue
                members, d = np.array(members), unit[cols].T
                step = max(1, _STEP // len(cols))
                for i in range(0, len(members), step):
                    part = members[i:i + step]
                    s = np.round(q[part] @ d, _DIGITS)
                    r, c = _row_topk(s, k)
                    rows.append(part[r])
                    hits.append(cols[c])
                    sims.append(s[r, c])
            if not rows:
                return None
            at = pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in keys], ids.take(pa.array(np.concatenate(hits))), pa.array(np.concatenate(sims))],
                [*keys, "id", "score"])
        return ask
    return block


def _near(q, d, keys, filters, n, doc_block, query_block):
    """Best n per question of the documents in its cells; both sides have ``cell``."""
    kinds = dict(q.dtypes), dict(d.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[0][k]}" for k in keys], f"id {kinds[1]['id']}", "score double"])
    f = [f"f_{c}" for c in filters]
    doubles = lambda c: F.col(c).cast("array<double>").alias("v")
    stored = d.where("embedding is not null").select("cell", "id", doubles("embedding"), *[F.col(c).cast("string").alias(f"f_{c}") for c in filters])
    asked = q.where("vector is not null").select("cell", *keys, doubles("vector"), *[F.col(c).cast("string").alias(c) for c in f])
    best = meet(stored, asked, keys, doc_block, query_block, _block_topk(keys, filters, n), schema, order=["id"])
    return top_n(best, keys, [F.desc("score"), "id"], n)


def search(queries, vectors, n=fv.CANDIDATES_PER_RETRIEVER, keys=("query_id",), filters=(),
           doc_block=DOC_BLOCK, query_block=QUERY_BLOCK):
    """Best n vectors per query by cosine similarity.

    ``queries``: keys, vector and optional ``f_x`` filters (NULL = any);
    ``vectors``: id, embedding and the metadata columns that are filtered on, or a
    ``CellIndex`` of them. Rows without a vector are not found and find nothing.
    """
    if isinstance(vectors, CellIndex):
        return search_cells(queries, vectors, n, keys, filters, doc_block=doc_block, query_block=query_block)
    one = F.lit(0).alias("cell")
    return _near(queries.select("*", one), vectors.select("*", one), list(keys), list(filters), n, doc_block, query_block)


# --- cells ------------------------------------------------------------------------------
@dataclass
class CellIndex:
    """Centroids (a matrix of MAX_CELLS rows at most), the vectors with their cell, cells that a question visits."""

    centroids: np.ndarray
    vectors: DataFrame
    probes: int


def _train(rows, cells, rounds):
    """Centroids of unit rows, starting from rows far from those taken before; no randomness."""
    taken, near = [0], rows @ rows[0]
    while len(taken) < min(cells, len(rows)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[taken[-1]])
    c = rows[taken]
    for _ in range(rounds):
        cell = _nearest(rows, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, cell, rows)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), c)
    return c


def _nearest(rows, centroids, k):
    out = [np.argsort(-np.round(rows[i:i + 2000] @ centroids.T, _DIGITS), axis=1, kind="stable")[:, :k] for i in range(0, len(rows), 2000)]
    return np.concatenate(out) if out else np.zeros((0, k), int)


def _probes(rows, centroids, target):
    """Cells to visit so that training rows find ``target`` of their nearest neighbours among the training rows."""
    q = np.unique(np.linspace(0, len(rows) - 1, min(TARGET_ROWS, len(rows))).astype(int))
    cell, order = _nearest(rows, centroids, 1)[:, 0], _nearest(rows[q], centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    sims = rows[q] @ rows.T
    sims[np.arange(len(q)), q] = -2
    k = min(TARGET_TOP, len(rows) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    visits = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(visits[min(len(visits) - 1, math.ceil(target * len(visits)) - 1)]) + 1


def _to_cells(df, column, centroids, k):
    """One row per row of ``df`` and each of its k nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_matrix(batch.column(column)), shared.value, k)
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                out = batch.take(at)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype("int32"))], [*out.schema.names, "cell"])

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*df.schema.fields]).add("cell", IntegerType())
    return df.mapInArrow(run, schema)


def build_cells(vectors, folder, cells=None, train_rows=TRAIN_ROWS, rounds=TRAIN_ROUNDS, target=TARGET):
    """Writes a cell index below ``folder``: every vector, by its nearest centroid.

    The centroids are trained on ``train_rows`` vectors per cell, taken by a hash of their
    id (a bounded sample: MAX_CELLS times that at most); the default number of cells is the
    square root of the number of vectors. A cell of any size is searched in blocks, so
    very uneven cells are no problem. How many cells a question visits is measured on the
    same sample: few where vectors form clusters, about half of all where they have no
    structure. As the sample is thinner than the table, it asks for too many rather than too few.
    """
    spark = vectors.sparkSession
    d = vectors.where("embedding is not null")
    total = d.count()
    cells = max(1, min(MAX_CELLS, cells or round(math.sqrt(total))))
    want = train_rows * cells
    order = F.xxhash64("id")
    picked = d if total <= want else d.where(F.pmod(order, F.lit(total)) < want)
    rows = picked.select(order.alias("h"), F.col("embedding").cast("array<double>").alias("v")).orderBy("h").limit(2 * want).toArrow()
    centroids, probes = np.zeros((1, 1)), 1
    if rows.num_rows:
        unit = _matrix(rows.column("v"))
        centroids = _train(unit, cells, rounds)
        probes = _probes(unit, centroids, target)
    spark.createDataFrame([(i, probes, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, probes int, v array<double>").write.mode("overwrite").parquet(f"{folder}/cells")
    placed = _to_cells(d, "embedding", centroids, 1) if rows.num_rows else d.withColumn("cell", F.lit(0))
    # a large cell goes to several files
    spread = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(total / cells / DOC_BLOCK))))
    write_once(placed.repartition("cell", spread), f"{folder}/vectors", ["cell"])
    return read_cells(spark, folder)


def read_cells(spark, folder):
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    return CellIndex(np.array([r["v"] for r in rows]), spark.read.parquet(f"{folder}/vectors"), rows[0]["probes"])


def search_cells(queries, index, n=fv.CANDIDATES_PER_RETRIEVER, keys=("query_id",), filters=(), probes=None,
                 doc_block=DOC_BLOCK, query_block=QUERY_BLOCK):
    """Best n vectors per query among those of its ``probes`` nearest cells.

    By default as many as the index measured; as many probes as cells give the exact result.
    Filters apply within the visited cells.
    """
    probes = min(len(index.centroids), probes or index.probes)
    asked = _to_cells(queries.where("vector is not null"), "vector", index.centroids, probes)
    # only the folders of cells that some question visits are read (one row per cell)
    seen = F.broadcast(asked.select("cell").distinct())
    return _near(asked, index.vectors.join(seen, "cell", "left_semi"), list(keys), list(filters), n, doc_block, query_block)


def recall(found, exact, keys=("query_id",)):
    """``n`` exact hits and the share of them that was found."""
    both = exact.select(*keys, "id").join(found.select(*keys, "id", F.lit(1).alias("hit")), [*keys, "id"], "left")
    return both.agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))


def centroids(vectors, group):
    """Mean vector per group, component by component (combines on the map side)."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(group).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
