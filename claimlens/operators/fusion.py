"""Combining ranked lists: reciprocal rank fusion, reranking, parents, relevance."""

from pyspark.sql import functions as F, Window as W

from claimlens.functions import fixed_values as fv
from claimlens.operators.catalog import top_n

ROUND = 12


def reciprocal_rank_fusion(lists, keys=("query_id",), k=fv.RRF_K, fusion="concat"):
    """Fuse ranked lists of (keys, lista, sub, id, score).

    ``concat`` ranks all sub-lists of one retriever as one list, in the order of
    ``sub``: ranks run on, and an id found by several sub-questions adds up.
    ``per_list`` ranks every sub-list on its own. The lists are already cut to
    the candidate limit, so a window group stays small.
    """
    keys = list(keys)
    group = [*keys, "lista"] + ([] if fusion == "concat" else ["sub"])
    w = W.partitionBy(*group).orderBy("sub", F.desc("score"), "id")
    ranked = lists.withColumn("_rank", F.row_number().over(w))
    return ranked.groupBy(*keys, "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.col("_rank") + F.lit(k))), ROUND).alias("score"))


def rerank_scores(candidates, scores, keys=("query_id",)):
    """Candidates with a ``rerank`` column, NULL where the reranker gives none.

    ``scores``: a frame of (keys, id, rerank) or of (pergunta, id, rerank), or a function
    that adds the column to the candidates (for example a pandas UDF over ``pergunta``
    and ``texto``, which the search flows put beside the ids).
    """
    if callable(scores):
        return scores(candidates)
    if "pergunta" in scores.columns:
        keys = ("pergunta",)
    return candidates.join(scores.select(*keys, "id", "rerank"), [*keys, "id"], "left")


def rerank(candidates, scores, keys=("query_id",), top=10):
    """Replace scores by those of a reranker; candidates without one drop out. Without
    a reranker the candidates are only cut."""
    if scores is not None:
        candidates = rerank_scores(candidates, scores, keys).where("rerank is not null").withColumn(
            "score", F.col("rerank").cast("double")).drop("rerank")
    return top_n(candidates, list(keys), [F.desc("score"), "id"], top).drop("posicao")


def resolve_parents(results, parent_map, keys=("query_id",), carry=()):
    """Child ids to parent ids (unmapped ids stay), best score per parent."""
    keys = list(keys)
    up = results.join(parent_map.select("id", "parent_id"), "id", "left")
    return up.groupBy(*keys, *carry, F.coalesce("parent_id", "id").alias("id")).agg(F.max("score").alias("score"))


def keep_relevant(results, keys=("query_id",), threshold=fv.KEEP_RELEVANCE):
    """Rows at or above the threshold; all rows of a question that has none."""
    # a question has as many results as its limit, so the groups are small and the results are evaluated once
    best = F.max(F.coalesce("score", F.lit(0.0))).over(W.partitionBy(*keys))
    keep = (F.coalesce("score", F.lit(0.0)) >= threshold) | (F.col("_best") < threshold)
    return results.withColumn("_best", best).where(keep).drop("_best")


def merge_results(results, keys=("query_id",), order="ordem", keep="best"):
    """One row per id over several questions: the best score, or the first one seen."""
    keys = list(keys)
    rest = [c for c in results.columns if c not in [*keys, "id"]]
    rank = (F.struct((-F.col("score")).alias("_o"), F.col(order).alias("_i")) if keep == "best"
            else F.struct(F.col(order).alias("_o"), (-F.col("score")).alias("_i")))
    one = results.groupBy(*keys, "id").agg(F.min_by(F.struct(*rest), rank).alias("_r"))
    return one.select(*keys, "id", *[F.col(f"_r.{c}").alias(c) for c in rest])
