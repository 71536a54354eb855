"""Retrieval metrics: Recall@K, MRR, comparison of pipelines."""

from pyspark.sql import functions as F


def query_metrics(results, qrels, questions, pipelines, ks=(5, 10)):
    """Per pipeline and question: recall at each k, reciprocal rank, hit in the top 5.

    ``pipelines``: the names to report (a pipeline may find nothing); ``results``: pipeline, query_id, secao, posicao; ``qrels``: query_id, secao
    (expected); ``questions``: all query_ids. Recall counts distinct sections; a
    question without expected sections has recall 1.
    """
    expected = qrels.select("query_id", "secao").distinct()
    n_expected = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    best = results.groupBy("pipeline", "query_id", "secao").agg(F.min("posicao").alias("posicao"))
    hits = best.join(expected, ["query_id", "secao"]).groupBy("pipeline", "query_id").agg(
        F.min("posicao").alias("first"),
        *[F.count_if(F.col("posicao") <= k).alias(f"found_{k}") for k in ks])
    grid = questions.select("query_id").distinct().withColumn(
        "pipeline", F.explode(F.array(*[F.lit(p) for p in pipelines])))
    df = grid.join(n_expected, "query_id", "left").join(hits, ["pipeline", "query_id"], "left")
    recall = lambda k: F.when(F.col("n_expected").isNull(), 1.0).otherwise(
        F.coalesce(F.col(f"found_{k}"), F.lit(0)) / F.col("n_expected")).alias(f"recall_{k}")
    return df.select("pipeline", "query_id", *[recall(k) for k in ks],
                     F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
                     F.coalesce(F.col("first") <= 5, F.lit(False)).alias("hit"))


def pipeline_metrics(per_query, ks=(5, 10)):
    """Mean of every metric per pipeline."""
    names = [f"recall_{k}" for k in ks] + ["mrr"]
    return per_query.groupBy("pipeline").agg(*[F.avg(c).alias(c) for c in names])


def compare_pipelines(per_query, base, other, ks=(5, 10)):
    """Metric, base, other and delta, one row per metric (one aggregation, no self-join)."""
    names = [f"recall_{k}" for k in ks] + ["mrr"]
    pick = lambda p, c: F.avg(F.when(F.col("pipeline") == p, F.col(c)))
    wide = per_query.agg(*[pick(p, c).alias(f"{s}_{c}") for s, p in (("a", base), ("b", other)) for c in names])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("metrica"), F.col(f"a_{c}").alias("base"), F.col(f"b_{c}").alias("outro")) for c in names]))
    return wide.select(rows.alias("m")).select("m.metrica", "m.base", "m.outro", (F.col("m.outro") - F.col("m.base")).alias("delta"))


def hit_changes(per_query, base, other):
    """Per question: found by the other pipeline only, by the base only, by both or by none."""
    got = lambda p: F.bool_or((F.col("pipeline") == p) & F.col("hit"))
    g = per_query.groupBy("query_id").agg(got(base).alias("a"), got(other).alias("b"))
    return g.select("query_id", F.when(F.col("b") & ~F.col("a"), "+NEW").when(F.col("a") & ~F.col("b"), "-LOST")
                    .when(F.col("a") & F.col("b"), "both").otherwise("none").alias("hit"))
