"""Search plans: hybrid retrieval and the flows built on it.

``index`` holds the BM25 tables, ``vectors`` the chunk vectors, ``chunks`` the
chunk table. ``embed`` is a function that adds a ``vector`` column to a frame of
(query_id, sub, pergunta): the caller's model or a lookup table. ``reranker`` is
what operators.fusion.rerank takes.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from claimlens.functions import fixed_values as fv, questions as Q, rules as R
from claimlens.functions.codes import as_col
from claimlens.functions.text import drop_context_prefix, first_line, page_number, truncate
from claimlens.operators import bm25, claim_text, fusion, vector
from claimlens.operators.catalog import growing, top_n
from claimlens.session import shared_dir, write_once

FILTERS = ("ano", "tipo")


@dataclass
class Corpus:
    """What a search runs on."""

    chunks: DataFrame
    index: dict
    vectors: DataFrame
    embed: Callable
    reranker: object = None
    parent_map: DataFrame = None


def with_filters(questions, text="pergunta"):
    """Year and type asked for in the text, as per-question filters (NULL = any)."""
    return questions.withColumn("f_ano", Q.year_filter(text)).withColumn("f_tipo", Q.type_filter(text))


def expand(questions, decompose=True, text="pergunta"):
    """One row per sub-question: (query_id, sub, pergunta, f_ano, f_tipo)."""
    parts = Q.sub_questions(text) if decompose else F.array(as_col(text))
    return with_filters(questions, text).select(
        "query_id", "f_ano", "f_tipo", F.posexplode(parts).alias("sub", "pergunta"))


def hybrid(questions, c: Corpus, n=5, decompose=True, parents=True, fusion_mode="concat"):
    """BM25 and vector candidates per sub-question, fused, reranked, lifted to parents.

    Result: query_id, id, score, score_kind, posicao. Short questions keep their
    fused scores.
    """
    subs = expand(questions, decompose)
    keys = ["query_id", "sub"]
    words = bm25.search(subs, c.index, keys=keys, filters=FILTERS)
    near = vector.search(c.embed(subs), c.vectors, keys=keys, filters=FILTERS)
    lists = words.withColumn("lista", F.lit("bm25")).unionByName(near.withColumn("lista", F.lit("vetor")))
    fused = fusion.reciprocal_rank_fusion(lists, fusion=fusion_mode)
    order = [F.desc("score"), "id"]
    pool = top_n(fused, "query_id", order, max(fv.MIN_RERANK_POOL, 3 * n)).drop("posicao")
    if c.reranker is None:
        scored = pool.withColumn("score_kind", F.lit("rrf"))
    else:
        # one path for short and long questions, so that the retrieval runs once
        # the scorer sees question and chunk text
        asked = questions.select("query_id", "pergunta", Q.is_short("pergunta").alias("short"))
        texts = c.chunks.select("id", "texto")
        both = fusion.rerank_scores(pool.join(asked, "query_id").join(texts, "id", "left"), c.reranker)
        has_text = F.coalesce("texto", F.lit("")) != ""
        usable = F.when(F.col("short"), F.col("score")).when(has_text, F.col("rerank").cast("double"))
        scored = both.withColumn("score_kind", F.when(F.col("short"), "rrf").otherwise("rerank")).withColumn(
            "score", usable).where("score is not null")
    kept = top_n(scored.select("query_id", "id", "score", "score_kind"), "query_id", order, 2 * n).drop("posicao")
    if parents and c.parent_map is not None:
        kept = fusion.resolve_parents(kept, c.parent_map, carry=["score_kind"])
    known = kept.join(c.chunks.select("id"), "id", "left_semi")
    return top_n(known, "query_id", order, n)


def vector_only(questions, c: Corpus, n=5, hints=True, repeated=False):
    """Vector search alone, the question followed by its hint if it has one.

    ``repeated``: many questions may have the same vector; each distinct one is searched once.
    """
    q = questions.withColumn("sub", F.lit(0))
    if hints:
        q = q.withColumn("pergunta", Q.with_hint("pergunta"))
    if not repeated:
        return vector.search(c.embed(q), c.vectors, n=n)
    # written, so that hints are looked for once and few vectors are known to be few; vectors are told apart by 128 bits
    folder = shared_dir(questions.sparkSession, "question-vectors")
    asked = c.embed(write_once(q.select("query_id", "sub", "pergunta"), f"{folder}/asked"))
    keyed = asked.select("query_id", *[F.xxhash64(F.lit(k), "vector").alias(f"v{k}") for k in (1, 2)])
    heads = write_once(keyed.groupBy("v1", "v2").agg(F.min("query_id").alias("head")), f"{folder}/heads")
    one = asked.select(F.col("query_id").alias("head"), "vector").join(heads.select("head"), "head", "left_semi")
    hits = write_once(vector.search(one, c.vectors, n=n, keys=("head",)), f"{folder}/hits")
    return keyed.join(heads, ["v1", "v2"]).join(hits, "head").select("query_id", "id", "score", "posicao")


def search(questions, c: Corpus, n=5, mode="hybrid", **options):
    return hybrid(questions, c, n, **options) if mode == "hybrid" else vector_only(questions, c, n, **options)


def present(results, chunks, text="texto"):
    """Results with section, first title line, page and text (context prefix removed)."""
    view = chunks.select("id", F.col("secao"), first_line("titulo").alias("titulo"),
                         page_number("pagina").alias("pagina"), drop_context_prefix(text).alias("texto"))
    return results.join(view, "id")


def search_texts(requests, c: Corpus, n, mode="hybrid", decompose=False):
    """Search the questions of (request_id, ordem, pergunta), each distinct text once.

    Requests repeat questions a great deal (claims of one ward share most of
    theirs), so the text itself is the search key and hits are joined back.
    """
    spark = requests.sparkSession
    # written once: deriving questions is costly, and the hits meet them again; the vector search looks at the texts more than once
    folder = shared_dir(spark, "questions")
    asked = write_once(requests.select("request_id", "ordem", "pergunta"), f"{folder}/asked")
    # a number stands for the text wherever rows are sorted or shuffled
    texts = write_once(asked.select("pergunta").distinct().withColumn("query_id", F.monotonically_increasing_id()), f"{folder}/texts")
    if mode == "hybrid" and isinstance(c.reranker, DataFrame) and "pergunta" not in c.reranker.columns:
        raise ValueError("a frame of scores for questions of requests needs the key pergunta")
    options = {"decompose": decompose} if mode == "hybrid" else {"repeated": True}
    hits = search(texts, c, n, mode, **options).select("query_id", "id", "score")
    found = texts.select("pergunta", "query_id").join(growing(hits), "query_id").drop("query_id")
    return asked.join(growing(found), "pergunta")


def multi_query(requests, c: Corpus, n_per_query=3, keep="best", limit=None, decompose=False, mode="hybrid"):
    """Several questions per request: best score per chunk, or the first one seen.

    ``requests``: request_id, ordem, pergunta. ``relevancia`` has three digits; the
    question a chunk came from is kept, cut to its display length.
    """
    rows = search_texts(requests, c, n_per_query, mode, decompose).select(
        "request_id", "id", "score", "ordem",
        F.substring("pergunta", 1, fv.ORIGIN_QUERY_CHARS).alias("query_origem"))
    merged = fusion.merge_results(rows, ("request_id",), keep=keep).withColumn("relevancia", F.round("score", 3))
    if limit:
        return top_n(merged, "request_id", [F.desc("score"), "id"], limit)
    return merged


def with_retry(questions, c: Corpus, first, n_retry=5, retry_below=fv.RETRY_RELEVANCE,
               keep_from=fv.KEEP_RELEVANCE, mode="vector"):
    """Search again with rewrites where the first results are weak.

    ``first``: results of the questions. Only weak questions are searched again;
    new ids are added (the first score seen counts), the threshold is applied
    again, and a warning is set per question. The first search is evaluated once: what is
    kept of it is written, and the weak questions, the pool and the warnings read that.
    """
    folder = shared_dir(questions.sparkSession, "retry")
    kept = write_once(fusion.keep_relevant(first, threshold=keep_from), f"{folder}/kept")
    best = questions.select("query_id").join(
        kept.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    weak = best.where(F.coalesce("best", F.lit(0.0)) < retry_below).select("query_id")
    rewrites = questions.join(weak, "query_id", "left_semi").select(
        F.col("query_id").alias("request_id"), F.posexplode(Q.reformulations("pergunta")).alias("ordem", "pergunta")
    ).where("ordem > 0")
    again = search_texts(rewrites, c, n_retry, mode).select(
        F.col("request_id").alias("query_id"), "id", "score", "ordem")
    pooled = kept.select("query_id", "id", "score").withColumn("ordem", F.lit(0)).unionByName(again)
    merged = fusion.merge_results(pooled, keep="first").drop("ordem")
    final = write_once(fusion.keep_relevant(merged, threshold=keep_from), f"{folder}/final")
    stats = questions.select("query_id").join(
        final.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n")), "query_id", "left")
    top = F.coalesce("best", F.lit(0.0))
    warn = stats.select("query_id", F.when(
        top < retry_below, F.format_string(fv.WARN_LOW, F.bround(top * 100, 0).cast("int")))
        .when(F.coalesce("n", F.lit(0)) < 2, fv.WARN_FEW).otherwise("").alias("aviso"))
    return final, warn


# --- rules and claims ------------------------------------------------------------------
def map_rules(rules, c: Corpus, folder, n=3):
    """The n best chunks of every rule by its enriched name, written to ``folder`` and read back.

    Rules share names: each distinct one is searched once, and the few hits of each name
    get their section before they meet the rules. Vectors may be there without their chunk:
    such a hit counts for the rule (``mapped_share``), but has no section (``achado`` is false).
    Result: numero, codigo, nome, id, score, posicao, secao, pagina, achado.
    """
    named = rules.select("numero", "codigo", "nome", R.enriched_name("nome").alias("pergunta"))
    # written once: the vector search looks at the questions more than once
    texts = write_once(named.select("pergunta").distinct(), shared_dir(rules.sparkSession, "rule-names"))
    hits = vector.search(c.embed(texts), c.vectors, n=n, keys=("pergunta",))
    placed = hits.join(c.chunks.select("id", "secao", "pagina", F.lit(True).alias("achado")), "id", "left")
    # written, so that its true size is known and not the many rules are taken for the small side
    placed = write_once(placed.withColumn("achado", F.coalesce("achado", F.lit(False))), shared_dir(rules.sparkSession, "rule-hits"))
    return write_once(named.join(placed, "pergunta").drop("pergunta"), folder)


def mapped_share(rule_map, above=0.5):
    """Mapped rules, and the share whose best chunk scores above a threshold."""
    best = rule_map.where("posicao = 1")
    return best.agg(F.count("*").alias("n"), F.avg((F.col("score") > above).cast("double")).alias("share"))


def rule_sections(rule_map, chunks, max_chars=None):
    """The sections of a stored rule map with the context of their first chunk."""
    first = chunks.groupBy("secao").agg(F.min_by("contexto", "id").alias("texto"))
    found = rule_map.where("achado").select("numero", "codigo", "nome", "secao").distinct().join(first, "secao", "left")
    return found.withColumn("texto", truncate("texto", max_chars)) if max_chars else found


def claim_search(claims, c: Corpus, n_per_query=3, limit=12, mode="vector", decompose=False, secondaries=None):
    """Chunks for each claim text (claim_id, texto): the questions that it gives rise to,
    the first score seen per chunk, the best ``limit`` of them."""
    asked = claims.select(F.col("claim_id").alias("request_id"), F.posexplode(
        Q.claim_questions(claim_text.parse_claim("texto"), secondaries)).alias("ordem", "pergunta"))
    return multi_query(asked, c, n_per_query, keep="first", limit=limit, decompose=decompose, mode=mode).withColumnRenamed("request_id", "claim_id")
