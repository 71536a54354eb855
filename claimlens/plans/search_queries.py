"""Registered queries: BM25, vectors, fusion, hybrid flows, evaluation, streaming."""

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv, rules as R
from claimlens.operators import bm25, evaluation as E, fusion as U, vector as W
from claimlens.plans import search as S, text_views as V
from claimlens.plans.oracle_views import view
from claimlens.plans.registry import query
from claimlens.plans.text_queries import CLAIM_Q, ENRICH
from claimlens.session import shared_dir
from claimlens.streaming import claims as stream_claims, documents as stream_documents

r6 = lambda c: F.round(c, 6).alias(c)


_STORED = {}


def index(b):
    """The stored corpus index: written by the first search of a session, read by all later ones."""
    key = (b.spark.sparkContext.applicationId, b.dir)
    if key not in _STORED:
        folder = shared_dir(b.spark, "bm25")
        bm25.build_index(b.chunks, meta=S.FILTERS, folder=folder, source="fonte")
        _STORED[key] = folder
    return bm25.read_index(b.spark, _STORED[key])


def corpus(b, rerank=True, words=True):
    return S.Corpus(b.chunks, index(b) if words else None, b.vectors, b.embed,
                    b.rerank_scores if rerank else None, b.parent_map)


# --- BM25 ------------------------------------------------------------------------------
@query("bm25_index", "SELECT id, term, tf, CAST(dl AS INTEGER) AS dl FROM v_tf")
def _(b):
    return bm25.postings(b.chunks).select("id", "term", F.col("tf").cast("long").alias("tf"), "dl")


@query("bm25_terms", "SELECT term, df, round(idf, 6) AS idf FROM v_terms")
def _(b):
    return bm25.term_idf(index(b)).select("term", "df", r6("idf"))


view("v_lists_after", """
SELECT term, count(*) AS df, sum(tf) AS cf FROM v_tf WHERE CAST(substr(id, 2) AS BIGINT) % 3 <> 1 OR id NOT IN (SELECT id FROM v_replaced) GROUP BY term""")
view("v_replaced", "SELECT id FROM v_chunks WHERE fonte IN (SELECT DISTINCT fonte FROM v_chunks ORDER BY fonte LIMIT 2)")


@query("bm25_replace_sources", "SELECT term, df, CAST(cf AS BIGINT) AS cf FROM v_lists_after")
def _(b):
    """Two sources come again without a third of their documents: statistics of the index after the replacement."""
    folder = shared_dir(b.spark, "bm25")
    bm25.build_index(b.chunks, meta=S.FILTERS, folder=folder, source="fonte")
    names = b.chunks.select("fonte").distinct().orderBy("fonte").limit(2)
    new = b.chunks.join(names, "fonte", "left_semi").where("cast(substring(id, 2) as bigint) % 3 <> 1")
    return bm25.replace_sources(new, folder, meta=S.FILTERS)["terms"]


view("v_plain_q", "SELECT query_id, pergunta AS texto FROM v_questions")
view("v_bm25_plain", V.bm25("v_plain_q", "query_id"))


@query("bm25_topk", "SELECT query_id, id, round(score, 6) AS score, CAST(posicao AS INTEGER) AS posicao FROM v_bm25_plain")
def _(b):
    return bm25.search(b.questions, index(b)).select("query_id", "id", r6("score"), "posicao")


view("v_filtered_q", f"SELECT query_id, pergunta AS texto, {V.year_of('pergunta')} AS f_ano, {V.type_of('pergunta')} AS f_tipo FROM v_questions")


@query("bm25_filtered", f"SELECT query_id, id, round(score, 6) AS score, CAST(posicao AS INTEGER) AS posicao FROM ({V.bm25('v_filtered_q', 'query_id', True)})")
def _(b):
    q = S.with_filters(b.questions)
    hits = bm25.search(q, index(b), filters=S.FILTERS)
    return hits.select("query_id", "id", r6("score"), "posicao")


@query("metadata_filter", "SELECT id FROM v_chunks WHERE tipo = 'manual' AND ano = '2009' OR (tipo = 'portaria' AND ano = '2008')")
def _(b):
    a = bm25.match_filter({"$and": [{"tipo": "manual"}, {"ano": 2009}]})
    c = bm25.match_filter({"tipo": "portaria", "ano": "2008"})
    return b.chunks.where(a | c).select("id")


# --- vectors ---------------------------------------------------------------------------
view("v_centroid_q", "SELECT label AS query_id, v FROM v_centroids")
view("v_near_label", V.vector_top("v_centroid_q", "query_id"))
NEAR = "SELECT query_id, id, round(score, 6) AS score, CAST(posicao AS INTEGER) AS posicao FROM v_near_label"


def _label_queries(b):
    return b.label_centroids.withColumnRenamed("label", "query_id")


@query("vector_topk", NEAR)
def _(b):
    return W.search(_label_queries(b), b.vectors).select("query_id", "id", r6("score"), "posicao")


@query("vector_topk_blocks", NEAR)
def _(b):
    hits = W.search(_label_queries(b), b.vectors, doc_block=200, query_block=4)
    return hits.select("query_id", "id", r6("score"), "posicao")


@query("vector_cells_all", NEAR)
def _(b):
    ix = W.build_cells(b.vectors, shared_dir(b.spark, "cells"))
    return W.search_cells(_label_queries(b), ix, probes=len(ix.centroids)).select("query_id", "id", r6("score"), "posicao")


@query("vector_cells_recall", """
SELECT count(*) * 20 AS n, true AS recall_90, true AS fewer_cells FROM embeddings WHERE vec_id % 50 = 0""")
def _(b):
    """Stored vectors as questions: recall@20 of the default probes against the exact search."""
    q = b.vectors.where("cast(substring(id, 2) as bigint) % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    ix = W.build_cells(b.vectors, shared_dir(b.spark, "cells"))
    found = W.recall(W.search(q, ix), W.search(q, b.vectors))
    return found.select("n", (F.col("recall") >= 0.9).alias("recall_90"), F.lit(ix.probes < len(ix.centroids)).alias("fewer_cells"))


@query("vector_filtered", f"""
WITH q AS (SELECT label AS query_id, v, CASE WHEN label % 3 = 0 THEN '2008' END AS f_ano, CASE WHEN label % 2 = 0 THEN 'manual' END AS f_tipo FROM v_centroids)
SELECT query_id, id, round(score, 6) AS score FROM ({V.vector_top('q', 'query_id', 10, True)})""")
def _(b):
    k = F.col("query_id")
    q = _label_queries(b).withColumn("f_ano", F.when(k % 3 == 0, "2008")).withColumn("f_tipo", F.when(k % 2 == 0, "manual"))
    return W.search(q, b.vectors, n=10, filters=S.FILTERS).select("query_id", "id", r6("score"))


@query("cosine_to_centroid", """
SELECT e.id, round(list_cosine_similarity(e.v, c.v), 6) AS score FROM v_vectors e JOIN v_centroids c USING (label)""")
def _(b):
    from claimlens.functions.vectors import cosine_similarity

    return b.vectors.join(b.label_centroids, "label").select("id", F.round(cosine_similarity("embedding", "vector"), 6).alias("score"))


# --- fusion and hybrid search ------------------------------------------------------------
def _lists(b):
    subs = S.expand(b.questions)
    keys = ["query_id", "sub"]
    c = corpus(b)
    words = bm25.search(subs, c.index, keys=keys, filters=S.FILTERS).withColumn("lista", F.lit("bm25"))
    near = W.search(b.embed(subs), b.vectors, keys=keys, filters=S.FILTERS).withColumn("lista", F.lit("vetor"))
    return words.unionByName(near)


@query("rrf_fuse", "SELECT query_id, id, round(score, 6) AS score FROM v_fused")
def _(b):
    return U.reciprocal_rank_fusion(_lists(b)).select("query_id", "id", r6("score"))


@query("rrf_fuse_per_list", """
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + posicao)), 6) AS score FROM (
  SELECT query_id, id, posicao FROM v_bm25 UNION ALL SELECT query_id, id, posicao FROM v_near) GROUP BY query_id, id""")
def _(b):
    return U.reciprocal_rank_fusion(_lists(b), fusion="per_list").select("query_id", "id", r6("score"))


@query("parent_resolve", """
SELECT query_id, coalesce(c.parent_id, k.id) AS id, round(max(score), 6) AS score FROM v_bm25_plain k LEFT JOIN v_chunks c ON c.id = k.id GROUP BY 1, 2""")
def _(b):
    hits = bm25.search(b.questions, index(b))
    return U.resolve_parents(hits, b.parent_map).select("query_id", "id", r6("score"))


@query("rerank_join", f"""
SELECT query_id, id, round(s, 6) AS score FROM (SELECT query_id, id, {V.rerank_of()} AS s FROM v_bm25_plain)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10""")
def _(b):
    hits = bm25.search(b.questions, index(b))
    return U.rerank(hits, b.rerank_scores, top=10).select("query_id", "id", r6("score"))


@query("hybrid_search", """
SELECT h.query_id, h.id, round(score, 6) AS score, posicao, secao, titulo, pagina, md5(text) AS h FROM v_hybrid h JOIN v_chunks USING (id)""")
def _(b):
    res = S.present(S.hybrid(b.questions, corpus(b), n=5), b.chunks)
    # even chunks carry a context prefix, which the view removes
    return res.select("query_id", "id", r6("score"), "posicao", "secao", "titulo", "pagina", F.md5(F.col("texto").cast("binary")).alias("h"))


view("v_hybrid_plain", V.hybrid(5, rerank=False))


@query("hybrid_no_rerank", "SELECT query_id, id, round(score, 6) AS score, posicao FROM v_hybrid_plain")
def _(b):
    return S.hybrid(b.questions, corpus(b, rerank=False), n=5).select("query_id", "id", r6("score"), "posicao")


view("v_vec_only", V.vector_top("v_question_vectors", "query_id", 10))
view("v_question_vectors", "SELECT query_id, c.v FROM v_questions JOIN v_centroids c ON c.label = length(pergunta) % 10")


@query("vector_only_search", "SELECT query_id, id, round(score, 6) AS score, CAST(posicao AS INTEGER) AS posicao FROM v_vec_only WHERE posicao <= 5")
def _(b):
    return S.search(b.questions, corpus(b, words=False), n=5, mode="vector").select("query_id", "id", r6("score"), "posicao")


# Several questions per request: the questions of ten benchmark items form one request.
view("v_mq_subs", f"""
SELECT item_id AS query_id, item_id // 10 AS request_id, item_id % 10 AS ordem, pergunta AS texto, c.v, {V.year_of('pergunta')} AS f_ano, {V.type_of('pergunta')} AS f_tipo
FROM (SELECT query_id AS item_id, pergunta FROM v_questions) JOIN v_centroids c ON c.label = length(pergunta) % 10""")
view("v_mq_bm25", V.bm25("v_mq_subs", "query_id", True))
view("v_mq_near", V.vector_top("v_mq_subs", "query_id", filters=True))
view("v_mq_fused", """
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + posicao)), 12) AS score FROM (
  SELECT query_id, id, posicao FROM v_mq_bm25 UNION ALL SELECT query_id, id, posicao FROM v_mq_near) GROUP BY query_id, id""")
view("v_mq_hits", """
SELECT * FROM (SELECT query_id, coalesce(c.parent_id, k.id) AS id, max(score) AS score FROM (
    SELECT query_id, id, score FROM v_mq_fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 6) k
  LEFT JOIN v_chunks c ON c.id = k.id GROUP BY 1, 2) WHERE id IN (SELECT id FROM v_chunks)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")


def _requests(b):
    k = F.col("query_id")
    return b.questions.select(F.floor(k / 10).alias("request_id"), (k % 10).alias("ordem"), "pergunta")


MQ = """
SELECT request_id, id, round(score, 6) AS score, round(score, 3) AS relevancia, query_origem FROM (
  SELECT q.request_id, h.id, h.score, q.ordem, substr(q.texto, 1, 60) AS query_origem FROM v_mq_hits h JOIN v_mq_subs q USING (query_id))
QUALIFY row_number() OVER (PARTITION BY request_id, id ORDER BY {order}) = 1"""


@query("multi_query_search", MQ.format(order="score DESC, ordem"))
def _(b):
    return S.multi_query(_requests(b), corpus(b, rerank=False)).select("request_id", "id", r6("score"), "relevancia", "query_origem")


@query("multi_query_first_seen", "SELECT * FROM (" + MQ.format(order="ordem, score DESC") + ") QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) <= 12")
def _(b):
    return S.multi_query(_requests(b), corpus(b, rerank=False), keep="first", limit=12).select(
        "request_id", "id", r6("score"), "relevancia", "query_origem")


@query("relevance_fallback", """
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM v_vec_only) WHERE score >= 0.35 OR m < 0.35""")
def _(b):
    hits = S.vector_only(b.questions, corpus(b, words=False), n=10)
    return U.keep_relevant(hits).select("query_id", "id", r6("score"))


# Retry: weak questions are searched again with their rewrites.
view("v_retry_first", V.vector_top("v_question_vectors", "query_id", 5))
view("v_retry_kept", """
SELECT query_id, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM v_retry_first) WHERE score >= 0.95 OR m < 0.95""")
view("v_rewrites", V.unrolled("v_questions", V.reformulation_list("pergunta")))
view("v_retry_q", """
SELECT query_id, sub, c.v FROM v_rewrites r JOIN v_centroids c ON c.label = length(texto) % 10
WHERE sub > 0 AND query_id IN (SELECT query_id FROM v_retry_kept GROUP BY query_id HAVING max(score) < 0.97)""")
view("v_retry_new", V.vector_top("v_retry_q", "query_id, sub", 5))
view("v_retry_pool", """
SELECT query_id, id, score FROM (SELECT query_id, id, score, 0 AS o FROM v_retry_kept UNION ALL SELECT query_id, id, score, sub FROM v_retry_new)
QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY o, score DESC) = 1""")
view("v_retry_final", """
SELECT query_id, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM v_retry_pool) WHERE score >= 0.95 OR m < 0.95""")


def _retry(b):
    c = corpus(b, words=False)
    first = S.vector_only(b.questions, c, n=5)
    return S.with_retry(b.questions, c, first, retry_below=0.97, keep_from=0.95)


@query("low_relevance_retry", "SELECT query_id, id, round(score, 6) AS score FROM v_retry_final")
def _(b):
    return _retry(b)[0].select("query_id", "id", r6("score"))


@query("low_relevance_warning", """
SELECT query_id, CASE WHEN coalesce(m, 0) < 0.97 THEN '[AVISO: Resultados de baixa relevancia (melhor score: ' || CAST(round_even(coalesce(m, 0) * 100, 0) AS INTEGER)
  || '%). A informacao pode ser imprecisa ou incompleta.]' WHEN coalesce(n, 0) < 2 THEN '[AVISO: Poucos trechos relevantes encontrados para esta consulta.]' ELSE '' END AS aviso
FROM v_questions LEFT JOIN (SELECT query_id, max(score) AS m, count(*) AS n FROM v_retry_final GROUP BY query_id) USING (query_id)""")
def _(b):
    return _retry(b)[1]


# --- rules and claims against the corpus ----------------------------------------------------
view("v_rule_q", f"""SELECT query_id, c.v FROM (SELECT CAST(numero AS INTEGER) AS query_id, CASE {ENRICH} ELSE nome END AS texto FROM v_rules)
JOIN v_centroids c ON c.label = length(texto) % 10""")
view("v_rule_hits", V.vector_top("v_rule_q", "query_id", 3))


def _rules(b):
    return R.rule_definitions(b.rule_texts, "texto")


def _rule_map(b):
    return S.map_rules(_rules(b), corpus(b, words=False), shared_dir(b.spark, "rule-map"))


@query("rule_section_map", """
SELECT query_id AS numero, secao, pagina, round(score, 3) AS relevancia, CAST(posicao AS INTEGER) AS posicao FROM v_rule_hits JOIN v_chunks USING (id)""")
def _(b):
    return _rule_map(b).where("achado").select("numero", "secao", "pagina", F.round("score", 3).alias("relevancia"), "posicao")


@query("rule_map_share", """
SELECT count(*) AS n, round(avg(CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM v_rule_hits WHERE posicao = 1""")
def _(b):
    return S.mapped_share(_rule_map(b)).select("n", r6("share"))


@query("rule_lookup", """
SELECT m.query_id AS numero, r.codigo, r.nome, m.secao, md5(CASE WHEN length(t) > 1500 THEN substr(t, 1, 1500) || chr(10) || '[...truncado]' ELSE t END) AS texto
FROM (SELECT DISTINCT query_id, secao FROM v_rule_hits JOIN v_chunks USING (id)) m JOIN v_rules r ON r.numero = m.query_id
LEFT JOIN (SELECT secao, min_by(contexto, id) AS t FROM v_chunks GROUP BY secao) s ON s.secao = m.secao""")
def _(b):
    return S.rule_sections(_rule_map(b), b.chunks, 1500).select("numero", "codigo", "nome", "secao", F.md5(F.col("texto").cast("binary")).alias("texto"))


view("v_rule_terms", f"""
SELECT text_id AS request_id, CAST(row_number() OVER (PARTITION BY text_id ORDER BY i) - 1 AS INTEGER) AS ordem, t AS texto FROM (
  SELECT text_id, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (
    SELECT text_id, [{{terms}}, nome] AS l FROM v_rule_code)) WHERE t IS NOT NULL""".replace(
    "{terms}", ", ".join("CASE WHEN " + " OR ".join(
        [f"contains(codigo_fonte, {V.lit(w)})" for w in ex] + [f"contains(lower(codigo_fonte), {V.lit(w)})" for w in an])
        + f" THEN {V.lit(t)} END" for t, ex, an in fv.SOURCE_KEYWORD_TERMS)))
view("v_rule_term_q", "SELECT request_id, ordem, c.v FROM v_rule_terms JOIN v_centroids c ON c.label = length(texto) % 10")
view("v_rule_term_hits", V.vector_top("v_rule_term_q", "request_id, ordem", 3))


@query("rule_context", """
SELECT request_id, h.id, round(score, 3) AS relevancia FROM (
  SELECT request_id, id, score FROM v_rule_term_hits QUALIFY row_number() OVER (PARTITION BY request_id, id ORDER BY score DESC, ordem) = 1) h
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, h.id) <= 5""")
def _(b):
    names = b.raw("part").select(F.col("p_partkey").alias("text_id"), F.col("p_name").alias("nome"))
    req = b.rule_texts.join(names, "text_id").select(F.col("text_id").alias("request_id"), F.posexplode(
        R.source_search_terms("codigo_fonte", "nome")).alias("ordem", "pergunta"))
    return S.multi_query(req, corpus(b, words=False), mode="vector", limit=5).select("request_id", "id", "relevancia")


view("v_claim_q", V.unrolled("v_claims_parsed", CLAIM_Q, "claim_id"))
# a vector depends on the length of the text only, so ten searches serve all claims
view("v_label_top3", "SELECT query_id, id, score FROM v_near_label WHERE posicao <= 3")
view("v_claim_hits", "SELECT claim_id, sub, id, score FROM v_claim_q JOIN v_label_top3 ON query_id = length(texto) % 10")


@query("claim_search", """
SELECT claim_id, id, round(score, 6) AS score, CAST(posicao AS INTEGER) AS posicao FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, id) AS posicao FROM (
    SELECT claim_id, id, score FROM v_claim_hits QUALIFY row_number() OVER (PARTITION BY claim_id, id ORDER BY sub, score DESC) = 1)) WHERE posicao <= 12""")
def _(b):
    return S.claim_search(b.claim_texts, corpus(b, words=False), secondaries=fv.QUESTION_SECONDARIES).select("claim_id", "id", r6("score"), "posicao")


# --- evaluation ------------------------------------------------------------------------------
PIPES = ["bm25", "hibrido", "vetor"]
view("v_eval", """
SELECT 'bm25' AS pipeline, query_id, id, posicao FROM v_bm25_plain WHERE posicao <= 10 UNION ALL SELECT 'vetor', query_id, id, posicao FROM v_vec_only
UNION ALL SELECT 'hibrido', query_id, id, posicao FROM v_hybrid10""")
view("v_per_query", """
SELECT pipeline, query_id, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(f5, 0) / n END AS recall_5,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(f10, 0) / n END AS recall_10, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(first <= 5, false) AS hit
FROM (SELECT p AS pipeline, query_id FROM v_questions, (VALUES ('bm25'), ('hibrido'), ('vetor')) AS x(p))
LEFT JOIN (SELECT query_id, count(*) AS n FROM v_qrels GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT pipeline, e.query_id, min(posicao) AS first, count(DISTINCT CASE WHEN posicao <= 5 THEN secao END) AS f5,
    count(DISTINCT CASE WHEN posicao <= 10 THEN secao END) AS f10 FROM v_eval e JOIN v_chunks c USING (id) JOIN v_qrels r USING (query_id, secao) GROUP BY 1, 2)
  USING (pipeline, query_id)""")


def _per_query(b):
    c = corpus(b)
    runs = [
        bm25.search(b.questions, c.index, n=10).withColumn("pipeline", F.lit("bm25")),
        S.vector_only(b.questions, c, n=10).withColumn("pipeline", F.lit("vetor")),
        S.hybrid(b.questions, c, n=10).withColumn("pipeline", F.lit("hibrido")),
    ]
    cols = ["pipeline", "query_id", "id", "posicao"]
    results = runs[0].select(cols).unionByName(runs[1].select(cols)).unionByName(runs[2].select(cols))
    results = results.join(b.chunks.select("id", "secao"), "id")
    return E.query_metrics(results, b.qrels, b.questions, PIPES)


@query("query_metrics", "SELECT pipeline, query_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr, hit FROM v_per_query")
def _(b):
    return _per_query(b).select("pipeline", "query_id", r6("recall_5"), r6("recall_10"), r6("mrr"), "hit")


@query("retrieval_metrics", """
SELECT pipeline, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr FROM v_per_query GROUP BY pipeline""")
def _(b):
    return E.pipeline_metrics(_per_query(b)).select("pipeline", r6("recall_5"), r6("recall_10"), r6("mrr"))


@query("pipeline_comparison", """
WITH m AS (SELECT pipeline, avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, avg(mrr) AS mrr FROM v_per_query GROUP BY pipeline),
l AS (UNPIVOT m ON recall_5, recall_10, mrr INTO NAME metrica VALUE v)
SELECT a.metrica, round(a.v, 6) AS base, round(b.v, 6) AS outro, round(b.v - a.v, 6) AS delta
FROM l a JOIN l b ON a.metrica = b.metrica AND a.pipeline = 'vetor' AND b.pipeline = 'hibrido'""")
def _(b):
    return E.compare_pipelines(_per_query(b), "vetor", "hibrido").select("metrica", r6("base"), r6("outro"), r6("delta"))


@query("hit_changes", """
SELECT query_id, CASE WHEN n AND NOT o THEN '+NEW' WHEN o AND NOT n THEN '-LOST' WHEN o AND n THEN 'both' ELSE 'none' END AS hit FROM (
  SELECT query_id, bool_or(pipeline = 'vetor' AND hit) AS o, bool_or(pipeline = 'bm25' AND hit) AS n FROM v_per_query GROUP BY query_id)""")
def _(b):
    return E.hit_changes(_per_query(b), "vetor", "bm25")


# --- streaming ---------------------------------------------------------------------------------
@query("stream_audit", "SELECT claim_id, conforme, n_pendencias, vl_total FROM v_verdicts")
def _(b):
    out = stream_claims.audit_orders(b)
    return out.select("claim_id", "conforme", "n_pendencias", F.col("vl_total").cast("double").alias("vl_total"))


@query("stream_replace_sources", """
SELECT 'd' || doc_id AS id, source AS fonte, length(text) AS n FROM documents""")
def _(b):
    out = stream_documents.replace_documents(b)
    return out.select("id", "fonte", F.length("texto").cast("long").alias("n"))


@query("stream_replace_editions", """
SELECT 'd' || doc_id AS id, source AS fonte, length(text) AS n, 2 AS edicao FROM documents""")
def _(b):
    out = stream_documents.edition_documents(b)
    return out.select("id", "fonte", F.length("texto").cast("long").alias("n"), "edicao")
