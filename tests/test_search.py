import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import bm25, evaluation as E, fusion as U, inventory as I, vector as W
from claimlens.plans import search as S


def ranked(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# --- BM25 -------------------------------------------------------------------------------
DOCS = {"d1": "leito uti leito hospital", "d2": "hospital cirurgia", "d3": "hospital parto cesariana parto parto",
        "d4": "", "d5": "hospital hospital uti diaria"}


def bm25_by_hand(query):
    docs = {k: v.split() for k, v in DOCS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (1 - 0.75 + 0.75 * len(d) / avg)) for t in query.split() if t in tf)
        if s > 0:
            out[k] = s
    return out


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(k, v, "manual" if k < "d3" else "portaria", "2012") for k, v in DOCS.items()],
                                   "id string, contexto string, tipo string, ano string")
    return bm25.build_index(chunks, meta=("ano", "tipo"))


@pytest.mark.parametrize("q", ["uti leito", "hospital", "parto parto hospital", "nada"])
def test_bm25_formula(spark, index, q):
    qs = spark.createDataFrame([(1, q)], ["query_id", "pergunta"])
    got = {r.id: r.score for r in bm25.score(qs, index).collect()}
    want = bm25_by_hand(q)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_filters_before_the_cut_with_whole_corpus_idf(spark, index):
    qs = spark.createDataFrame([(1, "uti hospital", "portaria"), (2, "uti hospital", None)], "query_id int, pergunta string, f_tipo string")
    got = bm25.search(qs, index, n=1, filters=("tipo",)).collect()
    want = bm25_by_hand("uti hospital")
    best = max(want, key=want.get)
    assert {r.query_id: r.id for r in got} == {1: "d5", 2: best}
    assert {r.id: round(r.score, 6) for r in got}["d5"] == round(want["d5"], 6)
    only = bm25.search(qs.where("query_id = 2"), index, where={"$and": [{"tipo": "portaria"}, {"ano": 2012}]})
    assert {r.id for r in only.collect()} == {"d3", "d5"}


def test_match_filter(spark):
    df = spark.createDataFrame([("manual", "2024"), ("portaria", "2023"), (None, None)], "tipo string, ano string")
    n = lambda w: df.where(bm25.match_filter(w)).count()
    assert n({"tipo": "manual"}) == 1 and n({"$and": [{"tipo": "portaria"}, {"ano": "2024"}]}) == 0
    assert n({"tipo": ""}) == 1 and n(None) == 3


def test_stored_index_gives_the_same_answers(spark, index, tmp_path):
    folder = str(tmp_path / "ix")
    chunks = spark.createDataFrame([(k, v) for k, v in DOCS.items()], ["id", "contexto"])
    stored = bm25.build_index(chunks, folder=folder)
    qs = spark.createDataFrame([(1, "uti leito hospital")], ["query_id", "pergunta"])
    want = sorted(ranked(bm25.search(qs, index), "id", "score"))
    for ix in (stored, bm25.read_index(spark, folder)):
        assert sorted(ranked(bm25.search(qs, ix), "id", "score")) == want


@pytest.fixture(scope="module")
def many(spark):
    """3000 documents of 40 sources; a word of a third of them, rare words in few."""
    rnd = random.Random(4)
    rows = [(f"x{i:04d}", f"s{i % 40}", " ".join(["comum"] * (i % 3 == 0) * rnd.randint(1, 4) + [f"raro{i % 40}"]
             + [f"termo{int(rnd.paretovariate(.7)) % 300}" for _ in range(rnd.randint(1, 30))])) for i in range(3000)]
    return spark.createDataFrame(rows, "id string, fonte string, contexto string")


def test_blocks_give_the_best_of_all_pairs(spark, many, monkeypatch):
    ix = bm25.build_index(many, source="fonte", meta=("fonte",), segments=4, block_docs=200)
    sizes = ix["lists"].groupBy("segment", "block").agg(F.max("df").alias("df")).collect()
    assert len(sizes) >= 10 and sum(ix["lists"].where("term = 'comum'").select("df").toPandas()["df"]) == 1000
    qs = spark.createDataFrame([(1, "comum", None), (2, "comum raro7 raro9", None), (3, "raro3 termo5 termo5", None), (4, "comum termo2", "s3"), (5, "nada", None)],
                               "query_id int, pergunta string, f_fonte string")
    full = bm25.score(qs, ix).join(many.select("id", "fonte"), "id").join(qs.select("query_id", "f_fonte"), "query_id").where("f_fonte is null or f_fonte = fonte")
    want = {(r.query_id, r.posicao, r.id, r.score) for r in bm25.top_n(full, ["query_id"], [F.desc("score"), "id"], 10).collect()}
    passes = []
    real = bm25.scan_blocks
    monkeypatch.setattr(bm25, "scan_blocks", lambda *a, **k: passes.append((a[1].count(), real(*a, **k))) or passes[-1][1])
    for slice_rows in (50000, 2):
        passes.clear()
        got = bm25.search(qs, ix, n=10, filters=("fonte",), slice_rows=slice_rows)
        assert {(r.query_id, r.posicao, r.id, r.score) for r in got.collect()} == want
        # k rows per question and block leave the tasks, however many documents hold a word
        assert all(df.count() <= 10 * pairs for pairs, df in passes)
    # the rare words rule out most blocks
    passes.clear()
    bm25.search(qs.where("query_id = 2"), ix, n=5).count()
    assert passes[0][0] == 1 and passes[1][0] <= 2


def test_replaced_sources_equal_a_full_rebuild(spark, many, tmp_path):
    folder = str(tmp_path / "ix")
    bm25.build_index(many, folder=folder, source="fonte", meta=("fonte",), segments=8, block_docs=100)
    before = {r.segment: r.f for r in spark.read.parquet(f"{folder}/docs").groupBy("segment").agg(F.max("_metadata.file_modification_time").alias("f")).collect()}
    new = many.where("fonte in ('s1', 's2')").where("id < 'x2000'").unionByName(
        spark.createDataFrame([("y1", "s1", "comum novo novo"), ("y2", "outra", "novo")], "id string, fonte string, contexto string"))
    for _ in range(2):  # a repeated call changes nothing
        ix = bm25.replace_sources(new, folder, meta=("fonte",), segments=8, block_docs=100)
        whole = bm25.build_index(many.where("fonte not in ('s1', 's2')").unionByName(new), source="fonte", meta=("fonte",), segments=8, block_docs=100)
        for table in ("terms", "corpus"):
            assert sorted(map(str, ix[table].collect())) == sorted(map(str, whole[table].collect()))
        flat = lambda x: sorted(map(str, x["lists"].select("segment", "block", "term", "df", "cf", "tf_most", "dl_least", F.sort_array("entries").alias("e")).collect()))
        assert flat(ix) == flat(whole)
    after = {r.segment: r.f for r in spark.read.parquet(f"{folder}/docs").groupBy("segment").agg(F.max("_metadata.file_modification_time").alias("f")).collect()}
    assert 0 < sum(before[s] != after[s] for s in before) <= 3


# --- vectors ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 8))
    v[10] = v[11] = v[12]  # equal vectors: the smaller id wins
    rows = [(f"v{i:03d}", [float(x) for x in v[i]], str(2010 + i % 2)) for i in range(300)]
    return v, spark.createDataFrame(rows, "id string, embedding array<double>, ano string")


@pytest.mark.parametrize("block,filters", [(1000, ()), (70, ()), (1000, ("ano",)), (70, ("ano",))])
@pytest.mark.parametrize("cells", [False, True])
def test_vector_search_is_exact(spark, vectors, tmp_path, block, filters, cells):
    v, df = vectors
    big = 9_007_199_254_740_993  # not representable as a double
    qs = [(big + i, [float(x) for x in v[i]], None if i % 2 else "2011") for i in range(12)]
    q = spark.createDataFrame(qs, "query_id long, vector array<double>, f_ano string")
    got = {}
    run = {"n": 5, "filters": filters, "doc_block": block, "query_block": 5}
    hits = W.search_cells(q, W.build_cells(df, str(tmp_path)), probes=100, **run) if cells else W.search(q, df, **run)
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((r.posicao, r.id))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i, (k, _, year) in enumerate(qs):
        s = np.round(unit @ unit[i], 12)
        ok = [j for j in range(300) if not filters or year is None or str(2010 + j % 2) == year]
        want = sorted(ok, key=lambda j: (-s[j], j))[:5]
        assert [d for _, d in sorted(got[k])] == [f"v{j:03d}" for j in want]


def test_filter_that_matches_nothing(spark, vectors):
    q = spark.createDataFrame([(1, [1.0] * 8, "1999")], "query_id long, vector array<double>, f_ano string")
    assert W.search(q, vectors[1], filters=("ano",)).count() == 0
    assert W.search(q.limit(0), vectors[1]).count() == 0 and W.search(q, vectors[1].limit(0)).count() == 0


def test_cells_find_most_neighbours_in_few_cells(spark, tmp_path):
    """Clustered vectors with one huge cluster and one vector repeated: recall, every vector indexed, blocks of bounded size."""
    rnd = np.random.default_rng(9)
    middle = rnd.normal(size=(30, 16)) * 3
    of = np.concatenate([np.zeros(1500, int), rnd.integers(0, 30, 1500)])
    v = middle[of] + rnd.normal(size=(3000, 16))
    v[:400] = v[0]
    df = spark.createDataFrame([(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)], "id string, embedding array<double>")
    df = df.unionByName(spark.createDataFrame([("none", None)], "id string, embedding array<double>"))
    q = df.where("id like '%00' and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    ix = W.build_cells(df, str(tmp_path))
    assert len(ix.centroids) == round(math.sqrt(3000)) and ix.vectors.count() == 3000
    exact = W.search(q, df)
    got = W.recall(W.search(q, ix, doc_block=100), exact).first()
    assert got.n == 30 * 20 and got.recall >= 0.9 and ix.probes <= len(ix.centroids) // 4
    assert W.recall(W.search(q, W.read_cells(spark, str(tmp_path))), exact).first().recall == got.recall


# --- fusion -----------------------------------------------------------------------------
LISTS = "query_id int, lista string, sub int, id string, score double"


def fused(spark, rows, **kw):
    df = U.reciprocal_rank_fusion(spark.createDataFrame(rows, LISTS), **kw)
    return [(r.id, r.score) for r in df.orderBy(F.desc("score"), "id").collect()]


def test_rrf_two_lists(spark):
    rows = [(1, "a", 0, "doc1", .9), (1, "a", 0, "doc2", .8), (1, "b", 0, "doc2", .95), (1, "b", 0, "doc3", .7)]
    got = fused(spark, rows)
    assert got[0][0] == "doc2" and abs(got[0][1] - (1 / 62 + 1 / 61)) < 1e-9
    assert fused(spark, []) == [] and fused(spark, rows[:1], k=1)[0][1] > fused(spark, rows[:1], k=60)[0][1]


def test_rrf_concat_runs_ranks_on(spark):
    rows = [(1, "a", 0, "x", .9), (1, "a", 1, "x", .5), (1, "a", 1, "y", .4)]
    assert dict(fused(spark, rows))["x"] == round(1 / 61 + 1 / 62, 12)
    assert dict(fused(spark, rows, fusion="per_list"))["x"] == round(2 / 61, 12)


def test_parents_keep_the_best_child(spark):
    res = spark.createDataFrame([(1, "c1", .5), (1, "c2", .9), (1, "c3", .7), (1, "solo", .1)], ["query_id", "id", "score"])
    pm = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2")], ["id", "parent_id"])
    assert sorted(ranked(U.resolve_parents(res, pm), "id", "score")) == [("p1", .9), ("p2", .7), ("solo", .1)]


def test_rerank_drops_unscored_and_passes_through(spark):
    c = spark.createDataFrame([(1, "a", .1), (1, "b", .2), (1, "c", .3)], ["query_id", "id", "score"])
    t = spark.createDataFrame([(1, "a", 5.0), (1, "b", 4.0)], ["query_id", "id", "rerank"])
    assert sorted(ranked(U.rerank(c, t, top=5), "id", "score")) == [("a", 5.0), ("b", 4.0)]
    assert {r[0] for r in ranked(U.rerank(c, None, top=2), "id")} == {"b", "c"}


def test_keep_relevant_falls_back_to_all(spark):
    r = spark.createDataFrame([(1, "a", .9), (1, "b", .1), (2, "c", .2), (2, "d", .1)], ["query_id", "id", "score"])
    assert {x[0] for x in ranked(U.keep_relevant(r), "id")} == {"a", "c", "d"}


def test_merge_best_or_first(spark):
    r = spark.createDataFrame([(1, "a", .2, 0, "q0"), (1, "a", .9, 1, "q1")], ["query_id", "id", "score", "ordem", "q"])
    assert ranked(U.merge_results(r), "score", "q") == [(.9, "q1")]
    assert ranked(U.merge_results(r, keep="first"), "score", "q") == [(.2, "q0")]


# --- whole flow ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def corpus(spark, index):
    chunks = spark.createDataFrame([(k, v, k, "T\nx", 1, "F", "2012", "manual" if k < "d3" else "portaria") for k, v in DOCS.items()],
                                   "id string, texto string, secao string, titulo string, pagina int, fonte string, ano string, tipo string")
    axis = {"d1": [1., 0.], "d2": [0., 1.], "d3": [.6, .8], "d5": [.8, .6]}
    vecs = chunks.select("id", "ano", "tipo").join(spark.createDataFrame(list(axis.items()), "id string, embedding array<double>"), "id")
    embed = lambda f: f.withColumn("vector", F.when(F.contains("pergunta", F.lit("uti")), F.array(F.lit(1.), F.lit(0.))).otherwise(F.array(F.lit(0.), F.lit(1.))))
    scores = lambda c: c.withColumn("rerank", F.substring("id", 2, 1).cast("double"))
    return S.Corpus(chunks, index, vecs, embed, scores, spark.createDataFrame([("d1", "d2")], ["id", "parent_id"]))


def test_hybrid_reranks_long_questions_only(spark, corpus):
    q = spark.createDataFrame([(1, "leito de uti no hospital"), (2, "uti hospital")], ["query_id", "pergunta"])
    rows = S.hybrid(q, corpus, n=3).orderBy("query_id", "posicao").collect()
    one, two = [[r for r in rows if r.query_id == k] for k in (1, 2)]
    assert [r.id for r in one] == ["d5", "d3", "d2"] and {r.score_kind for r in one} == {"rerank"}
    assert {r.score_kind for r in two} == {"rrf"} and "d1" not in {r.id for r in rows}
    shown = S.present(S.hybrid(q, corpus, n=1), corpus.chunks).collect()
    assert {r.titulo for r in shown} == {"T"}


def test_multi_query_searches_equal_texts_once(spark, corpus):
    req = spark.createDataFrame([(r, o, t) for r in range(50) for o, t in enumerate(["uti leito hospital", "cirurgia geral hospital"])],
                                ["request_id", "ordem", "pergunta"])
    calls = []
    c = S.Corpus(corpus.chunks, corpus.index, corpus.vectors, lambda f: calls.append(f.count()) or corpus.embed(f), None, None)
    out = S.multi_query(req, c, 2, mode="vector")
    assert calls == [2] and out.select("request_id").distinct().count() == 50
    best = {r.id: r.relevancia for r in out.where("request_id = 7").collect()}
    assert best["d1"] == 1.0 and best["d2"] == 1.0


def test_multi_query_scores_question_and_text(spark, corpus):
    long = "quais regras de uti valem para leito de hospital geral no periodo"
    req = spark.createDataFrame([(7, 0, long), (8, 0, long)], "request_id int, ordem int, pergunta string")
    seen = []

    def scorer(candidates):
        seen.append(set(candidates.columns))
        return candidates.withColumn("rerank", F.when(F.contains("texto", F.lit("uti")), 0.9).otherwise(0.1))

    base = (corpus.chunks, corpus.index, corpus.vectors, corpus.embed)
    by_text = S.multi_query(req, S.Corpus(*base, scorer, None), 2).collect()
    assert {"pergunta", "texto"} <= seen[0] and {r.request_id for r in by_text} == {7, 8}
    ids = [r.id for r in corpus.chunks.collect()]
    frame = spark.createDataFrame([(long, i, 0.5) for i in ids], ["pergunta", "id", "rerank"])
    assert {r.score for r in S.multi_query(req, S.Corpus(*base, frame, None), 2).collect()} == {0.5}
    keyed = spark.createDataFrame([(7, i, 0.5) for i in ids], ["request_id", "id", "rerank"])
    with pytest.raises(ValueError):
        S.multi_query(req, S.Corpus(*base, keyed, None), 2)


def test_retry_only_for_weak_questions(spark, corpus):
    q = spark.createDataFrame([(1, "uti"), (2, "outra coisa")], ["query_id", "pergunta"])
    first = spark.createDataFrame([(1, "d1", .9), (1, "d5", .8), (2, "d3", .2)], ["query_id", "id", "score"])
    final, warn = S.with_retry(q, corpus, first)
    got = {}
    for r in final.collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got[1] == {"d1", "d5"} and "d2" in got[2]
    assert {r.query_id: r.aviso for r in warn.collect()} == {1: "", 2: ""}
    _, warn = S.with_retry(q.where("query_id = 2"), S.Corpus(corpus.chunks, None, corpus.vectors.limit(0), corpus.embed), first.where("query_id = 2"))
    assert warn.first().aviso.startswith("[AVISO: Resultados de baixa relevancia (melhor score: 20%)")


def test_rule_map_is_stored_and_looked_up(spark, corpus, tmp_path):
    rules = spark.createDataFrame([(1, "05a", "uti"), (2, "05b", "parto")], "numero int, codigo string, nome string")
    S.map_rules(rules, corpus, str(tmp_path / "map"), n=2)
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert sorted((r.numero, r.posicao, r.id) for r in stored.collect()) == [(1, 1, "d1"), (1, 2, "d5"), (2, 1, "d2"), (2, 2, "d3")]
    assert tuple(S.mapped_share(stored, 0.5).first()) == (2, 1.0) and tuple(S.mapped_share(stored, 1.0).first()) == (2, 0.0)
    chunks = corpus.chunks.withColumn("contexto", F.col("texto"))
    got = {(r.numero, r.secao): r.texto for r in S.rule_sections(stored, chunks, 4).collect()}
    assert got.keys() == {(1, "d1"), (1, "d5"), (2, "d2"), (2, "d3")} and got[1, "d1"].startswith("leit") and got[1, "d1"] != DOCS["d1"]


@pytest.mark.parametrize("mode", ["vector", "hybrid"])
def test_claim_search_in_both_modes(spark, corpus, mode):
    text = "Procedimento principal : 03.04.01.039-0 - UTI GERAL\nDiag. principal: A00 - Doença"
    out = S.claim_search(spark.createDataFrame([(1, text), (2, text)], "claim_id int, texto string"), corpus, limit=2, mode=mode).collect()
    assert {r.claim_id for r in out} == {1, 2} and {r.posicao for r in out} <= {1, 2}


def test_inventory(spark):
    ch = spark.createDataFrame([("a", "4.1", "[Manual X]\n\ntexto longo", "T\nu", 1, "f", "m", "2020"), ("b", "4.1", "curto", "V", 2, "f", None, None), ("c", "4.2", "x", "W", 3, "g", "p", "2021")],
                               "id string, secao string, texto string, titulo string, pagina int, fonte string, tipo string, ano string")
    asked = spark.createDataFrame([("4.1",), ("4.1",), ("9",)], ["secao"])
    assert sorted((r.id, r.titulo, r.texto) for r in I.chunks_of_sections(ch, asked).collect()) == [("a", "T", "texto longo"), ("b", "V", "curto")]
    assert {r.id: r.texto for r in I.chunks_of_sections(ch, asked, 5).collect()}["a"].startswith("texto\n")
    assert sorted(map(tuple, I.sources(ch).collect())) == [("f", 2, "m", "2020"), ("g", 1, "p", "2021")]
    assert {(r.por, r.valor): r.n for r in I.counts_by(ch, ["tipo", "fonte"]).collect()} == {("tipo", "m"): 1, ("tipo", None): 1, ("tipo", "p"): 1, ("fonte", "f"): 2, ("fonte", "g"): 1}
    rules = spark.createDataFrame([(1, "Sexo 100%"), (2, "idade")], ["numero", "nome"])
    assert [r.numero for r in I.rules_named(rules, "sEXO").collect()] == [1] and I.rules_named(rules, "0%").count() == 1 and I.rules_named(rules).count() == 2


# --- metrics --------------------------------------------------------------------------------
def test_metrics(spark):
    res = spark.createDataFrame([("v", 1, "s1", 1), ("v", 1, "s2", 2), ("v", 1, "s2", 3), ("h", 1, "s2", 1), ("v", 2, "s9", 6)],
                                ["pipeline", "query_id", "secao", "posicao"])
    qrels = spark.createDataFrame([(1, "s2"), (1, "s7"), (2, "s9")], ["query_id", "secao"])
    qs = spark.createDataFrame([(1,), (2,), (3,)], ["query_id"])
    m = {(r.pipeline, r.query_id): r for r in E.query_metrics(res, qrels, qs, ["v", "h"]).collect()}
    assert (m["v", 1].recall_5, m["v", 1].mrr) == (.5, .5) and m["h", 1].mrr == 1.0
    assert (m["v", 2].recall_5, m["v", 2].recall_10, m["v", 2].hit) == (0.0, 1.0, False)
    assert m["v", 3].recall_5 == 1.0 and m["v", 3].mrr == 0.0 and m["h", 2].mrr == 0.0
    per = E.query_metrics(res, qrels, qs, ["v", "h"])
    assert {r.metrica: round(r.delta, 6) for r in E.compare_pipelines(per, "v", "h").collect()}["mrr"] == round((1 - (.5 + 1 / 6)) / 3, 6)
    assert {r.query_id: r.hit for r in E.hit_changes(per, "v", "h").collect()} == {1: "both", 2: "none", 3: "none"}


def test_term_counts_on_random_tokens(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice("abcdef") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t array<string>").select("i", bm25.term_counts(F.col("t")).alias("c"))
    want = dict(rows)
    for r in df.collect():
        assert {x.term: x.tf for x in r.c} == dict(Counter(want[r.i]))


def test_rules_of_one_name_are_searched_once_and_hits_without_chunk_count(spark, tmp_path):
    seen = []

    def embed(q):
        seen.append(sorted(r.pergunta for r in q.select("pergunta").collect()))
        return q.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))

    rules = spark.createDataFrame([(1, "0501", "xis"), (2, "0502", "xis"), (3, "0503", "outra")], "numero int, codigo string, nome string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1])], "id string, embedding array<double>")
    chunks = spark.createDataFrame([("b", "2.1", 7, "t")], "id string, secao string, pagina int, contexto string")
    m = S.map_rules(rules, S.Corpus(chunks, None, vectors, embed), str(tmp_path / "map"), n=2)
    assert seen == [["outra", "xis"]]
    assert sorted((r.numero, r.posicao, r.secao) for r in m.collect()) == [(n, p, s) for n in (1, 2, 3) for p, s in ((1, None), (2, "2.1"))]
    assert S.mapped_share(m).first()["n"] == 3
    assert sorted((r.numero, r.secao) for r in S.rule_sections(m, chunks).collect()) == [(1, "2.1"), (2, "2.1"), (3, "2.1")]


def test_index_lists_shuffle_documents_not_postings(spark):
    docs = spark.createDataFrame([("a", 3, [("x", 1), ("y", 2)], "s", 0)], "id string, dl int, terms array<struct<term:string,tf:int>>, _src string, segment int")
    lists = bm25._lists(docs, [], 10)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Generate explode")]
    assert "Exchange" not in above
    assert sorted((r.term, r.df, r.cf) for r in lists.collect()) == [("x", 1, 1), ("y", 1, 2)]


def test_questions_with_one_vector_are_searched_once_and_not_broadcast(spark, corpus, monkeypatch):
    req = spark.createDataFrame([(r, 0, f"{t} {r}") for r in range(30) for t in ("uti", "cirurgia")], "request_id int, ordem int, pergunta string")
    asked, search = [], S.vector.search
    monkeypatch.setattr(S.vector, "search", lambda q, *a, **k: asked.append(q.count()) or search(q, *a, **k))
    hits = S.search_texts(req, corpus, 1, mode="vector")
    assert asked == [2]
    assert {(r.pergunta.split()[0], r.id) for r in hits.collect()} == {("uti", "d1"), ("cirurgia", "d2")} and hits.count() == 60
    # questions grow with the requests: their hits must not pass the driver
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("pergunta" in x or "query_id" in x)]


def test_block_scores_hold_bounded_entries():
    """Questions of common words bring a list entry for every document and word: a task takes few of them at a time."""
    import tracemalloc

    import pyarrow as pa

    docs, terms, asks = 1000, 40, 400
    entry = [{"id": f"d{i:04}", "tf": 1 + i % 3, "dl": 50 + i % 7} for i in range(docs)]
    lists = pa.RecordBatch.from_pydict({"term": [f"t{k}" for k in range(terms)], "entries": [entry] * terms})
    asked = pa.RecordBatch.from_pydict({"query_id": list(range(asks + 1)), "terms": [[{"term": f"t{k}", "w": 1.0 + (q * k) % 5} for k in range(terms)] for q in range(asks)] + [[]]})
    ask = bm25._block_scores(["query_id"], [], [], 50.0, 3, 9)([lists])
    tracemalloc.start()
    out = ask(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    w = np.array([[1.0 + (q * k) % 5 for k in range(terms)] for q in range(asks)])
    gain = bm25._gain(1.0 + np.arange(docs) % 3, 50 + np.arange(docs) % 7, 50.0)
    want = [sorted(((-round(float(sum(x * g for x in row)), 9), i) for i, g in enumerate(gain)))[:3] for row in w[:5]]
    got = list(zip(out.column("query_id").to_pylist(), out.column("id").to_pylist(), strict=True))
    assert len(got) == 3 * asks and [i for q, i in got if q < 5] == [f"d{i:04}" for row in want for _, i in row]
