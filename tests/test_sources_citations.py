import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from claimlens.operators import chunks as H, citations as Z, claim_text as P, catalog as K, facility
from claimlens.functions.questions import claim_questions
from claimlens.sources import corpus, schemas as S, sinks, snapshots as N
from claimlens.streaming.claims import audit_stream
from claimlens.streaming.documents import replace_editions, replace_stream


def grupo(spark, rows):
    return spark.createDataFrame(rows, S.schema("tb_grupo"))


def test_schemas():
    assert len(S.CATALOG_TABLES) == 41 and len(S.FACILITY_TABLES) == 5
    assert S.COLUMNS["tb_tuss"] == ["co_tuss", "no_tuss"] and S.COLUMNS["rl_procedimento_leito"] == ["co_procedimento", "co_tipo_leito"]
    assert S.key_column("tb_leito_cnes") == "co_leito" and S.key_column("tb_cid") == "co_cid"


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    N.write_snapshot(grupo(spark, [("01", "a", "202401"), ("01", "b", "202402"), ("02", "c", "202402")]), root, "tb_grupo")
    (tmp_path / "SIGTAP" / "notas").mkdir()
    assert N.list_months(spark, root) == ["202401", "202402"] and N.list_months(spark, root, "CNES") == []
    assert N.read_table(spark, root, "tb_grupo").count() == 3
    assert N.read_table(spark, root, "tb_grupo", ["202402", "202402"]).count() == 2
    assert N.load_table(spark, root, "tb_grupo", "202401").count() == 1
    assert N.load_table(spark, root, "tb_grupo", "209901") is None
    assert N.register_views(spark, root) == ["tb_grupo"]
    assert spark.sql("SELECT max(dt_competencia) m FROM tb_grupo").first().m == "202402"
    N.write_partitioned(N.read_table(spark, root, "tb_grupo"), f"{root}/flat")
    flat = spark.read.parquet(f"{root}/flat").where("dt_competencia = '202402'")
    assert "PartitionFilters: [isnotnull(dt_competencia" in flat._jdf.queryExecution().toString() and flat.count() == 2


def test_latest_month(spark):
    df = grupo(spark, [("01", "a", "202401"), ("02", "c", "202402")])
    assert [r.co_grupo for r in N.at_latest(df).collect()] == ["02"]
    assert N.at_latest(df.limit(0)).count() == 0 and N.at_months(df, []).count() == 2


def test_prefix_is_pushed_down(spark, tmp_path):
    grupo(spark, [("01", "a", "202401")]).write.parquet(str(tmp_path / "t"))
    plan = K.by_prefix(spark.read.parquet(str(tmp_path / "t")), "01", "202401", column="co_grupo")._jdf.queryExecution().toString()
    assert "StringStartsWith" in plan


def test_discover(spark, tmp_path):
    for p in ["portaria2007/a.PDF", "portaria2007/.oculto/b.pdf", "x/c.html", "x/d.txt", ".git/e.doc", "x/f.zip"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("conteudo")
    rows = corpus.discover(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.relative_path for r in rows] == ["portaria2007/a.PDF", "x/c.html", "x/f.zip"]
    assert [r.extension for r in rows] == ["pdf", "html", "zip"] and bytes(rows[0].content) == b"conteudo"


def test_path_attributes(spark):
    paths = ["/d/portaria2007/Anexo_I-x.pdf", "/d/1999/manual_2012.pdf", "/d/m/manual_sih.pdf", "/d/" + "n" * 80 + ".html"]
    rows = corpus.with_path_attributes(spark.createDataFrame([(p,) for p in paths], ["path"])).collect()
    assert [(r.ano, r.tipo, r.is_annex) for r in rows[:3]] == [("2007", "anexo_sigtap", True), ("2012", "manual", False), ("", "manual", False)]
    assert rows[0].fonte == "Anexo I x (2007)" and rows[1].fonte == "manual 2012 (2012)" and len(rows[3].fonte) == 60


def test_annex_cap(spark):
    pages = spark.range(1, 15).select(F.col("id").cast("int").alias("pagina"), F.explode(F.array(F.lit(True), F.lit(False))).alias("is_annex"))
    assert corpus.cap_annex_pages(pages, cap=10).count() == 10 + 14 and corpus.cap_annex_pages(pages).count() == 28
    arr = spark.createDataFrame([([(i, "t") for i in range(1, 15)],)], "pages array<struct<pagina:int,texto:string>>")
    assert arr.select(F.size(corpus.cap_annex_page_array("pages", F.lit(True), 10))).first()[0] == 10


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], ["fonte", "id"])
    new = spark.createDataFrame([("b", "4"), ("c", "5")], ["fonte", "id"])
    assert sorted(r.id for r in sinks.replace_by_source(old, new).collect()) == ["1", "4", "5"]
    sinks.overwrite_sources(old, str(tmp_path / "t"))
    sinks.overwrite_sources(new, str(tmp_path / "t"))
    assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 4, 5]
    chunks = spark.createDataFrame([("c", "p"), ("p", None)], "id string, parent_id string")
    sinks.write_corpus(chunks, chunks, str(tmp_path / "corpus"), "json")
    assert spark.read.json(str(tmp_path / "corpus/parent_child_map")).count() == 1


# --- claim texts ----------------------------------------------------------------------------
MIRROR = """Num AIH : 3512-0
Tipo: 1-NORMAL
Procedimento principal : 04.07.03.003-4 - COLECISTECTOMIA
Diag. principal: K802 - Calculose
Especialidade : 01 - CIRURGICO
Mot saida: 12 - ALTA
0407030034 0301010072 0407030034 0901010072
CID SECUNDARIO
E110 I10 E110 J189
MS-DATASUS
Z999"""


def test_claim_text(spark):
    df = spark.createDataFrame([(1, MIRROR), (2, "nada")], ["k", "t"]).withColumn("c", P.parse_claim("t")).orderBy("k")
    a, b = [r.c for r in df.collect()]
    assert (a.num_aih, a.tipo, a.especialidade, a.carater, a.motivo_saida) == ("3512-0", "NORMAL", "CIRURGICO", None, "ALTA")
    assert tuple(a.procedimento_principal) == ("0407030034", "COLECISTECTOMIA") and tuple(a.diagnostico_principal) == ("K802", "Calculose")
    assert a.procedimentos_unicos == ["0407030034", "0301010072"] and a.cids_secundarios == ["E110", "J189"]
    assert b.procedimento_principal is None and b.procedimentos_unicos == [] and b.num_aih is None
    qs = df.select("k", claim_questions("c").alias("q")).orderBy("k").collect()
    assert len(qs[0].q) == 8 and qs[0].q[-1] == "CID secundario E110 J189 causas externas politraumatismo" and qs[1].q == []
    one = df.select(claim_questions("c", 1).alias("q")).where(F.size("q") > 0).first().q
    assert one[-1] == "CID secundario E110 causas externas politraumatismo"


# --- citations ------------------------------------------------------------------------------
def chunks(spark):
    return spark.createDataFrame([
        ("a1", "4.1", "Laudo\nx", 20, "F", "primeira parte"), ("a2", "4.1", "Laudo", 21, "F", "segunda Ação"),
        ("a3", "4.1", "Laudo", 22, "F", "curto"), ("a4", "4.1", "Laudo", 22, "F", "fim"), ("b1", "8", "Outra", 5, "F", "x" * 700)],
        "id string, secao string, titulo string, pagina int, fonte string, contexto string")


def test_citations_and_verification(spark):
    text = "Ver [Seção 4.1, p. 20] e [Secao 4.1, p.21], seção 8 (página 9). Secao 4.1 e SEÇÃO 99."
    cites = Z.extract_citations(spark.createDataFrame([(1, text)], ["answer_id", "texto"]))
    assert sorted((r.secao, r.pagina or -1) for r in cites.collect()) == [("4.1", -1), ("4.1", 20), ("4.1", 21), ("8", 9), ("99", -1)]
    every = Z.extract_citations(spark.createDataFrame([(1, text)], ["answer_id", "texto"]), every_pattern=True)
    assert every.count() == 6
    v = {(r.secao, r.pagina): r for r in Z.verify_citations(cites, chunks(spark)).collect()}
    assert v["4.1", 20].pagina_confere and not v["4.1", 21].pagina_confere and v["4.1", 21].alguma_pagina
    assert v["4.1", 20].titulo == "Laudo" and not v["99", None].existe and not v["8", 9].alguma_pagina


def test_section_verification_across_chunks(spark):
    asked = [("4.1", "ACAO"), ("4.1", "parte\nSEGUNDA"), ("4.1", "ação\ncurto\nfi"), ("4.1", "parte\ncurto"), ("8", None), ("7", "x")]
    req = spark.createDataFrame(asked, "secao string, trecho string")
    got = {(r.secao, r.trecho): r for r in Z.verify_sections(req, chunks(spark)).collect()}
    assert [got[a].texto_encontrado for a in asked] == [True, True, True, False, None, False]
    assert got["8", None].resumo == "x" * 500 + "\n[...truncado]" and got["4.1", "ACAO"].n_trechos == 4
    assert got["4.1", "ACAO"].resumo == "primeira parte\nsegunda Ação\ncurto\nfim" and not got["7", "x"].encontrada


def test_passages_over_borders_of_a_long_section(spark):
    lines = [f"linha {i}" + (f"\nfim {i}" if i % 3 == 0 else "") for i in range(600)]
    long = spark.createDataFrame([("9", f"c{i:04d}", t) for i, t in enumerate(lines)] + [("8", "c0000", "linha 5"), ("8", "c0001", "linha 7")],
                                 "secao string, id string, contexto string")
    whole = "\n".join(lines)
    passages = ["\n".join(whole.split("\n")[a:a + k]) for a in range(0, 790, 60) for k in (2, 3, 5)] + ["linha 5\nlinha 7", "fim 3\nlinha 5", "\nlinha"]
    asked = spark.createDataFrame([(s, p) for p in passages for s in ("9", "8")], "secao string, trecho string")
    want = {("9", p) for p in passages if p in whole} | {("8", p) for p in passages if p in "linha 5\nlinha 7"}
    for chunks_per_range in (1, 64, 4096):
        got = {(r.secao, r.trecho) for r in Z._across_chunks(asked, long, "contexto", chunks_per_range).collect()}
        inside = {("9", p) for p in passages if any(p in x for x in lines)}
        assert got | inside == want | inside and got <= want, chunks_per_range


def test_answer_flags(spark):
    answers = spark.createDataFrame([(1, -1.0), (2, 0.4), (3, 0.9), (4, 0.9)], ["answer_id", "score_geral"])
    ver = spark.createDataFrame([(1, True), (3, False)], ["answer_id", "existe"])
    labels = spark.createDataFrame([(4, "sem_fonte"), (4, "fundamentado"), (1, "inferencia")], ["answer_id", "classificacao"])
    got = {r.answer_id: r.tem_problemas for r in Z.answer_flags(answers, ver, Z.grounding(labels)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


# --- streaming ------------------------------------------------------------------------------
def test_document_stream_replaces_sources(spark, tmp_path):
    base = str(tmp_path)
    sinks.overwrite_sources(spark.createDataFrame([("a", "1"), ("b", "2")], "fonte string, id string"), f"{base}/t")
    spark.createDataFrame([("b", "9")], "fonte string, id string").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("fonte string, id string").parquet(f"{base}/in")
    for _ in range(2):  # a second run finds nothing new
        replace_stream(stream, f"{base}/t", f"{base}/cp").awaitTermination()
    assert sorted((r.fonte, int(r.id)) for r in spark.read.parquet(f"{base}/t").collect()) == [("a", 1), ("b", 9)]


EDITION = "id string, texto string, edicao int, parte int, partes int, fonte string"


def edition_batches(spark, folder, batches):
    """One file per batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, EDITION)
        df.coalesce(1).write.parquet(f"{folder}/x{i}")
        name, = glob.glob(f"{folder}/x{i}/part-*")
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.copy(name, f"{folder}/in/{i:02d}.parquet")
        os.utime(f"{folder}/in/{i:02d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(EDITION).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def rows_of(spark, path):
    return sorted((r.fonte, r.edicao, r.id, r.texto) for r in spark.read.parquet(path).collect())


def test_editions_over_several_batches(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("a0", "old", 1, 0, 1, "a"), ("b0", "old", 1, 0, 1, "b"), ("c0", "old", 5, 0, 1, "c")], EDITION).write.partitionBy("fonte").parquet(f"{base}/t")
    batches = [
        [("a1", "x", 2, 0, 2, "a"), ("b1", "x", 2, 0, 1, "b")],             # half of a, all of b
        [("c1", "late", 4, 0, 1, "c"), ("d1", "x", 1, 0, 2, "d")],          # older than the table; half of a new source
        [("a2", "x", 2, 1, 2, "a"), ("a9", "y", 3, 0, 2, "a")],             # a complete; half of the next edition
        [("d1", "again", 1, 0, 2, "d"), ("d2", "x", 1, 1, 2, "d")],         # a part comes again, changed
    ]
    stream = edition_batches(spark, base, batches)
    for _ in range(2):  # a second run finds nothing new
        replace_editions(stream, f"{base}/t", f"{base}/s", f"{base}/cp").awaitTermination()
        assert rows_of(spark, f"{base}/t") == [("a", 2, "a1", "x"), ("a", 2, "a2", "x"), ("b", 2, "b1", "x"), ("c", 5, "c0", "old"),
                                               ("d", 1, "d1", "again"), ("d", 1, "d2", "x")]
    assert [r.id for r in spark.read.parquet(f"{base}/s/espera/lote=3").collect()] == ["a9"]
    # all batches again from the start, as after a lost checkpoint, over the table as it is
    replace_editions(stream, f"{base}/t", f"{base}/s", f"{base}/cp2").awaitTermination()
    assert len(rows_of(spark, f"{base}/t")) == 6


def test_incomplete_editions_time_out(spark, tmp_path):
    base = str(tmp_path)
    stream = edition_batches(spark, base, [[("a1", "x", 2, 0, 2, "a")], [("b1", "x", 1, 0, 1, "b")], [("c1", "x", 1, 0, 1, "c")], [("a2", "x", 2, 1, 2, "a")]])
    replace_editions(stream, f"{base}/t", f"{base}/s", f"{base}/cp", wait=2).awaitTermination()
    assert [r[2] for r in rows_of(spark, f"{base}/t")] == ["b1", "c1"]
    assert [r.id for r in spark.read.parquet(f"{base}/s/incompletas").collect()] == ["a1"]


def test_months_as_of(spark):
    reg = spark.createDataFrame([("1", "202401", 10), ("1", "202401", 11), ("1", "202403", 12), ("2", "202405", 13)], "cnes string, dt_competencia string, v int")
    req = spark.createDataFrame([(1, "1", "202312"), (2, "1", "202402"), (3, "1", "202412"), (4, "2", "202404"), (5, "9", "202404"), (6, None, "202404")],
                                "claim_id int, codigo_cnes string, competencia string")
    got = {r.claim_id: r.mes_cnes for r in facility.as_of_months(req, reg).collect()}
    assert got == {1: None, 2: "202401", 3: "202403", 4: None, 5: None, 6: None}
    assert sorted((r.claim_id, r.v) for r in facility.rows_as_of(req, reg).collect()) == [(2, 10), (2, 11), (3, 12)]


def test_claim_stream_equals_batch(spark, tmp_path):
    from claimlens.operators import audit as A
    from claimlens.plans.bindings import Bound

    b = Bound(spark, "/root/testdata/sf0.001")
    base = str(tmp_path)
    b.claims.repartition(3).write.parquet(f"{base}/in")
    claims = spark.readStream.schema(b.claims.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    audit_stream(claims, None, b, "202402", f"{base}/out", f"{base}/cp").awaitTermination()
    got = spark.read.parquet(f"{base}/out").drop("lote")
    want = A.audit(b.claims, None, b, "202402")[0]
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_chunks_of_files_with_equal_names_are_replaced_apart(spark, tmp_path):
    paths = spark.range(10000, 13000).select(F.concat(F.lit("m/" + "a" * 60), F.col("id").cast("string"), F.lit(".pdf")).alias("path"))
    files = corpus.with_path_attributes(paths).withColumn("pages", F.array(F.struct(F.lit(1).alias("pagina"), F.concat(F.lit("texto de uma pagina "), "path").alias("texto")))).withColumn(
        "secoes", F.array(F.struct(F.lit("4").alias("numero"), F.lit("A").alias("titulo"), F.lit(1).alias("pagina_inicio"), F.col("path").alias("texto"))))
    for make in (H.chunk_pages, H.chunk_sections):
        for parents in (True, False):
            old = make(files, parents=parents).cache()
            n = old.count()
            assert n == 3000 * (1 + parents) and old.select("id").distinct().count() == n and old.select("fonte").distinct().count() == 1
            new = make(files.where(F.endswith("path", F.lit("a10077.pdf"))), parents=parents).withColumn("tipo", F.lit("new"))
            out = sinks.replace_by_source(old, new)
            assert out.count() == n and out.where("tipo = 'new'").count() == 1 + parents
    with pytest.raises(ValueError, match="fonte_id"):
        sinks.replace_by_source(old, new.drop("fonte_id"))
    few = old.limit(3)
    sinks.overwrite_sources(few, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="fonte_id"):
        sinks.overwrite_sources(few.drop("fonte_id"), str(tmp_path / "t"))


def test_files_with_equal_name_starts_are_replaced_apart(spark):
    files = corpus.with_path_attributes(spark.range(10000, 15000).select(F.concat(F.lit("m/" + "a" * 60), F.col("id").cast("string"), F.lit(".pdf")).alias("path")))
    assert files.select("fonte").distinct().count() == 1 and files.select("fonte_id").distinct().count() == 5000
    new = files.where(F.endswith("path", F.lit("a10077.pdf"))).withColumn("tipo", F.lit("new"))
    out = sinks.replace_by_source(files, new)
    assert out.count() == 5000 and out.where("tipo = 'new'").count() == 1


def test_parts_are_dealt_before_they_become_many_rows(spark):
    """A small file is read by one task; its rows must not be multiplied there."""
    from claimlens.plans.bindings import Bound

    b = Bound(spark, "/root/testdata/sf0.001")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in ("rl_procedimento_cid", "rl_procedimento_habilitacao", "rl_procedimento_servico", "tb_procedimento"):
        assert b.table(table).rdd.getNumPartitions() == n


def test_parts_of_editions_are_many_files_and_no_window(spark, tmp_path, monkeypatch):
    """A part may be any number of files, one batch each, and its rows never meet in one task."""
    from claimlens.plans.bindings import Bound
    from claimlens.streaming import documents as D

    monkeypatch.setattr(D, "shared_dir", lambda _spark, label: str(tmp_path / label))
    docs = Bound(spark, "/root/testdata/sf0.001")
    docs._read["documents"] = docs.raw("documents").repartition(6)
    out = D.edition_documents(docs, files=2)
    base = tmp_path / "stream-editions"
    assert len(spark.read.parquet(str(base / "in")).inputFiles()) > 2
    assert sorted(p.name for p in (base / "stage" / "lidas").iterdir() if p.is_dir()) == ["lote=0", "lote=1"]
    want = sorted((f"d{r.doc_id}", r.source, r.text) for r in docs.raw("documents").collect())
    assert sorted((r.id, r.fonte, r.texto) for r in out.where("edicao = 2").collect()) == want


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_documents_may_be_a_folder_of_files(spark, tmp_path, files):
    from claimlens.plans.bindings import Bound
    from claimlens.streaming import documents as D

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    if files > 1:
        docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    out = D.replace_documents(Bound(spark, str(tmp_path)))
    assert sorted((r.id, r.texto) for r in out.collect()) == sorted((f"d{r.doc_id}", r.text) for r in docs.collect())
