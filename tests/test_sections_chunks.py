import hashlib
import random

from pyspark.sql import functions as F

from claimlens.functions.arrays import occurrence, split_with_overlap
from claimlens.operators import chunks as H, sections as D
from claimlens.operators.html import html_pages

PAGES = "fonte string, ano string, tipo string, pages array<struct<pagina:int,texto:string>>"


def files(spark, *pages, fonte="F"):
    return spark.createDataFrame([(fonte, "2012", "manual", [(p, t) for p, t in pages])], PAGES)


def sections(spark, *pages):
    rows = files(spark, *pages).select(F.explode(D.detect_sections("pages")).alias("s")).select("s.*").collect()
    return [(r.numero, r.titulo, r.pagina_inicio, r.texto) for r in rows]


def test_sections_run_over_pages(spark):
    got = sections(
        spark,
        (9, "SETEMBRO 2012\n1 INTRODUÇÃO\nprimeira linha\n12\nsegunda"),
        (10, "MANUAL TÉCNICO OPERACIONAL X\ncontinua\n4.1.\nLAUDO MÉDICO\ncorpo do laudo\n4.2 VAZIA"),
    )
    assert got == [("1", "INTRODUÇÃO", 9, "primeira linha\nsegunda\ncontinua"), ("4.1", "LAUDO MÉDICO", 10, "corpo do laudo")]


def test_heading_keeps_the_rest_of_its_line(spark):
    assert sections(spark, (1, "2.3 REGRAS DE OPM para todos\nlinha")) == [("2.3", "REGRAS DE OPM", 1, "para todos\nlinha")]


def test_preamble_only_after_page_eight(spark):
    page = "texto solto\n1 TITULO\ncorpo"
    assert [s[0] for s in sections(spark, (9, page))] == ["0", "1"]
    assert [s[0] for s in sections(spark, (8, page))] == ["1"]
    assert sections(spark, (9, page))[0] == ("0", "PREÂMBULO", 9, "texto solto")


def test_contents_pages_are_skipped(spark):
    assert sections(spark, (1, "1 SUMARIO ......................\nx"), (2, "2 REAL\ncorpo")) == [("2", "REAL", 2, "corpo")]


def test_no_sections(spark):
    assert sections(spark, (1, "apenas texto")) == []


def test_manual_needs_two_markers(spark):
    got = lambda *p: files(spark, *p).select(D.is_manual("pages", 10)).first()[0]
    late = [*[(i, "") for i in range(10)], (11, "SIH/SUS AIH")]
    assert files(spark, *late).select(D.is_manual("pages")).first()[0]
    assert got((1, "Sih/Sus"), (2, "aih")) and not got((1, "aih")) and not got(*[(i, "") for i in range(10)], (11, "SIH/SUS AIH"))


def pieces_by_search(text, limit, overlap, sep):
    """Independent statement of the rule, by trying ends and starts."""
    if len(text) <= limit:
        return [text]
    paras, out, start = text.split(sep), [], 0
    while True:
        end = start + 1
        first_new = out[-1][1] if out else 0
        end = max(end, first_new + 1)
        while end < len(paras) and sum(map(len, paras[start:end + 1])) <= limit:
            end += 1
        out.append((start, end))
        if end == len(paras):
            return [sep.join(paras[a:b]) for a, b in out]
        start = min(s for s in range(max(start, 0), end + 1) if sum(map(len, paras[s:end])) <= overlap)


def test_split_with_overlap_against_search(spark):
    rnd = random.Random(7)
    texts = ["\n\n".join("x" * rnd.choice([0, 3, 40, 90, 150, 700]) + str(i) for i in range(rnd.randint(1, 40))) for _ in range(150)]
    texts += ["", "a" * 5000, "a" * 600 + "\n\n" + "b" * 10]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ["i", "t"])
    got = {r.i: r.p for r in df.select("i", split_with_overlap(F.col("t"), 500, 200, "\n\n").alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pieces_by_search(t, 500, 200, "\n\n"), i


def test_section_chunks_ids_contexts_and_repeats(spark):
    f = files(spark, (1, ""), fonte="Manual SIH/SUS 2012").withColumn("secoes", F.expr(
        "array(struct('4' as numero, 'A' as titulo, 1 as pagina_inicio, 'um' as texto),"
        "struct('4' as numero, 'B' as titulo, 2 as pagina_inicio, 'dois' as texto))"))
    rows = H.chunk_sections(f).collect()
    pre = "manual_sih_sus_2012_" + hashlib.md5("Manual SIH/SUS 2012".encode()).hexdigest()[:6] + "_secao_4"
    assert [r.id for r in rows] == [pre + "_parent0", pre + "_p0_c0", pre + "_parent0_dup1", pre + "_p0_c0_dup1"]
    assert rows[3].parent_id == pre + "_parent0_dup1" and rows[0].parent_id is None
    head = "[Manual SIH/SUS 2012 | Seção 4. A | Página 1 | Tipo: manual]"
    assert rows[0].contexto == head + "\n\num" and rows[1].contexto == head + "\n\nContexto da seção: um\n\num"


def test_occurrence_counts_equal_elements_before(spark):
    rnd = random.Random(3)
    lists = [[rnd.choice(["a", "b", None, "c"]) for _ in range(n)] for n in (0, 1, 2, 30, 200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    got = {r.i: r.n for r in df.select("i", occurrence(F.col("v")).alias("n")).collect()}
    assert got == {i: [v[:k].count(x) for k, x in enumerate(v)] for i, v in enumerate(lists)}


def test_ids_of_repeated_sections_of_different_length(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("12"), "T", k, "\n\n".join("x" * rnd.choice([30, 200, 700]) for _ in range(rnd.randint(1, 12)))) for k in range(25)]
    f = files(spark, (1, "")).crossJoin(spark.createDataFrame([(rows,)], "secoes array<struct<numero:string,titulo:string,pagina_inicio:int,texto:string>>"))
    got = [(r.pagina, r.texto, r.id.split("_secao_")[1], r.parent_id and r.parent_id.split("_secao_")[1]) for r in H.chunk_sections(f).collect()]
    seen, want = {}, []

    def once(base):
        n = seen[base] = seen.get(base, -1) + 1
        return base + (f"_dup{n}" if n else "")

    for number, _, page, text in rows:
        for p, part in enumerate(pieces_by_search(text, H.fv.PARENT_CHUNK_CHARS, H.fv.OVERLAP_CHARS, "\n\n")):
            parent = once(f"{number}_parent{p}")
            want.append((page, part, parent, None))
            want += [(page, t, once(f"{number}_p{p}_c{c}"), parent) for c, t in enumerate(
                pieces_by_search(part, H.fv.CHILD_CHUNK_CHARS, H.fv.OVERLAP_CHARS, "\n\n"))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({r[2] for r in got}) == len(got)


def test_flat_chunks(spark):
    text = "\n\n".join(["p" * 700] * 3)
    f = files(spark, (1, "")).withColumn("secoes", F.array(F.struct(
        F.lit("2").alias("numero"), F.lit("T").alias("titulo"), F.lit(3).alias("pagina_inicio"), F.lit(text).alias("texto"))))
    rows = H.chunk_sections(f, parents=False).collect()
    assert [len(r.texto) for r in rows] == [1402, 700]
    assert rows[1].id.endswith("_secao_2_parte1") and "T (parte 2) - Página 3]" in rows[1].contexto


def test_page_chunks_pack_across_pages(spark):
    f = files(spark, (1, "curto\n\n" + "a" * 1000), (2, "b" * 1500), (3, "c" * 1000 + "\n\n" + "........."), (4, "." * 30))
    rows = H.chunk_pages(f).collect()
    parents = [(r.pagina, len(r.texto)) for r in rows if r.is_parent]
    assert parents == [(1, 2502), (3, 1000)]
    assert rows[0].id.endswith("_p1_parent0") and rows[1].id.endswith("_p1_c0_0") and rows[1].parent_id == rows[0].id
    flat = H.chunk_pages(f, parents=False).collect()
    assert [r.id.split("_c")[-1] for r in flat] == ["0", "1", "2"]


def test_html(spark):
    html = ("<!DOCTYPE html><html><head><title>T</title><script>var a='<p>x</p>';</script><style>p{}</style></head>"
            "<body><p>um &amp; dois<!-- c -->tres<br>" + "z" * 50 + "</p>\n\n\n<p>fim</body>")
    rows = html_pages(spark.createDataFrame([(1, html), (2, "<p>curto</p>")], ["k", "html"])).collect()
    assert [r.k for r in rows] == [1]
    assert rows[0].pages[0].texto == "T\num & dois\ntres\n" + "z" * 50 + "\n\nfim"


def test_html_bytes_and_cap(spark):
    body = "<p>" + "ação " * 20 + "</p>"
    df = spark.createDataFrame([(bytearray(body.encode("cp1252")),), (bytearray(body.encode("utf-8")),)], ["html"])
    texts = [r.pages[0].texto for r in html_pages(df).collect()]
    assert texts == [("ação " * 20).strip()] * 2
    assert html_pages(df, max_chars=60).first().pages[0].texto.endswith("[... conteudo truncado ...]")
