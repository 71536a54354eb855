import pytest
from pyspark.sql import functions as F

from claimlens.functions import codes as C, questions as Q, rules as R, text as T
from claimlens.functions.vectors import cosine_similarity


@pytest.mark.parametrize("raw,want", [
    ("0304010390", "304010390"), ("304010390", "304010390"), ("1234567890", "1234567890"),
    ("  0304010390  ", "304010390"), ("\t0304010390\n", "304010390"), ("", ""), ("12345", "12345"),
    ("03.04.01.039-0", "03.04.01.039-0"),
])
def test_normalise_code(one, raw, want):
    assert one(C.normalise_code, raw) == want


def test_codes_from_csv(one):
    assert one(C.codes_from_csv, " 0301010072, ,0415020018,x") == ["301010072", "415020018", "x"]


def test_pad_code_never_cuts(one):
    assert one(lambda v: C.pad_code(v, 9), 1234567890123) == "1234567890123"
    assert one(lambda v: C.pad_code(v, 9), 7) == "000000007"


def test_money_of_bad_text_is_zero(one):
    assert str(one(C.money, "")) == "0.00" and str(one(C.money, "12.345")) == "12.35" and str(one(C.money, "x")) == "0.00"


def test_int_default_keeps_zero(one):
    f = lambda v: C.int_or(v, 999)
    assert one(f, "0") == 0 and one(f, "") == 999


def test_tokens(one):
    assert set(one(T.tokens, "Ação Emergência")) == {"acao", "emergencia"}
    got = one(T.tokens, "o procedimento de saúde para o paciente")
    assert got == ["procedimento", "saude", "paciente"]
    assert one(T.tokens, "CID-10: I10.0") == ["cid", "10", "i10"]
    assert one(T.tokens, "a é o x y") == [] and one(T.tokens, "") == []
    assert one(T.tokens, "leito leito") == ["leito", "leito"]


def test_fold_covers_latin_letters(one):
    assert one(T.fold, "ÀÉÎÕÜÇÑ ŠŽĀ ß ø") == "aeioucn sza ß ø"
    assert one(T.fold, "é") == "e"
    assert one(T.normalise_spaces, "  Ação \n\t X ") == "acao x"


def test_context_prefix_and_first_line(one):
    assert one(T.drop_context_prefix, "[Manual X]\n\ncorpo") == "corpo"
    assert one(T.drop_context_prefix, "[Outro]\n\ncorpo") == "[Outro]\n\ncorpo"
    assert one(T.drop_context_prefix, "[Manual sem fim") == "[Manual sem fim"
    assert one(T.first_line, " Titulo \nresto") == "Titulo"


def test_truncate(one):
    assert one(lambda v: T.truncate(v, 3), "abcd") == "abc\n[...truncado]"
    assert one(lambda v: T.truncate(v, 3), "abc") == "abc"


def test_section_sort_key_is_numeric(spark):
    rows = spark.createDataFrame([("4.10",), ("4.9",), ("10",), ("4.x.2",)], ["s"])
    assert [r.s for r in rows.orderBy(T.section_sort_key("s")).collect()] == ["4.x.2", "4.9", "4.10", "10"]


def test_verdict_line(one):
    assert one(T.verdict_line, "x\n  Veredicto: OK \nCONFORME") == "Veredicto: OK"
    assert one(T.verdict_line, "nada") == "?"


def test_filters(one):
    q = "portaria de 2024 sobre OPM"
    assert one(Q.year_filter, q) == "2024" and one(Q.type_filter, q) == "portaria"
    assert one(Q.type_filter, "manual do SIH sobre AIH") == "manual"
    assert one(Q.type_filter, "manual e portaria") is None
    assert one(Q.type_filter, "ver tabela  sigtap e portaria") == "anexo_sigtap"
    assert one(Q.year_filter, "como funciona o faturamento") is None


def test_sub_questions(one):
    got = one(Q.sub_questions, "como preencher AIH")
    assert got[0] == "como preencher AIH" and any("autorizacao internacao hospitalar" in x for x in got)
    assert len(one(Q.sub_questions, "diferença entre SH e SP no procedimento")) >= 2
    assert "cirurgia eletiva" in one(Q.sub_questions, "diferença entre cirurgia eletiva e de urgência")
    assert one(Q.sub_questions, "teste simples") == ["teste simples"]
    # keys are whole words: rule 129 is not rule 12
    assert len(one(Q.sub_questions, "critica 129")) == 1
    assert one(Q.sub_questions, "critica 12")[1].startswith("critica 12 diagnostico")


def test_sub_questions_keep_order_and_repeat_nothing(one):
    got = one(Q.sub_questions, "regras de OPM e quantidade de OPM")
    assert got == ["regras de OPM e quantidade de OPM", "regras de OPM", "quantidade de OPM",
                   "regras de OPM e quantidade de OPM orteses proteses materiais especiais OPM"]


def test_reformulations(one):
    got = one(Q.reformulations, "qual o leito de uti")
    assert got == ["qual o leito de uti", "qual o leito de uti SIH/SUS regras manual",
                   "qual o leito de uti unidade terapia intensiva", "leito uti"]
    assert one(Q.reformulations, "manual") == ["manual"]


def test_short_questions(one):
    assert one(Q.is_short, "050046") and one(Q.is_short, " dois termos ") and not one(Q.is_short, "um dois tres")


def test_rule_definitions(spark):
    text = "x CRITICA_7: {\n codigo: '050046',\n nome: 'nome da regra',\n campos: ['a', \"b\" , ],\n}, CRITICA_8:{codigo:'1',nome:'n',campos:[]}"
    rows = R.rule_definitions(spark.createDataFrame([(text,)], ["t"]), "t").orderBy("numero").collect()
    assert [(r.numero, r.codigo, r.nome, r.campos) for r in rows] == [
        (7, "050046", "nome da regra", ["a", "b"]), (8, "1", "n", [])]


def test_rule_enrichment_first_keyword_wins(one):
    assert one(R.enriched_name, "Leito e DIÁRIA") == "Leito e DIÁRIA especialidade leito CNES cadastro"
    assert one(R.enriched_name, "sem palavra") == "sem palavra"


def test_source_terms_end_with_the_name(one):
    got = one(R.source_search_terms, "if (CBO) { rlProcedimentoCid }", "nome")
    assert got == ["compatibilidade CID diagnostico procedimento SIGTAP CID-10",
                   "CBO classificacao brasileira ocupacoes medico profissional CNES", "nome"]


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], ["a", "b"])
    assert [round(r[0], 9) for r in df.select(cosine_similarity("a", "b")).collect()] == [1.0, 0.0, 0.0]


def test_group_description(one):
    assert one(C.group_description, "07").startswith("orteses") and one(C.group_description, "99") == "grupo 99"


def test_question_functions_run_over_a_table(spark):
    df = spark.range(1000).select(F.concat(F.lit("critica 7 caso "), "id").alias("q"))
    assert df.select(F.explode(Q.sub_questions("q"))).count() == 2000
