import pytest
from pyspark.sql import functions as F

from claimlens.operators import audit as A, catalog as K, facility as Y
from claimlens.sources import schemas as S

M = "202402"


@pytest.fixture(scope="module")
def cat(spark):
    data = {
        "tb_procedimento": [
            dict(co_procedimento="301", no_procedimento="Consulta", vl_sh="100.00", vl_sa="10.05", vl_sp="", vl_idade_minima="10", vl_idade_maxima="0"),
            dict(co_procedimento="302", no_procedimento="Parto", vl_sh="50", vl_sa="0", vl_sp="0", vl_idade_minima="", vl_idade_maxima=""),
        ],
        "tb_cid": [dict(co_cid="I10", no_cid="Hipertensão", tp_sexo="I"), dict(co_cid="O80", no_cid="Parto", tp_sexo="F"),
                   dict(co_cid="X01", no_cid="Sem sexo", tp_sexo=None)],
        "rl_procedimento_cid": [dict(co_procedimento="302", co_cid="O80", st_principal="S"), dict(co_procedimento="302", co_cid="X01", st_principal="N")],
        "rl_procedimento_habilitacao": [dict(co_procedimento="302", co_habilitacao="H1"), dict(co_procedimento="302", co_habilitacao="H2")],
        "rl_procedimento_servico": [dict(co_procedimento="302", co_servico="S1", co_classificacao=None)],
        "rl_procedimento_leito": [dict(co_procedimento="302", co_tipo_leito="L1")],
        "rl_procedimento_ocupacao": [dict(co_procedimento="302", co_ocupacao="C1")],
        "rl_procedimento_compativel": [dict(co_procedimento_principal="302", co_procedimento_compativel="301")],
        "rl_procedimento_incremento": [
            dict(co_procedimento="302", co_habilitacao="H2", vl_percentual_sh="33.33", vl_percentual_sa="", vl_percentual_sp="0"),
            dict(co_procedimento="302", co_habilitacao="H9", vl_percentual_sh="50", vl_percentual_sa="0", vl_percentual_sp="0")],
        "rl_procedimento_regra_cond": [], "tb_regra_condicionada": [], "tb_servico": [], "tb_servico_classificacao": [],
        "tb_habilitacao": [dict(co_habilitacao="H2", no_habilitacao="Alta")], "tb_ocupacao": [], "tb_tipo_leito": [dict(co_tipo_leito="L1", no_tipo_leito="Clínico")],
        "tb_grupo_habilitacao": [], "tb_descricao": [],
        "tb_habilitacao_cnes": [dict(cnes="A", cod_sub_grupo_habilitacao="H2"), dict(cnes="B", cod_sub_grupo_habilitacao="H7")],
        "tb_servico_cnes": [dict(cnes="A", co_servico="S1", co_classificacao=None), dict(cnes="B", co_servico="S1", co_classificacao="001")],
        "tb_leito_cnes": [dict(cnes="A", co_tipo_leito="L1", quantidade_sus="3"), dict(cnes="A", co_tipo_leito="L2", quantidade_sus=""),
                          dict(cnes="B", co_tipo_leito="L2", quantidade_sus="x")],
        "tb_profissional_cnes": [dict(cnes="A", co_ocupacao="C1", co_profissional_sus=str(i)) for i in range(3)],
    }
    out = {}
    for t, rows in data.items():
        sch = S.schema(t)
        out[t] = spark.createDataFrame([tuple({**r, S.MONTH: M}.get(c) for c in sch.names) for r in rows], sch)
    return out


COLS = ("claim_id long, codigo_procedimento string, codigo_cid string, codigo_cnes string, co_ocupacao_executante string, "
        "sexo_paciente string, idade_paciente int")


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame([
        (1, "302", "O80", "A", "C1", "F", 30),       # everything fits
        (2, "302", "O80", "B", "C9", "M", 30),       # wrong sex, facility B has nothing that is needed
        (3, "301", "I10", "A", "", "M", 5),          # diagnosis not listed, too young, no requirements
        (4, "999", "I10", "A", "C1", "F", 30),       # unknown procedure
        (5, "302", "X01", "A", "C1", "M", -1),       # diagnosis without sex, age not given
        (6, "302", "ZZZ", "Q", "C1", "", 30),        # unknown diagnosis and facility
        (7, "301", "I10", "A", None, None, None),    # nothing optional given
    ], COLS)


def test_checks_and_verdicts(spark, cat, claims):
    secs = spark.createDataFrame([(1, "301"), (1, "305"), (4, "301")], "claim_id long, co_secundario string")
    verdicts, checks, alerts = A.audit(claims, secs, cat, M)
    got = {}
    for r in checks.collect():
        got.setdefault(r.claim_id, {})[(r.tipo, r.codigo)] = r.atendido
    assert got[1] == {("cid", ""): True, ("sexo", ""): True, ("idade", ""): True, ("habilitacao", ""): True, ("servico", ""): True,
                      ("leito", ""): True, ("ocupacao_executante", ""): True,
                      ("compatibilidade_secundario", "301"): True, ("compatibilidade_secundario", "305"): False}
    assert {k[0] for k, v in got[2].items() if not v} == {"sexo", "habilitacao", "servico", "leito", "ocupacao_executante"}
    # an upper age limit of "0" stays 0, so age 5 is outside 10-0
    assert got[3] == {("cid", ""): False, ("sexo", ""): True, ("idade", ""): False}
    assert got[4] == {("procedimento", ""): False}
    assert ("idade", "") not in got[5] and got[5][("sexo", "")] is True
    assert ("sexo", "") not in got[6] and got[6][("cid", "")] is False and got[6][("habilitacao", "")] is False
    assert got[7] == {("cid", ""): False}
    v = {r.claim_id: r for r in verdicts.collect()}
    assert {k for k in v if v[k].conforme} == {5}
    assert v[1].n_pendencias == 1 and v[1].n_secundarios == 2 and str(v[1].vl_total) == "50.00"
    assert str(v[3].vl_total) == "110.05" and not v[4].proc_existe
    text = {(r.claim_id, r.tipo): r.alerta for r in alerts.collect()}
    assert text[(4, "procedimento")] == "Procedimento 999 inexistente na competencia 202402."
    assert text[(2, "habilitacao")] == "CNES B sem habilitacoes exigidas: ['H1', 'H2']."
    assert text[(2, "sexo")] == "CID O80 restrito ao sexo 'F', paciente e 'M'."
    assert text[(3, "idade")] == "Idade 5 fora da faixa permitida (10-0)."
    assert text[(1, "compatibilidade_secundario")] == "Secundario 305 incompativel com 302."


def test_bidirectional_compatibility(spark, cat, claims):
    secs = spark.createDataFrame([(3, "302")], "claim_id long, co_secundario string")
    assert A.secondary_checks(claims, secs, cat, M).first().atendido is False
    assert A.secondary_checks(claims, secs, cat, M, bidirectional=True).first().atendido is True


def test_value_with_increments(cat, claims):
    got = {r.claim_id: (str(r.vl_total_base), r.n_aplicaveis, str(r.vl_total_com_incrementos)) for r in A.claim_values(claims, cat, M).collect()}
    assert got[1] == ("50.00", 1, "66.67") and got[2] == ("50.00", 0, "50.00") and got[3] == ("110.05", 0, "110.05") and 4 not in got
    inc = {(r.codigo_cnes, r.co_habilitacao): (r.aplicavel, str(r.valor_adicional), r.no_habilitacao) for r in A.value_increments(claims, cat, M).collect()}
    assert inc[("A", "H2")] == (True, "16.67", "Alta") and inc[("A", "H9")] == (False, "0.00", "")


def test_facility_fit_and_diagnosis(cat, claims):
    fit = {(r.co_procedimento, r.codigo_cnes): r for r in A.facility_fit(claims, cat, M).collect()}
    assert fit[("302", "A")].conforme and not fit[("302", "B")].conforme and fit[("301", "A")].ok_leito is None
    d = {(r.co_procedimento, r.codigo_cid): r for r in A.diagnosis_check(claims, cat, M).collect()}
    assert d[("302", "O80")].valido and d[("302", "O80")].st_principal == "S" and d[("302", "O80")].tp_sexo == "F"
    assert d[("302", "ZZZ")].cid_nome == "CID nao encontrado" and d[("301", "I10")].msg.startswith("CID I10 NAO")


def test_facility_profile(cat):
    p = {r.cnes: r for r in Y.profile(cat, M).collect()}
    assert (p["A"].total_leitos_sus, p["A"].tipos_leito, p["A"].total_profissionais, p["A"].total_ocupacoes_distintas) == (3, 2, 3, 1)
    assert p["B"].total_leitos_sus == 0 and p["B"].total_profissionais == 0


def test_names_default_to_empty(cat):
    beds = {(r.cnes, r.co_tipo_leito): r.no_tipo_leito for r in Y.beds_named(cat, M, M).collect()}
    assert beds == {("A", "L1"): "Clínico", ("A", "L2"): "", ("B", "L2"): ""}


def test_first_by_key_is_ordered(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 1, None)], ["k", "n", "v"])
    assert sorted(map(tuple, K.first_by_key(df, "k", ["n"]).collect())) == [("a", 1, "z"), ("b", 1, None)]


def test_lookup_exact_code_wins(spark):
    cols = "co_procedimento no_procedimento vl_sh vl_sa vl_sp vl_total_hospitalar qt_x dt_competencia".split()
    t = spark.createDataFrame([("0301", "com zero", *["1"] * 5, M), ("301", "sem zero", *["1"] * 5, M)], cols)
    req = spark.createDataFrame([("0301",), ("00301",), ("9",)], ["codigo"])
    got = {r.codigo: r.no_procedimento for r in K.lookup_with_fallback(t, req).collect()}
    assert got == {"0301": "com zero", "00301": "sem zero"}


def test_compatible_pairs_have_no_repeats(spark, cat):
    req = spark.createDataFrame([("301",), ("302",)], ["co_procedimento"])
    assert K.compatible_pairs(cat["rl_procedimento_compativel"], req, M).count() == 1


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("a_b", M), ("axb", M)], ["no_cid", S.MONTH])
    assert [r.no_cid for r in K.search(df, "no_cid", "A_B").collect()] == ["a_b"]


def test_skewed_procedure(spark, cat):
    """A third of all claims on one procedure and facility: same verdicts as alone."""
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("claim_id"), F.when(F.col("id") % 3 == 0, "302").otherwise("301").alias("codigo_procedimento"),
        F.lit("O80").alias("codigo_cid"), F.lit("A").alias("codigo_cnes"), F.lit("C1").alias("co_ocupacao_executante"),
        F.lit("F").alias("sexo_paciente"), F.lit(30).alias("idade_paciente"))
    v = A.audit(df, None, cat, M)[0]
    assert v.where("conforme").count() == n // 3


@pytest.mark.parametrize("name", ["audit_claims", "audit_checks_long", "audit_alerts", "audit_details", "audit_bidirectional",
                                  "diagnosis_check", "suggest_procedures", "snapshot_diff", "claim_value", "procedure_facility_fit"])
def test_no_growing_side_is_broadcast(spark, name):
    """Frames by procedure, facility or claim must not pass the driver, however small their files look."""
    from claimlens.plans import all_queries

    df = all_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
    # domains of a fixed size (diagnoses, accreditations) may be
    assert not [x for x in joins if any(k in x for k in ("co_procedimento", "cnes", "claim_id", "l_orderkey", "co_secundario"))]
