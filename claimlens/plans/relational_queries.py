"""Registered queries: catalog, facilities, claim audit."""

from pyspark.sql import functions as F

from claimlens.functions import codes as C
from claimlens.operators import audit as A, catalog as K, facility as Y
from claimlens.plans.bindings import M1, M2
from claimlens.plans.oracle_views import proc, cnes
from claimlens.plans.registry import query
from claimlens.session import shared_dir
from claimlens.sources import snapshots as N
from claimlens.sources.schemas import MONTH

AT2 = "dt_competencia = '202402'"


# --- sources and snapshots -----------------------------------------------------------
@query("catalog_latest_snapshot", """
SELECT 'catalogo' AS fonte, max(dt_competencia) AS dt_competencia FROM tb_procedimento
UNION ALL SELECT 'cnes', max(dt_competencia) FROM tb_profissional_cnes""")
def _(b):
    cat = N.latest_month(b.tb_procedimento).select(F.lit("catalogo").alias("fonte"), MONTH)
    fac = N.latest_month(b.tb_profissional_cnes).select(F.lit("cnes").alias("fonte"), MONTH)
    return cat.unionByName(fac)


@query("snapshot_scan", """
SELECT dt_competencia, count(*) AS linhas, CAST(sum(CAST(vl_sh AS DECIMAL(14,2))) AS DOUBLE) AS soma_sh FROM
(SELECT dt_competencia, vl_sh FROM tb_procedimento) GROUP BY 1""")
def _(b):
    root = shared_dir(b.spark, "snapshots")
    N.write_snapshot(b.tb_procedimento, root, "tb_procedimento")
    months = N.list_months(b.spark, root)
    df = N.read_table(b.spark, root, "tb_procedimento", months)
    return df.groupBy(MONTH).agg(F.count("*").alias("linhas"),
                                 F.sum(C.money("vl_sh")).cast("double").alias("soma_sh"))


@query("snapshot_scan_facility", f"""
SELECT cnes, co_leito, co_tipo_leito, quantidade_sus FROM tb_leito_cnes WHERE {AT2}""")
def _(b):
    root = shared_dir(b.spark, "snapshots")
    N.write_snapshot(b.tb_leito_cnes, root, "tb_leito_cnes")
    return N.load_table(b.spark, root, "tb_leito_cnes", M2).select(
        "cnes", "co_leito", "co_tipo_leito", "quantidade_sus")


@query("catalog_at_snapshot", """
SELECT co_procedimento, no_procedimento, vl_sh, dt_competencia FROM tb_procedimento WHERE dt_competencia = '202401'""")
def _(b):
    return K.list_all(b.tb_procedimento, M1).select("co_procedimento", "no_procedimento", "vl_sh", MONTH)


@query("catalog_all_snapshots", """
SELECT co_procedimento, vl_total_hospitalar, dt_competencia FROM tb_procedimento""")
def _(b):
    return K.list_all(b.tb_procedimento).select("co_procedimento", "vl_total_hospitalar", MONTH)


@query("catalog_by_ids", f"""
SELECT co_procedimento, no_procedimento, dt_competencia FROM tb_procedimento WHERE {AT2}
AND co_procedimento IN (SELECT co_procedimento FROM v_claims)""")
def _(b):
    asked = b.claims.select(C.normalise_code("codigo_procedimento").alias("co_procedimento"))
    return K.list_by_ids(b.tb_procedimento, asked, "co_procedimento", M2).select(
        "co_procedimento", "no_procedimento", MONTH)


@query("catalog_get_first", """
SELECT co_procedimento, no_procedimento, vl_sh, dt_competencia FROM (
  SELECT *, row_number() OVER (PARTITION BY co_procedimento ORDER BY dt_competencia) AS rn FROM tb_procedimento
  WHERE co_procedimento IN (SELECT co_procedimento FROM v_claims)) WHERE rn = 1""")
def _(b):
    asked = b.claims.select(C.normalise_code("codigo_procedimento").alias("co_procedimento"))
    return K.get_by_id(b.tb_procedimento, asked, "co_procedimento").select(
        "co_procedimento", "no_procedimento", "vl_sh", MONTH)


@query("diagnosis_get", f"""
SELECT DISTINCT co_cid, no_cid, tp_sexo FROM tb_cid WHERE {AT2} AND co_cid IN (SELECT codigo_cid FROM v_claims)""")
def _(b):
    asked = b.claims.select(F.col("codigo_cid").alias("co_cid"))
    return K.get_by_id(b.tb_cid, asked, "co_cid", M2).select("co_cid", "no_cid", "tp_sexo")


@query("diagnosis_search", f"""
SELECT co_cid, no_cid FROM tb_cid WHERE {AT2} AND contains(lower(no_cid), 'nation_1') ORDER BY co_cid LIMIT 30""")
def _(b):
    return K.search(b.tb_cid, "no_cid", "NATION_1", M2, limit=30, order=["co_cid"]).select("co_cid", "no_cid")


@query("catalog_search_name", f"""
SELECT co_procedimento, no_procedimento, vl_total_hospitalar FROM tb_procedimento WHERE {AT2}
AND contains(no_procedimento_normalizado, 'acao red') ORDER BY co_procedimento LIMIT 50""")
def _(b):
    return K.search_procedures(b.tb_procedimento, "AÇÃO red", M2).select(
        "co_procedimento", "no_procedimento", "vl_total_hospitalar")


@query("catalog_search_name_group", f"""
SELECT co_procedimento AS codigo, no_procedimento AS nome FROM tb_procedimento WHERE {AT2}
AND contains(no_procedimento_normalizado, 'ring') AND co_procedimento LIKE '0000001%' ORDER BY co_procedimento LIMIT 20""")
def _(b):
    return K.search_procedures(b.tb_procedimento, "Ring", M2, group="0000001", limit=20).select(
        F.col("co_procedimento").alias("codigo"), F.col("no_procedimento").alias("nome"))


@query("catalog_by_prefix", f"""
SELECT co_procedimento, no_procedimento FROM tb_procedimento WHERE {AT2} AND co_procedimento LIKE '0000001%'""")
def _(b):
    return K.by_prefix(b.tb_procedimento, "0000001", M2).select("co_procedimento", "no_procedimento")


@query("code_normalise", """
SELECT claim_id, codigo_procedimento, CASE WHEN length(codigo_procedimento) = 10 AND codigo_procedimento LIKE '0%'
  THEN substr(codigo_procedimento, 2) ELSE codigo_procedimento END AS co_procedimento FROM v_claims""")
def _(b):
    return b.claims.select("claim_id", "codigo_procedimento",
                           C.normalise_code("codigo_procedimento").alias("co_procedimento"))


@query("code_lookup_fallback", """
WITH cat AS (SELECT ltrim(co_procedimento, '0') AS k, no_procedimento, vl_sh, tp_complexidade, qt_dias_permanencia FROM tb_procedimento
  WHERE dt_competencia = '202402')
SELECT DISTINCT c.codigo_procedimento AS codigo, cat.k AS co_procedimento, no_procedimento, vl_sh, tp_complexidade, qt_dias_permanencia
FROM v_claims c JOIN cat ON cat.k = ltrim(c.codigo_procedimento, '0')""")
def _(b):
    # a catalog whose codes lost all leading zeros
    cat = N.at_months(b.tb_procedimento, M2).withColumn("co_procedimento", C.strip_leading_zeros("co_procedimento"))
    asked = b.claims.select(F.col("codigo_procedimento").alias("codigo")).distinct()
    return K.lookup_with_fallback(cat, asked).select(
        "codigo", "co_procedimento", "no_procedimento", "vl_sh", "tp_complexidade", "qt_dias_permanencia")


@query("hierarchy_levels", f"""
SELECT 'grupo' AS nivel, co_grupo, '' AS co_sub_grupo, '' AS co_forma_organizacao, no_grupo AS nome FROM tb_grupo WHERE {AT2}
UNION ALL SELECT 'sub_grupo', co_grupo, co_sub_grupo, '', no_sub_grupo FROM tb_sub_grupo WHERE {AT2}
UNION ALL SELECT 'forma', co_grupo, co_sub_grupo, co_forma_organizacao, no_forma_organizacao FROM tb_forma_organizacao WHERE {AT2}""")
def _(b):
    return K.hierarchy(b.tb_grupo, b.tb_sub_grupo, b.tb_forma_organizacao, M2)


@query("hierarchy_subgroups", f"SELECT co_sub_grupo, no_sub_grupo AS nome FROM tb_sub_grupo WHERE {AT2} AND co_grupo = '02'")
def _(b):
    return K.hierarchy(b.tb_grupo, b.tb_sub_grupo, b.tb_forma_organizacao, M2, group="02").select("co_sub_grupo", "nome")


@query("compat_pairs_named", f"""
SELECT co_procedimento_principal, coalesce(a.no_procedimento, '') AS no_principal, co_procedimento_compativel,
  coalesce(b.no_procedimento, '') AS no_compativel, tp_compatibilidade, qt_permitida
FROM rl_procedimento_compativel r LEFT JOIN v_proc a ON a.co_procedimento = co_procedimento_principal
LEFT JOIN v_proc b ON b.co_procedimento = co_procedimento_compativel
WHERE {AT2} AND (co_procedimento_principal IN (SELECT co_procedimento FROM rl_procedimento_leito)
  OR co_procedimento_compativel IN (SELECT co_procedimento FROM rl_procedimento_leito))""")
def _(b):
    # requested: the procedures that need a bed
    return K.compatible_pairs_named(b.rl_procedimento_compativel, b.tb_procedimento, b.rl_procedimento_leito, M2).select(
        "co_procedimento_principal", "no_principal", "co_procedimento_compativel", "no_compativel",
        "tp_compatibilidade", "qt_permitida")


@query("procedure_diagnoses", f"""
SELECT r.co_procedimento, r.co_cid, d.no_cid, r.st_principal, d.tp_sexo FROM rl_procedimento_cid r
LEFT JOIN tb_cid d ON d.co_cid = r.co_cid AND d.dt_competencia = r.dt_competencia WHERE r.{AT2}""")
def _(b):
    return K.with_name(N.at_months(b.rl_procedimento_cid, M2), b.tb_cid, "co_cid", ["no_cid", "tp_sexo"], M2).select(
        "co_procedimento", "co_cid", "no_cid", "st_principal", "tp_sexo")


@query("procedure_services", f"""
SELECT r.co_procedimento, r.co_servico, s.no_servico, coalesce(r.co_classificacao, '') AS co_classificacao,
  coalesce(c.no_classificacao, '') AS no_classificacao
FROM rl_procedimento_servico r LEFT JOIN tb_servico s ON s.co_servico = r.co_servico AND s.dt_competencia = r.dt_competencia
LEFT JOIN tb_servico_classificacao c ON c.co_servico = r.co_servico AND c.co_classificacao IS NOT DISTINCT FROM r.co_classificacao
  AND c.dt_competencia = r.dt_competencia WHERE r.{AT2}""")
def _(b):
    return K.services_named(b, M2).select("co_procedimento", "co_servico", "no_servico",
        F.coalesce("co_classificacao", F.lit("")).alias("co_classificacao"), "no_classificacao")


@query("conditional_rules", f"""
SELECT r.co_procedimento, r.co_regra_condicionada, coalesce(d.no_regra_condicionada, '') AS no_regra,
  coalesce(d.ds_regra_condicionada, '') AS ds_regra
FROM rl_procedimento_regra_cond r LEFT JOIN tb_regra_condicionada d ON d.co_regra_condicionada = r.co_regra_condicionada
  AND d.dt_competencia = r.dt_competencia WHERE r.{AT2}""")
def _(b):
    return K.conditional_rules(b, M2).select("co_procedimento", "co_regra_condicionada",
        F.col("no_regra_condicionada").alias("no_regra"), F.col("ds_regra_condicionada").alias("ds_regra"))


@query("procedure_increments", f"""
SELECT r.co_procedimento, r.co_habilitacao, h.no_habilitacao, CAST(sh AS DOUBLE) AS sh, CAST(sa AS DOUBLE) AS sa, CAST(sp AS DOUBLE) AS sp
FROM rl_procedimento_incremento r JOIN tb_habilitacao h ON h.co_habilitacao = r.co_habilitacao AND h.dt_competencia = r.dt_competencia
WHERE r.{AT2}""")
def _(b):
    return K.increments_named(b, M2).select("co_procedimento", "co_habilitacao", "no_habilitacao", *[
        C.percent(f"vl_percentual_{x}").cast("double").alias(x) for x in ("sh", "sa", "sp")])


def _named_relation(section, table, code, extra, dim, name):
    return (f"SELECT r.co_procedimento, '{section}' AS relacao, r.{code} AS codigo, {extra} AS extra, coalesce(d.{name}, '') AS nome "
            f"FROM {table} r LEFT JOIN {dim} d ON d.{code} = r.{code} AND d.dt_competencia = r.dt_competencia WHERE r.{AT2}")


PROFILE_SQL = "\nUNION ALL ".join(
    _named_relation(s, t, c, f"coalesce(r.{x}, '')" if x else "''", d, n) for s, t, c, x, d, n in K.RELATIONS)


@query("procedure_profile", PROFILE_SQL)
def _(b):
    return K.procedure_profile(b, M2)


@query("procedure_sheet", f"""
SELECT p.co_procedimento, p.no_procedimento, d.ds_procedimento AS descricao,
  (SELECT count(*) FROM rl_procedimento_cid r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_cids,
  (SELECT count(*) FROM rl_procedimento_habilitacao r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_habilitacoes,
  (SELECT count(*) FROM rl_procedimento_servico r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_servicos,
  (SELECT count(*) FROM rl_procedimento_ocupacao r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_ocupacoes,
  (SELECT count(*) FROM rl_procedimento_leito r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_leitos,
  (SELECT count(*) FROM rl_procedimento_incremento r WHERE r.co_procedimento = p.co_procedimento AND r.{AT2}) AS n_incrementos
FROM tb_procedimento p LEFT JOIN tb_descricao d ON d.co_procedimento = p.co_procedimento AND d.dt_competencia = p.dt_competencia
WHERE p.{AT2}""")
def _(b):
    return K.procedure_sheet(b, M2).select("co_procedimento", "no_procedimento", "descricao", *[
        f"n_{x}" for x in ("cids", "habilitacoes", "servicos", "ocupacoes", "leitos", "incrementos")])


@query("catalog_info", """
SELECT g.dt_competencia, co_grupo, no_grupo, t.n AS total_procedimentos FROM tb_grupo g
JOIN (SELECT dt_competencia, count(DISTINCT co_procedimento) AS n FROM tb_procedimento GROUP BY 1) t USING (dt_competencia)""")
def _(b):
    return K.catalog_info(b.tb_procedimento, b.tb_grupo)


@query("suggest_procedures", f"""
SELECT co_cid, no_cid, co_procedimento, st_principal, CAST(vl_total AS DOUBLE) AS vl_total, tp_complexidade, CAST(posicao AS INTEGER) AS posicao FROM (
  SELECT x.co_cid, d.no_cid, p.co_procedimento, x.st_principal, p.vl_total, p.tp_complexidade,
    row_number() OVER (PARTITION BY x.co_cid ORDER BY vl_total DESC, p.co_procedimento, x.st_principal) AS posicao
  FROM (SELECT DISTINCT co_cid, co_procedimento, st_principal FROM v_cids) x JOIN v_proc p USING (co_procedimento)
  JOIN tb_cid d ON d.co_cid = x.co_cid AND d.{AT2}) WHERE posicao <= 30""")
def _(b):
    return K.suggest_procedures(b, M2).select("co_cid", "no_cid", "co_procedimento", "st_principal",
        F.col("vl_total").cast("double").alias("vl_total"), "tp_complexidade", "posicao")


DIFF_SQL = """
WITH a AS (SELECT * FROM tb_procedimento WHERE dt_competencia = '202401'), b AS (SELECT * FROM tb_procedimento WHERE dt_competencia = '202402'),
common AS (SELECT co_procedimento FROM a JOIN b USING (co_procedimento)),
rel AS (SELECT co_procedimento, 'cids' AS campo, co_cid AS codigo, dt_competencia FROM rl_procedimento_cid
  UNION ALL SELECT co_procedimento, 'habilitacoes', co_habilitacao, dt_competencia FROM rl_procedimento_habilitacao
  UNION ALL SELECT co_procedimento, 'servicos', co_servico || '/' || coalesce(co_classificacao, ''), dt_competencia FROM rl_procedimento_servico),
ra AS (SELECT DISTINCT co_procedimento, campo, codigo FROM rel WHERE dt_competencia = '202401'),
rb AS (SELECT DISTINCT co_procedimento, campo, codigo FROM rel WHERE dt_competencia = '202402'),
d AS (SELECT co_procedimento, 'status' AS campo, 'REMOVIDO' AS tipo, no_procedimento AS valor_a, '' AS valor_b FROM a WHERE co_procedimento NOT IN (SELECT co_procedimento FROM b)
UNION ALL SELECT co_procedimento, 'status', 'ADICIONADO', '', no_procedimento FROM b WHERE co_procedimento NOT IN (SELECT co_procedimento FROM a)
UNION ALL SELECT co_procedimento, 'vl_sh', 'ALTERADO', a.vl_sh, b.vl_sh FROM a JOIN b USING (co_procedimento) WHERE a.vl_sh <> b.vl_sh
UNION ALL SELECT co_procedimento, 'vl_sa', 'ALTERADO', a.vl_sa, b.vl_sa FROM a JOIN b USING (co_procedimento) WHERE a.vl_sa <> b.vl_sa
UNION ALL SELECT co_procedimento, 'no_procedimento', 'ALTERADO', a.no_procedimento, b.no_procedimento FROM a JOIN b USING (co_procedimento) WHERE a.no_procedimento <> b.no_procedimento
UNION ALL SELECT co_procedimento, campo, 'ADICIONADO', '', codigo FROM (SELECT * FROM rb EXCEPT SELECT * FROM ra) JOIN common USING (co_procedimento)
UNION ALL SELECT co_procedimento, campo, 'REMOVIDO', codigo, '' FROM (SELECT * FROM ra EXCEPT SELECT * FROM rb) JOIN common USING (co_procedimento))
"""


@query("snapshot_diff", DIFF_SQL + "SELECT * FROM d")
def _(b):
    return K.snapshot_diff(b, M1, M2)


@query("snapshot_diff_summary", DIFF_SQL + "SELECT co_procedimento, campo, tipo, count(*) AS quantidade FROM d GROUP BY ALL")
def _(b):
    return K.diff_summary(K.snapshot_diff(b, M1, M2))


# --- facilities ------------------------------------------------------------------------
@query("facility_beds", f"""
SELECT cnes, co_leito, l.co_tipo_leito, no_tipo_leito, coalesce(TRY_CAST(quantidade_sus AS INTEGER), 0) AS quantidade
FROM tb_leito_cnes l JOIN tb_tipo_leito t ON t.co_tipo_leito = l.co_tipo_leito AND t.dt_competencia = '202402' WHERE l.{AT2}""")
def _(b):
    return Y.beds_named(b, M2, M2).select("cnes", "co_leito", "co_tipo_leito", "no_tipo_leito",
                                          C.int_or("quantidade_sus").alias("quantidade"))


FAC_SERV = f"""
SELECT r.cnes, r.co_servico, s.no_servico, coalesce(r.co_classificacao, '') AS co_classificacao, coalesce(c.no_classificacao, '') AS no_classificacao
FROM tb_servico_cnes r LEFT JOIN tb_servico s ON s.co_servico = r.co_servico AND s.dt_competencia = r.dt_competencia
LEFT JOIN tb_servico_classificacao c ON c.co_servico = r.co_servico AND c.co_classificacao IS NOT DISTINCT FROM r.co_classificacao
  AND c.dt_competencia = r.dt_competencia WHERE r.{AT2}"""


@query("facility_services", FAC_SERV)
def _(b):
    return Y.services_named(b, M2, M2).select("cnes", "co_servico", "no_servico",
        F.coalesce("co_classificacao", F.lit("")).alias("co_classificacao"), "no_classificacao")


@query("facility_accreditations", f"""
SELECT cnes, cod_sub_grupo_habilitacao, coalesce(no_grupo_habilitacao, '') AS no_grupo, coalesce(ds_grupo_habilitacao, '') AS ds_grupo
FROM tb_habilitacao_cnes h LEFT JOIN tb_grupo_habilitacao g ON g.nu_grupo_habilitacao = cod_sub_grupo_habilitacao AND g.{AT2} WHERE h.{AT2}""")
def _(b):
    return Y.accreditations_named(b, M2, M2).select("cnes", "cod_sub_grupo_habilitacao",
        F.col("no_grupo_habilitacao").alias("no_grupo"), F.col("ds_grupo_habilitacao").alias("ds_grupo"))


@query("facility_staff", """
SELECT cnes, p.co_ocupacao, no_ocupacao, co_profissional_sus, co_vinculacao,
  coalesce(qt_carga_horaria_total_profissional, '') AS carga_horaria
FROM tb_profissional_cnes p JOIN tb_ocupacao o ON o.co_ocupacao = p.co_ocupacao AND o.dt_competencia = '202402'""")
def _(b):
    return Y.staff_named(b, M2, M2).select("cnes", "co_ocupacao", "no_ocupacao", "co_profissional_sus", "co_vinculacao",
        F.coalesce("qt_carga_horaria_total_profissional", F.lit("")).alias("carga_horaria"))


@query("facility_staff_by_cbo", """
SELECT DISTINCT p.cnes, p.co_ocupacao, p.co_profissional_sus FROM tb_profissional_cnes p
JOIN v_claims c ON c.codigo_cnes = p.cnes AND c.co_ocupacao_executante = p.co_ocupacao""")
def _(b):
    asked = b.claims.select(F.col("codigo_cnes").alias("cnes"), F.col("co_ocupacao_executante").alias("co_ocupacao"))
    return Y.of_facility(b.tb_profissional_cnes, asked, M2).select("cnes", "co_ocupacao", "co_profissional_sus")


@query("professional_records", "SELECT cnes, co_profissional_sus, co_cpf, co_cns FROM tb_dados_profissionais_cnes")
def _(b):
    return Y.professional_records(b, M2, b.tb_profissional_cnes).select("cnes", "co_profissional_sus", "co_cpf", "co_cns")


STAFF_N = """
SELECT cnes, p.co_ocupacao, no_ocupacao, count(*) AS quantidade FROM tb_profissional_cnes p
JOIN tb_ocupacao o ON o.co_ocupacao = p.co_ocupacao AND o.dt_competencia = '202402' GROUP BY ALL"""


@query("facility_staff_counts", STAFF_N)
def _(b):
    return Y.staff_by_occupation(b, M2, M2)


@query("facility_top_occupations", f"""
SELECT cnes, co_ocupacao, no_ocupacao, quantidade, CAST(posicao AS INTEGER) AS posicao FROM (
  SELECT *, row_number() OVER (PARTITION BY cnes ORDER BY quantidade DESC, co_ocupacao) AS posicao FROM ({STAFF_N})) WHERE posicao <= 3""")
def _(b):
    return Y.top_occupations(b, M2, M2, n=3)


@query("facility_profile", f"""
WITH f AS (SELECT DISTINCT cnes FROM tb_leito_cnes WHERE {AT2} UNION SELECT cnes FROM tb_profissional_cnes)
SELECT cnes,
 (SELECT coalesce(sum(coalesce(TRY_CAST(quantidade_sus AS INTEGER), 0)), 0)::BIGINT FROM tb_leito_cnes l WHERE l.cnes = f.cnes AND l.{AT2}) AS total_leitos_sus,
 (SELECT count(DISTINCT co_tipo_leito) FROM tb_leito_cnes l WHERE l.cnes = f.cnes AND l.{AT2}) AS tipos_leito,
 (SELECT count(*) FROM tb_servico_cnes l WHERE l.cnes = f.cnes AND l.{AT2}) AS total_servicos,
 (SELECT count(*) FROM tb_habilitacao_cnes l WHERE l.cnes = f.cnes AND l.{AT2}) AS total_habilitacoes,
 (SELECT count(*) FROM tb_profissional_cnes l WHERE l.cnes = f.cnes) AS total_profissionais,
 (SELECT count(DISTINCT co_ocupacao) FROM tb_profissional_cnes l WHERE l.cnes = f.cnes) AS total_ocupacoes_distintas FROM f""")
def _(b):
    return Y.profile(b, M2)


@query("facility_assets", f"""
SELECT cnes, 'leito' AS secao, l.co_tipo_leito AS codigo, co_leito AS extra, no_tipo_leito AS nome, coalesce(TRY_CAST(quantidade_sus AS BIGINT), 0) AS quantidade
FROM tb_leito_cnes l JOIN tb_tipo_leito t ON t.co_tipo_leito = l.co_tipo_leito AND t.{AT2} WHERE l.{AT2}
UNION ALL SELECT cnes, 'servico', co_servico, co_classificacao, no_servico || ' / ' || no_classificacao, 1 FROM ({FAC_SERV})
UNION ALL SELECT cnes, 'habilitacao', cod_sub_grupo_habilitacao, coalesce(ds_grupo_habilitacao, ''), coalesce(no_grupo_habilitacao, ''), 1
FROM tb_habilitacao_cnes h LEFT JOIN tb_grupo_habilitacao g ON g.nu_grupo_habilitacao = cod_sub_grupo_habilitacao AND g.{AT2} WHERE h.{AT2}
UNION ALL SELECT cnes, 'ocupacao', co_ocupacao, '', no_ocupacao, quantidade FROM ({STAFF_N})""")
def _(b):
    return Y.assets(b, M2, M2)


@query("facility_info", """
SELECT dt_competencia, 'leitos' AS tipo, count(DISTINCT cnes) AS total_cnes FROM tb_leito_cnes GROUP BY ALL
UNION ALL SELECT dt_competencia, 'servicos', count(DISTINCT cnes) FROM tb_servico_cnes GROUP BY ALL
UNION ALL SELECT dt_competencia, 'habilitacoes', count(DISTINCT cnes) FROM tb_habilitacao_cnes GROUP BY ALL
UNION ALL SELECT dt_competencia, 'profissionais', count(DISTINCT cnes) FROM tb_profissional_cnes GROUP BY ALL""")
def _(b):
    return Y.info(b)


# --- claim audit -------------------------------------------------------------------------
def _verdicts(b):
    v, _, _ = A.audit(b.claims, b.claim_secondaries, b, M2)
    return v.select("claim_id", "codigo_cnes", "co_procedimento", "proc_existe", "conforme", "n_pendencias",
                    "n_secundarios", F.col("vl_total").cast("double").alias("vl_total"))


query("audit_claims", "SELECT * FROM v_verdicts")(_verdicts)


@query("audit_checks_long", "SELECT claim_id, ordem, tipo, codigo, atendido FROM v_long")
def _(b):
    _, checks, _ = A.audit(b.claims, b.claim_secondaries, b, M2)
    return checks.drop("alerta")


@query("audit_alerts", "SELECT claim_id, ordem, tipo, codigo, alerta FROM v_long WHERE NOT atendido")
def _(b):
    return A.audit(b.claims, b.claim_secondaries, b, M2)[2]


@query("audit_details", """
SELECT claim_id, coalesce(no_cid, 'CID nao encontrado') AS no_cid, coalesce(st_principal, '') AS st_principal,
  CASE WHEN existe THEN (SELECT count(*) FROM v_cids x WHERE x.co_procedimento = v.co_procedimento) ELSE 0 END AS total_cids,
  CASE WHEN existe THEN (SELECT count(*) FROM tb_profissional_cnes p WHERE p.cnes = v.codigo_cnes AND p.co_ocupacao = v.co_ocupacao_executante) ELSE -1 END AS profissionais
FROM v_checks v""")
def _(b):
    ev = A.evaluate(b.claims, b, M2)
    return ev.select("claim_id", "no_cid", "st_principal", "total_cids",
                     F.coalesce("profissionais_no_cnes", F.lit(-1)).cast("long").alias("profissionais"))


@query("audit_bidirectional", """
SELECT s.claim_id, s.co_secundario, s.atendido OR v.s IS NOT NULL AS atendido FROM v_sec_checks s
LEFT JOIN v_compat v ON v.p = s.co_secundario AND v.s = s.co_procedimento""")
def _(b):
    return A.secondary_checks(b.claims, b.claim_secondaries, b, M2, bidirectional=True).select(
        "claim_id", "co_secundario", "atendido")


VALUE_SQL = f"""
WITH inc AS (SELECT r.co_procedimento, r.co_habilitacao, sh, sa, sp, p.vl_sh * sh / 100.0 AS _x,
    CAST(p.vl_sh * sh * 0.01 + p.vl_sa * sa * 0.01 + p.vl_sp * sp * 0.01 AS DECIMAL(28,6)) AS add_v
  FROM rl_procedimento_incremento r JOIN v_proc p USING (co_procedimento) WHERE r.{AT2})
"""


@query("claim_value", VALUE_SQL + """
SELECT c.claim_id, c.co_procedimento, c.codigo_cnes, CAST(p.vl_total AS DOUBLE) AS vl_total_base, CAST(count(h.cnes) AS INTEGER) AS n_aplicaveis,
  CAST(round(p.vl_total + coalesce(sum(CASE WHEN h.cnes IS NOT NULL THEN i.add_v END), 0), 2) AS DOUBLE) AS vl_total_com_incrementos
FROM v_claims c JOIN v_proc p USING (co_procedimento) LEFT JOIN inc i USING (co_procedimento)
LEFT JOIN c_hab h ON h.cnes = c.codigo_cnes AND h.code = i.co_habilitacao GROUP BY c.claim_id, c.co_procedimento, c.codigo_cnes, p.vl_total""")
def _(b):
    req = b.claims.select("claim_id", "codigo_procedimento", "codigo_cnes")
    return A.claim_values(req, b, M2).select("claim_id", "co_procedimento", "codigo_cnes",
        F.col("vl_total_base").cast("double").alias("vl_total_base"), "n_aplicaveis",
        F.col("vl_total_com_incrementos").cast("double").alias("vl_total_com_incrementos"))


@query("value_increments", VALUE_SQL + f"""
SELECT q.co_procedimento, q.codigo_cnes, i.co_habilitacao, no_habilitacao, h.cnes IS NOT NULL AS aplicavel, CAST(sh AS DOUBLE) AS pct_sh,
  CAST(CASE WHEN h.cnes IS NOT NULL THEN round(add_v, 2) ELSE 0 END AS DOUBLE) AS valor_adicional
FROM (SELECT DISTINCT co_procedimento, codigo_cnes FROM v_claims) q JOIN inc i USING (co_procedimento)
JOIN tb_habilitacao t ON t.co_habilitacao = i.co_habilitacao AND t.{AT2}
LEFT JOIN c_hab h ON h.cnes = q.codigo_cnes AND h.code = i.co_habilitacao""")
def _(b):
    return A.value_increments(b.claims, b, M2).select("co_procedimento", "codigo_cnes", "co_habilitacao", "no_habilitacao",
        "aplicavel", F.col("pct_sh").cast("double").alias("pct_sh"), F.col("valor_adicional").cast("double").alias("valor_adicional"))


@query("procedure_facility_fit", """
SELECT co_procedimento, codigo_cnes,
  CASE WHEN ok_hab THEN 1 WHEN NOT ok_hab THEN 0 ELSE -1 END AS habilitacao, CASE WHEN ok_serv THEN 1 WHEN NOT ok_serv THEN 0 ELSE -1 END AS servico,
  CASE WHEN ok_leito THEN 1 WHEN NOT ok_leito THEN 0 ELSE -1 END AS leito, CASE WHEN ok_prof THEN 1 WHEN NOT ok_prof THEN 0 ELSE -1 END AS profissional,
  coalesce(ok_hab, true) AND coalesce(ok_serv, true) AND coalesce(ok_leito, true) AND coalesce(ok_prof, true) AS conforme
FROM v_pairs JOIN v_proc USING (co_procedimento)""")
def _(b):
    tri = lambda c: F.when(F.col(c).isNull(), -1).when(F.col(c), 1).otherwise(0).alias(c[3:])
    return A.facility_fit(b.claims, b, M2).select("co_procedimento", "codigo_cnes", *[
        tri(f"ok_{k}") for k in ("habilitacao", "servico", "leito", "profissional")], "conforme")


@query("diagnosis_check", """
SELECT DISTINCT co_procedimento, codigo_cid, ok_cid AS valido, coalesce(no_cid, CASE WHEN ok_cid THEN '' ELSE 'CID nao encontrado' END) AS cid_nome,
  coalesce(st_principal, '') AS st_principal, CASE WHEN ok_cid THEN coalesce(tp_sexo, '') ELSE '' END AS tp_sexo,
  CASE WHEN NOT ok_cid THEN 'CID ' || codigo_cid || ' NAO e permitido para o procedimento ' || co_procedimento || '.' ELSE '' END AS msg
FROM v_checks WHERE existe""")
def _(b):
    return A.diagnosis_check(b.claims, b, M2).drop("no_procedimento", "total_cids")


AS_OF = """
WITH q AS (SELECT claim_id, codigo_cnes, CASE claim_id % 3 WHEN 0 THEN '202312' WHEN 1 THEN '202401' ELSE '202403' END AS competencia FROM v_claims),
m AS (SELECT claim_id, q.codigo_cnes, competencia, (SELECT max(l.dt_competencia) FROM tb_leito_cnes l WHERE l.cnes = q.codigo_cnes AND l.dt_competencia <= q.competencia) AS mes_cnes FROM q)
"""


def _dated_claims(b):
    k = F.col("claim_id") % 3
    return b.claims.select("claim_id", "codigo_cnes", F.when(k == 0, "202312").when(k == 1, "202401").otherwise("202403").alias("competencia"))


@query("facility_month_as_of", AS_OF + "SELECT claim_id, codigo_cnes, competencia, mes_cnes FROM m")
def _(b):
    """Claims of months that the registry does not have, is older than, or has without their facility."""
    return Y.as_of_months(_dated_claims(b), b.tb_leito_cnes)


@query("facility_beds_as_of", AS_OF + """
SELECT claim_id, competencia, mes_cnes, co_leito, quantidade_sus FROM m JOIN tb_leito_cnes l ON l.cnes = m.codigo_cnes AND l.dt_competencia = m.mes_cnes""")
def _(b):
    return Y.rows_as_of(_dated_claims(b), b.tb_leito_cnes).select("claim_id", "competencia", "mes_cnes", "co_leito", "quantidade_sus")
