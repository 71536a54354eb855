"""The derivations of ``plans.bindings`` in DuckDB SQL, as named WITH parts."""

import re

VIEWS = {}


def view(name, sql):
    VIEWS[name] = sql.strip()


def with_views(body):
    """The query with a WITH part for every view it names, directly or not."""
    order, seen = [], set()

    def visit(sql):
        for name in re.findall(r"[A-Za-z_]\w*", sql):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    m = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if m:
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{parts},\n{body[m.end():]}"
    return f"WITH {parts}\n{body}"


def pad(expr, width):
    return (f"(CASE WHEN length(CAST({expr} AS VARCHAR)) >= {width} THEN CAST({expr} AS VARCHAR) "
            f"ELSE lpad(CAST({expr} AS VARCHAR), {width}, '0') END)")


def proc(e):
    return pad(e, 9)


def cnes(e):
    return pad(e, 7)


MONTHS = "(VALUES ('202401'), ('202402')) AS m(dt_competencia)"
BOTH = f"CROSS JOIN {MONTHS}"

view("v_lines", """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice, l_shipdate, l_returnflag) AS rk FROM lineitem""")
view("v_claims", f"""
SELECT o_orderkey AS claim_id, '0' || {proc('l_partkey')} AS codigo_procedimento, {proc('l_partkey')} AS co_procedimento,
  l_returnflag || {pad('l_linenumber', 2)} AS codigo_cid, {cnes('l_suppkey')} AS codigo_cnes,
  substr(o_orderpriority, 1, 1) AS co_ocupacao_executante,
  CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sexo_paciente, CAST(o_custkey % 90 AS INTEGER) AS idade_paciente
FROM v_lines JOIN orders ON o_orderkey = l_orderkey WHERE rk = 1""")
view("v_secondaries", f"""
SELECT DISTINCT l_orderkey AS claim_id, {proc('l_partkey')} AS co_secundario FROM v_lines
WHERE rk > 1 AND l_orderkey IN (SELECT o_orderkey FROM orders)""")

view("tb_procedimento", f"""
SELECT {proc('p_partkey')} AS co_procedimento,
  CASE WHEN p_partkey % 4 = 0 THEN 'Ação ' || p_name ELSE p_name END AS no_procedimento,
  CAST(p_size % 3 AS VARCHAR) AS tp_complexidade, CAST(p_size % 4 + 1 AS VARCHAR) AS qt_maxima_execucao,
  CAST(p_size % 12 AS VARCHAR) AS qt_dias_permanencia,
  CAST(p_size % 20 AS VARCHAR) AS vl_idade_minima, CAST(p_size % 20 + 60 AS VARCHAR) AS vl_idade_maxima,
  CAST(CAST(CAST(p_retailprice AS DECIMAL(14,2)) * CASE WHEN dt_competencia = '202402' AND p_partkey % 7 = 0
    THEN 1.10 ELSE 1.00 END AS DECIMAL(14,2)) AS VARCHAR) AS vl_sh,
  CAST(CAST(CAST(p_retailprice AS DECIMAL(14,2)) * 0.10 AS DECIMAL(14,2)) AS VARCHAR) AS vl_sa,
  CAST(CAST(CAST(p_retailprice AS DECIMAL(14,2)) * 0.25 AS DECIMAL(14,2)) AS VARCHAR) AS vl_sp,
  CAST(CAST(CAST(p_retailprice AS DECIMAL(14,2)) * 1.25 AS DECIMAL(14,2)) AS VARCHAR) AS vl_total_hospitalar,
  strip_accents(lower(CASE WHEN p_partkey % 4 = 0 THEN 'Ação ' || p_name ELSE p_name END)) AS no_procedimento_normalizado,
  dt_competencia
FROM part {BOTH}
WHERE (dt_competencia = '202401' AND p_partkey % 20 <> 0) OR (dt_competencia = '202402' AND p_partkey % 20 <> 1)""")
view("tb_descricao", f"""
SELECT {proc('p_partkey')} AS co_procedimento, p_name || ' ' || p_type || ' ' || p_brand AS ds_procedimento,
  dt_competencia FROM part {BOTH}""")
view("tb_cid", f"""
SELECT substr('ANR', CAST(n_nationkey // 7 AS INTEGER) + 1, 1) || {pad('n_nationkey % 7 + 1', 2)} AS co_cid,
  'Doença ' || n_name AS no_cid, substr('IFM', CAST(n_nationkey // 7 AS INTEGER) + 1, 1) AS tp_sexo, dt_competencia
FROM nation {BOTH} WHERE n_nationkey < 21""")


def _domain(name, code, label, below, width):
    cond = f"WHERE n_nationkey < {below}" if below else ""
    view(name, f"SELECT {pad('n_nationkey', width)} AS {code}, n_name AS {label}, dt_competencia FROM nation {BOTH} {cond}")


_domain("tb_habilitacao", "co_habilitacao", "no_habilitacao", None, 2)
_domain("tb_servico", "co_servico", "no_servico", 10, 3)
_domain("tb_tipo_leito", "co_tipo_leito", "no_tipo_leito", 6, 2)
view("tb_grupo_habilitacao", f"""
SELECT {pad('n_nationkey', 2)} AS nu_grupo_habilitacao, n_name AS no_grupo_habilitacao,
  'regiao ' || n_regionkey AS ds_grupo_habilitacao, dt_competencia FROM nation {BOTH} WHERE n_nationkey % 2 = 0""")
view("tb_servico_classificacao", f"""
SELECT {pad('n_nationkey', 3)} AS co_servico, c AS co_classificacao, n_name || ' ' || coalesce(c, 'geral') AS no_classificacao,
  dt_competencia FROM nation {BOTH} CROSS JOIN (VALUES ('000'), ('001'), (NULL)) AS k(c) WHERE n_nationkey < 10""")
view("tb_ocupacao", f"""
SELECT CAST(r_regionkey + 1 AS VARCHAR) AS co_ocupacao, r_name AS no_ocupacao, dt_competencia FROM region {BOTH}""")
view("tb_regra_condicionada", f"""
SELECT {pad('n_nationkey', 4)} AS co_regra_condicionada, n_name AS no_regra_condicionada,
  'regra da regiao ' || n_regionkey AS ds_regra_condicionada, dt_competencia FROM nation {BOTH} WHERE n_nationkey < 4""")
view("tb_grupo", f"SELECT {pad('r_regionkey', 2)} AS co_grupo, r_name AS no_grupo, dt_competencia FROM region {BOTH}")
view("tb_sub_grupo", f"""
SELECT {pad('n_regionkey', 2)} AS co_grupo, {pad('n_nationkey', 2)} AS co_sub_grupo, n_name AS no_sub_grupo, dt_competencia
FROM nation {BOTH}""")
view("tb_forma_organizacao", f"""
SELECT {pad('n_regionkey', 2)} AS co_grupo, {pad('n_nationkey', 2)} AS co_sub_grupo,
  {cnes('s_suppkey')} AS co_forma_organizacao, s_name AS no_forma_organizacao, dt_competencia
FROM supplier JOIN nation ON s_nationkey = n_nationkey {BOTH}""")

view("rl_procedimento_cid", f"""
SELECT {proc('p_partkey')} AS co_procedimento, l || {pad('n', 2)} AS co_cid,
  CASE WHEN n <= 3 THEN 'S' ELSE 'N' END AS st_principal, dt_competencia
FROM part {BOTH} CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS a(l) CROSS JOIN range(1, 8) AS b(n)
WHERE CASE WHEN dt_competencia = '202402' AND p_partkey % 10 = 0 THEN (p_partkey + n) % 4 <> 0 ELSE (p_partkey + n) % 3 <> 0 END""")
view("rl_procedimento_habilitacao", f"""
SELECT DISTINCT {proc('p_partkey')} AS co_procedimento, {pad('h', 2)} AS co_habilitacao, {pad('h', 2)} AS nu_grupo_habilitacao, dt_competencia
FROM (SELECT p_partkey, dt_competencia, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) - 1 AS h FROM part {BOTH} WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, dt_competencia, p_size % 25 FROM part {BOTH}
  WHERE p_size % 2 = 0 AND NOT (dt_competencia = '202402' AND p_partkey % 11 = 0))""")
view("rl_procedimento_servico", f"""
SELECT co_procedimento, co_servico, CASE WHEN c <> 2 THEN {pad('c', 3)} END AS co_classificacao, dt_competencia
FROM (SELECT {proc('p_partkey')} AS co_procedimento, {pad('p_size % 10', 3)} AS co_servico,
  (p_partkey % 3 + CASE WHEN dt_competencia = '202402' AND p_partkey % 13 = 0 THEN 1 ELSE 0 END) % 3 AS c, dt_competencia
  FROM part {BOTH} WHERE p_size % 5 = 0)""")
view("rl_procedimento_leito", f"""
SELECT {proc('p_partkey')} AS co_procedimento, {pad('p_partkey % 6', 2)} AS co_tipo_leito, dt_competencia
FROM part {BOTH} WHERE p_size % 4 = 0""")
view("rl_procedimento_ocupacao", f"""
SELECT DISTINCT {proc('p_partkey')} AS co_procedimento, CAST(unnest([p_partkey % 5 + 1, (p_partkey + 2) % 5 + 1]) AS VARCHAR) AS co_ocupacao,
  dt_competencia FROM part {BOTH} WHERE p_partkey % 3 = 0""")
view("rl_procedimento_compativel", f"""
SELECT DISTINCT {proc('f.l_partkey')} AS co_procedimento_principal, {proc('x.l_partkey')} AS co_procedimento_compativel,
  '1' AS tp_compatibilidade, '1' AS qt_permitida, dt_competencia
FROM v_lines f JOIN v_lines x ON f.l_orderkey = x.l_orderkey AND f.rk = 1 AND x.l_partkey <> f.l_partkey
  AND (x.l_partkey + f.l_partkey) % 2 = 0 {BOTH}""")
view("rl_procedimento_incremento", f"""
SELECT {proc('p_partkey')} AS co_procedimento, {pad('p_partkey % 25', 2)} AS co_habilitacao,
  CAST((p_size % 10) * 5 AS DECIMAL(7,2)) AS sh, CAST(p_size % 4 AS DECIMAL(7,2)) AS sa,
  CAST((p_size % 6) * 2.5 AS DECIMAL(7,2)) AS sp, dt_competencia FROM part {BOTH} WHERE p_partkey % 5 = 0""")
view("rl_procedimento_regra_cond", f"""
SELECT {proc('p_partkey')} AS co_procedimento, {pad('p_size % 5', 4)} AS co_regra_condicionada, dt_competencia
FROM part {BOTH} WHERE p_partkey % 6 = 0""")

view("tb_habilitacao_cnes", f"""
SELECT {cnes('s_suppkey')} AS cnes, {pad('s_nationkey', 2)} AS cod_sub_grupo_habilitacao, dt_competencia
FROM supplier {BOTH} WHERE dt_competencia = '202402' OR s_suppkey % 10 <> 3""")
view("tb_servico_cnes", f"""
SELECT DISTINCT {cnes('s_suppkey')} AS cnes, lpad(CAST(unnest([s_suppkey % 10, (s_suppkey * 7) % 10]) AS VARCHAR), 3, '0') AS co_servico,
  CASE WHEN s_suppkey % 3 <> 2 THEN {pad('s_suppkey % 3', 3)} END AS co_classificacao, '1' AS tp_caracteristica, dt_competencia
FROM supplier {BOTH} WHERE dt_competencia = '202402' OR s_suppkey % 10 <> 3""")
view("tb_leito_cnes", f"""
SELECT {cnes('s_suppkey')} AS cnes, {pad('j + 1', 2)} AS co_leito, {pad('(s_suppkey + j) % 6', 2)} AS co_tipo_leito,
  CASE WHEN ((s_suppkey * (j + 1)) % 20) % 7 = 0 THEN '' ELSE CAST((s_suppkey * (j + 1)) % 20 AS VARCHAR) END AS quantidade_sus, dt_competencia
FROM supplier {BOTH} CROSS JOIN range(0, 3) AS r(j) WHERE dt_competencia = '202402' OR s_suppkey % 10 <> 3""")
view("v_staff", """
SELECT DISTINCT l_suppkey AS k, substr(o_orderpriority, 1, 1) AS cbo, o_custkey AS c
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
view("tb_profissional_cnes", f"""
SELECT {cnes('k')} AS cnes, cbo AS co_ocupacao, CAST(c AS VARCHAR) AS co_profissional_sus, '1' AS co_vinculacao,
  CASE WHEN c % 5 <> 0 THEN CAST(c % 40 AS VARCHAR) END AS qt_carga_horaria_total_profissional, '202402' AS dt_competencia FROM v_staff""")
view("tb_dados_profissionais_cnes", f"""
SELECT DISTINCT {cnes('k')} AS cnes, CAST(c AS VARCHAR) AS co_profissional_sus, {pad('c', 11)} AS co_cpf, {pad('c', 15)} AS co_cns,
  '202402' AS dt_competencia FROM v_staff""")

# --- claim audit -------------------------------------------------------------------
view("v_proc", """
SELECT co_procedimento, no_procedimento, tp_complexidade, TRY_CAST(vl_idade_minima AS INTEGER) AS mn, TRY_CAST(vl_idade_maxima AS INTEGER) AS mx,
  CAST(vl_sh AS DECIMAL(14,2)) AS vl_sh, CAST(vl_sa AS DECIMAL(14,2)) AS vl_sa, CAST(vl_sp AS DECIMAL(14,2)) AS vl_sp,
  CAST(vl_sh AS DECIMAL(14,2)) + CAST(vl_sa AS DECIMAL(14,2)) + CAST(vl_sp AS DECIMAL(14,2)) AS vl_total
FROM tb_procedimento WHERE dt_competencia = '202402'""")


def _req(name, key, table, cols):
    view(name, f"SELECT DISTINCT {key}, {cols} FROM {table} WHERE dt_competencia = '202402'")


_req("r_hab", "co_procedimento", "rl_procedimento_habilitacao", "co_habilitacao AS code")
_req("r_serv", "co_procedimento", "rl_procedimento_servico", "co_servico || '/' || coalesce(co_classificacao, '-') AS code")
_req("r_leito", "co_procedimento", "rl_procedimento_leito", "co_tipo_leito AS code")
_req("r_ocup", "co_procedimento", "rl_procedimento_ocupacao", "co_ocupacao AS code")
_req("c_hab", "cnes", "tb_habilitacao_cnes", "cod_sub_grupo_habilitacao AS code")
_req("c_serv", "cnes", "tb_servico_cnes", "co_servico || '/' || coalesce(co_classificacao, '-') AS code")
_req("c_leito", "cnes", "tb_leito_cnes", "co_tipo_leito AS code")
_req("c_ocup", "cnes", "tb_profissional_cnes", "co_ocupacao AS code")
view("v_cids", "SELECT * FROM rl_procedimento_cid WHERE dt_competencia = '202402'")
view("v_compat", """
SELECT DISTINCT co_procedimento_principal AS p, co_procedimento_compativel AS s FROM rl_procedimento_compativel
WHERE dt_competencia = '202402'""")


def overlap(req, has, claim="c"):
    """NULL without requirement, else whether any required code is possessed."""
    return (f"CASE WHEN EXISTS (SELECT 1 FROM {req} r WHERE r.co_procedimento = {claim}.co_procedimento) THEN "
            f"EXISTS (SELECT 1 FROM {req} r JOIN {has} h ON h.code = r.code "
            f"WHERE r.co_procedimento = {claim}.co_procedimento AND h.cnes = {claim}.codigo_cnes) END")


view("v_pairs", f"""
SELECT *, {overlap('r_hab', 'c_hab', 'q')} AS ok_hab, {overlap('r_serv', 'c_serv', 'q')} AS ok_serv,
  {overlap('r_leito', 'c_leito', 'q')} AS ok_leito, {overlap('r_ocup', 'c_ocup', 'q')} AS ok_prof
FROM (SELECT DISTINCT co_procedimento, codigo_cnes FROM v_claims) q""")
view("v_checks", """
SELECT c.*, p.co_procedimento IS NOT NULL AS existe, p.no_procedimento, p.mn, p.mx,
  coalesce(p.vl_sh, 0) AS vl_sh, coalesce(p.vl_sa, 0) AS vl_sa, coalesce(p.vl_sp, 0) AS vl_sp, coalesce(p.vl_total, 0) AS vl_total,
  d.no_cid, d.tp_sexo, x.st_principal,
  CASE WHEN p.co_procedimento IS NOT NULL THEN x.st_principal IS NOT NULL END AS ok_cid,
  CASE WHEN p.co_procedimento IS NOT NULL AND d.co_cid IS NOT NULL THEN d.tp_sexo IN ('', 'I') OR d.tp_sexo = c.sexo_paciente END AS ok_sexo,
  CASE WHEN p.co_procedimento IS NOT NULL THEN c.idade_paciente BETWEEN p.mn AND p.mx END AS ok_idade,
  CASE WHEN p.co_procedimento IS NOT NULL THEN q.ok_hab END AS ok_hab,
  CASE WHEN p.co_procedimento IS NOT NULL THEN q.ok_serv END AS ok_serv,
  CASE WHEN p.co_procedimento IS NOT NULL THEN q.ok_leito END AS ok_leito,
  CASE WHEN p.co_procedimento IS NOT NULL THEN
    NOT EXISTS (SELECT 1 FROM r_ocup r WHERE r.co_procedimento = c.co_procedimento)
    OR EXISTS (SELECT 1 FROM r_ocup r WHERE r.co_procedimento = c.co_procedimento AND r.code = c.co_ocupacao_executante) END AS ok_ocup
FROM v_claims c LEFT JOIN v_proc p USING (co_procedimento)
LEFT JOIN (SELECT * FROM tb_cid WHERE dt_competencia = '202402') d ON d.co_cid = c.codigo_cid
LEFT JOIN v_cids x ON x.co_procedimento = c.co_procedimento AND x.co_cid = c.codigo_cid
LEFT JOIN v_pairs q ON q.co_procedimento = c.co_procedimento AND q.codigo_cnes = c.codigo_cnes""")
view("v_sec_checks", """
SELECT s.claim_id, c.co_procedimento, s.co_secundario, v.s IS NOT NULL AS atendido
FROM v_secondaries s JOIN v_claims c USING (claim_id) JOIN v_proc p ON p.co_procedimento = c.co_procedimento
LEFT JOIN v_compat v ON v.p = c.co_procedimento AND v.s = s.co_secundario""")


def codes(req):
    return (f"(SELECT '[' || string_agg('''' || code || '''', ', ' ORDER BY code) || ']' FROM {req} r "
            "WHERE r.co_procedimento = c.co_procedimento)")


view("v_long", f"""
SELECT claim_id, 1 AS ordem, 'procedimento' AS tipo, '' AS codigo, false AS atendido,
  'Procedimento ' || co_procedimento || ' inexistente na competencia 202402.' AS alerta FROM v_checks WHERE NOT existe
UNION ALL SELECT claim_id, 2, 'cid', '', ok_cid, 'CID ' || codigo_cid || ' NAO e permitido para o procedimento ' || co_procedimento || '.' FROM v_checks WHERE ok_cid IS NOT NULL
UNION ALL SELECT claim_id, 3, 'sexo', '', ok_sexo, 'CID ' || codigo_cid || ' restrito ao sexo ''' || tp_sexo || ''', paciente e ''' || sexo_paciente || '''.' FROM v_checks WHERE ok_sexo IS NOT NULL
UNION ALL SELECT claim_id, 4, 'idade', '', ok_idade, 'Idade ' || idade_paciente || ' fora da faixa permitida (' || mn || '-' || mx || ').' FROM v_checks WHERE ok_idade IS NOT NULL
UNION ALL SELECT claim_id, 5, 'habilitacao', '', ok_hab, 'CNES ' || codigo_cnes || ' sem habilitacoes exigidas: ' || {codes('r_hab')} || '.' FROM v_checks c WHERE ok_hab IS NOT NULL
UNION ALL SELECT claim_id, 6, 'servico', '', ok_serv, 'CNES ' || codigo_cnes || ' sem servicos exigidos.' FROM v_checks WHERE ok_serv IS NOT NULL
UNION ALL SELECT claim_id, 7, 'leito', '', ok_leito, 'CNES ' || codigo_cnes || ' sem tipos de leito exigidos: ' || {codes('r_leito')} || '.' FROM v_checks c WHERE ok_leito IS NOT NULL
UNION ALL SELECT claim_id, 8, 'ocupacao_executante', '', ok_ocup, 'CBO ' || co_ocupacao_executante || ' nao autorizado. Permitidos: ' || {codes('r_ocup')} || '.' FROM v_checks c WHERE ok_ocup IS NOT NULL
UNION ALL SELECT claim_id, 9, 'compatibilidade_secundario', co_secundario, atendido, 'Secundario ' || co_secundario || ' incompativel com ' || co_procedimento || '.' FROM v_sec_checks""")
view("v_verdicts", """
SELECT claim_id, codigo_cnes, co_procedimento, existe AS proc_existe,
  existe AND coalesce(bad, 0) + f = 0 AS conforme, CAST(f + coalesce(bad, 0) AS INTEGER) AS n_pendencias,
  CAST(coalesce(n, 0) AS INTEGER) AS n_secundarios, CAST(vl_total AS DOUBLE) AS vl_total
FROM (SELECT *, (NOT coalesce(ok_cid, true))::INT + (NOT coalesce(ok_sexo, true))::INT + (NOT coalesce(ok_idade, true))::INT
  + (NOT coalesce(ok_hab, true))::INT + (NOT coalesce(ok_serv, true))::INT + (NOT coalesce(ok_leito, true))::INT
  + (NOT coalesce(ok_ocup, true))::INT AS f FROM v_checks)
LEFT JOIN (SELECT claim_id, count(*) AS n, count(*) FILTER (NOT atendido) AS bad FROM v_sec_checks GROUP BY claim_id) USING (claim_id)""")
