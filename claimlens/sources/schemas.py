"""Schemas of the monthly tables. Every column is a string."""

from pyspark.sql import types as T

MONTH = "dt_competencia"

# --- fixed values: table and column names ----------------------------------------
# co_X, no_X
NAME_DOMAINS = [
    "financiamento", "habilitacao", "modalidade", "ocupacao", "rede_atencao",
    "registro", "renases", "rubrica", "servico", "tipo_leito", "tuss",
]

# co_procedimento and one code: relation name -> code column
CODE_RELATIONS = {
    "comp_rede": "co_componente_rede",
    "detalhe": "co_detalhe",
    "leito": "co_tipo_leito",
    "modalidade": "co_modalidade",
    "ocupacao": "co_ocupacao",
    "origem": "co_procedimento_origem",
    "registro": "co_registro",
    "regra_cond": "co_regra_condicionada",
    "renases": "co_renases",
    "tuss": "co_tuss",
}

OTHER_TABLES = {
    "rl_excecao_compatibilidade": "co_procedimento_restricao co_procedimento_principal "
        "co_registro_principal co_procedimento_compativel co_registro_compativel tp_compatibilidade",
    "rl_procedimento_cid": "co_procedimento co_cid st_principal",
    "rl_procedimento_compativel": "co_procedimento_principal co_registro_principal "
        "co_procedimento_compativel co_registro_compativel tp_compatibilidade qt_permitida",
    "rl_procedimento_habilitacao": "co_procedimento co_habilitacao nu_grupo_habilitacao",
    "rl_procedimento_incremento": "co_procedimento co_habilitacao vl_percentual_sh "
        "vl_percentual_sa vl_percentual_sp",
    "rl_procedimento_servico": "co_procedimento co_servico co_classificacao",
    "rl_procedimento_sia_sih": "co_procedimento co_procedimento_sia_sih tp_procedimento",
    "tb_cid": "co_cid no_cid tp_agravo tp_sexo tp_estadio vl_campos_irradiados",
    "tb_componente_rede": "co_componente_rede no_componente_rede co_rede_atencao",
    "tb_descricao": "co_procedimento ds_procedimento ds_procedimento_normalizada",
    "tb_descricao_detalhe": "co_detalhe ds_detalhe",
    "tb_detalhe": "co_detalhe no_detalhe",
    "tb_forma_organizacao": "co_grupo co_sub_grupo co_forma_organizacao no_forma_organizacao",
    "tb_grupo": "co_grupo no_grupo",
    "tb_grupo_habilitacao": "nu_grupo_habilitacao no_grupo_habilitacao ds_grupo_habilitacao",
    "tb_procedimento": "co_procedimento no_procedimento tp_complexidade tp_sexo "
        "qt_maxima_execucao qt_dias_permanencia qt_pontos vl_idade_minima vl_idade_maxima "
        "vl_sh vl_sa vl_sp co_financiamento co_rubrica qt_tempo_permanencia "
        "vl_total_hospitalar no_procedimento_normalizado",
    "tb_regra_condicionada": "co_regra_condicionada no_regra_condicionada ds_regra_condicionada",
    "tb_servico_classificacao": "co_servico co_classificacao no_classificacao",
    "tb_sia_sih": "co_procedimento_sia_sih no_procedimento_sia_sih tp_procedimento",
    "tb_sub_grupo": "co_grupo co_sub_grupo no_sub_grupo",
}

FACILITY_TABLES = {
    "tb_profissional_cnes": "cnes co_ocupacao co_profissional_sus co_vinculacao "
        "qt_vinculos_publicos_profissional qt_carga_horaria_total_profissional",
    "tb_dados_profissionais_cnes": "cnes co_profissional_sus co_cpf co_cns",
    "tb_leito_cnes": "cnes co_leito co_tipo_leito quantidade_sus",
    "tb_habilitacao_cnes": "cnes cod_sub_grupo_habilitacao",
    "tb_servico_cnes": "cnes co_servico co_classificacao tp_caracteristica co_cnpjcpf",
}

FACILITY_FILES = {
    "tb_profissional_cnes": "profissionais",
    "tb_dados_profissionais_cnes": "dadosProfissionais",
    "tb_leito_cnes": "leitos",
    "tb_habilitacao_cnes": "habilitacoes",
    "tb_servico_cnes": "servicos",
}

# tables whose lookup key is not their first column
KEY_COLUMNS = {
    "tb_profissional_cnes": "co_profissional_sus",
    "tb_dados_profissionais_cnes": "co_profissional_sus",
    "tb_leito_cnes": "co_leito",
    "tb_habilitacao_cnes": "cod_sub_grupo_habilitacao",
    "tb_servico_cnes": "co_servico",
}

CATALOG_SOURCE, FACILITY_SOURCE = "SIGTAP", "CNES"


def _columns():
    out = {f"tb_{d}": [f"co_{d}", f"no_{d}"] for d in NAME_DOMAINS}
    out.update({f"rl_procedimento_{r}": ["co_procedimento", c] for r, c in CODE_RELATIONS.items()})
    out.update({t: cols.split() for t, cols in {**OTHER_TABLES, **FACILITY_TABLES}.items()})
    return out


COLUMNS = _columns()
CATALOG_TABLES = sorted(t for t in COLUMNS if t not in FACILITY_TABLES)


def schema(table):
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[table] + [MONTH]])


def key_column(table):
    return KEY_COLUMNS.get(table, COLUMNS[table][0])


def source_of(table):
    return FACILITY_SOURCE if table in FACILITY_TABLES else CATALOG_SOURCE


def file_stem(table):
    return FACILITY_FILES.get(table, table)
