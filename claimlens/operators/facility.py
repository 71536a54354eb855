"""Facility registry: assets, staff, profiles.

Long frames throughout (one row per asset), so that a very large facility is
never gathered into one row; counts and sums combine on the map side.
"""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions.codes import int_or
from claimlens.operators.catalog import top_n, with_name
from claimlens.sources.schemas import MONTH
from claimlens.sources.snapshots import at_months

TOP_OCCUPATIONS = 15


def of_facility(table, requests, months=None, key="cnes"):
    """Rows of the requested facilities; requests may name further key columns.

    ``requests`` is one facility code or a frame; with (cnes, co_ocupacao) in the
    frame both are matched.
    """
    rows = at_months(table, months)
    if isinstance(requests, str):
        return rows.where(F.col(key) == requests)
    return rows.join(requests.distinct(), requests.columns, "left_semi")


def beds_named(cat, month, catalog_month):
    rows = at_months(cat["tb_leito_cnes"], month)
    return with_name(rows, cat["tb_tipo_leito"], "co_tipo_leito", "no_tipo_leito", catalog_month)


def services_named(cat, month, catalog_month):
    rows = with_name(at_months(cat["tb_servico_cnes"], month), cat["tb_servico"],
                     "co_servico", "no_servico", catalog_month)
    return with_name(rows, cat["tb_servico_classificacao"], ["co_servico", "co_classificacao"],
                     "no_classificacao", catalog_month)


def accreditations_named(cat, month, catalog_month):
    """Facility accreditations with group name and description."""
    return with_name(at_months(cat["tb_habilitacao_cnes"], month), cat["tb_grupo_habilitacao"],
                     "cod_sub_grupo_habilitacao", ["no_grupo_habilitacao", "ds_grupo_habilitacao"],
                     catalog_month, dim_key="nu_grupo_habilitacao")


def staff_named(cat, month, catalog_month, occupation=""):
    rows = at_months(cat["tb_profissional_cnes"], month)
    if occupation:
        rows = rows.where(F.col("co_ocupacao") == occupation)
    return with_name(rows, cat["tb_ocupacao"], "co_ocupacao", "no_ocupacao", catalog_month)


def professional_records(cat, month, requests=None):
    """All establishments and identifiers of a professional id."""
    rows = at_months(cat["tb_dados_profissionais_cnes"], month)
    if requests is not None:
        rows = rows.join(requests.select("co_profissional_sus").distinct(), "co_profissional_sus", "left_semi")
    return rows


def staff_by_occupation(cat, month, catalog_month):
    """Professionals per facility and occupation, with the occupation name."""
    n = at_months(cat["tb_profissional_cnes"], month).groupBy("cnes", "co_ocupacao").agg(
        F.count("*").alias("quantidade"))
    return with_name(n, cat["tb_ocupacao"], "co_ocupacao", "no_ocupacao", catalog_month)


def top_occupations(cat, month, catalog_month, n=TOP_OCCUPATIONS):
    return top_n(staff_by_occupation(cat, month, catalog_month), "cnes",
                 [F.desc("quantidade"), "co_ocupacao"], n)


def assets(cat, month, catalog_month):
    """Full facility profile in long form: beds, services, accreditations, staff counts."""
    beds = beds_named(cat, month, catalog_month).select(
        "cnes", F.lit("leito").alias("secao"), F.col("co_tipo_leito").alias("codigo"),
        F.col("co_leito").alias("extra"), F.col("no_tipo_leito").alias("nome"),
        int_or("quantidade_sus").cast("long").alias("quantidade"))
    services = services_named(cat, month, catalog_month).select(
        "cnes", F.lit("servico").alias("secao"), F.col("co_servico").alias("codigo"),
        F.coalesce("co_classificacao", F.lit("")).alias("extra"),
        F.concat_ws(" / ", "no_servico", "no_classificacao").alias("nome"), F.lit(1).cast("long").alias("quantidade"))
    accred = accreditations_named(cat, month, catalog_month).select(
        "cnes", F.lit("habilitacao").alias("secao"), F.col("cod_sub_grupo_habilitacao").alias("codigo"),
        F.col("ds_grupo_habilitacao").alias("extra"), F.col("no_grupo_habilitacao").alias("nome"),
        F.lit(1).cast("long").alias("quantidade"))
    staff = staff_by_occupation(cat, month, catalog_month).select(
        "cnes", F.lit("ocupacao").alias("secao"), F.col("co_ocupacao").alias("codigo"),
        F.lit("").alias("extra"), F.col("no_ocupacao").alias("nome"), "quantidade")
    return reduce(lambda a, b: a.unionByName(b), [beds, services, accred, staff])


def profile(cat, month):
    """Totals per facility: SUS beds, bed types, services, accreditations, staff, occupations."""
    def part(table, kind, code, amount=F.lit(0)):
        return at_months(cat[table], month).select(
            "cnes", F.lit(kind).alias("kind"), F.col(code).alias("code"), amount.cast("long").alias("amount"))

    staff = at_months(cat["tb_profissional_cnes"], month).groupBy("cnes", "co_ocupacao").agg(F.count("*").alias("n"))
    # staff is counted per occupation first, so that the profile step sees few rows of it
    rows = reduce(lambda a, b: a.unionByName(b), [
        part("tb_leito_cnes", "leito", "co_tipo_leito", int_or("quantidade_sus")),
        part("tb_servico_cnes", "servico", "co_servico"),
        part("tb_habilitacao_cnes", "habilitacao", "cod_sub_grupo_habilitacao"),
        staff.select("cnes", F.lit("ocupacao").alias("kind"), F.col("co_ocupacao").alias("code"),
                     F.col("n").alias("amount")),
    ])
    # per code first: distinct counts become plain counts
    per_code = rows.groupBy("cnes", "kind", "code").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    is_kind = lambda k: F.col("kind") == k
    total = lambda k, c: F.coalesce(F.sum(F.when(is_kind(k), F.col(c))), F.lit(0)).cast("long")
    return per_code.groupBy("cnes").agg(
        total("leito", "amount").alias("total_leitos_sus"),
        F.count_if(is_kind("leito")).alias("tipos_leito"),
        total("servico", "n").alias("total_servicos"),
        total("habilitacao", "n").alias("total_habilitacoes"),
        total("ocupacao", "amount").alias("total_profissionais"),
        F.count_if(is_kind("ocupacao")).alias("total_ocupacoes_distintas"),
    )


def info(cat, months=None):
    """Facilities that have each kind of asset, per month."""
    tables = {"leitos": "tb_leito_cnes", "servicos": "tb_servico_cnes",
              "habilitacoes": "tb_habilitacao_cnes", "profissionais": "tb_profissional_cnes"}
    per_table = [
        at_months(cat[t], months).select(MONTH, "cnes").distinct()
        .groupBy(MONTH).agg(F.count("*").alias("total_cnes")).withColumn("tipo", F.lit(k))
        for k, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), per_table)


def as_of_months(requests, registry, key="codigo_cnes", month="competencia", registry_key="cnes", name="mes_cnes"):
    """Requests with the newest month of ``registry`` that has their facility and is not after their own.

    NULL where the facility appears later only, or never. Months are YYYYMM texts. A facility's
    months (a handful a year) are one array, so requests are joined once by facility and keep
    their number of rows.
    """
    months = registry.groupBy(F.col(registry_key).alias("_key")).agg(F.collect_set(MONTH).alias("_months"))
    found = F.array_max(F.filter("_months", lambda m: m <= F.col(month)))
    return requests.join(months, requests[key] == months["_key"], "left").withColumn(name, found).drop("_key", "_months")


def rows_as_of(requests, registry, key="codigo_cnes", month="competencia", registry_key="cnes", name="mes_cnes"):
    """Requests with the registry rows of their facility, as of their month; requests without any drop out."""
    dated = as_of_months(requests, registry, key, month, registry_key, name)
    rows = registry.withColumnsRenamed({registry_key: "_key", MONTH: "_month"})
    return dated.join(rows, (F.col(key) == F.col("_key")) & (F.col(name) == F.col("_month"))).drop("_key", "_month")
