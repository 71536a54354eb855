"""Lookups in the procedure catalog.

Each function takes whole tables (and, for batch lookups, a frame of keys) and
returns a lazy frame. First-row rules are stated as an explicit order and done
with ``min_by``, which combines on the map side, so that a hot key never
gathers in one task.
"""

from functools import reduce

from pyspark.sql import functions as F, Window as W

from claimlens.functions import codes as C
from claimlens.functions.text import contains_folded, fold
from claimlens.sources.schemas import MONTH
from claimlens.sources.snapshots import at_months

SEARCH_LIMIT = 50


def growing(df):
    """A join side with rows per procedure, facility or claim: sorted and merged, never broadcast.

    Spark takes a side's size from its files; rows that were exploded, padded or aggregated
    from a narrow scan are many times that, and would all go through the driver.
    """
    return df.hint("merge")


def list_all(table, months=None):
    return at_months(table, months)


def first_by_key(table, key, order=None):
    """One row per key: the first in the given order (default: all other columns).

    An order that leaves ties is completed with the remaining columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in table.columns if c not in keys]
    lead = [c for c in (order or []) if c in rest]
    ranked = F.struct(*lead, *[c for c in rest if c not in lead])
    one = table.groupBy(*keys).agg(F.min(ranked).alias("_first"))
    return one.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*table.columns)


def get_by_id(table, requests, key, months=None, order=None):
    """One table row per requested key; keys that are not found drop out."""
    wanted = requests.select(key).distinct()
    hits = at_months(table, months).join(wanted, key, "left_semi")
    return first_by_key(hits, key, order or [MONTH])


def list_by_ids(table, requests, key, months=None):
    """All rows of the requested keys; a frame of keys or a Python list."""
    rows = at_months(table, months)
    if isinstance(requests, (list, tuple, set)):
        return rows.where(F.col(key).isin(sorted(map(str, requests))))
    return rows.join(requests.select(key).distinct(), key, "left_semi")


def search(table, column, text, months=None, limit=SEARCH_LIMIT, order=None):
    """Rows whose column contains the text, in any case; ordered, then limited (``None``: all)."""
    hits = at_months(table, months).where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))
    hits = hits.orderBy(*(order or hits.columns))
    return hits if limit is None else hits.limit(limit)


def search_procedures(table, text, months=None, group="", limit=SEARCH_LIMIT):
    """Name search without regard to case or accents, with an optional code prefix (``limit=None``: all)."""
    name = F.coalesce(F.nullif(F.col("no_procedimento_normalizado"), F.lit("")), fold("no_procedimento"))
    hits = at_months(table, months).where(F.contains(name, fold(F.lit(text))))
    if group:
        hits = hits.where(F.col("co_procedimento").startswith(group))
    hits = hits.orderBy("co_procedimento", MONTH)
    return hits if limit is None else hits.limit(limit)


def by_prefix(table, prefix, months=None, column="co_procedimento"):
    """Code prefix; ``startswith`` is pushed down to the Parquet scan."""
    return at_months(table, months).where(F.col(column).startswith(prefix))


def lookup_with_fallback(table, requests, code="codigo"):
    """Exact code first, else the code without any leading zeros.

    Result columns: the request, the code found, name, values and all columns
    that start with qt_, id_ or tp_.
    """
    picked = ["co_procedimento", "no_procedimento", "vl_sh", "vl_sa", "vl_sp",
              "vl_total_hospitalar", MONTH]
    picked += [c for c in C.prefixed_columns(table) if c not in picked]
    dim = first_by_key(table.select(*picked), "co_procedimento", [MONTH])
    trimmed = F.trim(code)
    # both candidates of a request in one equi-join; the exact one ranks first
    tries = requests.select(code, F.posexplode(F.array_distinct(
        F.array(trimmed, C.strip_leading_zeros(trimmed)))).alias("_try", "co_procedimento"))
    hits = tries.join(dim, "co_procedimento")
    best = hits.groupBy(code).agg(F.min(F.struct("_try", *picked)).alias("_r"))
    return best.select(code, *[F.col(f"_r.{c}").alias(c) for c in picked])


def compatible_pairs(compat, requests, months=None, key="co_procedimento"):
    """Compatibility rows where a requested code is on either side.

    Written as two semi-joins (an OR in one join would compare every pair); the
    second branch leaves out the rows of the first.
    """
    rows = at_months(compat, months)
    wanted = requests.select(F.col(key).alias("_k")).distinct()
    left = rows.join(wanted, rows["co_procedimento_principal"] == F.col("_k"), "left_semi")
    right = (
        rows.join(wanted, rows["co_procedimento_compativel"] == F.col("_k"), "left_semi")
        .join(wanted.withColumnRenamed("_k", "_p"), F.col("co_procedimento_principal") == F.col("_p"), "left_anti")
    )
    return left.unionByName(right)


def with_name(df, dim, key, name, months=None, default="", alias=None, dim_key=None):
    """Left join of a code to its name; the dimension is reduced to one row per code.

    ``key`` may be a list (for example service and classification); compared
    null-safely, so that a missing second part matches a missing one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    dkeys = keys if dim_key is None else ([dim_key] if isinstance(dim_key, str) else list(dim_key))
    names = [name] if isinstance(name, str) else list(name)
    aliases = names if alias is None else ([alias] if isinstance(alias, str) else list(alias))
    small = at_months(dim, months).select(*dkeys, *names)
    small = small.groupBy(*[F.col(d).alias(f"_k{i}") for i, d in enumerate(dkeys)]).agg(
        F.min(F.struct(*names)).alias("_n"))
    on = reduce(lambda a, b: a & b, [
        (F.col(k) == F.col(f"_k{i}")) if i == 0 else F.col(k).eqNullSafe(F.col(f"_k{i}"))
        for i, k in enumerate(keys)])
    out = df.join(small, on, "left")
    for n, a in zip(names, aliases):
        v = F.col(f"_n.{n}")
        out = out.withColumn(a, v if default is None else F.coalesce(v, F.lit(default)))
    return out.drop("_n", *[f"_k{i}" for i in range(len(keys))])


def compatible_pairs_named(compat, procedures, requests, months=None):
    """Compatibility rows with the names of both sides."""
    rows = compatible_pairs(compat, requests, months)
    for side, alias in [("co_procedimento_principal", "no_principal"),
                        ("co_procedimento_compativel", "no_compativel")]:
        rows = with_name(rows, procedures, side, "no_procedimento", months,
                         alias=alias, dim_key="co_procedimento")
    return rows


def hierarchy(groups, subgroups, forms, months=None, group="", subgroup=""):
    """Groups, subgroups of a group, or forms of a subgroup, as one long frame.

    Without arguments all three levels are returned.
    """
    g = at_months(groups, months).select(
        F.lit("grupo").alias("nivel"), "co_grupo", F.lit("").alias("co_sub_grupo"),
        F.lit("").alias("co_forma_organizacao"), F.col("no_grupo").alias("nome"))
    s = at_months(subgroups, months).select(
        F.lit("sub_grupo").alias("nivel"), "co_grupo", "co_sub_grupo",
        F.lit("").alias("co_forma_organizacao"), F.col("no_sub_grupo").alias("nome"))
    f = at_months(forms, months).select(
        F.lit("forma").alias("nivel"), "co_grupo", "co_sub_grupo", "co_forma_organizacao",
        F.col("no_forma_organizacao").alias("nome"))
    if subgroup:
        f = f.where(F.col("co_sub_grupo") == subgroup)
        return f.where(F.col("co_grupo") == group) if group else f
    if group:
        return s.where(F.col("co_grupo") == group)
    return g.unionByName(s).unionByName(f)


def catalog_info(procedures, groups, months=None):
    """Total procedures per month, next to the group list (one row per group)."""
    total = at_months(procedures, months).groupBy(MONTH).agg(
        F.countDistinct("co_procedimento").alias("total_procedimentos"))
    return at_months(groups, months).select(MONTH, "co_grupo", "no_grupo").distinct().join(total, MONTH, "left")


# --- profile of a procedure -------------------------------------------------------
RELATIONS = [
    # section, table, code, second code, dimension, dimension name
    ("cids", "rl_procedimento_cid", "co_cid", "st_principal", "tb_cid", "no_cid"),
    ("habilitacoes", "rl_procedimento_habilitacao", "co_habilitacao", "nu_grupo_habilitacao",
     "tb_habilitacao", "no_habilitacao"),
    ("servicos", "rl_procedimento_servico", "co_servico", "co_classificacao", "tb_servico", "no_servico"),
    ("ocupacoes", "rl_procedimento_ocupacao", "co_ocupacao", None, "tb_ocupacao", "no_ocupacao"),
    ("leitos", "rl_procedimento_leito", "co_tipo_leito", None, "tb_tipo_leito", "no_tipo_leito"),
    ("regras", "rl_procedimento_regra_cond", "co_regra_condicionada", None,
     "tb_regra_condicionada", "no_regra_condicionada"),
    ("incrementos", "rl_procedimento_incremento", "co_habilitacao", None, "tb_habilitacao", "no_habilitacao"),
]


def procedure_relation(cat, section, month, requests=None):
    """Rows of one relation with resolved names: (co_procedimento, codigo, extra, nome)."""
    _, table, code, extra, dim, name = next(r for r in RELATIONS if r[0] == section)
    rows = at_months(cat[table], month)
    if requests is not None:
        rows = rows.join(requests.select("co_procedimento").distinct(), "co_procedimento", "left_semi")
    named = with_name(rows, cat[dim], code, name, month)
    return named.select(
        "co_procedimento", F.lit(section).alias("relacao"), F.col(code).alias("codigo"),
        (F.coalesce(F.col(extra), F.lit("")) if extra else F.lit("")).alias("extra"),
        F.col(name).alias("nome"))


def procedure_profile(cat, month, requests=None):
    """Full profile in long form: one row per related item of each procedure.

    Long rather than nested: a procedure with very many diagnoses stays many
    small rows, and nothing is gathered into one.
    """
    parts = [procedure_relation(cat, r[0], month, requests) for r in RELATIONS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def procedure_sheet(cat, month):
    """Head row of the profile: the procedure, its description, and counts per relation."""
    counts = reduce(lambda a, b: a.unionByName(b), [
        at_months(cat[t], month).select("co_procedimento", F.lit(s).alias("relacao")) for s, t, *_ in RELATIONS])
    wide = counts.groupBy("co_procedimento").agg(*[
        F.count_if(F.col("relacao") == s).alias(f"n_{s}") for s, *_ in RELATIONS])
    head = first_by_key(at_months(cat["tb_procedimento"], month), "co_procedimento")
    text = at_months(cat["tb_descricao"], month).groupBy("co_procedimento").agg(
        F.min("ds_procedimento").alias("descricao"))
    out = head.join(text, "co_procedimento", "left").join(wide, "co_procedimento", "left")
    return out.withColumn("descricao", F.coalesce("descricao", F.lit(""))).fillna(
        0, [f"n_{s}" for s, *_ in RELATIONS])


def services_named(cat, month):
    """Required services with service and classification names (two-part key)."""
    rows = with_name(at_months(cat["rl_procedimento_servico"], month), cat["tb_servico"],
                     "co_servico", "no_servico", month)
    return with_name(rows, cat["tb_servico_classificacao"], ["co_servico", "co_classificacao"],
                     "no_classificacao", month)


def conditional_rules(cat, month):
    rows = at_months(cat["rl_procedimento_regra_cond"], month)
    return with_name(rows, cat["tb_regra_condicionada"], "co_regra_condicionada",
                     ["no_regra_condicionada", "ds_regra_condicionada"], month)


def increments_named(cat, month):
    return with_name(at_months(cat["rl_procedimento_incremento"], month), cat["tb_habilitacao"],
                     "co_habilitacao", "no_habilitacao", month)


def top_n(df, partition, order, n, rank="posicao"):
    """First n rows per partition (``None``: all, ranked). The rank filter lets Spark cut groups before the shuffle."""
    parts = [partition] if isinstance(partition, str) else list(partition)
    w = W.partitionBy(*parts).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col(rank) <= n)


def suggest_procedures(cat, month, diagnoses=None, limit=30):
    """Procedures that accept a diagnosis, the most valuable first (true top-n).

    A procedure that is linked both as principal and as secondary gives two rows.
    """
    rel = at_months(cat["rl_procedimento_cid"], month).select("co_cid", "co_procedimento", "st_principal")
    if diagnoses is not None:
        rel = rel.join(diagnoses.select("co_cid").distinct(), "co_cid", "left_semi")
    proc = first_by_key(at_months(cat["tb_procedimento"], month).select(
        "co_procedimento", "no_procedimento", "tp_complexidade",
        C.total_value(C.money("vl_sh"), C.money("vl_sa"), C.money("vl_sp")).alias("vl_total")), "co_procedimento")
    known = at_months(cat["tb_cid"], month).groupBy("co_cid").agg(F.min("no_cid").alias("no_cid"))
    rows = rel.distinct().join(growing(proc), "co_procedimento").join(known, "co_cid")
    return top_n(rows, "co_cid", [F.desc("vl_total"), "co_procedimento", "st_principal"], limit)


# --- snapshot comparison ------------------------------------------------------------
COMPARED_FIELDS = ["vl_sh", "vl_sa", "vl_sp", "no_procedimento", "vl_idade_minima",
                   "vl_idade_maxima", "qt_dias_permanencia", "tp_complexidade"]
ADDED, REMOVED, CHANGED = "ADICIONADO", "REMOVIDO", "ALTERADO"


def snapshot_diff(cat, month_a, month_b):
    """Differences of every procedure between two months, one row per difference.

    Both months go through one aggregation per key (present in A, present in B),
    so no self-join is needed. Relations are compared only for procedures that
    exist in both months; a status row stands for the others.
    """
    in_a, in_b = F.col(MONTH) == month_a, F.col(MONTH) == month_b
    proc = at_months(cat["tb_procedimento"], [month_a, month_b])
    row = F.struct(*COMPARED_FIELDS)
    both = proc.groupBy("co_procedimento").agg(
        F.min(F.when(in_a, row)).alias("a"), F.min(F.when(in_b, row)).alias("b"))
    exists_a, exists_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    value = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(""))
    entry = lambda campo, tipo, va, vb: F.struct(
        F.lit(campo).alias("campo"), F.lit(tipo).alias("tipo"), va.alias("valor_a"), vb.alias("valor_b"))
    status = F.array(F.when(exists_a, entry("status", REMOVED, value("a", "no_procedimento"), F.lit("")))
                     .otherwise(entry("status", ADDED, F.lit(""), value("b", "no_procedimento"))))
    fields = F.array_compact(F.array(*[
        F.when(value("a", f) != value("b", f), entry(f, CHANGED, value("a", f), value("b", f)))
        for f in COMPARED_FIELDS]))
    head = both.select("co_procedimento", F.explode(
        F.when(exists_a & exists_b, fields).otherwise(status)).alias("d")).select("co_procedimento", "d.*")

    def relation(table, campo, code):
        rows = at_months(cat[table], [month_a, month_b]).select(
            "co_procedimento", code.alias("codigo"), MONTH)
        seen = rows.groupBy("co_procedimento", "codigo").agg(
            F.bool_or(in_a).alias("in_a"), F.bool_or(in_b).alias("in_b"))
        return seen.where(F.col("in_a") != F.col("in_b")).select(
            "co_procedimento", F.lit(campo).alias("campo"),
            F.when(F.col("in_b"), ADDED).otherwise(REMOVED).alias("tipo"),
            F.when(F.col("in_a"), F.col("codigo")).otherwise("").alias("valor_a"),
            F.when(F.col("in_b"), F.col("codigo")).otherwise("").alias("valor_b"))

    service = F.concat_ws("/", "co_servico", F.coalesce("co_classificacao", F.lit("")))
    sets = (
        relation("rl_procedimento_cid", "cids", F.col("co_cid"))
        .unionByName(relation("rl_procedimento_habilitacao", "habilitacoes", F.col("co_habilitacao")))
        .unionByName(relation("rl_procedimento_servico", "servicos", service))
    )
    common = both.where(exists_a & exists_b).select("co_procedimento")
    return head.unionByName(sets.join(growing(common), "co_procedimento", "left_semi"))


def diff_summary(diff):
    """Number of differences per procedure and field."""
    return diff.groupBy("co_procedimento", "campo", "tipo").agg(F.count("*").alias("quantidade"))
