"""Claim audit: every claim against catalog rules and facility capacity.

Plan: the catalog is reduced to one row per procedure and the registry to one
row per facility (sets of codes, which the code domains bound; a professional
count per occupation likewise). A claim then meets each side once, and the
any-overlap checks are array operations inside the row: claims are never
multiplied by requirements. Only secondary procedures, which come as their own
long frame, are exploded and aggregated per claim.
"""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions import codes as C, fixed_values as fv
from claimlens.operators.catalog import first_by_key, growing
from claimlens.sources.snapshots import at_months

def _no_codes():
    return F.array().cast("array<string>")


def _service_pair(service="co_servico", cls="co_classificacao"):
    """Service and classification as one key; two missing classifications are equal."""
    return F.to_json(F.struct(F.col(service).alias("s"), F.col(cls).alias("c")))


def _code_sets(parts, key, kinds):
    """Union of (key, kind, code) frames to one row per key with a sorted set per kind."""
    rows = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return rows.groupBy(key).agg(*[
        F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("code")))).alias(k) for k in kinds])


def procedure_rules(cat, month):
    """One row per procedure: head fields, required code sets, number of diagnoses, increments."""
    def part(table, kind, code):
        return at_months(cat[table], month).select("co_procedimento", F.lit(kind).alias("kind"), code.alias("code"))

    req = _code_sets([
        part("rl_procedimento_habilitacao", "req_hab", F.col("co_habilitacao")),
        part("rl_procedimento_servico", "req_serv", _service_pair()),
        part("rl_procedimento_leito", "req_leito", F.col("co_tipo_leito")),
        part("rl_procedimento_ocupacao", "req_ocup", F.col("co_ocupacao")),
    ], "co_procedimento", ["req_hab", "req_serv", "req_leito", "req_ocup"])
    n_cids = at_months(cat["rl_procedimento_cid"], month).groupBy("co_procedimento").agg(
        F.count("*").alias("total_cids"))
    head = first_by_key(at_months(cat["tb_procedimento"], month).select(
        "co_procedimento", "no_procedimento", "vl_idade_minima", "vl_idade_maxima", "vl_sh", "vl_sa", "vl_sp"),
        "co_procedimento")
    sets = [F.coalesce(c, _no_codes()).alias(c) for c in ["req_hab", "req_serv", "req_leito", "req_ocup"]]
    return (
        head.join(growing(req), "co_procedimento", "left").join(growing(n_cids), "co_procedimento", "left")
        .select(
            "co_procedimento", "no_procedimento",
            C.int_or("vl_idade_minima").alias("idade_minima"),
            C.int_or("vl_idade_maxima", fv.AGE_UNBOUNDED).alias("idade_maxima"),
            C.money("vl_sh").alias("vl_sh"), C.money("vl_sa").alias("vl_sa"), C.money("vl_sp").alias("vl_sp"),
            *sets, F.coalesce("total_cids", F.lit(0).cast("long")).alias("total_cids"))
    )


def facility_capacity(cat, month):
    """One row per facility: code sets and professionals per occupation."""
    def part(table, kind, code):
        return at_months(cat[table], month).select("cnes", F.lit(kind).alias("kind"), code.alias("code"))

    sets = _code_sets([
        part("tb_habilitacao_cnes", "tem_hab", F.col("cod_sub_grupo_habilitacao")),
        part("tb_servico_cnes", "tem_serv", _service_pair()),
        part("tb_leito_cnes", "tem_leito", F.col("co_tipo_leito")),
    ], "cnes", ["tem_hab", "tem_serv", "tem_leito"])
    per_cbo = at_months(cat["tb_profissional_cnes"], month).groupBy("cnes", "co_ocupacao").agg(F.count("*").alias("n"))
    staff = per_cbo.where(F.col("co_ocupacao").isNotNull()).groupBy("cnes").agg(
        F.map_from_entries(F.collect_list(F.struct("co_ocupacao", "n"))).alias("staff"))
    return sets.join(staff, "cnes", "full")


def allowed_diagnoses(cat, month):
    return at_months(cat["rl_procedimento_cid"], month).groupBy("co_procedimento", "co_cid").agg(
        F.min("st_principal").alias("st_principal"))


def diagnosis_dim(cat, month):
    d = first_by_key(at_months(cat["tb_cid"], month).select("co_cid", "no_cid", "tp_sexo"), "co_cid")
    return d.withColumn("cid_conhecido", F.lit(True))


def compatible_pairs(cat, month):
    """Distinct (co_procedimento, co_secundario): what may be claimed beside a principal."""
    return at_months(cat["rl_procedimento_compativel"], month).select(
        F.col("co_procedimento_principal").alias("co_procedimento"),
        F.col("co_procedimento_compativel").alias("co_secundario")).distinct()


#: What the audit looks up: a month's rules by procedure, diagnosis and pair, and the facilities.
TABLES = {"rules": procedure_rules, "diagnoses": diagnosis_dim, "allowed": allowed_diagnoses,
          "pairs": compatible_pairs, "capacity": facility_capacity}


def audit_tables(cat, month, facility_month=None, keep=None):
    """The frames that claims of a month are checked against, by name.

    ``keep(name, frame)`` may store a frame and return the stored one, for many batches
    against the same month.
    """
    made = {name: make(cat, (facility_month or month) if name == "capacity" else month) for name, make in TABLES.items()}
    return {name: keep(name, df) for name, df in made.items()} if keep else made


def _with_rules(claims, tables):
    """Claims with normalised code and the row of their procedure (left)."""
    rules = tables["rules"].withColumn("proc_existe", F.lit(True))
    return (
        claims.withColumn("co_procedimento", C.normalise_code("codigo_procedimento"))
        .join(growing(rules), "co_procedimento", "left")
        .withColumn("proc_existe", F.coalesce("proc_existe", F.lit(False)))
    )


def _with_capacity(df, tables):
    cap = tables["capacity"].withColumnRenamed("cnes", "codigo_cnes")
    out = df.join(growing(cap), "codigo_cnes", "left")
    for c in ["tem_hab", "tem_serv", "tem_leito"]:
        out = out.withColumn(c, F.coalesce(c, _no_codes()))
    return out


def _with_diagnosis(df, tables):
    out = df.join(tables["diagnoses"].withColumnRenamed("co_cid", "codigo_cid"), "codigo_cid", "left")
    allowed = tables["allowed"].select(
        "co_procedimento", F.col("co_cid").alias("codigo_cid"), F.coalesce("st_principal", F.lit("")).alias("st_principal"))
    return out.join(growing(allowed), ["co_procedimento", "codigo_cid"], "left").withColumn(
        "cid_conhecido", F.coalesce("cid_conhecido", F.lit(False)))


def secondary_checks(claims, secondaries, cat, month, bidirectional=False, tables=None):
    """One row per claim and secondary procedure: is it compatible with the principal?

    Only claims whose principal exists are checked.
    """
    pairs = tables["pairs"] if tables else compatible_pairs(cat, month)
    if bidirectional:
        pairs = pairs.unionByName(pairs.select(
            F.col("co_secundario").alias("co_procedimento"), F.col("co_procedimento").alias("co_secundario")))
    known = tables["rules"] if tables else at_months(cat["tb_procedimento"], month)
    known = known.select("co_procedimento")
    principal = (
        claims.select("claim_id", C.normalise_code("codigo_procedimento").alias("co_procedimento"))
        .join(growing(known), "co_procedimento", "left_semi"))
    sec = secondaries.select("claim_id", C.normalise_code("co_secundario").alias("co_secundario"))
    pairs = (pairs.distinct() if bidirectional else pairs).withColumn("atendido", F.lit(True))
    return (
        sec.join(growing(principal), "claim_id")
        .join(growing(pairs), ["co_procedimento", "co_secundario"], "left")
        .withColumn("atendido", F.coalesce("atendido", F.lit(False)))
    )


def given(c):
    return F.col(c).isNotNull() & (F.col(c) != "")


def evaluate(claims, cat, month, facility_month=None, tables=None):
    """One wide row per claim with the outcome of every check but the secondaries.

    An outcome is NULL where the check does not apply: the procedure is unknown,
    it has no such requirement, or the claim does not state the field. ``tables``
    (``audit_tables``) are made of the catalog unless given.
    """
    tables = tables or audit_tables(cat, month, facility_month)
    df = _with_capacity(_with_diagnosis(_with_rules(claims, tables), tables), tables)
    exists = F.col("proc_existe")
    sex = F.coalesce("tp_sexo", F.lit(""))
    asked = lambda c: exists & (F.size(c) > 0)
    cbo = F.col("co_ocupacao_executante")
    return df.select(
        *claims.columns, "co_procedimento",
        F.coalesce("no_procedimento", F.lit("")).alias("no_procedimento"), "proc_existe",
        F.when(exists, F.col("st_principal").isNotNull()).alias("ok_cid"),
        F.when(exists & F.col("cid_conhecido") & given("sexo_paciente"),
               sex.isin("", "I") | (sex == F.col("sexo_paciente"))).alias("ok_sexo"),
        F.when(exists & (F.col("idade_paciente") >= 0),
               F.col("idade_paciente").between(F.col("idade_minima"), F.col("idade_maxima"))).alias("ok_idade"),
        F.when(asked("req_hab"), F.arrays_overlap("req_hab", "tem_hab")).alias("ok_habilitacao"),
        F.when(asked("req_serv"), F.arrays_overlap("req_serv", "tem_serv")).alias("ok_servico"),
        F.when(asked("req_leito"), F.arrays_overlap("req_leito", "tem_leito")).alias("ok_leito"),
        F.when(exists & given("co_ocupacao_executante"),
               (F.size("req_ocup") == 0) | F.array_contains("req_ocup", cbo)).alias("ok_ocupacao"),
        F.when(F.col("cid_conhecido"), F.col("no_cid")).otherwise(fv.DIAGNOSIS_NOT_FOUND).alias("no_cid"),
        F.coalesce("st_principal", F.lit("")).alias("st_principal"),
        F.coalesce("total_cids", F.lit(0).cast("long")).alias("total_cids"),
        sex.alias("tp_sexo_cid"), "idade_minima", "idade_maxima",
        "req_hab", "req_leito", "req_ocup",
        F.when(exists, F.array_intersect("req_hab", "tem_hab")).alias("possui_hab"),
        F.when(exists, F.array_intersect("req_leito", "tem_leito")).alias("possui_leito"),
        F.when(exists & given("co_ocupacao_executante"),
               F.coalesce(F.try_element_at("staff", cbo), F.lit(0).cast("long"))).alias("profissionais_no_cnes"),
        "vl_sh", "vl_sa", "vl_sp", C.total_value("vl_sh", "vl_sa", "vl_sp").alias("vl_total"),
    )


CHECKS = [  # number, kind, outcome column
    (2, "cid", "ok_cid"), (3, "sexo", "ok_sexo"), (4, "idade", "ok_idade"),
    (5, "habilitacao", "ok_habilitacao"), (6, "servico", "ok_servico"), (7, "leito", "ok_leito"),
    (8, "ocupacao_executante", "ok_ocupacao"),
]
SECONDARY_CHECK = (9, "compatibilidade_secundario")


def verdicts(evaluated, secondary=None):
    """One row per claim: conforming or not, failed checks, value."""
    oks = [F.col(c) for _, _, c in CHECKS]
    failed = reduce(lambda a, b: a + b, [F.when(~o, 1).otherwise(0) for o in oks])
    out = evaluated.withColumn("_failed", failed)
    if secondary is not None:
        per_claim = secondary.groupBy("claim_id").agg(
            F.count("*").alias("n_secundarios"), F.count_if(~F.col("atendido")).alias("n_secundarios_ruins"))
        out = out.join(growing(per_claim), "claim_id", "left")
    else:
        out = out.withColumn("n_secundarios", F.lit(0)).withColumn("n_secundarios_ruins", F.lit(0))
    bad = F.coalesce("n_secundarios_ruins", F.lit(0)).cast("int")
    return out.select(
        "claim_id", "codigo_cnes", "co_procedimento", "proc_existe",
        (F.col("proc_existe") & (F.col("_failed") == 0) & (bad == 0)).alias("conforme"),
        (F.col("_failed") + bad).cast("int").alias("n_pendencias"),
        F.coalesce("n_secundarios", F.lit(0)).cast("int").alias("n_secundarios"),
        F.coalesce("vl_sh", F.lit(0).cast(C.MONEY)).alias("vl_sh"),
        F.coalesce("vl_sa", F.lit(0).cast(C.MONEY)).alias("vl_sa"),
        F.coalesce("vl_sp", F.lit(0).cast(C.MONEY)).alias("vl_sp"),
        F.coalesce("vl_total", F.lit(0).cast(C.MONEY)).alias("vl_total"),
    )


def _quoted(codes):
    return F.concat(F.lit("["), F.array_join(F.transform(codes, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))


def checks_long(evaluated, secondary=None):
    """One row per claim and check that applies, with the alert text of failed ones.

    A claim whose procedure is unknown has the single failed check 1.
    """
    a = fv.ALERT_FORMATS
    say = {
        "cid": F.format_string(a["cid"], "codigo_cid", "co_procedimento"),
        "sexo": F.format_string(a["sexo"], "codigo_cid", "tp_sexo_cid", "sexo_paciente"),
        "idade": F.format_string(a["idade"], F.col("idade_paciente").cast("string"),
                                 F.col("idade_minima").cast("string"), F.col("idade_maxima").cast("string")),
        "habilitacao": F.format_string(a["habilitacao"], "codigo_cnes", _quoted(F.col("req_hab"))),
        "servico": F.format_string(a["servico"], "codigo_cnes"),
        "leito": F.format_string(a["leito"], "codigo_cnes", _quoted(F.col("req_leito"))),
        "ocupacao_executante": F.format_string(a["ocupacao_executante"], "co_ocupacao_executante",
                                               _quoted(F.col("req_ocup"))),
    }

    def item(no, kind, ok, alert):
        return F.struct(F.lit(no).alias("ordem"), F.lit(kind).alias("tipo"), ok.alias("atendido"),
                        F.when(~ok, alert).otherwise("").alias("alerta"))

    items = [F.when(F.col(c).isNotNull(), item(no, kind, F.col(c), say[kind])) for no, kind, c in CHECKS]
    unknown = F.when(~F.col("proc_existe"), item(1, "procedimento", F.lit(False), F.format_string(
        a["procedimento"], "co_procedimento", "competencia")))
    rows = evaluated.select("claim_id", F.explode(F.array_compact(F.array(unknown, *items))).alias("c")).select(
        "claim_id", "c.ordem", "c.tipo", F.lit("").alias("codigo"), "c.atendido", "c.alerta")
    if secondary is None:
        return rows
    no, kind = SECONDARY_CHECK
    return rows.unionByName(secondary.select(
        "claim_id", F.lit(no).alias("ordem"), F.lit(kind).alias("tipo"), F.col("co_secundario").alias("codigo"),
        "atendido", F.when(~F.col("atendido"), F.format_string(a[kind], "co_secundario", "co_procedimento"))
        .otherwise("").alias("alerta")))


def alerts(checks):
    return checks.where(~F.col("atendido")).select("claim_id", "ordem", "tipo", "codigo", "alerta")


def audit(claims, secondaries, cat, month, facility_month=None, bidirectional=False, tables=None):
    """Verdicts, check rows and alerts of a batch of claims (three lazy frames)."""
    claims = claims.withColumn("competencia", F.lit(month))
    ev = evaluate(claims, cat, month, facility_month, tables)
    sec = None if secondaries is None else secondary_checks(claims, secondaries, cat, month, bidirectional, tables)
    checks = checks_long(ev, sec)
    return verdicts(ev, sec), checks, alerts(checks)


# --- value with increments --------------------------------------------------------
def increment_sets(cat, month):
    """Increments of a procedure as one array, repeated rows as one entry with a count.

    Only distinct (accreditation, percentages) entries are gathered, so the array is
    bounded by the accreditation codes of the catalog.
    """
    entry = ["co_habilitacao", C.percent("vl_percentual_sh").alias("sh"),
             C.percent("vl_percentual_sa").alias("sa"), C.percent("vl_percentual_sp").alias("sp")]
    rows = at_months(cat["rl_procedimento_incremento"], month).select("co_procedimento", *entry)
    counted = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy("co_procedimento").agg(F.sort_array(F.collect_list(
        F.struct("co_habilitacao", "sh", "sa", "sp", "n"))).alias("incrementos"))


def _added(inc, scale="decimal(28,6)"):
    share = lambda v, p: (F.col(v) * inc[p] * F.lit("0.01").cast("decimal(3,2)"))
    return (share("vl_sh", "sh") + share("vl_sa", "sa") + share("vl_sp", "sp")).cast(scale)


def _times(inc):
    return (_added(inc) * inc["n"]).cast("decimal(28,6)")


def _value_base(requests, cat, month, facility_month):
    head = first_by_key(at_months(cat["tb_procedimento"], month).select(
        "co_procedimento", C.money("vl_sh").alias("vl_sh"), C.money("vl_sa").alias("vl_sa"),
        C.money("vl_sp").alias("vl_sp")), "co_procedimento")
    accred = (
        at_months(cat["tb_habilitacao_cnes"], facility_month or month)
        .select(F.col("cnes").alias("codigo_cnes"), "cod_sub_grupo_habilitacao").distinct()
        .groupBy("codigo_cnes").agg(F.collect_set("cod_sub_grupo_habilitacao").alias("tem_hab")))
    return (
        requests.withColumn("co_procedimento", C.normalise_code("codigo_procedimento"))
        .join(growing(head), "co_procedimento")
        .join(growing(increment_sets(cat, month)), "co_procedimento", "left")
        .join(growing(accred), "codigo_cnes", "left")
        .withColumn("tem_hab", F.coalesce("tem_hab", _no_codes()))
    )


def claim_values(requests, cat, month, facility_month=None):
    """Base value and value with the increments the facility is accredited for.

    Needs codigo_procedimento and codigo_cnes; requests with unknown procedures
    drop out. The sum is exact and rounded once.
    """
    df = _value_base(requests, cat, month, facility_month)
    none = F.expr("cast(array() as array<struct<co_habilitacao:string,sh:decimal(7,2),sa:decimal(7,2),sp:decimal(7,2),n:int>>)")
    usable = F.filter(F.coalesce("incrementos", none), lambda i: F.array_contains("tem_hab", i["co_habilitacao"]))
    extra = F.aggregate(usable, F.lit(0).cast("decimal(28,6)"),
                        lambda s, i: (s + _times(i)).cast("decimal(28,6)"))
    base = C.total_value("vl_sh", "vl_sa", "vl_sp")
    return df.select(
        *requests.columns, "co_procedimento", base.alias("vl_total_base"), F.size(usable).alias("n_aplicaveis"),
        F.round(base + extra, 2).cast(C.MONEY).alias("vl_total_com_incrementos"))


def value_increments(requests, cat, month, facility_month=None):
    """One row per distinct (procedure, facility) and increment: applicable, added value."""
    pairs = requests.select("codigo_procedimento", "codigo_cnes").distinct()
    df = _value_base(pairs, cat, month, facility_month)
    rows = df.select("*", F.explode("incrementos").alias("i"))
    ok = F.array_contains("tem_hab", F.col("i.co_habilitacao"))
    rows = rows.select(
        "co_procedimento", "codigo_cnes", F.col("i.co_habilitacao").alias("co_habilitacao"), ok.alias("aplicavel"),
        F.col("i.sh").alias("pct_sh"), F.col("i.sa").alias("pct_sa"), F.col("i.sp").alias("pct_sp"),
        F.when(ok, F.round(_added(F.col("i")), 2)).otherwise(0).cast(C.MONEY).alias("valor_adicional"))
    dim = at_months(cat["tb_habilitacao"], month).groupBy("co_habilitacao").agg(F.min("no_habilitacao").alias("no_habilitacao"))
    return rows.join(dim, "co_habilitacao", "left").withColumn("no_habilitacao", F.coalesce("no_habilitacao", F.lit("")))


# --- single validations --------------------------------------------------------------
def facility_fit(requests, cat, month, facility_month=None):
    """Can the facility perform the procedure? One row per distinct pair.

    Like the audit's requirement checks, plus: any required occupation is on the staff.
    """
    pairs = requests.select("codigo_procedimento", "codigo_cnes").distinct()
    tables = audit_tables(cat, month, facility_month)
    df = _with_capacity(_with_rules(pairs, tables), tables).where("proc_existe")
    staff = F.coalesce(F.map_keys("staff"), _no_codes())
    checks = {
        "ok_habilitacao": ("req_hab", F.col("tem_hab")), "ok_servico": ("req_serv", F.col("tem_serv")),
        "ok_leito": ("req_leito", F.col("tem_leito")), "ok_profissional": ("req_ocup", staff)}
    oks = {n: F.when(F.size(r) > 0, F.arrays_overlap(r, has)) for n, (r, has) in checks.items()}
    return df.select(
        "co_procedimento", "no_procedimento", "codigo_cnes", *[o.alias(n) for n, o in oks.items()],
        reduce(lambda a, b: a & b, [F.coalesce(o, F.lit(True)) for o in oks.values()]).alias("conforme"))


def diagnosis_check(requests, cat, month):
    """Is the diagnosis allowed for the procedure? Needs codigo_procedimento, codigo_cid."""
    pairs = requests.select("codigo_procedimento", "codigo_cid").distinct()
    tables = audit_tables(cat, month)
    df = _with_diagnosis(_with_rules(pairs, tables), tables).where("proc_existe")
    ok = F.col("st_principal").isNotNull()
    return df.select(
        "co_procedimento", "no_procedimento", "codigo_cid", ok.alias("valido"),
        F.when(F.col("cid_conhecido"), F.col("no_cid")).otherwise(F.when(ok, "").otherwise(fv.DIAGNOSIS_NOT_FOUND))
        .alias("cid_nome"),
        F.coalesce("st_principal", F.lit("")).alias("st_principal"),
        F.when(ok, F.coalesce("tp_sexo", F.lit(""))).otherwise("").alias("tp_sexo"),
        F.when(~ok, F.format_string(fv.ALERT_FORMATS["cid"], "codigo_cid", "co_procedimento")).otherwise("").alias("msg"),
        "total_cids")
