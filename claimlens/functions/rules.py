"""Billing rules: definitions in source text, name enrichment, search terms."""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.codes import as_col


def rule_definitions(df, text, keep=()):
    """One row per rule definition found in a source text."""
    pat = F.lit(fv.RULE_DEFINITION_PATTERN)
    groups = [F.regexp_extract_all(as_col(text), pat, F.lit(i)) for i in (1, 2, 3, 4)]
    found = df.select(*keep, F.explode(F.arrays_zip(*[
        g.alias(n) for g, n in zip(groups, ["numero", "codigo", "nome", "campos"])])).alias("d"))
    fields = F.transform(
        F.filter(F.split(F.col("d.campos"), ","), lambda x: F.trim(x) != ""),
        lambda x: F.regexp_replace(x, r"(?U)^[\s'\"]+|[\s'\"]+$", ""),
    )
    return found.select(*keep, F.col("d.numero").cast("int").alias("numero"),
                        F.col("d.codigo").alias("codigo"), F.col("d.nome").alias("nome"),
                        fields.alias("campos"))


def enriched_name(name):
    """Rule name plus the extra words of the first keyword it contains."""
    n = as_col(name)
    low = F.lower(n)
    rules = [(F.contains(low, F.lit(k.lower())), v) for k, v in fv.RULE_NAME_ENRICHMENT.items()]
    extra = reduce(lambda acc, kv: acc.when(kv[0], kv[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    return F.concat_ws(" ", n, extra)


def source_search_terms(source, name):
    """Search phrases suggested by a rule's source code, then the rule name."""
    s, n = as_col(source), as_col(name)
    low = F.lower(s)
    picks = []
    for terms, exact, anycase in fv.SOURCE_KEYWORD_TERMS:
        tests = [F.contains(s, F.lit(w)) for w in exact] + [F.contains(low, F.lit(w)) for w in anycase]
        picks.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(terms)))
    return F.array_compact(F.array(*picks, n))
