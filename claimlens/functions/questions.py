"""Question analysis: metadata filters, sub-questions, reformulations.

All functions return Column expressions, so a whole table of questions is
rewritten without leaving the JVM.
"""

from functools import reduce

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.codes import as_col, group_description
from claimlens.functions.text import strip


def _first_match(rules):
    """CASE over (condition, value) pairs: the first condition that holds wins."""
    head, *rest = rules
    return reduce(lambda acc, cv: acc.when(*cv), rest, F.when(*head))


def _word(text, pattern):
    return text.rlike(rf"(?U)\b{pattern}\b")


def year_filter(question):
    y = F.regexp_extract(as_col(question), r"(?U)\b(20\d{2})\b", 1)
    return F.when(y != "", y)


def type_filter(question):
    """Document type a question asks for: annex, ordinance or manual; else NULL."""
    q = F.lower(as_col(question))
    ordinance, manual = _word(q, "portaria"), _word(q, "manual")
    return (
        F.when(_word(q, r"(anexo\s+sigtap|tabela\s+sigtap)"), "anexo_sigtap")
        .when(ordinance & ~manual, "portaria")
        .when(manual & ~ordinance, "manual")
    )


def _hint(question, lowered):
    """Hint text of the first rule key in the question; keys match whole words."""
    rules = [(_word(lowered, key), F.lit(hint)) for key, hint in fv.RULE_HINTS.items()]
    return F.concat_ws(" ", question, _first_match(rules)), reduce(lambda a, b: a | b, [r[0] for r in rules])


def with_hint(question):
    """The question, followed by its hint if one applies."""
    q = as_col(question)
    text, hit = _hint(q, F.lower(q))
    return F.when(hit, text).otherwise(q)


def _expansion(question, lowered, table):
    rules = [(_word(lowered, k), F.concat_ws(" ", question, F.lit(v))) for k, v in table.items()]
    return _first_match(rules)


def _clean_distinct(parts):
    trimmed = F.transform(F.array_compact(F.array(*parts)), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def _words(text):
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def sub_questions(question):
    """The question itself plus hint, split, contrast and acronym variants."""
    q = as_col(question)
    low = F.lower(q)
    hinted, hit = _hint(q, low)
    at = F.instr(q, " e ")
    left, right = F.substr(q, F.lit(1), at - 1), F.substr(q, at + F.lit(3))
    splits = (at > 0) & (_words(left) >= 2) & (_words(right) >= 2)
    contrast = r"(?iu)diferen[cç]a\s+entre\s+(.+?)\s+e\s+(.+)"
    first, second = F.regexp_extract(q, contrast, 1), F.regexp_extract(q, contrast, 2)
    parts = [
        q,
        F.when(hit, hinted),
        F.when(splits, left),
        F.when(splits, right),
        F.when(first != "", first),
        F.when(second != "", second),
        _expansion(q, low, fv.ACRONYM_EXPANSIONS),
    ]
    out = _clean_distinct(parts)
    return F.when(F.size(out) > 0, out).otherwise(F.array(q))


def reformulations(question):
    """Rewrites tried when the first results are weak; the original comes first."""
    q = as_col(question)
    low = F.lower(q)
    in_domain = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in fv.DOMAIN_TERMS])
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(fv.REFORMULATION_STOPWORDS))
    shortened = (F.size(kept) >= 2) & (F.size(kept) != F.size(words))
    return _clean_distinct([
        q,
        F.when(~in_domain, F.concat_ws(" ", q, F.lit(fv.DOMAIN_SUFFIX))),
        _expansion(q, low, fv.REFORMULATION_EXPANSIONS),
        F.when(shortened, F.array_join(kept, " ")),
    ])


def is_short(question):
    """Questions that are not reranked: at most two words, or only digits."""
    q = strip(question)
    return (_words(q) <= 2) | q.rlike(r"^\d+$")


def claim_questions(claim, secondaries=None):
    """Search questions for one parsed claim (a struct column of operators.claim_text).

    The question on secondary diagnoses names all of them, or the first ``secondaries``.
    """
    return let(as_col(claim), lambda c: _claim_questions(c, secondaries))


def _claim_questions(c, secondaries):
    fmt = fv.CLAIM_QUERY_FORMATS
    proc, diag = c["procedimento_principal"], c["diagnostico_principal"]
    pname, dcode, dname = proc["nome"], diag["cid"], diag["nome"]
    codes = c["procedimentos_unicos"]
    groups = F.sort_array(F.array_distinct(F.transform(codes, lambda x: F.substring(x, 1, 2))))
    single = F.array(
        F.when(proc.isNotNull(), F.format_string(fmt["procedure"], pname)),
        F.when(diag.isNotNull(), F.format_string(fmt["diagnosis"], dcode, dname)),
        F.when(proc.isNotNull() & diag.isNotNull(), F.format_string(fmt["pair"], pname, dcode, dname)),
        *[F.when(c[field].isNotNull(), F.format_string(fmt[key], c[field]))
          for key, field in [("specialty", "especialidade"), ("admission", "carater"),
                             ("discharge", "motivo_saida")]],
    )
    per_group = F.transform(groups, lambda g: F.format_string(fmt["group"], group_description(g), g))
    sec = c["cids_secundarios"]
    named = sec if secondaries is None else F.slice(sec, 1, secondaries)
    secondary = F.array(F.when(
        F.size(sec) > 0, F.format_string(fmt["secondary"], F.array_join(named, " "))))
    return F.array_compact(F.concat(single, per_group, secondary))
