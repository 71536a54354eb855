"""Parsing of claim mirror texts into one struct per row."""

from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.codes import as_col, group_description
from claimlens.functions.text import strip


def _group(text, pattern, group=1):
    return F.regexp_extract(text, "(?Ud)" + pattern, group)  # dot stops only at newline


def _field(text, pattern):
    """Trimmed first group, NULL without a match. The groups used match at least one
    character, so an empty extract means no match."""
    return let(_group(text, pattern), lambda g: F.when(g != "", strip(g)))


def parse_claim(text):
    """Struct of the nine fields of a claim mirror text."""
    t = as_col(text)
    block = F.regexp_extract(t, "(?Uius)" + fv.CLAIM_SECONDARY_BLOCK, 1)
    procedure = let(_group(t, fv.CLAIM_PROCEDURE_PATTERN), lambda g: F.when(g != "", F.struct(
        F.regexp_replace(g, r"[.\-]", "").alias("codigo"),
        strip(_group(t, fv.CLAIM_PROCEDURE_PATTERN, 2)).alias("nome"))))
    diagnosis = let(_group(t, fv.CLAIM_DIAGNOSIS_PATTERN), lambda g: F.when(g != "", F.struct(
        g.alias("cid"), strip(_group(t, fv.CLAIM_DIAGNOSIS_PATTERN, 2)).alias("nome"))))
    return F.struct(
        *[_field(t, p).alias(n) for n, p in fv.CLAIM_FIELD_PATTERNS.items()],
        procedure.alias("procedimento_principal"),
        diagnosis.alias("diagnostico_principal"),
        F.array_distinct(F.regexp_extract_all(block, F.lit("(?U)" + fv.CLAIM_SECONDARY_CODE), F.lit(1)))
        .alias("cids_secundarios"),
        F.array_distinct(F.regexp_extract_all(t, F.lit("(?U)" + fv.CLAIM_CODE_PATTERN), F.lit(1)))
        .alias("procedimentos_unicos"),
    )


def codes_by_group(parsed, key, claim="aih"):
    """One row per claim and procedure code with the group's description."""
    g = F.substring("codigo", 1, 2)
    return parsed.select(key, F.explode(F.col(claim)["procedimentos_unicos"]).alias("codigo")).select(
        key, "codigo", g.alias("grupo"), group_description(g).alias("no_grupo"))
