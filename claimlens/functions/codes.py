"""Codes, money and other small scalar helpers, as Column expressions."""

from pyspark.sql import Column, functions as F

from claimlens.functions import fixed_values as fv

# every character that Unicode counts as white space
BLANKS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())

MONEY = "decimal(14,2)"
PERCENT = "decimal(7,2)"


def as_col(c):
    return c if isinstance(c, Column) else F.col(c)


def normalise_code(code):
    """Trim, and drop the leading zero of a ten-digit procedure code."""
    c = F.btrim(as_col(code), F.lit(BLANKS))
    return F.when((F.length(c) == 10) & c.startswith("0"), F.substring(c, 2, 9)).otherwise(c)


def pad_code(value, width):
    """Left-pad with zeros; longer values stay whole (``lpad`` would cut them)."""
    s = as_col(value).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def strip_leading_zeros(code):
    return F.ltrim(as_col(code), F.lit("0"))


def codes_from_csv(text):
    """``'a, b'`` to an array of normalised non-empty codes."""
    return F.transform(
        F.filter(F.split(as_col(text), ","), lambda x: F.trim(x) != ""), normalise_code
    )


def money(value):
    """String money to DECIMAL; empty or unreadable counts as zero."""
    return F.coalesce(as_col(value).try_cast(MONEY), F.lit(0).cast(MONEY))


def percent(value):
    return F.coalesce(as_col(value).try_cast(PERCENT), F.lit(0).cast(PERCENT))


def total_value(sh, sa, sp):
    return (as_col(sh) + as_col(sa) + as_col(sp)).cast(MONEY)


def int_or(value, default=0):
    return F.coalesce(as_col(value).try_cast("int"), F.lit(default))


def group_description(code):
    """Description of a two-digit procedure group, or ``grupo NN``."""
    pairs = [F.lit(x) for kv in fv.PROCEDURE_GROUPS.items() for x in kv]
    c = as_col(code)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.concat(F.lit("grupo "), c))


def prefixed_columns(df, prefixes=("qt_", "id_", "tp_")):
    """Names of the columns that start with one of the prefixes."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]
