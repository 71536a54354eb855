"""Vector expressions for row-wise use; the top-k search is in operators.vector."""

from pyspark.sql import functions as F

from claimlens.functions.codes import as_col


def dot(a, b):
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )


def unit(v):
    """Scale to length one; a zero vector stays as it is."""
    c = as_col(v)
    n = F.sqrt(dot(c, c))
    return F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)).otherwise(
        F.transform(c, lambda x: x.cast("double")))


def cosine_similarity(a, b):
    return dot(unit(a), unit(b))
