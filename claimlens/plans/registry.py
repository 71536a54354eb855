"""Registered queries: a Spark plan over the test tables and its SQL counterpart."""

from claimlens.plans.bindings import Bound
from claimlens.plans.oracle_views import with_views

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Register a function of a ``Bound``; ``sql`` may use the oracle views."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Bound(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return fn
    return add
