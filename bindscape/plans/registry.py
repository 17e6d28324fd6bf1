"""Registry of named queries (one per operator) and their SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is DuckDB SQL over
the raw driver tables. Output columns are scalars with the same names on
both sides; doubles are rounded to 6 decimals on both sides so the compare
is about values, not summation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def joined(arr, sep: str = ",") -> Column:
    """Array as text for comparison (elements cast to string)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(a, lambda x: x.cast("string")), sep)


def load_all():
    """Import every registration module (side effect: fills the registry)."""
    from bindscape.plans import (  # noqa: F401
        reg_prepare, reg_scalar, reg_profile, reg_joins, reg_metrics, reg_windows,
        reg_sources, reg_streaming,
    )
    return QUERIES, ORACLE
