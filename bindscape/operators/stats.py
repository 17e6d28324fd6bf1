"""Exact order statistics that stay distributed.

A column is reduced to its distinct values with counts (map-side combined),
``prefix_sums`` gives running counts, and ``percentile_aggs`` picks the order
statistics with conditional aggregates. Linear interpolation between closest
ranks, the definition used by NumPy and SQL ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import functions as F


def percentile_aggs(value_col: str, cum_col: str, total_col: str, probs, names):
    """Aggregate expressions picking linear-interpolated percentiles from a
    table of distinct values with running counts ``cum_col`` and the grand
    count ``total_col`` (rows with a null value are ignored)."""
    aggs = []
    v = F.col(value_col) if isinstance(value_col, str) else value_col
    for p, nm in zip(probs, names):
        h = (F.col(total_col) - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        v_lo = F.min(F.when(v.isNotNull() & (F.col(cum_col) > lo), v))
        v_hi = F.min(F.when(v.isNotNull() & (F.col(cum_col) > hi), v))
        frac = F.max(F.when(v.isNotNull(), h - lo))
        aggs.append((v_lo + frac * (v_hi - v_lo)).alias(nm))
    return aggs
