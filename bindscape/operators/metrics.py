"""Evaluation metrics as relational queries over ``(y_true, score)`` tables.

Threshold metrics are one conditional aggregate. Rank metrics (ROC AUC,
average precision, Spearman) first reduce the table to distinct scores with
positive/negative counts (partial aggregation), then take running counts
with the range-partitioned ``prefix_sums`` - no global single-partition window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.operators.ranking import partition_rank, prefix_sums
from bindscape.session import cut_lineage


def classification_metrics(df: DataFrame, y: str = "y_true", score: str = "score",
                           threshold: float = 0.5) -> DataFrame:
    """prediction = score >= threshold; accuracy, precision, recall, F1
    (0 on zero division), confusion counts, specificity and NPV (0 if empty)."""
    pred = F.col(score) >= F.lit(threshold)
    pos = F.col(y) == 1
    tp = F.sum(F.when(pred & pos, 1).otherwise(0)).cast("long")
    fp = F.sum(F.when(pred & ~pos, 1).otherwise(0)).cast("long")
    tn = F.sum(F.when(~pred & ~pos, 1).otherwise(0)).cast("long")
    fn = F.sum(F.when(~pred & pos, 1).otherwise(0)).cast("long")
    c = df.agg(tp.alias("true_positives"), fp.alias("false_positives"), tn.alias("true_negatives"),
               fn.alias("false_negatives"))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    TP, FP, TN, FN = (F.col(x) for x in ("true_positives", "false_positives", "true_negatives",
                                          "false_negatives"))
    prec, rec = div(TP, TP + FP), div(TP, TP + FN)
    return (c.withColumn("accuracy", div(TP + TN, TP + FP + TN + FN))
             .withColumn("precision", prec).withColumn("recall", rec)
             .withColumn("f1_score", div(2 * prec * rec, prec + rec))
             .withColumn("specificity", div(TN, TN + FP)).withColumn("npv", div(TN, TN + FN)))


def score_counts(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Distinct scores with positive and negative counts, plus running counts
    from the highest score down (``cum_pos``, ``cum_neg``) and totals."""
    g = df.groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
                              F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).cast("long").alias("neg"))
    return prefix_sums(g, score, ["pos", "neg"], descending=True)


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve with tied scores as one step (trapezoid);
    null when only one class is present."""
    c = score_counts(df, y, score)
    contrib = F.col("neg") * (2 * F.col("cum_pos") - F.col("pos"))
    P, N = F.max("total_pos"), F.max("total_neg")
    return c.agg(F.when((P > 0) & (N > 0), F.try_divide(F.sum(contrib), 2.0 * P * N)).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """The start (0, 0) (threshold null), then one (fpr, tpr) point per distinct score
    threshold, from the top."""
    c = score_counts(df, y, score)
    start = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[score].dataType).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.union(c.select(
        F.col(score).alias("threshold"),
        F.when(F.col("total_neg") > 0, F.col("cum_neg") / F.col("total_neg")).alias("fpr"),
        F.when(F.col("total_pos") > 0, F.col("cum_pos") / F.col("total_pos")).alias("tpr")))


def pr_auc(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Average precision sum((R_n - R_n-1) P_n) over distinct thresholds."""
    c = score_counts(df, y, score)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    P = F.max("total_pos")
    return c.agg(F.when(P > 0, F.try_divide(F.sum(F.col("pos") * prec), P)).alias("pr_auc"))


def pr_curve(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """(precision, recall) per distinct threshold, and the end point (1, 0) (threshold null)."""
    c = score_counts(df, y, score)
    end = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[score].dataType).alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return c.select(F.col(score).alias("threshold"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    F.when(F.col("total_pos") > 0, F.col("cum_pos") / F.col("total_pos")).alias("recall")).union(end)


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MSE, MAE, R^2 = 1 - SSE/SST (SST from the centered population
    variance), Pearson correlation (one aggregate)."""
    e = F.col(pred) - F.col(y)
    n = F.count(e)
    sse = F.sum(e * e)
    sst = F.var_pop(F.when(e.isNotNull(), F.col(y))) * n
    return df.agg(F.try_divide(sse, n).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
                  F.corr(y, pred).alias("pearson"))


def average_ranks(df: DataFrame, col: str, out: str, weight: str | None = None) -> DataFrame:
    """Average (tie-aware) 1-based ranks of ``col``: distinct values with counts
    (or summed ``weight``), running counts, rank = rows below + (count + 1) / 2.
    Returns ``(col, out, _total)``, the last being the number of rows."""
    g = df.groupBy(col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    c = prefix_sums(g, col, ["_n"])
    return c.select(col, (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out),
                    F.col("total__n").alias("_total"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """E5: Pearson correlation of average-tied ranks. Rows are first counted
    per distinct pair (combined map-side), so a frequent value meets its rank
    once per value of the other column; the mean rank is known, so the sums
    are centered. Rows with a null in either column are left out; null when a
    column is constant or the table empty."""
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b_")).dropna().groupBy("_a", "_b_").agg(
        F.count(F.lit(1)).alias("_w"))
    ra = average_ranks(pairs, "_a", "_ra", "_w")
    rb = average_ranks(pairs, "_b_", "_rb", "_w")
    j = pairs.join(ra, "_a").join(rb.drop("_total"), "_b_")
    x, y, w = F.col("_ra") - (F.col("_total") + 1) / 2.0, F.col("_rb") - (F.col("_total") + 1) / 2.0, F.col("_w")
    return j.agg(F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))).alias("spearman"))


TEMPERATURES = [round(0.1 + i * 0.1, 10) for i in range(50)]   # 0.1 .. 5.0
EPS = 1e-7


def _to_prob(score):
    """Sigmoid only when the batch contains values outside [0, 1] (decided by the caller)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _temper(p, t: float):
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    logit = F.log(q / (F.lit(1.0) - q)) / F.lit(t)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit_temperature(df: DataFrame, y: str = "y_true", score: str = "score") -> DataFrame:
    """Pick T from 50 points 0.1..5.0 minimising mean log-loss (first
    minimum wins). All 50 losses are aggregates of one scan; no 50x copy of
    the data. Scores are passed through a sigmoid when any lies outside [0, 1]
    (one min/max aggregate decides)."""
    rng = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    need_sigmoid = rng["hi"] is not None and (rng["hi"] > 1.0 or rng["lo"] < 0.0)
    p = _to_prob(F.col(score)) if need_sigmoid else F.col(score)
    losses = []
    for t in TEMPERATURES:
        q = F.least(F.greatest(_temper(p, t), F.lit(EPS)), F.lit(1 - EPS))
        ll = -(F.col(y) * F.log(q) + (F.lit(1) - F.col(y)) * F.log(F.lit(1.0) - q))
        losses.append(F.avg(ll))
    out = df.agg(F.array(*losses).alias("losses"))
    temps = F.array(*[F.lit(t) for t in TEMPERATURES])
    best = F.array_position("losses", F.array_min("losses"))
    return out.select(F.element_at(temps, best.cast("int")).alias("temperature"),
                      F.array_min("losses").alias("best_loss"))


def calibrate(df: DataFrame, score: str, temperature: float | None) -> DataFrame:
    """Per row, sigmoid only outside [0, 1], temperature applied,
    error = |p - calibrated|; without a fitted T the score passes through with error 0."""
    s = F.col(score)
    if temperature is None:
        return df.withColumn("calibrated", s).withColumn("calibration_error", F.lit(0.0))
    p = F.when((s > 1.0) | (s < 0.0), _to_prob(s)).otherwise(s)
    return (df.withColumn("_p", p).withColumn("calibrated", _temper(F.col("_p"), temperature))
              .withColumn("calibration_error", F.abs(F.col("_p") - F.col("calibrated"))).drop("_p"))


#: Points whose pairs one task counts at a time.
DOMINANCE_POINTS = 1 << 17


def dominance_counts(g: np.ndarray, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per group number ``g`` (0, 1, ...) the weight of the pairs whose second point is above the first in both ``p`` and ``y``.

    Points get a place by (group, p, falling y) and are taken in the order (falling group, y, falling place): a
    point then comes before another in both only if it is in the same group and lower in both. The places are
    halved level by level; at each level a point of a right half meets the sum of the left half before it."""
    n = len(g)
    by_place = np.lexsort((-y, p, g))
    g, y, w = g[by_place], y[by_place], w[by_place]
    at = np.lexsort((-np.arange(n), y, -g))
    found = np.zeros(n, np.int64)
    for level in reversed(range(max(n - 1, 0).bit_length())):
        right = (at >> level) & 1 == 1
        before = np.concatenate(([0], np.cumsum(np.where(right, 0, w[at]))))
        start = np.searchsorted(at >> (level + 1), at >> (level + 1))      # blocks lie one after another
        found[at[right]] += (before[:-1] - before[start])[right]
        at = at[np.argsort(at >> level, kind="stable")]
    out = np.zeros(int(g.max()) + 1 if n else 0, np.int64)
    np.add.at(out, g, found * w)
    return out


def _codes(values) -> np.ndarray:
    """Dense ranks; NaN is one value, above all others."""
    return np.unique(values.to_numpy(), return_inverse=True)[1]


def concordant_weight(points: DataFrame, size: int | None = None) -> DataFrame:
    """``(g, conc)`` of distinct points ``(g, y, p, w)``, a table that is read several times: per group that has such pairs, the sum of ``w_i * w_j``
    over the pairs with ``y_i > y_j`` and ``p_i > p_j``. No pair is made.

    Groups of up to ``size`` points are dealt by hash into units that one task counts at a time. The points of a larger
    group are numbered along both axes and cut into strips of ``size`` points along each. A pair then lies in one
    strip of the first axis, or in two of the first and one of the second, or in two of both; the first two kinds are counted
    per strip, the last one between the cells of the grid, of which there are fewer than points: the same
    task again on a smaller table."""
    size = size or DOMINANCE_POINTS
    sizes = points.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    n, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    # strips of 4 sqrt(n) points or more leave at most n / 16 cells
    size = max(size, 4 * math.isqrt(most or 0))
    unit = [F.pmod(F.xxhash64("g"), F.lit((n or 0) // size + 1)).alias("u"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("axis")]
    if (most or 0) <= size:
        return _unit_weight(points.select(*unit, "g", "y", "p", "w"))
    # at most n / size groups are larger
    large = F.broadcast(sizes.where(F.col("_n") > size).select("g"))
    small = points.join(large, "g", "left_anti").select(*unit, "g", "y", "p", "w")
    # one order is strict in the other's ties: a pair that rises in both numbers rises in both values
    rows = partition_rank(points.join(large, "g"), ["g"], "p", [F.col("y").desc()], rank_col="_r")
    rows = partition_rank(rows, ["g"], "y", [F.col("_r").desc()], rank_col="_s")
    strip = [F.floor((F.col(c) - 1) / F.lit(size)).cast("long") for c in ("_r", "_s")]
    rows = rows.select("g", "w", F.col("_r").cast("double").alias("r"), F.col("_s").cast("double").alias("s"),
                       strip[0].alias("c"), strip[1].alias("d"))
    first = rows.select(F.xxhash64("g").alias("u"), F.col("c").alias("k"), F.lit(1).alias("axis"), "g", F.col("s").alias("y"), F.col("r").alias("p"), "w")
    # within a strip of the second axis only pairs from two strips of the first rise in ``c``
    second = rows.select(F.xxhash64("g").alias("u"), F.col("d").alias("k"), F.lit(2).alias("axis"), "g", F.col("s").alias("y"),
                         F.col("c").cast("double").alias("p"), "w")
    cells = cut_lineage(rows.groupBy("g", F.col("d").cast("double").alias("y"), F.col("c").cast("double").alias("p")).agg(F.sum("w").alias("w")))
    parts = _unit_weight(small.unionByName(first).unionByName(second)).unionByName(concordant_weight(cells, size))
    return parts.groupBy("g").agg(F.sum("conc").alias("conc"))


def _unit_weight(rows: DataFrame) -> DataFrame:
    """``dominance_counts`` of each unit ``(u, k, axis)``, as ``(g, conc)``."""

    def count(pdf):
        codes, groups = pd.factorize(pdf["g"], use_na_sentinel=False)
        conc = dominance_counts(codes, _codes(pdf["p"]), _codes(pdf["y"]), pdf["w"].to_numpy())
        return pd.DataFrame({"g": groups, "conc": conc})

    return rows.groupBy("u", "k", "axis").applyInPandas(count, f"g {rows.schema['g'].dataType.simpleString()}, conc long")


def concordance_index(df: DataFrame, group: str, y: str, pred: str, size: int | None = None) -> DataFrame:
    """Per group, Harrell's C over pairs with ``y_i > y_j``: a pair counts 1
    when ``pred_i > pred_j``, 0.5 when the predictions tie. Output
    ``(group, comparable_pairs, concordant, c_index)``.

    No pair is materialised. Rows are counted per distinct (group, y, pred). Comparable pairs and ties come from the counts:
    all pairs but those of equal y, and pairs of equal pred but those of equal y; pairs that rise in both come from
    ``concordant_weight``. Work is O(n log n); rows with a null group, y or pred are left out."""
    points = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p")).where(
        "g is not null and y is not null and p is not null").groupBy("g", "y", "p").agg(F.count(F.lit(1)).alias("w"))
    points = cut_lineage(points)      # read once per figure below

    def pairs(*keys):
        """Twice the pairs of rows that agree in ``g`` and ``keys``, rows with themselves included."""
        n = points.groupBy("g", *keys).agg(F.sum("w").alias("_n"))
        return n.groupBy("g").agg(F.sum(F.col("_n") * F.col("_n")).alias("v"))

    # one signed table per figure, added up by group
    comp = pairs().select("g", "v").unionByName(pairs("y").select("g", (-F.col("v")).alias("v")))
    ties = pairs("p").unionByName(points.groupBy("g").agg((-F.sum(F.col("w") * F.col("w"))).alias("v")))
    parts = (comp.select("g", "v", F.lit(0).alias("ties"), F.lit(0).alias("conc"))
             .unionByName(ties.select("g", F.lit(0).alias("v"), F.col("v").alias("ties"), F.lit(0).alias("conc")))
             .unionByName(concordant_weight(points, size).select("g", F.lit(0).alias("v"), F.lit(0).alias("ties"), "conc")))
    out = parts.groupBy("g").agg(F.expr("sum(v) div 2").alias("comparable"), F.expr("sum(ties) div 2").alias("ties"),
                                 F.sum("conc").alias("conc"))
    c = (F.col("conc") + F.lit(0.5) * F.col("ties"))
    return out.select(F.col("g").alias(group), F.col("comparable").alias("comparable_pairs"), c.alias("concordant"),
                      F.when(F.col("comparable") > 0, c / F.col("comparable")).alias("c_index"))
