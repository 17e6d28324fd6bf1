"""Reports over sample, conformation and request-log tables (one aggregate each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.operators.ranking import prefix_sums
from bindscape.operators.stats import percentile_aggs


def mc_aggregate(samples: DataFrame, pair_cols, value: str) -> DataFrame:
    """Per pair, mean, epistemic uncertainty (population std) and sample count."""
    return samples.groupBy(*pair_cols).agg(
        F.avg(value).alias("mean_prediction"),
        F.stddev_pop(value).alias("epistemic_uncertainty"),
        F.count(value).alias("n_samples"))


def uncertainty_interval(mc: DataFrame, mean: str = "mean_prediction",
                         epistemic: str = "epistemic_uncertainty") -> DataFrame:
    """aleatoric = 0.5 * std, total = sqrt(e^2 + a^2), mean +- 1.96 total."""
    e = F.col(epistemic)
    a = F.lit(0.5) * e
    total = F.sqrt(e * e + a * a)
    return (mc.withColumn("aleatoric_uncertainty", a).withColumn("total_uncertainty", total)
              .withColumn("ci_low", F.col(mean) - F.lit(1.96) * F.col("total_uncertainty"))
              .withColumn("ci_high", F.col(mean) + F.lit(1.96) * F.col("total_uncertainty")))


def ensemble_properties(conf: DataFrame, group_cols, energy: str, conf_id: str) -> DataFrame:
    """Boltzmann-like weights p = exp(-E / 2.5) (not normalized):
    weighted mean energy (null when all weights underflow to 0), population std of E, max p, -sum p ln p (p > 0),
    primary conformation = lowest energy (ties: smallest id)."""
    p = F.exp(-F.col(energy) / F.lit(2.5))
    c = conf.withColumn("_p", p)
    return c.groupBy(*group_cols).agg(
        F.try_divide(F.sum(F.col(energy) * F.col("_p")), F.sum("_p")).alias("average_energy"),
        F.stddev_pop(energy).alias("energy_spread"),
        F.max("_p").alias("dominant_conformation_prob"),
        (-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log(F.col("_p"))))).alias("conformational_entropy"),
        F.min(F.struct(F.col(energy), F.col(conf_id)))[conf_id].alias("primary_conformation"),
    )


def latency_report(log: DataFrame, latency: str = "latency_ms", threshold_ms: float = 120.0) -> DataFrame:
    """Mean, median, min, max, sample std, p95, p99 (linear), share under
    the threshold. Percentiles are exact from a value histogram with running
    counts; the moments come from the same histogram (one scan of the log)."""
    base = log.filter(F.col(latency).isNotNull() & ~F.isnan(latency))
    hist = base.groupBy(latency).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(hist, latency, ["_c"])
    x, c = F.col(latency), F.col("_c")
    n = F.sum(c)
    # second moments around the mean (one number read back), so a large offset costs no digits
    mean = cum.agg(F.try_divide(F.sum(x * c), n)).first()[0]
    d = x - F.lit(mean if mean is not None else 0.0)
    return cum.agg(
        F.coalesce(n, F.lit(0)).alias("n_requests"), F.lit(mean).cast("double").alias("avg_latency_ms"),
        *percentile_aggs(latency, "cum__c", "total__c", [0.5, 0.95, 0.99],
                         ["median_latency_ms", "p95_latency_ms", "p99_latency_ms"]),
        F.min(x).alias("min_latency_ms"), F.max(x).alias("max_latency_ms"),
        F.sqrt(F.when(n > 1, F.sum(d * d * c) / (n - 1))).alias("std_latency_ms"),
        F.try_divide(F.sum(F.when(x < threshold_ms, c).otherwise(0)), n).alias("sub_120ms_rate"),
    )


def throughput_report(log: DataFrame, batch: str = "batch_size", latency: str = "latency_ms",
                      error: str = "is_error") -> DataFrame:
    """Per batch size: total seconds, rows per second, ms per row, rows without error."""
    tot = F.sum(latency) / F.lit(1000.0)
    n = F.count(F.lit(1))
    return log.groupBy(batch).agg(
        tot.alias("total_time_s"), n.alias("n_rows"),
        F.when(tot > 0, n / tot).alias("throughput_pps"),
        F.when(n > 0, tot / n * F.lit(1000.0)).alias("avg_latency_ms"),
        F.sum(F.when(~F.col(error), 1).otherwise(0)).cast("long").alias("successful_predictions"))


def cache_effectiveness(log: DataFrame, cached: str = "cached", latency: str = "latency_ms") -> DataFrame:
    """Per cached / uncached: average latency, total seconds, throughput;
    speedup = t_off / t_on and latency reduction = (m_off - m_on) / m_off, in
    one conditional aggregate."""
    on, off = F.col(cached), ~F.col(cached)
    t_on = F.sum(F.when(on, F.col(latency))) / 1000.0
    t_off = F.sum(F.when(off, F.col(latency))) / 1000.0
    n_on = F.sum(F.when(on, 1).otherwise(0))
    n_off = F.sum(F.when(off, 1).otherwise(0))
    m_on, m_off = F.avg(F.when(on, F.col(latency))), F.avg(F.when(off, F.col(latency)))
    return log.agg(
        m_on.alias("cache_avg_latency_ms"), t_on.alias("cache_total_time_s"),
        F.when(t_on > 0, n_on / t_on).alias("cache_throughput_pps"),
        m_off.alias("nocache_avg_latency_ms"), t_off.alias("nocache_total_time_s"),
        F.when(t_off > 0, n_off / t_off).alias("nocache_throughput_pps"),
        F.when(t_on > 0, t_off / t_on).alias("speedup_factor"),
        F.when(m_off != 0, (m_off - m_on) / m_off).alias("latency_reduction"))


def hit_rate(log: DataFrame, hit: str = "cached") -> DataFrame:
    """Hits, misses and hit rate (0 when there are no requests)."""
    h = F.sum(F.when(F.col(hit), 1).otherwise(0)).cast("long")
    m = F.sum(F.when(~F.col(hit), 1).otherwise(0)).cast("long")
    return log.agg(F.coalesce(h, F.lit(0)).alias("hits"), F.coalesce(m, F.lit(0)).alias("misses"),
                   F.coalesce(F.when(h + m > 0, h / (h + m)), F.lit(0.0)).alias("hit_rate"))


def performance_grade(log: DataFrame, latency: str = "latency_ms", cached: str = "cached") -> DataFrame:
    """Weighted grade of latency (40), cache speedup (30) and load (30)
    sub-scores over one scan of the log; letter grade by thresholds. Only the
    parts that the log has count: without both cached and uncached requests
    there is no speedup, and its weight is left out. An empty log is 'N/A'."""
    x = F.col(latency)
    sub = F.avg(F.when(x < 120, 1.0).otherwise(0.0))
    lat = sub * 0.6 + F.greatest(F.lit(0.0), (F.lit(120.0) - F.avg(x)) / 120.0) * 0.4
    t_on = F.sum(F.when(F.col(cached), x))
    t_off = F.sum(F.when(~F.col(cached), x))
    cache = F.least(F.lit(1.0), F.try_divide(t_off, t_on) / 3.0)
    cache = F.when((t_on > 0) & t_off.isNotNull(), cache)
    tput = F.try_divide(F.count(x), F.sum(x) / 1000.0)
    conc = F.least(F.lit(1.0), F.coalesce(tput, F.lit(0.0)) / 50.0) * 0.5 + sub * 0.5
    g = log.agg(lat.alias("latency_score"), cache.alias("cache_score"), conc.alias("concurrent_score"))
    parts = [("latency_score", 40), ("cache_score", 30), ("concurrent_score", 30)]
    got = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    most = sum((F.when(F.col(p).isNotNull(), w).otherwise(0) for p, w in parts), F.lit(0))
    g = g.withColumn("final_score", F.try_divide(got, most))
    s = F.col("final_score")
    grade = (F.when(s.isNull(), "N/A").when(s >= 0.9, "A+").when(s >= 0.8, "A").when(s >= 0.7, "B+")
              .when(s >= 0.6, "B").when(s >= 0.5, "C+").when(s >= 0.4, "C").otherwise("D"))
    return g.withColumn("grade", grade)
