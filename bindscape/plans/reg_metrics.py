"""Registered queries: evaluation metrics, uncertainty and request-log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import metrics as M
from bindscape.operators import reports as R
from bindscape.plans import views as V
from bindscape.plans.oracle_views import with_views
from bindscape.plans.reg_scalar import FIT_SQL, described_interactions, fit_score_sql, fitted_scorer
from bindscape.plans.registry import r6, register

# --------------------------------------------------------------- E1 .. E5

CONF_SQL = """
with c as (select
  cast(sum(case when score >= 0.5 and y_true = 1 then 1 else 0 end) as bigint) as tp,
  cast(sum(case when score >= 0.5 and y_true <> 1 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when score < 0.5 and y_true <> 1 then 1 else 0 end) as bigint) as tn,
  cast(sum(case when score < 0.5 and y_true = 1 then 1 else 0 end) as bigint) as fn from t_scored),
m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as prec,
             case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as rec from c)
select tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives,
 round(case when tp + fp + tn + fn > 0 then (tp + tn) / (tp + fp + tn + fn) else 0.0 end, 6) as accuracy,
 round(prec, 6) as precision, round(rec, 6) as recall,
 round(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end, 6) as f1_score,
 round(case when tn + fp > 0 then tn / (tn + fp) else 0.0 end, 6) as specificity,
 round(case when tn + fn > 0 then tn / (tn + fn) else 0.0 end, 6) as npv
from m"""


@register("E1_classification_metrics", with_views(CONF_SQL, "t_scored"))
def q_e1(spark, sf):
    m = M.classification_metrics(V.scored(spark, sf))
    cols = ["true_positives", "false_positives", "true_negatives", "false_negatives"]
    return m.select(*cols, *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1_score",
                                                       "specificity", "npv")])


SCORE_COUNTS_SQL = """
with g as (select score, sum(case when y_true = 1 then 1 else 0 end) as pos,
                  sum(case when y_true = 1 then 0 else 1 end) as neg from t_scored group by score),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cum_pos,
             sum(neg) over (order by score desc rows between unbounded preceding and current row) as cum_neg,
             sum(pos) over () as tp_all, sum(neg) over () as tn_all from g)"""


@register("E2_roc_auc", with_views(SCORE_COUNTS_SQL + """
select round(case when max(tp_all) > 0 and max(tn_all) > 0
  then sum(neg * (2 * cum_pos - pos)) / (2.0 * max(tp_all) * max(tn_all)) end, 6) as roc_auc from c""", "t_scored"))
def q_e2(spark, sf):
    return M.roc_auc(V.scored(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


@register("E2_roc_curve", with_views(SCORE_COUNTS_SQL + """
select null::double as threshold, 0.0::double as fpr, 0.0::double as tpr
union all select score, round(case when tn_all > 0 then cum_neg / tn_all end, 6),
       round(case when tp_all > 0 then cum_pos / tp_all end, 6) from c""", "t_scored"))
def q_e2c(spark, sf):
    c = M.roc_curve(V.scored(spark, sf))
    return c.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("E3_pr_auc", with_views(SCORE_COUNTS_SQL + """
select round(case when max(tp_all) > 0 then sum(pos * cum_pos / (cum_pos + cum_neg)) / max(tp_all) end, 6) as pr_auc
from c""", "t_scored"))
def q_e3(spark, sf):
    return M.pr_auc(V.scored(spark, sf)).select(r6("pr_auc").alias("pr_auc"))


@register("E3_pr_curve", with_views(SCORE_COUNTS_SQL + """
select score as threshold, round(cum_pos / (cum_pos + cum_neg), 6) as precision,
       round(case when tp_all > 0 then cum_pos / tp_all end, 6) as recall from c
union all select null, 1.0, 0.0""", "t_scored"))
def q_e3c(spark, sf):
    c = M.pr_curve(V.scored(spark, sf))
    return c.select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("E4_regression_metrics", with_views("""
select round(avg((score - y_true) * (score - y_true)), 6) as mse, round(avg(abs(score - y_true)), 6) as mae,
 round(1 - sum((score - y_true) * (score - y_true)) / (sum(y_true * y_true) - sum(y_true) * sum(y_true) / count(*)), 6) as r2,
 round(corr(y_true, score), 6) as pearson from t_scored""", "t_scored"))
def q_e4(spark, sf):
    d = V.scored(spark, sf).withColumn("y", F.col("y_true").cast("double"))
    r = M.regression_metrics(d, "y", "score")
    return r.select(*[r6(c).alias(c) for c in ("mse", "mae", "r2", "pearson")])


@register("E5_spearman", with_views("""
with s as (select doc_id, y_true, score,
  rank() over (order by y_true) + (count(*) over (partition by y_true) - 1) / 2.0 as ra,
  rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rb from t_scored)
select round(corr(ra, rb), 6) as spearman from s""", "t_scored"))
def q_e5(spark, sf):
    return M.spearman(V.scored(spark, sf), "y_true", "score").select(r6("spearman").alias("spearman"))


# --------------------------------------------------------------- E7, E8

def _temper_sql(p: str, t: float) -> str:
    q = f"least(greatest({p}, 1e-7), 1 - 1e-7)"
    return f"(1.0 / (1.0 + exp(-(ln({q} / (1.0 - {q})) / {t}))))"


def _loss_sql(t: float) -> str:
    q = f"least(greatest({_temper_sql('score', t)}, 1e-7), 1 - 1e-7)"
    return f"avg(-(y_true * ln({q}) + (1 - y_true) * ln(1.0 - {q})))"


@register("E7_fit_temperature", with_views(
    "with l as (select [" + ", ".join(_loss_sql(t) for t in M.TEMPERATURES) + "] as losses from t_scored)\n"
    "select round(cast(([" + ", ".join(repr(t) for t in M.TEMPERATURES) + "])[list_position(losses, list_min(losses))] as double), 6)"
    " as temperature, round(list_min(losses), 6) as best_loss from l", "t_scored"))
def q_e7(spark, sf):
    f = M.fit_temperature(V.scored(spark, sf))
    return f.select(r6("temperature").alias("temperature"), r6("best_loss").alias("best_loss"))


@register("E8_calibrate", with_views(f"""
select doc_id, round({_temper_sql('score', 1.5)}, 6) as calibrated,
       round(abs(score - {_temper_sql('score', 1.5)}), 6) as calibration_error from t_scored""", "t_scored"))
def q_e8(spark, sf):
    c = M.calibrate(V.scored(spark, sf), "score", 1.5)
    return c.select("doc_id", r6("calibrated").alias("calibrated"), r6("calibration_error").alias("calibration_error"))


# --------------------------------------------------------------- D11 .. D17, E10

def _log(spark, sf):
    """Request log with the derived flags used by the reports."""
    r = V.requests(spark, sf)
    return (r.withColumn("cached", F.col("priority") == 0)
             .withColumn("is_error", F.col("cache_key").endswith("|error"))
             .withColumn("batch_size", F.element_at(F.array(*[F.lit(x) for x in (1, 5, 10, 20, 50)]),
                                                    (F.col("event_id") % 5).cast("int") + 1)))


@register("D11_mc_aggregate", with_views("""
select cache_key, round(avg(latency_ms), 6) as mean_prediction, round(stddev_pop(latency_ms), 6) as epistemic_uncertainty,
       count(latency_ms) as n_samples from t_requests group by cache_key""", "t_requests"))
def q_d11(spark, sf):
    m = R.mc_aggregate(V.requests(spark, sf), ["cache_key"], "latency_ms")
    return m.select("cache_key", r6("mean_prediction").alias("mean_prediction"),
                    r6("epistemic_uncertainty").alias("epistemic_uncertainty"), "n_samples")


@register("E10_uncertainty_interval", with_views("""
with m as (select cache_key, avg(latency_ms) as mu, stddev_pop(latency_ms) as e from t_requests group by cache_key)
select cache_key, round(0.5 * e, 6) as aleatoric_uncertainty, round(sqrt(e * e + 0.25 * e * e), 6) as total_uncertainty,
 round(mu - 1.96 * sqrt(e * e + 0.25 * e * e), 6) as ci_low, round(mu + 1.96 * sqrt(e * e + 0.25 * e * e), 6) as ci_high
from m""", "t_requests"))
def q_e10(spark, sf):
    m = R.uncertainty_interval(R.mc_aggregate(V.requests(spark, sf), ["cache_key"], "latency_ms"))
    return m.select("cache_key", *[r6(c).alias(c) for c in ("aleatoric_uncertainty", "total_uncertainty",
                                                            "ci_low", "ci_high")])


@register("D12_ensemble_properties", with_views("""
with c as (select cache_key, event_id, latency_ms / 100.0 as energy, exp(-(latency_ms / 100.0) / 2.5) as p from t_requests)
select cache_key, round(sum(energy * p) / sum(p), 6) as average_energy, round(stddev_pop(energy), 6) as energy_spread,
 round(max(p), 6) as dominant_conformation_prob, round(-sum(case when p > 0 then p * ln(p) end), 6) as conformational_entropy,
 arg_min(event_id, (energy, event_id)) as primary_conformation
from c group by cache_key""", "t_requests"))
def q_d12(spark, sf):
    c = V.requests(spark, sf).withColumn("energy", F.col("latency_ms") / F.lit(100.0))
    e = R.ensemble_properties(c, ["cache_key"], "energy", "event_id")
    return e.select("cache_key", *[r6(x).alias(x) for x in ("average_energy", "energy_spread",
                                                            "dominant_conformation_prob", "conformational_entropy")],
                    "primary_conformation")


@register("D13_latency_report", with_views("""
select count(*) as n_requests, round(avg(latency_ms), 6) as avg_latency_ms,
 round(quantile_cont(latency_ms, 0.5), 6) as median_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms,
 round(quantile_cont(latency_ms, 0.99), 6) as p99_latency_ms, round(min(latency_ms), 6) as min_latency_ms,
 round(max(latency_ms), 6) as max_latency_ms, round(stddev_samp(latency_ms), 6) as std_latency_ms,
 round(avg(case when latency_ms < 120 then 1.0 else 0.0 end), 6) as sub_120ms_rate
from t_requests where latency_ms is not null and not isnan(latency_ms)""", "t_requests"))
def q_d13(spark, sf):
    r = R.latency_report(V.requests(spark, sf))
    return r.select(F.col("n_requests").cast("long").alias("n_requests"),
                    *[r6(c).alias(c) for c in ("avg_latency_ms", "median_latency_ms", "p95_latency_ms",
                                               "p99_latency_ms", "min_latency_ms", "max_latency_ms",
                                               "std_latency_ms", "sub_120ms_rate")])


LOG_SQL = """
lg as (select *, priority = 0 as cached, ends_with(cache_key, '|error') as is_error,
        ([1, 5, 10, 20, 50])[cast(event_id % 5 as int) + 1] as batch_size from t_requests)"""


@register("D14_throughput_report", with_views("with " + LOG_SQL + """
select batch_size, round(sum(latency_ms) / 1000.0, 6) as total_time_s, count(*) as n_rows,
 round(count(*) / (sum(latency_ms) / 1000.0), 6) as throughput_pps,
 round(sum(latency_ms) / 1000.0 / count(*) * 1000.0, 6) as avg_latency_ms,
 cast(sum(case when not is_error then 1 else 0 end) as bigint) as successful_predictions
from lg group by batch_size""", "t_requests"))
def q_d14(spark, sf):
    t = R.throughput_report(_log(spark, sf))
    return t.select(F.col("batch_size").cast("int").alias("batch_size"), r6("total_time_s").alias("total_time_s"),
                    "n_rows", r6("throughput_pps").alias("throughput_pps"),
                    r6("avg_latency_ms").alias("avg_latency_ms"), "successful_predictions")


@register("D15_cache_effectiveness", with_views("with " + LOG_SQL + """,
a as (select avg(case when cached then latency_ms end) as m_on, sum(case when cached then latency_ms end) / 1000.0 as t_on,
             sum(case when cached then 1 else 0 end) as n_on,
             avg(case when not cached then latency_ms end) as m_off, sum(case when not cached then latency_ms end) / 1000.0 as t_off,
             sum(case when not cached then 1 else 0 end) as n_off from lg)
select round(m_on, 6) as cache_avg_latency_ms, round(t_on, 6) as cache_total_time_s, round(n_on / t_on, 6) as cache_throughput_pps,
 round(m_off, 6) as nocache_avg_latency_ms, round(t_off, 6) as nocache_total_time_s, round(n_off / t_off, 6) as nocache_throughput_pps,
 round(t_off / t_on, 6) as speedup_factor, round((m_off - m_on) / m_off, 6) as latency_reduction from a""", "t_requests"))
def q_d15(spark, sf):
    c = R.cache_effectiveness(_log(spark, sf))
    return c.select(*[r6(x).alias(x) for x in c.columns])


@register("D16_hit_rate", with_views("with " + LOG_SQL + """
select cast(sum(case when cached then 1 else 0 end) as bigint) as hits,
       cast(sum(case when not cached then 1 else 0 end) as bigint) as misses,
       round(sum(case when cached then 1 else 0 end) / count(*), 6) as hit_rate from lg""", "t_requests"))
def q_d16(spark, sf):
    h = R.hit_rate(_log(spark, sf))
    return h.select("hits", "misses", r6("hit_rate").alias("hit_rate"))


@register("D17_performance_grade", with_views("with " + LOG_SQL + """,
a as (select avg(case when latency_ms < 120 then 1.0 else 0.0 end) as sub, avg(latency_ms) as av,
             sum(case when cached then latency_ms end) as t_on, sum(case when not cached then latency_ms end) as t_off,
             count(*) / (sum(latency_ms) / 1000.0) as tput from lg),
s as (select sub * 0.6 + greatest(0.0, (120.0 - av) / 120.0) * 0.4 as lat,
             least(1.0, case when t_on > 0 then t_off / t_on else 1.0 end / 3.0) as cache,
             least(1.0, tput / 50.0) * 0.5 + sub * 0.5 as conc from a)
select round(lat, 6) as latency_score, round(cache, 6) as cache_score, round(conc, 6) as concurrent_score,
 round((lat * 40 + cache * 30 + conc * 30) / 100.0, 6) as final_score,
 case when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.9 then 'A+'
      when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.8 then 'A'
      when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.7 then 'B+'
      when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.6 then 'B'
      when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.5 then 'C+'
      when (lat * 40 + cache * 30 + conc * 30) / 100.0 >= 0.4 then 'C' else 'D' end as grade from s""", "t_requests"))
def q_d17(spark, sf):
    g = R.performance_grade(_log(spark, sf))
    return g.select(*[r6(x).alias(x) for x in ("latency_score", "cache_score", "concurrent_score", "final_score")],
                    "grade")


# --------------------------------------------------------------- P4, P5

@register("P4_evaluate_predictions", with_views("""
with t as (select doc_id,
  coalesce(try_cast(trim(replace(regexp_extract(regexp_extract(
     'Binding Probability: ' || cast(score as varchar), '(?m)^(.*Binding Probability:.*)$', 1), '^[^:]*:(.*)$', 1), '*', '')) as double), 0.5) as score,
  y_true from t_scored),
g as (select score, sum(case when y_true = 1 then 1 else 0 end) as pos, sum(case when y_true = 1 then 0 else 1 end) as neg
      from t group by score),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cum_pos,
             sum(neg) over (order by score desc rows between unbounded preceding and current row) as cum_neg,
             sum(pos) over () as tp_all, sum(neg) over () as tn_all from g),
cm as (select cast(sum(case when score >= 0.5 and y_true = 1 then 1 else 0 end) as bigint) as tp,
              cast(sum(case when score >= 0.5 and y_true <> 1 then 1 else 0 end) as bigint) as fp,
              cast(sum(case when score < 0.5 and y_true <> 1 then 1 else 0 end) as bigint) as tn,
              cast(sum(case when score < 0.5 and y_true = 1 then 1 else 0 end) as bigint) as fn from t)
select 'roc_auc' as metric, round(sum(neg * (2 * cum_pos - pos)) / (2.0 * max(tp_all) * max(tn_all)), 6) as value from c
union all select 'pr_auc', round(sum(pos * cum_pos / (cum_pos + cum_neg)) / max(tp_all), 6) from c
union all select 'accuracy', round((tp + tn) / (tp + fp + tn + fn), 6) from cm
union all select 'precision', round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) from cm
union all select 'recall', round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) from cm
union all select 'f1_score', round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) from cm
union all select 'specificity', round(case when tn + fp > 0 then tn / (tn + fp) else 0 end, 6) from cm
union all select 'npv', round(case when tn + fn > 0 then tn / (tn + fn) else 0 end, 6) from cm
union all select 'true_positives', tp from cm union all select 'false_positives', fp from cm
union all select 'true_negatives', tn from cm union all select 'false_negatives', fn from cm""", "t_scored"))
def q_p4(spark, sf):
    from bindscape.plans.workflows import evaluate_predictions
    from bindscape.sources.writers import scratch_dir
    root = scratch_dir(spark, "evaluation")
    evaluate_predictions(V.scored(spark, sf), out=root)
    names = ["roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1_score", "specificity", "npv",
             "true_positives", "false_positives", "true_negatives", "false_negatives"]
    written = spark.read.text(root + "/metrics").select(F.from_json("value", "map<string,double>").alias("m"))
    return written.select(F.explode("m").alias("metric", "value")).where(F.col("metric").isin(names)).select(
        "metric", r6("value").alias("value"))


@register("P4_evaluation_curves", with_views(SCORE_COUNTS_SQL + """
select 'roc' as curve, null::double as threshold, 0.0::double as x, 0.0::double as y
union all select 'roc', score, round(cum_neg / tn_all, 6), round(cum_pos / tp_all, 6) from c
union all select 'pr', score, round(cum_pos / tp_all, 6), round(cum_pos / (cum_pos + cum_neg), 6) from c
union all select 'pr', null, 0.0, 1.0""", "t_scored"))
def q_p4c(spark, sf):
    from bindscape.plans.workflows import evaluation_curves
    c = evaluation_curves(V.scored(spark, sf))
    return c.select("curve", "threshold", r6("x").alias("x"), r6("y").alias("y"))


@register("P5_score_with_uncertainty", with_views("""
with m as (select user_id, avg(value) as mu, stddev_pop(value) as e from events group by user_id),
u as (select user_id, mu, 0.5 * e as a, sqrt(e * e + 0.25 * e * e) as tot,
   case when mu > 1.0 or mu < 0.0 then 1.0 / (1.0 + exp(-mu)) else mu end as p from m),
n as (select vec_id, embedding, label, sqrt(list_sum(list_transform(embedding, x -> x * x))) as nrm from t_emb),
q as (select * from n where vec_id in (select user_id from events)),
d as (select q.vec_id as q_id, t.vec_id as t_id, t.label,
   1.0 - case when q.nrm * t.nrm > 0 then list_dot_product(q.embedding, t.embedding) / (q.nrm * t.nrm) else 0.0 end as distance
   from q cross join n t),
k as (select * from (select *, row_number() over (partition by q_id order by distance, t_id) as rn from d) z where rn <= 5),
r as (select q_id, least(1.0, greatest(0.0, 0.7 / (1 + avg(distance)) + 0.3 / (1 + var_pop(label)))) as reliability
   from k group by q_id)
select u.user_id, round(mu, 6) as mean_prediction, round(tot, 6) as total_uncertainty,
 round(mu - 1.96 * tot, 6) as ci_low, round(mu + 1.96 * tot, 6) as ci_high,
 round(1.0 / (1.0 + exp(-(ln(least(greatest(p, 1e-7), 1 - 1e-7) / (1.0 - least(greatest(p, 1e-7), 1 - 1e-7))) / 1.5))), 6) as calibrated,
 round(coalesce(reliability, 0.5), 6) as reliability_score
from u left join r on r.q_id = u.user_id""", "t_emb"))
def q_p5(spark, sf):
    """Predictions are grouped by user; the embedding of every user that has one is a query."""
    from bindscape.operators import similarity as SIM
    from bindscape.plans.workflows import score_with_uncertainty
    from bindscape.session import read_table
    e = V.embeddings(spark, sf)
    events = read_table(spark, sf, "events").select("user_id", "value")
    train = e.withColumnRenamed("vec_id", "t_id")
    queries = e.withColumnRenamed("vec_id", "q_id").join(events, F.col("q_id") == F.col("user_id"), "left_semi")
    near = SIM.knn_join(queries, train, 5)
    rel = SIM.reliability(near, train).select(F.col("q_id").alias("user_id"), "reliability")
    s = score_with_uncertainty(events, ["user_id"], "value", 1.5, rel)
    return s.select("user_id", *[r6(c).alias(c) for c in ("mean_prediction", "total_uncertainty", "ci_low", "ci_high",
                                                          "calibrated", "reliability_score")])


@register("E6_concordance_index", with_views("""
with """ + FIT_SQL + f""",
t as (select protein_id as g, affinity as y, {fit_score_sql('protein', 'compound')} as p from t_interactions),
pr as (select a.g, count(*) as comparable,
              sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0.0 end) as concordant
       from t a join t b on a.g = b.g and a.y > b.y group by a.g)
select g as protein_id, comparable as comparable_pairs, round(cast(concordant as double), 6) as concordant,
       round(cast(concordant as double) / comparable, 6) as c_index from pr""", "t_interactions"))
def q_e6(spark, sf):
    model = fitted_scorer(spark, sf)
    d = described_interactions(spark, sf).select(
        "protein_id", "affinity", model.of(F.col("letters"), F.col("share")).alias("pred"))
    c = M.concordance_index(d, "protein_id", "affinity", "pred")
    return c.filter(F.col("comparable_pairs") > 0).select(
        "protein_id", "comparable_pairs", r6("concordant").alias("concordant"), r6("c_index").alias("c_index"))
