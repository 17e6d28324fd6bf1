"""Registered queries: frames, ranks, ordering and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import windows as W
from bindscape.plans import views as V
from bindscape.plans.oracle_views import with_views
from bindscape.plans.registry import r6, register


def _log(spark, sf):
    r = V.requests(spark, sf)
    return r.withColumn("ts_us", F.unix_micros("ts"))


@register("F5_rolling_latency", with_views("""
select event_id, row_number() over w as request_count,
 round(avg(latency_ms) over w1000 * least(row_number() over w, 1000), 2) as window_sum_ms,
 round(quantile_cont(latency_ms, 0.95) over w1000, 6) as p95_latency_ms,
 round(quantile_cont(latency_ms, 0.99) over w1000, 6) as p99_latency_ms
from t_requests
window w as (order by ts, event_id rows between unbounded preceding and current row),
       w1000 as (order by ts, event_id rows between 999 preceding and current row)""", "t_requests"))
def q_f5(spark, sf):
    r = W.rolling_latency(_log(spark, sf), "latency_ms", 1000, chunk_rows=20_000)
    # the window mean is compared as the window sum (2 decimals, like the input):
    # a mean of 2-decimal values can sit exactly on a 6-decimal rounding edge
    wsum = F.round(F.col("avg_latency_ms") * F.least(F.col("request_count"), F.lit(1000)), 2)
    return r.select("event_id", "request_count", wsum.alias("window_sum_ms"),
                    *[r6(c).alias(c) for c in ("p95_latency_ms", "p99_latency_ms")])


@register("F6_rolling_model_score", with_views("""
select event_id, priority as model, round(sum(latency_ms) over w, 2) as window_sum_ms,
 round(greatest(0.1, least(1.0, 200.0 / greatest(1.0, avg(latency_ms) over w))), 6) as perf_score
from t_requests
window w as (partition by priority order by ts, event_id rows between 99 preceding and current row)""", "t_requests"))
def q_f6(spark, sf):
    d = _log(spark, sf).withColumnRenamed("priority", "model")
    r = W.rolling_model_score(d, "model")
    return r.select("event_id", "model", F.round(F.col("avg_latency_ms") * F.col("window_rows"), 2)
                    .alias("window_sum_ms"), r6("perf_score").alias("perf_score"))


@register("F7_top_n_per_group", with_views("""
select cache_key, event_id, round(latency_ms, 6) as latency_ms, rk as rank from (
  select *, row_number() over (partition by cache_key order by latency_ms desc, event_id) as rk from t_requests) x
where rk <= 5""", "t_requests"))
def q_f7(spark, sf):
    t = W.top_n_per_group(V.requests(spark, sf), ["cache_key"], [F.col("latency_ms").desc(), "event_id"], 5)
    return t.select("cache_key", "event_id", r6("latency_ms").alias("latency_ms"), F.col("rank").cast("long").alias("rank"))


@register("F8_normalize_and_argmax", with_views("""
select event_id, cache_key,
 round(case when sum(latency_ms) over (partition by cache_key) <> 0
            then latency_ms / sum(latency_ms) over (partition by cache_key) end, 6) as share,
 row_number() over (partition by cache_key order by latency_ms desc, event_id) = 1 as is_max
from t_requests""", "t_requests"))
def q_f8(spark, sf):
    n = W.normalize_and_argmax(V.requests(spark, sf), ["cache_key"], "latency_ms", ["event_id"])
    return n.select("event_id", "cache_key", r6("share").alias("share"), "is_max")


@register("F9_chunk", with_views("""
select event_id, cache_key, (row_number() over (partition by cache_key order by ts, event_id) - 1) // 4 as chunk_id
from t_requests""", "t_requests"))
def q_f9(spark, sf):
    c = W.chunk(_log(spark, sf), ["cache_key"], "ts_us", ["event_id"], size=4)
    return c.select("event_id", "cache_key", F.col("chunk_id").cast("long").alias("chunk_id"))


@register("F10_backlog_top", with_views("""
select event_id, priority from t_requests order by priority desc, ts, event_id limit 100""", "t_requests"))
def q_f10(spark, sf):
    return W.backlog_top(V.requests(spark, sf), 100).select("event_id", "priority")


@register("F11_page", with_views("""
select id, username, role from t_users order by id limit 100 offset 200""", "t_users"))
def q_f11(spark, sf):
    return W.page(V.users(spark, sf), ["id"], 200, 100).select("id", "username", "role")


@register("F12_cumulative_throughput", with_views("""
select event_id, row_number() over (order by ts, event_id) as request_count,
 round(case when epoch_us(ts) - min(epoch_us(ts)) over () > 0
   then row_number() over (order by ts, event_id) / ((epoch_us(ts) - min(epoch_us(ts)) over ()) / 1e6) else 0.0 end, 6) as throughput
from t_requests""", "t_requests"))
def q_f12(spark, sf):
    c = W.cumulative_throughput(_log(spark, sf))
    return c.select("event_id", F.col("rn").alias("request_count"), r6("throughput").alias("throughput"))


SITES_RANK_SQL = """
select l_suppkey as protein_id, l_orderkey, l_linenumber, l_extendedprice / 10000.0 as score from lineitem"""


@register("G1_rank_sites", with_views(f"""
select protein_id, l_orderkey, l_linenumber, round(score, 6) as score, rk as rank from (
  select *, row_number() over (partition by protein_id order by score desc, l_orderkey, l_linenumber) as rk
  from ({SITES_RANK_SQL}) s) x where rk <= 5"""))
def q_g1(spark, sf):
    from bindscape.session import read_table
    s = read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("protein_id"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("score"))
    t = W.top_n_per_group(s, ["protein_id"], [F.col("score").desc(), "l_orderkey", "l_linenumber"], 5)
    return t.select("protein_id", "l_orderkey", "l_linenumber", r6("score").alias("score"),
                    F.col("rank").cast("long").alias("rank"))
