"""Registered queries: anchored-TTL hits (batch and stream), windowed latency
and streaming scoring. Stream queries run with ``availableNow`` over files
Spark writes from the driver tables and return what the sink received."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from bindscape.plans import views as V
from bindscape.plans.oracle_views import with_views
from bindscape.plans.reg_scalar import FIT_SQL, fit_score_sql, fitted_scorer
from bindscape.plans import reg_windows  # noqa: F401  (its oracle of F5 is used below)
from bindscape.plans.registry import ORACLE, r6, register
from bindscape.sources.writers import scratch_dir
from bindscape.streaming import jobs, ttl

TTL_DAYS = 2
TTL_US = TTL_DAYS * 86400 * 1_000_000

J1_SQL = f"""
with recursive ev as (select cache_key, event_id, epoch_us(ts) as t,
       row_number() over (partition by cache_key order by ts, event_id) as rn from t_requests),
nx as (select e.cache_key, e.rn,
        (select min(e2.rn) from ev e2 where e2.cache_key = e.cache_key and e2.t >= e.t + cast({TTL_US} as bigint)) as nxt
       from ev e),
chain(cache_key, rn) as (
  select cache_key, rn from ev where rn = 1
  union all
  select n.cache_key, n.nxt from chain c join nx n on n.cache_key = c.cache_key and n.rn = c.rn where n.nxt is not null)
select ev.event_id, ev.cache_key, c.rn is null as hit
from ev left join chain c on c.cache_key = ev.cache_key and c.rn = ev.rn"""


def _log(spark, sf):
    return V.requests(spark, sf).withColumn("ts_us", F.unix_micros("ts"))


@register("J1_ttl_hits", with_views(J1_SQL, "t_requests"))
def q_j1(spark, sf):
    h = ttl.ttl_hits(_log(spark, sf), ttl_us=TTL_US)
    return h.select("event_id", "cache_key", "hit")


FILES_PER_WEEK = 16
#: Files of one week arrive shuffled; the watermark waits that long for them.
ARRIVAL_DELAY = "8 days"


def _stream_files(spark, sf, name: str, cols):
    """Write the log as files of its weeks, 16 per week with the rows spread at random,
    and a last file with one row far past the end (null id), which closes the log. The file
    source reads the weeks in the order in which they were written."""
    root = scratch_dir(spark, name)
    log = V.requests(spark, sf).select(*cols)
    week = F.floor(F.unix_seconds("ts") / F.lit(7 * 86400))
    # one pass over the log; each week is then copied from its own folder
    (log.withColumn("week", week).repartition(FILES_PER_WEEK, F.xxhash64("event_id")).write.mode("overwrite")
        .partitionBy("week").parquet(os.path.join(root, "weeks")))
    staged = spark.read.parquet(os.path.join(root, "weeks"))
    source = os.path.join(root, "in")
    for wk in sorted(r[0] for r in staged.select("week").distinct().collect()):      # one value per week
        (staged.where(F.col("week") == wk).drop("week").repartition(FILES_PER_WEEK, F.xxhash64("event_id"))
               .write.mode("append").parquet(source))
    end = staged.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts"))
    closing = end.select(*[F.col("ts") if c == "ts" else F.lit("" if t == "string" else None).cast(t).alias(c)
                           for c, t in log.dtypes])
    closing.write.mode("append").parquet(source)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 8).parquet(source)
    return root, stream


def _run_to_end(out, root: str):
    """Run a stream over the files that are there and return what its sink holds."""
    q = (out.writeStream.format("parquet").outputMode("append").option("path", os.path.join(root, "out"))
            .option("checkpointLocation", os.path.join(root, "chk")).trigger(availableNow=True).start())
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(os.path.join(root, "out"))


@register("J1_ttl_hits_stream", with_views(J1_SQL, "t_requests"))
def q_j1s(spark, sf):
    root, stream = _stream_files(spark, sf, "ttl-stream", ["event_id", "ts", "cache_key"])
    out = ttl.ttl_hits_stream(stream, ttl_seconds=TTL_DAYS * 86400, watermark=ARRIVAL_DELAY)
    return _run_to_end(out, root).where("event_id is not null").select("event_id", "cache_key", "hit")


@register("J2_window_latency", with_views("""
select time_bucket(interval 1 hour, ts) as window_start, count(*) as n_requests,
       round(avg(latency_ms), 6) as avg_latency_ms, round(max(latency_ms), 6) as max_latency_ms,
       round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms
from t_requests group by all""", "t_requests"))
def q_j2(spark, sf):
    w = jobs.stream_latency(V.requests(spark, sf), exact=True)
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests",
                    r6("avg_latency_ms").alias("avg_latency_ms"), r6("max_latency_ms").alias("max_latency_ms"),
                    r6("p95_latency_ms").alias("p95_latency_ms"))


@register("J2_stream_latency", with_views("""
select time_bucket(interval 1 hour, ts) as window_start, count(*) as n_requests,
       round(avg(latency_ms), 6) as avg_latency_ms, round(max(latency_ms), 6) as max_latency_ms,
       round(quantile_disc(latency_ms, 0.95), 6) as p95_latency_ms
from t_requests group by all""", "t_requests"))
def q_j2s(spark, sf):
    root, stream = _stream_files(spark, sf, "latency-stream", ["event_id", "ts", "latency_ms"])
    out = jobs.latency_of_counts(_run_to_end(jobs.stream_latency_counts(stream, watermark=ARRIVAL_DELAY), root))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests",
                      r6("avg_latency_ms").alias("avg_latency_ms"), r6("max_latency_ms").alias("max_latency_ms"),
                      r6("p95_latency_ms").alias("p95_latency_ms"))


@register("J2_sliding_report", with_views("""
select w.s as window_start, count(*) as n_requests, round(avg(latency_ms) * count(*), 2) as window_sum_ms,
 round(quantile_cont(latency_ms, 0.5), 6) as median_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms,
 round(quantile_cont(latency_ms, 0.99), 6) as p99_latency_ms, round(min(latency_ms), 6) as min_latency_ms,
 round(max(latency_ms), 6) as max_latency_ms, round(stddev_samp(latency_ms), 6) as std_latency_ms,
 round(avg(case when latency_ms < 120 then 1.0 else 0.0 end), 6) as sub_120ms_rate
from (select latency_ms, unnest([time_bucket(interval 1 hour, ts) - to_hours(k) for k in range(6)]) as s from t_requests
      where latency_ms is not null and not isnan(latency_ms)) w group by all""", "t_requests"))
def q_j2w(spark, sf):
    """Windows of six hours every hour, over a stream of shuffled files. The mean is compared as the window's sum, as
    in F5: a mean of 2-decimal values can sit exactly on a rounding edge."""
    root, stream = _stream_files(spark, sf, "sliding-stream", ["event_id", "ts", "latency_ms"])
    panes = _run_to_end(jobs.stream_latency_counts(stream, watermark=ARRIVAL_DELAY), root)
    out = jobs.sliding_report(panes, n_panes=6)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests",
                      F.round(F.col("avg_latency_ms") * F.col("n_requests"), 2).alias("window_sum_ms"),
                      *[r6(c).alias(c) for c in jobs.FIGURES[1:]])


@register("J2_rolling_latency_stream", ORACLE["F5_rolling_latency"])
def q_j2r(spark, sf):
    """F5 over a stream of shuffled files: equal to the batch result."""
    root, stream = _stream_files(spark, sf, "rolling-stream", ["event_id", "ts", "latency_ms"])
    jobs.rolling_latency_stream(stream, root, delay=ARRIVAL_DELAY).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("basePath", os.path.join(root, "out")).parquet(os.path.join(root, "out")).where("event_id is not null")
    wsum = F.round(F.col("avg_latency_ms") * F.least(F.col("request_count"), F.lit(1000)), 2)
    return out.select("event_id", "request_count", wsum.alias("window_sum_ms"), r6("p95_latency_ms").alias("p95_latency_ms"), r6("p99_latency_ms").alias("p99_latency_ms"))


#: Requests of one year arrive in so many files, whatever their number.
FILES_PER_YEAR = 8


@register("J3_stream_score", with_views(f"""
with {FIT_SQL}
select distinct md5(concat_ws('|', protein, compound)) as pair_key,
       {fit_score_sql('protein', 'compound')} as binding_affinity
from t_interactions
where length(protein) > 0 and regexp_full_match(upper(protein), '[ACDEFGHIKLMNPQRSTVWY]+')
  and length(compound) >= 3 and regexp_matches(compound, '[A-Za-z]')""", "t_interactions"))
def q_j3(spark, sf):
    """The requests of a year arrive shuffled, the years in order: keys are kept for 400 days. A pair
    that comes back later is scored again and falls together with the first in the sink. The log has the
    ids; the stream gives its requests their strings."""
    from bindscape.session import read_table
    root = scratch_dir(spark, "score-stream")
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    ids = V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber", "compound_id", "protein_id")
    src = ids.join(li, ["l_orderkey", "l_linenumber"]).select("l_shipdate", "protein_id", "compound_id")
    src.withColumn("year", F.year("l_shipdate")).write.mode("overwrite").partitionBy("year").parquet(os.path.join(root, "years"))
    staged = spark.read.parquet(os.path.join(root, "years"))
    for y in sorted(r[0] for r in staged.select("year").distinct().collect()):       # one value per year
        (staged.where(F.col("year") == y).drop("year").repartition(FILES_PER_YEAR)
               .write.mode("append").parquet(os.path.join(root, "in")))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(os.path.join(root, "in"))
    out = jobs.stream_score(stream, "l_shipdate", delay="400 days", scorer=fitted_scorer(spark, sf), proteins=V.proteins(spark, sf),
                            compounds=V.compounds(spark, sf)).select("pair_key", "binding_affinity")
    return _run_to_end(out, root).dropDuplicates(["pair_key"])
