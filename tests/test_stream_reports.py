"""Rolling figures over a stream in small batches, late rows and a repeated batch; sliding windows of odd rows."""

import numpy as np
from pyspark.sql import functions as F

from bindscape.streaming import jobs

SCHEMA = "event_id long, ts timestamp, latency_ms double"


def put(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, s long, latency_ms double").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "latency_ms").coalesce(1).write.mode("append").parquet(path)


def test_rolling_latency_of_shuffled_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, 10_000 + int(rng.integers(0, 400)), float(rng.integers(0, 1000)) / 4) for i in range(300)]
    order = sorted(rows, key=lambda r: r[1] + rng.integers(0, 60))
    source, root = f"{tmp_path}/in", f"{tmp_path}/run"
    late = (900, 10_000, 5.0)
    put(spark, source, order[:100])
    put(spark, source, order[100:])
    put(spark, source, [(901, 20_000, 1.0)])
    put(spark, source, [late, (902, 30_000, 2.0)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        jobs.rolling_latency_stream(stream, root, delay="100 seconds", width=20).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.request_count, r.event_id, r.avg_latency_ms, r.p95_latency_ms) for r in
                      spark.read.parquet(f"{root}/out").collect())

    got, done = run(), sorted(rows, key=lambda r: (r[1], r[0])) + [(901, 20_000, 1.0)]
    assert [g[:2] for g in got] == [(k + 1, r[0]) for k, r in enumerate(done)]        # the late row is dropped, the last one waits
    for k, g in enumerate(got):
        frame = [r[2] for r in done[max(0, k - 19):k + 1]]
        assert abs(g[2] - np.mean(frame)) < 1e-9 and abs(g[3] - np.percentile(frame, 95)) < 1e-9
    put(spark, source, [(903, 40_000, 9.0)])
    assert [g[:2] for g in run()] == [g[:2] for g in got] + [(302, 902)]               # a restart goes on


def test_sliding_windows(spark):
    rows = [(1, 0, 1.0), (2, 3_599, 2.0), (3, 3_600, None), (4, 7_200, 4.0), (5, 50_000, float("nan")), (6, 7_300, 200.0)]
    log = spark.createDataFrame(rows, "event_id long, s long, latency_ms double").withColumn("ts", F.timestamp_seconds("s"))
    out = jobs.sliding_report(jobs.stream_latency_counts(log), n_panes=3)
    got = {int(r.window_start.timestamp()) // 3600: r for r in out.collect()}
    assert sorted(got) == [-2, -1, 0, 1, 2]
    for k, r in got.items():
        x = [v for _, s, v in rows if v is not None and v == v and k <= s // 3600 < k + 3]
        assert r.n_requests == len(x) and r.min_latency_ms == min(x) and r.max_latency_ms == max(x)
        assert abs(r.avg_latency_ms - np.mean(x)) < 1e-9 and abs(r.sub_120ms_rate - np.mean(np.array(x) < 120)) < 1e-9
        for q, c in ((50, "median_latency_ms"), (95, "p95_latency_ms"), (99, "p99_latency_ms")):
            assert abs(r[c] - np.percentile(x, q)) < 1e-9
        assert (r.std_latency_ms is None) == (len(x) == 1) and (len(x) == 1 or abs(r.std_latency_ms - np.std(x, ddof=1)) < 1e-9)
    assert jobs.sliding_report(jobs.stream_latency_counts(log.limit(0))).count() == 0
