"""Streaming J1: a hot key, late rows, a null key, ties, against a plain fold."""

import random

from pyspark.sql import functions as F

from bindscape.plans.reg_streaming import _run_to_end
from bindscape.streaming import ttl

SCHEMA = "event_id long, ts timestamp, cache_key string"


def plain(rows, ttl_us):
    out, last = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        hit = key in last and t - last[key] < ttl_us
        if not hit:
            last[key] = t
        out[i] = hit
    return out


def run(spark, tmp_path, files, **how):
    """One micro-batch per file, in the given order."""
    for k, rows in enumerate(files):
        df = spark.createDataFrame([(i, t, key) for key, t, i in rows], "event_id long, t long, cache_key string")
        df.select("event_id", F.timestamp_micros("t").alias("ts"), "cache_key").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    out = None
    spark.range(0).select(F.lit(1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(0)).alias("ts"),
                          F.lit("").alias("cache_key")).write.parquet(f"{tmp_path}/empty")
    for k in range(len(files)):
        spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
    out = _run_to_end(ttl.ttl_hits_stream(stream, **how), str(tmp_path))
    return {r.event_id: r.hit for r in out.collect()}


def test_hot_key_in_any_order_within_the_delay(spark, tmp_path):
    """60 % of 200,000 requests belong to one key; all wait at once; other keys, a null key and equal times are among them."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"k{rng.randrange(6)}",
             (1_000 + rng.randrange(3_000)) * 1_000_000, i) for i in range(200_000)]
    files = [rows[:120_000], rows[120_000:], [("end", 10_000_000_000_000, -1)]]
    got = run(spark, tmp_path, files, ttl_seconds=60, watermark="2 hours")
    want = plain(rows, 60_000_000)
    got.pop(-1, None)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_late_rows_and_expired_anchors(spark, tmp_path):
    def at(files):
        return [[(k, (1_000 + t) * 1_000_000, i) for k, t, i in f] for f in files]
    files = at([[("a", 0, 1), ("b", 5, 2)], [("b", 400, 3), ("a", 10, 9)], [("a", 405, 4), ("a", 20, 5), ("b", 406, 6)],
                [("a", 30, 7), ("z", 10_000, 8)]])
    got = run(spark, tmp_path, files, ttl_seconds=10, watermark="50 seconds", slice_seconds=3)
    # the watermark stands at 350 s when rows 5 and 7 arrive: both are dropped, and so the anchors of the first rows are gone
    assert {k: v for k, v in got.items() if k != 8} == {1: False, 2: False, 9: False, 3: False, 4: False, 6: True}


def test_many_keys_share_the_state_of_a_bucket(spark, tmp_path):
    """600 keys, a null one among them, in two buckets; anchors outlive their slices."""
    rng = random.Random(3)
    rows = [(None if k == 0 else f"k{k}", (1_000 + rng.randrange(400)) * 1_000_000, 10 * k + j) for k in range(600) for j in range(8)]
    rng.shuffle(rows)
    files = [rows[:2_000], rows[2_000:], [("k1", 10_000_000_000_000, -1)]]
    got = run(spark, tmp_path, files, ttl_seconds=60, watermark="2 hours", buckets=2)
    want = plain(rows, 60_000_000)
    got.pop(-1, None)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_an_anchor_stays_for_the_slice_that_the_watermark_stands_in(spark, tmp_path):
    """The anchor of 1000 s ends before the watermark (1011 s), but its hit waits in the slice of 1008 to 1012 s."""
    files = [[(k, (1_000 + t) * 1_000_000, i) for k, t, i in f]
             for f in ([("a", 0, 1), ("a", 9, 2)], [("b", 61, 3)], [("z", 10_000, 4)])]
    got = run(spark, tmp_path, files, ttl_seconds=10, watermark="50 seconds", slice_seconds=4)
    assert {k: v for k, v in got.items() if k != 4} == {1: False, 2: True, 3: False}
