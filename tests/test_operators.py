"""Operator properties on small fixtures, checked against brute force."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from bindscape.operators import metrics as M
from bindscape.operators import ranking, similarity, splits, windows
from bindscape.streaming import ttl


def test_hash_rank_matches_single_partition_row_number(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    r = ranking.hash_rank(df, ["k"], 42, "rank", n_parts=16)
    ref = df.withColumn("_h", ranking.hash_key(["k"], 42)) \
        .withColumn("ref", F.row_number().over(Window.orderBy("_h", "k")))
    j = r.join(ref, "k")
    assert j.filter(F.col("rank") != F.col("ref")).count() == 0
    assert r.select("n_total").distinct().collect()[0][0] == 3000


def test_value_rank_and_prefix_sums_exact(spark):
    rnd = random.Random(1)
    data = [(i, float(rnd.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v double")
    r = ranking.value_rank(df, "v", ["id"], "rank", n_parts=8).toPandas()
    pdf = pd.DataFrame(data, columns=["id", "v"]).sort_values(["v", "id"]).reset_index(drop=True)
    pdf["ref"] = np.arange(1, len(pdf) + 1)
    m = r.merge(pdf, on="id")
    assert (m["rank"] == m["ref"]).all()
    g = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    p = ranking.prefix_sums(g, "v", ["c"], descending=True, n_parts=4).toPandas().sort_values("v", ascending=False)
    assert list(p["cum_c"]) == list(p["c"].cumsum())


def test_splits_disjoint_complete_exact(spark):
    df = spark.range(1001).select(F.col("id").cast("string").alias("compound"), F.lit("P").alias("protein"))
    s = splits.ratio_split(df, n_parts=8)
    counts = dict(s.groupBy("split").count().collect())
    assert counts == {"train": 800, "validation": 100, "test": 101}
    assert s.select("compound").distinct().count() == 1001
    t = splits.two_stage_split(df, n_parts=8)
    c2 = dict(t.groupBy("split").count().collect())
    assert c2["test"] == math.ceil(1001 * 0.2) and c2["validation"] == math.ceil((1001 - 201) * 0.25)


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [("C", "P", "kiba", "train", 1, 1), ("C", "P", "davis", "test", 9, 1), ("C", "P", "davis", "train", 5, 2),
            ("D", "P", "bindingdb", "test", 3, 1)]
    df = spark.createDataFrame(rows, "compound string, protein string, source_dataset string, source_split string, "
                                     "l_orderkey long, l_linenumber int")
    d = splits.dedup_pairs(df, order_cols=("l_orderkey", "l_linenumber"))
    got = {(r.compound, r.source_dataset, r.source_split, r.l_orderkey) for r in d.collect()}
    assert got == {("C", "davis", "train", 5), ("D", "bindingdb", "test", 3)}
    assert splits.dedup_pairs(d, order_cols=("l_orderkey", "l_linenumber")).count() == 2


def test_roc_auc_ties_single_class_and_monotone(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(data, "y_true int, score double")
    auc = M.roc_auc(df).first()[0]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    ref = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, ref, rel_tol=1e-12)
    auc2 = M.roc_auc(df.withColumn("score", F.col("score") * 3 + 1)).first()[0]
    assert math.isclose(auc, auc2, rel_tol=1e-12)
    single = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y_true int, score double")
    assert M.roc_auc(single).first()[0] is None


def test_spearman_matches_pandas(spark):
    rnd = random.Random(5)
    data = [(float(rnd.randint(0, 9)), float(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame(data, "a double, b double")
    got = M.spearman(df, "a", "b").first()[0]
    ref = pd.DataFrame(data, columns=["a", "b"]).corr(method="spearman").iloc[0, 1]
    assert math.isclose(got, ref, rel_tol=1e-9)


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(7)
    X = rnd.normal(size=(300, 16))
    X[:40] = X[0] + 0.01 * rnd.normal(size=(40, 16))      # a dense cluster
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(300)], "id long, embedding array<double>")
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    D = 1 - U @ U.T
    ref = set()
    for i in range(300):
        order = sorted(range(300), key=lambda j: (round(D[i, j], 12), j))[:5]
        ref |= {(i, j) for j in order}
    for block_rows in (4096, 70):       # one block of queries, and several
        k = similarity.knn_join(df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "t_id"), 5,
                                block_rows=block_rows)
        got = {(r.q_id, r.t_id) for r in k.collect()}
        assert got == ref


def test_tanimoto_join_matches_brute_force(spark):
    rnd = random.Random(11)
    sets = [sorted(rnd.sample(range(40), rnd.randint(0, 12))) for _ in range(120)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, bits array<int>")
    j = similarity.tanimoto_join(df.withColumnRenamed("id", "l_id"), df.withColumnRenamed("id", "r_id"), 0.4,
                                 self_join=True)
    got = {(r.l_id, r.r_id) for r in j.collect()}
    ref = set()
    for a in range(120):
        for b in range(a + 1, 120):
            A, B = set(sets[a]), set(sets[b])
            u = len(A | B)
            if u and len(A & B) / u >= 0.4:
                ref.add((a, b))
    assert got == ref
    sets = similarity.ordered_sets([(df, "id", "bits")]).select("id", "e")
    scored = similarity.tanimoto_candidates(sets, sets, 0.7, True).count()
    print("share of pairs compared at 0.7:", scored / (120 * 119 / 2))
    assert scored < 0.1 * 120 * 119 / 2
    sym = similarity.tanimoto(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2)))
    assert spark.range(1).select(sym).first()[0] == 1.0


def test_ttl_gap_equal_to_ttl_is_a_miss(spark):
    rows = [("k", 1, 0), ("k", 2, 30), ("k", 3, 60), ("k", 4, 90), ("k", 5, 125), ("j", 6, 0), ("j", 7, 10)]
    df = spark.createDataFrame(rows, "cache_key string, event_id long, ts_us long")
    want = {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}
    # k: 0 miss, 30 hit, 60 miss (gap == ttl), 90 hit, 125 miss; j: 0 miss, 10 hit
    assert dict((r.event_id, r.hit) for r in ttl.ttl_hits(df, ttl_us=60).collect()) == want
    try:
        ttl.ttl_hits(df, ttl_us=60, max_rounds=1)
        raise AssertionError("pointers were left")
    except RuntimeError:
        pass


def test_ttl_matches_a_fold_on_the_request_log(spark):
    from tests.conftest import SMOKE
    from bindscape.plans import views as V
    log = V.requests(spark, SMOKE).withColumn("ts_us", F.unix_micros("ts")).select("cache_key", "event_id", "ts_us")
    ttl_us, want, t0 = 2 * 86400 * 10**6, {}, {}
    for r in sorted(log.collect(), key=lambda r: (r.ts_us, r.event_id)):
        want[r.event_id] = r.cache_key in t0 and r.ts_us - t0[r.cache_key] < ttl_us
        if not want[r.event_id]:
            t0[r.cache_key] = r.ts_us
    assert dict((r.event_id, r.hit) for r in ttl.ttl_hits(log, ttl_us=ttl_us).collect()) == want


def test_rolling_latency_chunks_match_full_window(spark):
    rnd = random.Random(2)
    data = [(i, i * 1000, float(rnd.randint(1, 300))) for i in range(1200)]
    df = spark.createDataFrame(data, "event_id long, ts_us long, latency_ms double")
    r = windows.rolling_latency(df, "latency_ms", 100, chunk_rows=150).toPandas().sort_values("event_id")
    s = pd.Series([d[2] for d in data])
    ref95 = s.rolling(100, min_periods=1).quantile(0.95)
    assert np.allclose(r["p95_latency_ms"].to_numpy(), ref95.to_numpy())
    assert list(r["request_count"]) == list(range(1, 1201))


def test_partition_rank_spreads_hot_key(spark):
    data = [("hot", i) for i in range(2000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(data, "k string, v long")
    r = ranking.partition_rank(df, ["k"], "v", rank_col="rn", n_parts=16)
    bad = r.filter(F.col("rn") != F.col("v") + 1).count()
    assert bad == 0


def test_hot_key_plans_reduce_before_shuffle(spark):
    """A key with a third of the rows: keep-first and top-n both reduce map-side."""
    df = spark.range(30000).select((F.col("id") % 3).cast("string").alias("compound"), F.lit("P").alias("protein"),
                                   F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
                                   F.lit("davis").alias("source_dataset"), F.lit("train").alias("source_split"))
    d = splits.dedup_pairs(df, order_cols=("l_orderkey", "l_linenumber"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert sorted(r.l_orderkey for r in d.collect()) == [0, 1, 2]
    t = windows.top_n_per_group(df, ["compound"], ["l_orderkey"], 5)
    plan2 = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan2 and "Partial" in plan2
    assert t.count() == 15
