"""Edge rows of the shared helpers: empty, one row, infinite, tied, large offsets, broken files."""

import math

import pytest
from pyspark.sql import functions as F

from bindscape.operators import metrics as M
from bindscape.operators import profile, ranking, reports, similarity, splits, windows
from bindscape.plans import workflows as W
from bindscape.sources import readers as RD

SCORED = "y_true int, score double"
LOG = "event_id long, ts_us long, latency_ms double, cached boolean"


def test_rank_metrics_of_empty_and_infinite_input(spark):
    empty = spark.createDataFrame([], SCORED)
    assert M.roc_auc(empty).first()[0] is None and M.pr_auc(empty).first()[0] is None
    assert M.spearman(empty.withColumn("y", F.col("y_true").cast("double")), "y", "score").first()[0] is None
    assert [tuple(r) for r in M.roc_curve(empty).collect()] == [(None, 0.0, 0.0)]
    assert [tuple(r) for r in M.pr_curve(empty).collect()] == [(None, 1.0, 0.0)]
    inf = spark.createDataFrame([(1, math.inf), (0, -math.inf), (1, 0.5), (0, 0.5)], SCORED)
    assert M.roc_auc(inf).first()[0] == 0.875


def test_latency_report_edges(spark):
    empty = reports.latency_report(spark.createDataFrame([], LOG)).first()
    assert empty["n_requests"] == 0 and empty["avg_latency_ms"] is None and empty["p95_latency_ms"] is None
    one = reports.latency_report(spark.createDataFrame([(1, 1, 5.0, True)], LOG)).first()
    assert (one["n_requests"], one["avg_latency_ms"], one["std_latency_ms"], one["p99_latency_ms"]) == (1, 5.0, None, 5.0)
    far = spark.range(1000).select((F.lit(1e9) + F.col("id") / 1000.0).alias("latency_ms"))
    got = reports.latency_report(far).first()
    assert abs(got["std_latency_ms"] - 0.28882) < 1e-3 and abs(got["median_latency_ms"] - 1e9 - 0.4995) < 1e-6


def test_regression_on_shifted_data(spark):
    d = spark.range(1000).select((F.lit(1e9) + F.col("id") / 1000.0).alias("y"),
                                 (F.lit(1e9) + F.col("id") / 1000.0 + (F.col("id") % 2) * 0.01).alias("p"))
    assert abs(M.regression_metrics(d, "y", "p").first()["r2"] - 0.9994) < 1e-3
    assert M.regression_metrics(d.limit(0), "y", "p").first()["r2"] is None


def test_guarded_divisions(spark):
    bad = spark.createDataFrame([("(",), ("",)], "compound string")
    assert profile.drug_summary(bad).first()["drug_like_percentage"] is None
    cold = spark.createDataFrame([("a", 1e6, 1), ("a", 2e6, 2)], "g string, e double, c int")
    assert reports.ensemble_properties(cold, ["g"], "e", "c").first()["average_energy"] is None
    tok = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [3.0, 4.0], 0)], "s int, v array<double>, m int")
    assert {r["value"] for r in profile.masked_mean_pool(tok, "s", "v", "m").collect()} == {None}


def test_performance_grade_counts_present_parts(spark):
    fast = spark.createDataFrame([(i, i, 1.0, False) for i in range(10)], LOG)
    got = reports.performance_grade(fast).first()
    assert got["cache_score"] is None and got["grade"] == "A+"
    assert reports.performance_grade(fast.limit(0)).first()["grade"] == "N/A"


@pytest.mark.parametrize("n_parts", [1, 5, 16])
def test_ranks_with_heavy_ties_and_nulls(spark, n_parts):
    rows = [("k" if i % 3 else None, 7.0 if i % 2 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    order = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=order), 1)}
    got = ranking.value_rank(df, "v", ["id"], n_parts=n_parts).collect()
    assert {r["id"]: r["rank"] for r in got} == want
    within = {}
    for k in ("k", None):
        within |= {r[2]: i for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=order), 1)}
    got = ranking.partition_rank(df, ["k"], "v", ["id"], n_parts=n_parts).collect()
    assert {r["id"]: r["rn"] for r in got} == within
    assert ranking.value_rank(df.limit(0), "v").count() == 0
    assert ranking.partition_rank(df.limit(0), ["k"], "v").count() == 0
    assert ranking.prefix_sums(df.limit(0).select("v", "id"), "v", ["id"]).count() == 0


def test_windows_of_empty_logs(spark):
    empty = spark.createDataFrame([], LOG)
    assert windows.rolling_latency(empty).count() == 0
    assert windows.cumulative_throughput(empty).count() == 0


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "compound int, protein int")
    assert splits.require_columns(df, ["compound", "protein"]) is df
    with pytest.raises(ValueError, match="affinity"):
        splits.require_columns(df, ["compound", "protein", "affinity"])
    with pytest.raises(ValueError, match="affinity"):
        W.prepare_training(df)


def test_whole_texts_in_the_protein_view(spark):
    from bindscape.plans import views as V
    from tests.conftest import SMOKE
    longest = V.proteins(spark, SMOKE).agg(F.max(F.length("protein"))).first()[0]
    assert longest > 1200


def test_reliability_without_neighbours(spark):
    q = spark.createDataFrame([(1,), (2,)], "q_id long")
    near = spark.createDataFrame([(1, 10, 0.0)], "q_id long, t_id long, distance double")
    labels = spark.createDataFrame([(10, 3)], "t_id long, label int")
    got = {r["q_id"]: r["reliability"] for r in similarity.reliability(near, labels, queries=q).collect()}
    assert got == {1: 1.0, 2: 0.5}
    empty = spark.createDataFrame([], "q_id long, embedding array<double>")
    assert similarity.knn_join(empty, empty.withColumnRenamed("q_id", "t_id")).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "ligands_a.txt").write_text('{"1": "CC", "2": "C"}\n')
    (tmp_path / "ligands_b.txt").write_text('{"1": "CC", broken\nsecond\n')
    rows = RD.read_id_dict(spark, str(tmp_path / "ligands_*.txt")).collect()
    assert sorted((r["compound_id"], r["compound"]) for r in rows if r["compound_id"]) == [("1", "CC"), ("2", "C")]
    assert [r["data"] for r in rows if r["data"]] == ['{"1": "CC", broken', "second"]
    (tmp_path / "Y.txt").write_bytes(b"\r\n1 2\r\n3 x\r\n5\t6 \r\n\r\n")
    got = sorted((r["i"], r["j"], r["affinity"]) for r in RD.read_matrix_txt(spark, str(tmp_path / "Y.txt")).collect())
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0), (1, 1, 6.0)]
    (tmp_path / "list.txt").write_text("\n  first\n\nthird \n\n")
    got = sorted((r["idx"], r["data"]) for r in RD.read_list_txt(spark, str(tmp_path / "list.txt")).collect())
    assert got == [(0, "first"), (1, ""), (2, "third")]


def test_lines_of_a_split_file(spark, tmp_path):
    """A file read in many blocks keeps its line numbers."""
    (tmp_path / "big.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["idx"]: r["data"] for r in RD.read_lines_indexed(spark, str(tmp_path / "big.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"line {i} {'x' * (i % 50)}".rstrip() if i == 2999 else f"line {i} {'x' * (i % 50)}" for i in range(3000)}


def test_fitted_scorer(spark):
    import numpy as np
    from bindscape.functions.affinity import LinearAffinity, fit_affinity, linear_model
    rng = np.random.default_rng(3)
    rows = [("C" * int(n) + "1(", "A" * int(k) + "G" * (20 - int(k)), 2.0 + 0.3 * int(n) + 1.5 * int(k) / 20)
            for n, k in zip(rng.integers(1, 30, 200), rng.integers(0, 20, 200), strict=True)]
    df = spark.createDataFrame(rows, "compound string, protein string, pKd double")
    m = fit_affinity(df)
    assert abs(m.intercept - 2) < 1e-6 and abs(m.letters - 0.3) < 1e-6 and abs(m.hydrophobic - 1.5) < 1e-6
    got = [r[0] for r in df.select(m("protein", "compound")).collect()]
    assert got == [round(x, 4) for x in linear_model(m)()([r[1] for r in rows], [r[0] for r in rows])]
    assert fit_affinity(df.limit(0)) == LinearAffinity(0.0, 0.0, 0.0)
    flat = fit_affinity(df.withColumn("protein", F.lit("")))
    assert flat.hydrophobic == 0.0 and abs(flat.letters - 0.3) < 0.1


def test_null_keys_are_keys(spark):
    """J1, F8 and I29 keep the rows of a null key; J1 keeps rows with equal ids apart."""
    from bindscape.streaming.ttl import ttl_hits
    log = spark.createDataFrame([(1, None, 0), (2, None, 50), (2, None, 50), (3, "a", 0), (4, "a", 100), (4, "a", 250), (5, "", 7)],
                                "event_id long, cache_key string, ts_us long")
    got = sorted((r.event_id, r.cache_key or "-", r.ts_us, r.hit) for r in ttl_hits(log, ttl_us=100).collect())
    assert got == [(1, "-", 0, False), (2, "-", 50, True), (2, "-", 50, True), (3, "a", 0, False), (4, "a", 100, False),
                   (4, "a", 250, False), (5, "-", 7, False)]
    rows = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "a", None), (4, "b", 5.0), (5, "b", None)],
                                 "event_id long, g string, v double")
    n = {r.event_id: (r.share, r.is_max) for r in windows.normalize_and_argmax(rows, ["g"], "v", ["event_id"]).collect()}
    assert n == {1: (0.25, False), 2: (0.75, True), 3: (None, True), 4: (1.0, True), 5: (None, False)}
    ids = spark.createDataFrame([(1, None, [1, 2]), (2, None, [3]), (3, 0, None), (4, 0, [4])], "i int, batch int, ids array<int>")
    p = {r.i: (r.input_ids, r.attention_mask) for r in windows.pad_and_mask(ids, "ids", "batch").collect()}
    assert p == {1: ([1, 2], [1, 1]), 2: ([3, 0], [1, 0]), 3: ([0], [0]), 4: ([4], [1])}
