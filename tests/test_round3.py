"""Large dictionary, score store, predictor capabilities, pooled vectors, required columns."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindscape.operators import profile, score_store, scoring, splits
from bindscape.sources import readers as RD


def test_large_dictionary_in_many_splits(spark, tmp_path):
    data = {f"id{i}": v for i, v in enumerate([
        "plain", "a,b", 'quote " comma , brace } {', "back\\slash", "ends with \\", "\\\\,\\\"", "", "日本, é", None, 5, 1.5, True,
        {"x": [1, {"y": "a,b}"}], "z": "{"}, [1, 2, [3, ","]], "tab\tline\n,", "\\", '"', ',"', '\\"'] * 40)}
    data |= {'key "with, quotes\\': "v", "": "empty key", "{": "}", "long": 'x" y\\' * 60_000}
    path = tmp_path / "one.json"
    path.write_text("  " + json.dumps(data, ensure_ascii=False, indent=1) + "\n ")
    want = dict(spark.createDataFrame([(path.read_text().strip(),)], "t string").select(
        F.explode(F.from_json("t", T.MapType(T.StringType(), T.StringType())))).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997b", "7kb", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = RD.read_large_id_dict(spark, str(path)).collect()
            assert len(got) == len(data) and {r.id: r.data for r in got} == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
        assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none.json").write_text(" { } ")
    assert RD.read_large_id_dict(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('{"a": "b", c}')
    with pytest.raises(Exception, match="not an entry"):
        RD.read_large_id_dict(spark, str(tmp_path / "bad.json")).collect()


def test_score_store(spark, tmp_path):
    prots = spark.createDataFrame([(i, "A" * i) for i in range(1, 4)], "protein_id long, protein string")
    comps = spark.createDataFrame([(i, "C" * i) for i in range(1, 4)], "compound_id long, compound string")
    asked = [(1, 1), (1, 1), (2, 3), (2, 9), (None, 1), (3, None)]
    req = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "r long, protein_id long, compound_id long")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scorer(p, c):
        calls.add(1)
        return float(10 * len(p) + len(c))

    store = f"{tmp_path}/store"
    one = {r.r: (r.score, r.cached) for r in score_store.score_requests(req, prots, comps, store, "one", scorer).collect()}
    assert one == {0: (11.0, False), 1: (11.0, False), 2: (23.0, False), 3: (None, False), 4: (None, False), 5: (None, False)}
    assert calls.value == 2                                       # each distinct pair that can be scored, once
    again = {r.r: (r.score, r.cached) for r in score_store.score_requests(req, prots, comps, store, "one", scorer).collect()}
    assert again == one and calls.value == 4                      # a repeated run makes its own part again
    two = {r.r: (r.score, r.cached) for r in score_store.score_requests(req, prots, comps, store, "two", scorer).collect()}
    assert two == {k: (v[0], v[0] is not None) for k, v in one.items()} and calls.value == 4     # all hits


def test_capabilities(spark, tmp_path):
    df = spark.createDataFrame([(i, "A" * (i % 5), None if i == 7 else "C") for i in range(50)], "i long, protein string, compound string").repartition(3)
    closed = spark.sparkContext.accumulator(0)
    built = spark.sparkContext.accumulator(0)

    class Base:
        def __init__(self):
            built.add(1)

        def close(self):
            closed.add(1)

    class Basic(Base):
        def predict_interaction(self, p, c):
            return len(p) + len(c)

    class Single(Basic):
        def predict_single(self, p, c):
            return len(p) / (0 if len(p) == 4 else 1), 0.5

    class Batch(Single):
        def predict_batch(self, p, c):
            return [(1.0, 0.1)] * len(p)

    def run(factory, how):
        return {r.i: (r.binding_affinity, r.confidence, r.capability) for r in scoring.score_by_capability(df, factory, on_error=how).collect()}

    assert set(run(Batch, "raise").values()) == {(1.0, 0.1, "batch")}
    assert built.value == closed.value == 3
    single = run(Single, "constant")
    assert all(v == ((0.75, 0.85, "fallback") if i % 5 == 4 else (float(i % 5), 0.5, "single")) for i, v in single.items())
    basic = run(Basic, "constant")
    assert basic[7] == (0.75, 0.85, "fallback") and basic[6] == (2.0, 0.85, "basic")
    assert set(run(Base, "raise").values()) == {(0.75, 0.85, "constant")}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        run(Single, "raise")
    assert scoring.score_by_capability(df.limit(0), Batch).count() == 0


def test_pooled_vectors(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [100.0, 100.0], 0), ("b", [1.0, 1.0], 0), (None, [4.0, 4.0], 2), ("c", None, 1)]
    df = spark.createDataFrame(rows, "s string, v array<double>, m int")
    got = {r.s: r.pooled for r in profile.pooled_vectors(df, "s", "v", "m").collect()}
    assert got == {"a": [2.0, 4.0], "b": [None, None], None: [4.0, 4.0], "c": None}
    plan = profile.pooled_vectors(df, "s", "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_checked_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert splits.checked_columns(df, ["a"]) == (df, None)
    empty, error = splits.checked_columns(df, ["a", "c"])
    assert empty.count() == 0 and empty.columns == ["a", "b", "c"] and error == "Missing required columns: ['c']"
