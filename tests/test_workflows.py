"""The normalized-star plans equal the plans on the joined table."""

from pyspark.sql import functions as F

from bindscape.operators import clean
from bindscape.plans import views as V
from bindscape.plans import workflows as W
from tests.conftest import SMOKE


def _sorted(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_prepare_training_normalized_equals_joined(spark):
    joined = W.prepare_training(V.interactions(spark, SMOKE))
    star = W.prepare_training_normalized(V.interactions_ids(spark, SMOKE), V.compounds(spark, SMOKE),
                                         V.proteins(spark, SMOKE))
    cols = ["l_orderkey", "l_linenumber", "compound_id", "protein_id", "split", "binding_label"]
    assert _sorted(joined, cols) == _sorted(star, cols)


def test_preprocess_dataset_normalized_equals_joined(spark):
    attrs = ("affinity", "source_dataset", "pKd", "binding_label")
    facts = V.interactions_ids(spark, SMOKE).select("compound_id", "protein_id", "affinity", "source_dataset")
    facts = facts.withColumn("pKd", clean.to_pkd("affinity")).withColumn("binding_label", clean.binding_label("pKd"))
    joined = (facts.join(V.compounds(spark, SMOKE), "compound_id").join(V.proteins(spark, SMOKE), "protein_id")
                   .select("compound", "protein", *attrs))
    a = W.preprocess_dataset(joined)
    b = W.preprocess_dataset_normalized(facts, V.compounds(spark, SMOKE), V.proteins(spark, SMOKE), attrs)
    for x, y in zip(a[:3], b[:3]):
        rx, ry = x.first().asDict(), y.first().asDict()
        for k, v in rx.items():
            if isinstance(v, float):
                assert abs(v - ry[k]) < 1e-9, k
            else:
                assert v == ry[k], k
    qa = dict((r.metric, r.value) for r in a[3].collect())
    qb = dict((r.metric, r.value) for r in b[3].collect())
    assert qa.keys() == qb.keys() and all(abs(qa[k] - qb[k]) < 1e-9 for k in qa)
    assert a[4].count() == b[4].count()
    assert a[4].select(F.sum("protein_length")).first()[0] == b[4].select(F.sum("protein_length")).first()[0]


def test_screen_summary_without_pairs(spark):
    """Equal to the summary of the full screen, scores just at a threshold included; no product in the plan."""
    from pyspark.sql import functions as F

    from bindscape.functions.affinity import LinearAffinity
    from bindscape.operators.joins import screen
    from bindscape.plans import workflows as W
    prots = spark.createDataFrame([(i, "A" * (i % 9) + "K" * (20 - i % 7)) for i in range(60)], "protein_idx long, protein string")
    comps = spark.createDataFrame([(i, "C" * (i % 13) + "(=O)") for i in range(40)], "compound_idx long, compound string")
    for model in (LinearAffinity(6.99995, 0.05, 2.0), LinearAffinity(9.00005, -0.25, -1.0), LinearAffinity(0.0, 0.0, 0.0)):
        s = screen(prots, comps, scorer=model)
        want = W.screening_summary(s).first()
        scores = W.screened_scores(prots, comps, model)
        got = W.counted_screening_summary(scores).first()
        assert all(abs(got[c] - want[c]) < 1e-9 for c in want.asDict())
        assert sorted(map(tuple, scores.groupBy("binding_affinity").agg(F.sum("n")).collect())) == sorted(
            map(tuple, s.groupBy("binding_affinity").count().collect()))
    plan = W.counted_screening_summary(scores)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    none = W.run_screen(prots.limit(0), comps, model).collect()
    assert {r.metric: r.value for r in none}["total"] == 0
