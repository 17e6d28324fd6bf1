from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SMOKE


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SMOKE)
        assert sorted(out.columns) == sorted(docs.columns), name
        if name != "mixing":
            assert out.join(rows, "doc_id", "left_anti").count() == 0
        rows = spark.createDataFrame(out.collect(), docs.schema)
    last = P.STAGES[-1][1](spark, rows, SMOKE)
    assert last.count() == rows.count()
    run = P.run(spark, SMOKE)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, last.collect()))


def test_brute_force_of_the_filters(spark):
    """Rows that the filtering stages keep, from plain versions of their rules."""
    from bindscape.llm.decontam import budget, normalise
    from bindscape.llm.toxicity import fit, score
    from tests.llm.test_decontam import substring_distance
    from tests.llm.test_simhash import plain_components, plain_fingerprint
    docs, labels, bench = (spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in score(docs, fit(docs, labels)).where("predicted = 1").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    groups = plain_components({i: plain_fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = [normalise(r["text"]) for r in bench.collect()]
    kept = docs
    for _, stage in P.STAGES[:3]:
        kept = stage(spark, kept, SMOKE)
    kept = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept <= set(left)
    for i in set(left) - kept:
        s = normalise(left[i])
        assert any(p in s or (len(s) < 3000 and substring_distance(p, s) <= budget(len(p))) for p in items)
    assert not any(p in normalise(left[i]) for i in kept for p in items)


def test_empty(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, docs, SMOKE).count() == 0
