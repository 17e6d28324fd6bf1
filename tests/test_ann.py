"""Index forms of the similarity joins: exact distances, recall against the exact joins, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from bindscape.operators import ann, similarity
from bindscape.plans import views as V
from tests.conftest import SMOKE

VECTORS = "t_id long, embedding array<double>"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], VECTORS)


def rows(df):
    return sorted((r.q_id, r["rank"], r.t_id, round(r.distance, 9)) for r in df.collect())


def test_exact_join_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    x[7] = 0
    x[9] = x[8]
    t = table(spark, x)
    q = t.withColumnRenamed("t_id", "q_id")
    d = 1 - np.divide(x @ x.T, (n := np.linalg.norm(x, axis=1))[:, None] * n, out=np.zeros((300, 300)), where=np.outer(n, n) > 0)
    want = [(i, k + 1, int(j), round(d[i, j], 9)) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), np.round(d[i], 12)))[:5])]
    got = rows(similarity.knn_join(q, t, 5, block_rows=64, train_rows=50))
    assert [(a, b, e) for a, b, _, e in got] == [(a, b, abs(e)) if e == 0 else (a, b, e) for a, b, _, e in want]
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) > 1490       # equal distances may differ in the last digit
    assert rows(similarity.knn_join(q, t, 5)) == got


def test_index_of_clustered_vectors_visits_few_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    t = table(spark, x)
    index = ann.fit_index(t, sample_rows=800)
    assert index.probes * 3 < len(index.centroids)
    indexed = ann.index_rows(index, t)
    assert indexed.count() == 3000
    q = t.where("t_id % 50 = 0").withColumnRenamed("t_id", "q_id")
    exact = similarity.knn_join(q, t, 5)
    for block in (16_384, 40):
        found = ann.knn_search(index, indexed, q, 5, block_rows=block)
        got = ann.recall(found, exact).first()
        assert (got.n_queries, got.n_neighbours) == (60, 300) and got.recall >= 0.9
    truth = {(r.q_id, r.t_id): r.distance for r in exact.collect()}
    assert all(abs(truth[r.q_id, r.t_id] - r.distance) < 1e-12 for r in found.collect() if (r.q_id, r.t_id) in truth)


def test_index_of_vectors_without_structure(spark):
    t = V.embeddings(spark, SMOKE).withColumnRenamed("vec_id", "t_id")
    index = ann.fit_index(t)
    q = t.where("t_id % 50 = 0").withColumnRenamed("t_id", "q_id")
    got = ann.recall(ann.knn_search(index, ann.index_rows(index, t), q, 5), similarity.knn_join(q, t, 5)).first()
    assert got.recall >= 0.9


def test_index_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = table(spark, np.eye(3)).union(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (9, None)], VECTORS))
    q = some.withColumnRenamed("t_id", "q_id")
    for t in (empty, some):
        index = ann.fit_index(t)
        found = ann.knn_search(index, ann.index_rows(index, t), q if t is some else empty.withColumnRenamed("t_id", "q_id"), 5)
        assert {r.t_id for r in found.where("rank = 1").collect()} == (set() if t is empty else {0, 1, 2})


def test_minhash_finds_what_the_exact_join_finds(spark):
    rng = np.random.default_rng(3)
    base = [set(rng.integers(0, 400, 30).tolist()) for _ in range(40)]
    sets = [None, [], *[[int(x) for x in b if rng.random() > 0.12] + [None, 5, 5] for b in base for _ in range(6)], [1, 2, 3], [1, 2, 3], [3, 2, 1]]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, bits array<int>")
    plain = {i: {x for x in s if x is not None} for i, s in enumerate(sets) if s}
    want = {(i, j): round(len(a & b) / len(a | b), 9) for i, a in plain.items() for j, b in plain.items() if i < j and len(a & b) >= 0.7 * len(a | b)}
    got = ann.minhash_join(df.withColumnRenamed("i", "a"), df.withColumnRenamed("i", "b"), 0.7, "a", "b", self_join=True)
    got = {(r.a, r.b): round(r.similarity, 9) for r in got.collect()}
    assert len(want) > 200 and set(got) <= set(want) and all(got[p] == want[p] for p in got)
    assert len(got) >= 0.9 * len(want)
    two = ann.minhash_join(df.withColumnRenamed("i", "a").where("a < 100"), df.withColumnRenamed("i", "b").where("b >= 100"), 0.7, "a", "b")
    assert {(r.a, r.b) for r in two.collect()} == {p for p in got if p[0] < 100 <= p[1]}
    assert ann.minhash_join(df.limit(0).select(F.col("i").alias("a"), "bits"), df.select(F.col("i").alias("b"), "bits"), 0.5, "a", "b").count() == 0
