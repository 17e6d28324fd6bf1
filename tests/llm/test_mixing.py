import math
from collections import Counter

from pyspark.sql import functions as F

from bindscape.llm.mixing import copies, mix_sources, poisson_draw, repetition_rates


def test_poisson_inverse(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 32.0):
        df = spark.range(2000).select((F.col("id") / 2000.0).alias("u")).withColumn("k", poisson_draw(F.col("u"), F.lit(rate)))
        for r in df.collect():
            k, cdf = -1, 0.0
            while cdf <= r["u"] or k < 0:
                k += 1
                cdf += math.exp(-rate + (k * math.log(rate) if k else 0.0) - math.lgamma(k + 1)) if rate else float(k == 0)
            assert abs(r["k"] - k) <= (1 if abs(cdf - r["u"]) < 1e-9 else 0)


def test_weights_and_shuffle(spark, docs_of):
    rows = [(i, "x" * 99, "big" if i < 3000 else "small") for i in range(4000)]
    docs = docs_of(rows)
    weights = spark.createDataFrame([("big", 0.25), ("small", 0.75)], "source string, weight double")
    out = mix_sources(docs, weights).collect()
    n = Counter(r["source"] for r in out)
    assert abs(n["big"] / 1000 - 1) < 0.15 and abs(n["small"] / 3000 - 1) < 0.15
    keys = [r["__order"] for r in out]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = mix_sources(docs.repartition(7), weights).collect()
    assert [(r["doc_id"], r["__copy"]) for r in again] == [(r["doc_id"], r["__copy"]) for r in out]
    copies = Counter(r["doc_id"] for r in out)
    assert all({r["__copy"] for r in out if r["doc_id"] == i} == set(range(c)) for i, c in list(copies.items())[:50])


def test_rates(spark, docs_of):
    docs = docs_of([(1, "x" * 9, "a"), (2, "x" * 39, "b"), (3, None, None)])
    rates = {r["src"]: r["rate"] for r in repetition_rates(docs).collect()}
    w = {"a": 10 ** 0.5, "b": 40 ** 0.5, None: 1.0}
    for s, size in (("a", 10), ("b", 40), (None, 1)):
        assert abs(rates[s] - w[s] / sum(w.values()) * 51 / size) < 1e-9
    only = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r["src"]: r["rate"] for r in repetition_rates(docs, only).collect()} == {"a": 5.1, "b": 0.0, None: 0.0}


def test_large_rates(spark, docs_of):
    n = [r[0] for r in spark.range(300).select(copies(F.lit(42), F.col("id"), F.lit(1000.0))).collect()]
    mean = sum(n) / len(n)
    var = sum((x - mean) ** 2 for x in n) / len(n)
    assert abs(mean - 1000) < 8 and 700 < var < 1350
    only = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    docs = docs_of([(1, "x" * 9, "a"), (2, "x" * 39, "b")])
    out = mix_sources(docs, only, total_bytes=2e6)
    rows = out.agg(F.count(F.lit(1)), F.countDistinct("__copy"), F.max("__copy"), F.max("doc_id")).first()
    assert abs(rows[0] / 2e5 - 1) < 0.02 and rows[0] == rows[1] == rows[2] + 1 and rows[3] == 1


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of([(i, t, None if i == 8 else "s") for i, t in odd_rows], extra=True)
    out = mix_sources(docs)
    assert out.columns == [*docs.columns, "__copy", "__order"]
    seen = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert seen[4, "one two three four five six"] % 2 == 0          # repeated rows draw alike
    assert mix_sources(docs_of([])).count() == 0
    none = spark.createDataFrame([], "source string, weight double")
    assert mix_sources(docs, none).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))
