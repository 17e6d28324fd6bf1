"""Findings of round 3: work that is done once per string or row, not once per use."""

from pyspark.sql import functions as F

from bindscape.functions.affinity import LinearAffinity
from bindscape.operators import profile, score_store


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dimension_extremes_sorts_a_vector_once(spark):
    df = spark.createDataFrame([(1, [4.0, 1.0, 3.0, 2.0, 9.0]), (2, None), (3, []), (4, [1.0, None, 2.0])], "i int, embedding array<double>")
    out = profile.dimension_extremes(df).select("i", "high_dims", "low_dims")
    assert _plan(out).count("array_sort") <= 1
    got = {r.i: (r.high_dims, r.low_dims) for r in out.where("i < 3").collect()}
    assert got == {1: ([4], [1]), 2: (None, None)}


def test_described_scorer_gets_no_sequence_with_the_pairs(spark, tmp_path):
    prots = spark.createDataFrame([(1, "AILM"), (2, "AC"), (3, None)], "protein_id long, protein string")
    comps = spark.createDataFrame([(1, "CC"), (2, "C(=O)")], "compound_id long, compound string")
    req = spark.createDataFrame([(k, *a) for k, a in enumerate([(1, 1), (2, 2), (3, 1), (9, 1)])], "r long, protein_id long, compound_id long")

    class Once(LinearAffinity):
        def __call__(self, protein, compound):
            raise AssertionError("scored from strings")

    s = score_store.score_requests(req, prots, comps, f"{tmp_path}/store", "one", Once(1.0, 0.5, 2.0))
    assert {r.r: r.score for r in s.collect()} == {0: 4.0, 1: 3.0, 2: 2.0, 3: None}


def test_parse_prediction_joins_rows_before_sequences(spark):
    from bindscape.plans.registry import load_all
    df = load_all()[0]["I26_parse_prediction"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().analyzed().toString()
    # the deepest join is that of the rows, the outermost that of the sequences
    assert text.index("Join Inner, (protein_id") < text.index("Join Inner, (compound_id") < text.index("Join Inner, ((l_orderkey")


def test_letters_are_counted_in_one_pass(spark):
    from bindscape.functions import protein as P
    rows = [(0, "AAWLK"), (1, ""), (2, None), (3, "aAé€😀AK-"), (4, "K" * 1000), (5, "A\nC D")]
    df = spark.createDataFrame(rows, "i int, s string").repartition(2)
    n = P.normalize_protein("s")
    out = df.select("i", P.letter_tally("s").alias("t"), P.residue_counts("s").alias("c"), P.residue_percentages("s").alias("p"),
                    P.property_groups("s").alias("g"), n.alias("n"), P.sequence_stats("s").alias("st"))
    for r in out.collect():
        s = rows[r.i][1]
        if s is None:
            assert r.t is None and r.c is None and r.p is None and r.n is None and r.st.valid is False
            continue
        assert r.t.n == len(s) and r.t.c == [s.count(chr(65 + k)) for k in range(26)]
        assert r.c == {x: s.count(x) for x in s} and r.p == {x: s.count(x) * 100.0 / len(s) for x in s}
        assert r.n == s.replace(" ", "").replace("\n", "").upper()
        assert r.g.hydrophobic == sum(s.count(x) for x in P.HYDROPHOBIC)
    st = {r.i: r.st for r in out.collect()}
    assert st[0].length == 5 and st[0].residue_counts["A"] == 2 and st[5].length == 3 and st[3].valid is False and st[3].length is None
    # one pass for all sets and weights
    plan = df.select(P.property_groups("s").alias("g"), P.residue_mw("s").alias("mw"), P.estimated_pi("s").alias("pi"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "translate" not in text


def test_protein_summary_shuffles_no_text(spark):
    df = spark.createDataFrame([("AILM",), ("AILM",), ("KK",), ("B1",), (None,), (None,)], "protein string")
    s = profile.protein_summary(df).first()
    assert (s.total_proteins, s.valid_proteins, s.length_min, s.length_max, s.length_median) == (4, 2, 2, 4, 3.0)
    assert (s.avg_hydrophobic_pct, round(s.avg_molecular_weight, 6)) == (50.0, round((89.1 + 2 * 131.2 + 149.2 + 2 * 146.2) / 2, 6))
    plan = profile.protein_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [protein" not in plan


def test_concordance_index_counts_no_row_per_level(spark):
    import itertools
    import random

    from bindscape.operators import metrics as M
    rng = random.Random(7)
    nan = float("nan")
    # groups on both sides of the strip size, heavy ties, copies, NaN, signed zeros and nulls
    rows = [("big", float(rng.randint(0, 25)), float(rng.randint(0, 40))) for _ in range(400)]
    rows += [("fine", rng.random(), rng.random()) for _ in range(150)] + [("one", 1.0, 2.0), ("tied", 1.0, 0.5), ("tied", 1.0, 0.7)]
    rows += [("small", float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(9)] * 2
    rows += [("odd", nan, 1.0), ("odd", 0.0, nan), ("odd", -0.0, -1.0), ("odd", 2.0, 0.0), ("odd", nan, -0.0), ("odd", 3.0, None), ("odd", None, 1.0)]
    rows += [(None, 1.0, 2.0), (None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double").repartition(3)

    def key(x):
        return (x != x, 0.0 if x != x else x)

    want = {}
    for g in {r[0] for r in rows} - {None}:
        own = [(key(y), key(p)) for h, y, p in rows if h == g and y is not None and p is not None]
        pairs = [(a, b) for a, b in itertools.permutations(own, 2) if a[0] > b[0]]
        want[g] = (len(pairs), sum(1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0 for a, b in pairs))
    for size in (8, 64, None):
        got = {r.g: (r.comparable_pairs, r.concordant) for r in M.concordance_index(df, "g", "y", "p", size=size).collect()}
        assert got == want, size


def test_preparation_reads_sequences_and_hashes_pairs_once(spark):
    from bindscape.operators import splits
    from bindscape.plans import workflows as W
    read, met = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(acc):
        def add(x):
            acc.add(1)
            return x
        return add

    seqs = [(k, "ACDEFGHIKLMN" * (k % 3 + 1)) for k in range(6)] + [(6, None)]
    prots = spark.createDataFrame(seqs, "protein_id long, protein string").withColumn(
        "protein", F.udf(counted(read), "string").asNondeterministic()("protein"))
    comps = spark.createDataFrame([(k, "C" * (6 + k % 2)) for k in range(4)], "compound_id long, compound string")
    facts = spark.range(40).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 4).alias("compound_id"),
                                   (F.col("id") % 7).alias("protein_id"), F.lit(7.0).alias("affinity"),
                                   F.lit("davis").alias("source_dataset"), F.lit("train").alias("source_split"))
    out = W.prepare_training_normalized(facts, comps, prots).collect()
    assert read.value == len(seqs)
    # distinct strings: 2 compounds, 3 proteins and a null, which has no length
    assert len(out) == 6 and sorted(len(r.protein) for r in out) == sorted([12, 24, 36] * 2)
    assert all(r.protein_length == len(r.protein) and r.compound_length == len(r.compound) for r in out)
    # the ranks sample their input for the ranges: rows are not hashed again for that
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "canon_c long, canon_p long, v double").withColumn(
        "v", F.udf(counted(met), "double").asNondeterministic()("v"))
    hashed = W.with_pair_hash(rows, comps, prots)
    splits.ratio_split(hashed, ("canon_c", "canon_p"), hash_col="pair_hash").collect()
    assert met.value == 2
