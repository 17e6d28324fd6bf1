import zlib

from bindscape.llm.toxicity import SEED, features, fit, fold, reject_toxic, score
from tests.conftest import SMOKE


def test_folding():
    assert fold("1di0t") == fold("IDIOT") == fold("іdіоt") == fold("i​diot")
    assert fold("a-b\nc").split() == ["a", "b", "c"]


LEX = tuple((f" {fold(w).strip()} ", 3.0) for w in SEED)


def test_lexicon_hits():
    assert features("you 1d10t!", LEX)[0] > 0 and features("idiotic", LEX) == (0.0, 0.0)
    assert features("the loser bracket is full of pond scum", LEX) == (0.0, 0.0)
    assert features("the loser bracket and a loser", LEX)[0] > 0
    short, long = features("scum", LEX), features("scum " + "fine words " * 200, LEX)
    assert short[0] == long[0] and short[1] > long[1]
    assert features(None, LEX) == features("", LEX) == features("   ", LEX) == (0.0, 0.0)


def test_held_out_accuracy(spark):
    folder = SMOKE.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum(s >= 0.7 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.7 for s in clean) <= 0.005 * len(clean)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    bad = {r["doc_id"] for r in score(docs, model).where("predicted = 1").collect()}
    kept = reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {
        r["doc_id"] for r in docs.select("doc_id").collect()} - bad


def test_labels_of_the_held_out_fold_are_not_used(spark, docs_of):
    from pyspark.sql import functions as F
    folder = SMOKE.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(docs, labels) == fit(docs, flipped)


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of([*odd_rows, (9, "what a pathetic idiot")], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    rows = score(docs, model).collect()
    assert len(rows) == len(odd_rows) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["doc_id"] for r in rows if r["predicted"]] == [9]
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    nulls = spark.createDataFrame([(4, None, None), (9, None, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert score(docs, fit(docs, nulls)).count() == len(rows)
    assert score(docs_of([]), model).count() == 0 and reject_toxic(docs_of([]), model).count() == 0


def plain_features(text, lexicon):
    """Every term at every place of the folded text, exception phrases by the same plain scan."""
    import math

    from bindscape.llm.toxicity import EXCEPTIONS
    words = fold(text or "").split()
    s = f" {' '.join(words)} "

    def places(p):
        return [i for i in range(len(s) - len(p) + 1) if s[i:i + len(p)] == p]
    spans = [(i, i + len(p)) for e in EXCEPTIONS for p in [f" {' '.join(fold(e).split())} "] for i in places(p)]
    total = 0.0
    for term, w in lexicon:
        n = sum(not any(a <= i and i + len(term) <= b for a, b in spans) for i in places(term))
        total += w * (1 + math.log(n)) if n else 0.0
    return math.log1p(total), math.log1p(1000 * total / max(1, len(words)))


def test_features_against_a_plain_scan():
    """Random texts of overlapping terms, beginnings of words, exception phrases and disguised letters."""
    import random

    from bindscape.llm.toxicity import EXCEPTIONS
    rng = random.Random(3)
    lexicon = (*LEX, (" lose", 1.5), (" ab", 0.5), (" abab ", 1.0), (" pathetic id", 0.7))
    parts = [*SEED, *EXCEPTIONS, "abab", "ab", "abc", "1d10t", "lоser", "fine", "words", "-", "\n", "loser's", "SCUM", "pathetic idiot"]
    hits = 0
    for _ in range(600):
        text = rng.choice(["", " "]) + rng.choice([" ", "  ", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got, want = features(text, lexicon), plain_features(text, lexicon)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True)), text
        hits += want[0] > 0
    assert 200 < hits < 600


def plain_fit(rows, labels):
    """Lexicon by plain counts over one text per labelled id of the training fold."""
    from collections import Counter

    from bindscape.llm.toxicity import MIN_DOCS, _lexicon, terms_of
    y = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            y[i] = max(v, y.get(i, 0))
    counts, n = {0: Counter(), 1: Counter()}, Counter()
    for i, text in {i: t for i, t in rows if i in y}.items():
        counts[y[i]].update(terms_of(text or ""))
        n[y[i]] += 1
    toxic = {t: c for t, c in counts[1].items() if c >= MIN_DOCS}
    return tuple(sorted(_lexicon(toxic, {t: c for t, c in counts[0].items() if t in toxic}, n[1], n[0]).items()))


def test_fit_against_plain_counts_and_a_hot_id(spark, docs_of):
    """The lexicon equals plain counts; one labelled id in half of the rows weighs as one text."""
    import random
    rng = random.Random(5)
    bad, good = ["vrexil", "skurn", "dolt ard", "idiot"], ["table", "river", "garden", "winter", "paper", "stone"]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1), (8, 0), (12, None)]
    rows = [(i, " ".join(rng.choices(good, k=20) + (rng.choices(bad, k=3) if i % 4 == 0 else []))) for i in range(400)]
    rows += [(402, "no label here"), (None, "null id idiot")]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs_of(rows, extra=True), table)
    assert model["lexicon"] == plain_fit(rows, labels)
    assert {t.strip() for t, _ in model["lexicon"]} & {fold("vrexil").strip(), fold("vrex").strip()}
    hot = next(i for i in range(0, 400, 4) if zlib.crc32(str(i).encode()) % 3 != 1)
    again = fit(docs_of(rows + [(hot, rows[hot][1])] * 400, extra=True), table)
    assert again == model
    many = [(hot, f"{rows[hot][1]} copy {k}") for k in range(400)]
    assert len(fit(docs_of(rows + many), table)["lexicon"]) <= len(model["lexicon"]) + 2
