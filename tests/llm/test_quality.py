import numpy as np
from pyspark.sql import functions as F

from bindscape.llm.quality import isotonic, score_quality, text_bins
from tests.conftest import SMOKE


def test_isotonic():
    out = isotonic(np.array([0.0, 5, 1, 9, 0]), np.array([9.0, 1, 5, 1, 0]))
    assert all(a <= b for a, b in zip(out, out[1:], strict=False)) and out[0] < 0.1 and out[3] > 0.8


def test_bins(odd_rows):
    for _, t in odd_rows:
        b = text_bins(t)
        assert len(b) == 10 and all(0 <= x < 32 for x in b)
    assert text_bins(None) == text_bins("") == text_bins(" \n ") == [0] * 10


def test_held_out_accuracy(spark):
    folder = SMOKE.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.12 * len(bad)
    # the metadata view is better than chance, the text view much better
    mean = lambda rs, c: sum(r[c] for r in rs) / len(rs)
    assert mean(good, "meta_score") > mean(bad, "meta_score") and mean(good, "text_score") > mean(bad, "text_score") + 0.5


def test_held_out_labels_are_not_used(spark):
    folder = SMOKE.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in score_quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(4, 1), (8, 0), (6, 1), (7, 0), (2, None), (8, 0)], "doc_id long, quality int")
    rows = score_quality(docs_of(odd_rows, extra=True), labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    none = score_quality(docs_of(odd_rows).drop("lang", "source", "n_chars"), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert score_quality(docs_of([]), labels).count() == 0


def plain_scores(rows, labels, rounds=3, confident=0.95):
    """Loops over the rows: counts, pseudo-labels, the isotonic curve by its max-min formula, the final score."""
    import math
    import zlib

    import xxhash
    y = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            y[i] = max(v, y.get(i, 0))

    def meta(text, source):
        return [xxhash.xxh64(b"en", seed=42).intdigest() % 32, xxhash.xxh64((source or "").encode(), seed=42).intdigest() % 256,
                min(31, math.floor(2 * math.log2(len(text or "") + 1)))]

    views = [[text_bins(t) for _, t, _ in rows], [meta(t, s) for _, t, s in rows]]
    known = [y.get(i) for i, _, _ in rows]
    seen = [k for k in known if k is not None]
    prior = (sum(seen) + 0.5) / (len(seen) + 1)
    base = math.log(prior / (1 - prior))
    sizes = [[32] * 10, [32, 256, 32]]

    def odds(view, target):
        out = []
        for f, n in enumerate(sizes[view]):
            pos, neg = [1.0] * n, [1.0] * n
            for bins, (label, w) in zip(views[view], target, strict=True):
                pos[bins[f]] += w * label
                neg[bins[f]] += w * (1 - label)
            out.append([math.log((p / sum(pos)) / (q / sum(neg))) for p, q in zip(pos, neg, strict=True)])
        return out

    def calibrated(scores):
        pos, n = [0.0] * 64, [0.0] * 64
        for s, k in zip(scores, known, strict=True):
            if k is not None:
                b = min(63, max(0, math.floor((s + 24) / 48 * 64)))
                pos[b] += k
                n[b] += 1
        share = (sum(pos) + 0.5) / (sum(n) + 1)
        a, b = [p + 0.02 * share for p in pos], [x + 0.02 for x in n]
        curve = [min(0.999, max(0.001, max(min(sum(a[lo:hi + 1]) / sum(b[lo:hi + 1]) for hi in range(k, 64))
                                           for lo in range(k + 1)))) for k in range(64)]
        out = []
        for s in scores:
            at = min(63.0, max(0.0, (s + 24) / 48 * 64 - 0.5))
            low = math.floor(at)
            out.append(curve[low] + (at - low) * (curve[min(63, low + 1)] - curve[low]))
        return out

    target = [[(k or 0, 0.0 if k is None else 1.0) for k in known]] * 2
    for k in range(rounds + 1):
        tables = [odds(v, target[v]) for v in (0, 1)]
        p = [calibrated([sum(t[b] for t, b in zip(tables[v], bins, strict=True)) + base for bins in views[v]]) for v in (0, 1)]
        if k < rounds:
            target = [[(k0, 1.0) if k0 is not None else (int(q >= 0.5), 0.5 if q >= confident or q <= 1 - confident else 0.0)
                       for k0, q in zip(known, p[1 - v], strict=True)] for v in (0, 1)]
    both = calibrated([math.log(a / (1 - a)) + math.log(b / (1 - b)) - base for a, b in zip(*p, strict=True)])
    return list(zip(both, *p, strict=True))


def test_against_a_loop_version(spark, docs_of):
    import random
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.6
        words = rng.choices(["river", "garden", "Winter", "paper", "stone", "a", "of", "long"] if good else
                            ["$$$", "CLICK", "http://x.y/z", "12345", "free"], k=rng.randint(1, 90)) + rng.choices(["the", "and"], k=5)
        rng.shuffle(words)
        rows.append((i, " ".join(words), rng.choice(["news", "books"] if rng.random() < (0.8 if good else 0.3) else ["ads", "web"])))
        if rng.random() < 0.5:
            labels.append((i, int(good)))
    rows += [(300, None, None), (301, "", "news")]
    table = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["score"], r["text_score"], r["meta_score"]) for r in score_quality(docs_of(rows), table).collect()}
    want = plain_scores(rows, labels)
    for (i, _, _), w in zip(rows, want, strict=True):
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], w, strict=True)), (i, got[i], w)
    assert len({round(w[0], 6) for w in want}) > 3
