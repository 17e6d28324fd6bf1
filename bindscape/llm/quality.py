"""Quality by co-training a text-content view and a page-metadata view.

Both views are naive Bayes classifiers over binned features, so all that a round of training needs
is a table of counts by (feature, bin, class): one aggregate over all rows, a few thousand
numbers at any data size. In each round a view's scores are calibrated on the labelled
training rows (isotonic over a score histogram), and the unlabelled rows of which it is
confident become pseudo-labels in the other view's counts. At the end the calibrated log odds
of both views are added (less the prior) and calibrated once more to score every row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.llm.toxicity import held_out
from bindscape.session import cut_lineage

ROUNDS = 3
CONFIDENT = 0.95
PSEUDO_WEIGHT = 0.5
SCORE_BINS = 64
SCORE_RANGE = 24.0

#: Bins per feature of either view.
TEXT_BINS = 32
TEXT_FEATURES = ("distinct words", "commonest word", "mean word length", "capitals", "punctuation", "digits",
                 "rare signs", "repeated lines", "words", "long words")
META_FEATURES = {"lang": 32, "source": 256, "length": 32}


def text_bins(text: str | None) -> list[int]:
    """Bin (0 to 31) of each text feature; a text without words has bin 0 throughout."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0] * len(TEXT_FEATURES)
    b = np.frombuffer(data, np.uint8)
    per = np.bincount(b, minlength=256)
    size, n = len(b), len(words)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = per[65:91].sum() + per[97:123].sum() + per[128:].sum()
    punctuation = per[33:127].sum() - per[48:58].sum() - per[65:91].sum() - per[97:123].sum()
    signs = per[[35, 36, 37, 42, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]].sum()

    def share(x):
        return min(TEXT_BINS - 1, int(math.sqrt(min(1.0, float(x))) * TEXT_BINS))

    return [share(len(seen) / n), share(max(seen.values()) / n), min(TEXT_BINS - 1, int(2 * sum(map(len, words)) / n)),
            share(per[65:91].sum() / max(1, letters)), share(punctuation / size), share(per[48:58].sum() / size),
            share(signs / size), share(1 - len(set(lines)) / len(lines)), min(TEXT_BINS - 1, int(2 * math.log2(n + 1))),
            share(sum(len(w) > 20 for w in words) / n)]


def _text_view(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([text_bins(t.as_py()) for t in texts], pa.list_(pa.int32()))
    return compute(text)


def _meta_view(docs: DataFrame, text_col: str) -> Column:
    """Bins of the metadata columns that are there; an absent column is bin 0 throughout."""
    def hashed(c):
        return (F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(META_FEATURES[c])).cast("int")
                if c in docs.columns else F.lit(0))
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length(text_col)
    length = F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)) + 1)), F.lit(31))
    return F.array(hashed("lang"), hashed("source"), length.cast("int"))


def _log_odds(rows: DataFrame, view: str, bins: list[int]) -> list[list[float]]:
    """Naive Bayes log odds by feature and bin from the weighted classes ``y``, ``w``; prior apart."""
    got = (rows.where("w > 0").select("y", "w", F.posexplode(view).alias("f", "b")).groupBy("f", "b")
           .agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg")).collect())
    table = [np.ones((n, 2)) for n in bins]
    for r in got:
        table[r["f"]][r["b"]] += (r["pos"], r["neg"])
    out = []
    for t in table:
        t = t / t.sum(0)
        out.append([float(x) for x in np.log(t[:, 0] / t[:, 1])])
    return out


def _sum_of(view: str, odds: list[list[float]]) -> Column:
    """Sum over features of the log odds of the row's bin (constant arrays of a few hundred numbers)."""
    parts = [F.get(F.from_json(F.lit(str(o)), "array<double>"), F.get(F.col(view), F.lit(k))) for k, o in enumerate(odds)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _score_bin(score: Column) -> Column:
    at = F.floor((score + SCORE_RANGE) / (2 * SCORE_RANGE) * SCORE_BINS)
    return F.least(F.greatest(at, F.lit(0)), F.lit(SCORE_BINS - 1)).cast("int")


def isotonic(pos: np.ndarray, neg: np.ndarray) -> list[float]:
    """Non-decreasing share of positives by score bin (pool adjacent violators), smoothed by half a
    row of each class; empty bins take the pooled value of their neighbours."""
    prior = (pos.sum() + 0.5) / (pos.sum() + neg.sum() + 1)
    blocks: list[list[float]] = []
    for p, n in zip(pos, neg, strict=True):
        blocks.append([p + 0.02 * prior, p + n + 0.02, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    out: list[float] = []
    for a, b, c in blocks:
        out += [float(min(0.999, max(0.001, a / b)))] * int(c)
    return out


def _calibrate(rows: DataFrame, score: str) -> list[float]:
    got = rows.where("train").groupBy(_score_bin(F.col(score)).alias("b")).agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect()
    pos, neg = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for r in got:
        pos[r["b"]], neg[r["b"]] = r["pos"], r["neg"]
    return isotonic(pos, neg)


def _probability(score: Column, curve: list[float]) -> Column:
    """The curve between the middles of the score bins, linear."""
    table = F.from_json(F.lit(str(curve)), "array<double>")
    at = (score + SCORE_RANGE) / (2 * SCORE_RANGE) * SCORE_BINS - 0.5
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(SCORE_BINS - 1)))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(SCORE_BINS - 1))
    return F.get(table, low) + (at - low) * (F.get(table, high) - F.get(table, low))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """``(id, held_out, score, predicted, text_score, meta_score)`` per row: the probability of label 1,
    whether it is at least one half, and the calibrated probabilities of the two views.

    Labels are learned from all labelled rows outside the held-out fold; held-out rows take part
    as unlabelled ones. Null labels are skipped; several labels of one id count as the largest.
    Null and empty texts have a bin of their own; null metadata count as empty strings. With one
    class or none labelled, every score is the smoothed prior. Repeated rows repeat. Metadata
    columns (lang, source, n_chars) may be absent; other columns are ignored."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    feats = docs.select(F.col(id_col).alias("id"), _text_view(F.col(text_col)).alias("tv"),
                        _meta_view(docs, text_col).alias("mv"))
    rows = cut_lineage(feats.join(known, F.col("id") == F.col("lid"), "left").select(
        "id", "tv", "mv", F.coalesce("label", F.lit(0)).alias("label"), F.col("label").isNotNull().alias("train")))
    sums = rows.where("train").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos, n = sums["p"] or 0, sums["n"]
    prior = (pos + 0.5) / (n + 1)
    base = math.log(prior / (1 - prior))
    if pos in (0, n):
        flat = F.lit(float(prior))
        return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), flat.alias("score"),
                           (flat >= 0.5).cast("int").alias("predicted"), flat.alias("text_score"), flat.alias("meta_score"))
    sizes = {"tv": [TEXT_BINS] * len(TEXT_FEATURES), "mv": list(META_FEATURES.values())}
    other = {"tv": "mv", "mv": "tv"}
    own = [F.col("label").alias("y"), F.when(F.col("train"), 1.0).otherwise(0.0).alias("w")]
    odds = {v: _log_odds(rows.select(v, *own), v, sizes[v]) for v in sizes}
    scored, curves = rows, {}
    for k in range(rounds + 1):
        scored = rows.select("*", *[(_sum_of(v, odds[v]) + base).alias(f"s_{v}") for v in sizes])
        curves = {v: _calibrate(scored, f"s_{v}") for v in sizes}
        scored = scored.select("*", *[_probability(F.col(f"s_{v}"), curves[v]).alias(f"p_{v}") for v in sizes])
        if k == rounds:
            break
        fresh = {}
        for v in sizes:
            # the other view's confident rows teach this one
            p = F.col(f"p_{other[v]}")
            sure = (p >= confident) | (p <= 1 - confident)
            fresh[v] = _log_odds(scored.select(
                v, F.when(F.col("train"), F.col("label")).otherwise((p >= 0.5).cast("int")).alias("y"),
                F.when(F.col("train"), 1.0).when(sure, PSEUDO_WEIGHT).otherwise(0.0).alias("w")), v, sizes[v])
        odds = fresh
    logit = [F.log(F.col(f"p_{v}") / (1 - F.col(f"p_{v}"))) for v in sizes]
    both = scored.withColumn("s", logit[0] + logit[1] - F.lit(base))
    curve = _calibrate(both, "s")
    return both.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"),
                       _probability(F.col("s"), curve).alias("score"), F.col("p_tv").alias("text_score"),
                       F.col("p_mv").alias("meta_score")).select(
        id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
