"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps homoglyphs (Cyrillic, Greek, full-width), digit and sign substitutions
and the look-alikes ``l``/``1`` to one letter each, drops zero-width marks and turns all else
into spaces, so ``1di0t`` and ``idiot`` are one word. The lexicon holds whole words and word
beginnings. Terms and weights (log odds) are learned from labelled documents of the training
fold, on top of a small seed list; hits inside an exception phrase don't count. A document's
weighted hits, as a sum and per thousand words, go through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

#: Bound of the labelled ids, and so of the texts, that a fit reads (chosen by a hash of the id).
MAX_TRAIN = 20_000
THRESHOLD = 0.7
MIN_DOCS = 3
MIN_WEIGHT = 3.0
PRIOR_WEIGHT = 3.0
PREFIXES = range(4, 9)

# Seed words and the phrases in which they are harmless.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "circus clown", "loser bracket",
              "stupid simple", "pond scum", "idiot proof")
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
              "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
              "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
              "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t",
               "8": "b"}


class _Fold(dict):
    """Code point -> folded text, worked out once per code point."""

    def __missing__(self, cp: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(cp)).lower():
            c = HOMOGLYPHS.get(c, c)
            c = SUBSTITUTES.get(c, c)
            if unicodedata.category(c) not in ("Mn", "Cf"):
                out += c if c.isalnum() else " "
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text with a space at either end."""
    return f" {text.translate(_FOLD)} "


def terms_of(text: str) -> set[str]:
    """Terms of a text: each word (with a space on both sides) and each of its
    beginnings of 4 to 8 letters (with a space before)."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        for n in PREFIXES:
            if n < len(w):
                out.add(f" {w[:n]}")
    return out


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the terms that mark toxic documents (log odds), shortest first; a term that a kept
    beginning covers about as well is left out. Seed words fill in. The evidence asked (Dunning's
    G2) rises with the number of terms tried, so that about one would pass by chance."""
    tried = max(2, len(toxic))
    least_g2 = NormalDist().inv_cdf(1 - 0.5 / tried) ** 2

    def weight(term):
        a, b = toxic.get(term, 0), clean.get(term, 0)
        return math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))

    def g2(term):
        a, b, n = toxic.get(term, 0), clean.get(term, 0), n_toxic + n_clean
        cells = ((a, (a + b) * n_toxic / n), (b, (a + b) * n_clean / n), (n_toxic - a, (n - a - b) * n_toxic / n),
                 (n_clean - b, (n - a - b) * n_clean / n))
        return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)

    kept: dict[str, float] = {}
    for term in sorted(toxic, key=lambda t: (len(t.strip()), t[-1] == " ", t)):
        w = weight(term)
        if w < MIN_WEIGHT or g2(term) < least_g2:
            continue
        word = term.strip()
        if any(kept.get(f" {word[:n]}", 0.0) >= 0.75 * w for n in PREFIXES if n <= len(word)):
            continue
        kept[term] = w
    for word in SEED:
        term = f" {fold(word).strip()} "
        if term not in toxic and term not in clean:
            kept.setdefault(term, PRIOR_WEIGHT)
    return kept


@functools.lru_cache(maxsize=2)
def _automaton(lexicon: tuple[tuple[str, float], ...]):
    import ahocorasick
    machine = ahocorasick.Automaton()
    for term, w in lexicon:
        machine.add_word(term, (term, w))
    machine.make_automaton()
    harmless = ahocorasick.Automaton()
    for phrase in EXCEPTIONS:
        p = f" {' '.join(fold(phrase).split())} "
        harmless.add_word(p, len(p))
    harmless.make_automaton()
    return machine, harmless


def features(text: str | None, lexicon: tuple[tuple[str, float], ...]) -> tuple[float, float]:
    """(log of 1 + weighted hits, log of 1 + weighted hits per 1,000 words)."""
    if not text or not lexicon:
        return 0.0, 0.0
    machine, harmless = _automaton(lexicon)
    folded = fold(text)
    if next(machine.iter(folded), None) is None:
        return 0.0, 0.0
    words = folded.split()
    folded = f" {' '.join(words)} "
    spans = [(end - n + 1, end) for end, n in harmless.iter(folded)]
    hits, weights = Counter(), {}
    for end, (term, w) in machine.iter(folded):
        start = end - len(term) + 1
        if not any(a <= start and end <= b for a, b in spans):
            hits[term] += 1
            weights[term] = w
    # a repeated term counts less each time
    total = sum(weights[term] * (1 + math.log(n)) for term, n in hits.items())
    return math.log1p(total), math.log1p(1000.0 * total / max(1, len(words)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """Probability cut with the best F1, half-way between its neighbours."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    last = np.append(p[1:] < p[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 1e-6, 1 - 1e-6))


def held_out(id_col: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3 (null: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_train: int = MAX_TRAIN) -> dict:
    """Model ``{lexicon, beta, cut}`` from at most about ``max_train`` labelled texts of the training fold,
    one per id. Null labels are skipped; several labels of one id count as the largest; of several
    texts of one id that with the smallest hash is read, so that an id that holds many rows weighs as
    much as any other. Without texts of both classes the seed words are used with a fixed curve."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y")))
    n = known.count()
    share = min(1.0, max_train / max(1, n))
    cut = int(share * (1 << 32))
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 32)) < cut)
    # at most about max_train rows of 12 bytes: a broadcast of proven size
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    one = F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))).alias("one")
    # one text per id, written once: the counts and the curve read the same rows
    rows = cut_lineage(mine.join(F.broadcast(picked), "__id").groupBy("__id", "__y").agg(one)
                       .select(F.col("one.text").alias("text"), F.col("__y").alias("y")))

    def counted(wanted):
        def count(batches):
            seen = Counter()
            for b in batches:
                for t in b.column(0):
                    terms = terms_of(t.as_py() or "")
                    seen.update(terms if wanted is None else terms & wanted)
                    seen[""] += 1
            keys = list(seen)
            for i in range(0, len(keys), 20_000):
                part = keys[i:i + 20_000]
                yield pa.record_batch({"term": pa.array(part, pa.string()),
                                       "n": pa.array([seen[k] for k in part], pa.int64())})
        return count

    def totals(y, wanted, least):
        got = (rows.where(F.col("y") == y).select("text").mapInArrow(counted(wanted), "term string, n long")
               .groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("term") == "")))
        return {r["term"]: int(r["n"]) for r in got.collect()}      # bounded by the sample

    toxic = totals(1, None, MIN_DOCS)
    n_toxic = toxic.pop("", 0)
    clean = totals(0, frozenset(toxic), 1)
    n_clean = clean.pop("", 0)
    if not n_toxic or not n_clean:
        return {"lexicon": tuple((f" {fold(w).strip()} ", PRIOR_WEIGHT) for w in SEED),
                "beta": (-4.0, 2.0, 0.5), "cut": 0.5}
    lexicon = tuple(sorted(_lexicon(toxic, clean, n_toxic, n_clean).items()))
    # sorted, so that sums don't depend on the order in which tasks end
    got = np.array(sorted((r[0], r[1], r[2]) for r in rows.select(_features(F.col("text"), lexicon).alias("f"), "y")
                          .select("f.total", "f.rate", "y").collect()))
    beta = _logistic(got[:, :2], got[:, 2])
    p = 1 / (1 + np.exp(-np.clip(beta[0] + got[:, :2] @ beta[1:], -30, 30)))
    return {"lexicon": lexicon, "beta": tuple(float(b) for b in beta), "cut": _cut(p, got[:, 2])}


def _features(text: Column, lexicon) -> Column:
    @F.arrow_udf("struct<total:double,rate:double>")
    def compute(texts: pa.Array) -> pa.Array:
        rows = [features(t.as_py(), lexicon) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()),
                                           pa.array([r[1] for r in rows], pa.float64())], ["total", "rate"])
    return compute(text)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)`` per row. The curve is rescaled so that the model's cut
    lies at ``threshold``. Null and empty texts score like a text without hits; equal texts score
    alike; repeated rows repeat; other columns are ignored."""
    b0, b1, b2 = model["beta"]
    f, cut = F.col("f"), model["cut"]
    p = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * f["total"] + F.lit(b2) * f["rate"])))
    scaled = F.when(F.col("p") < cut, F.lit(threshold) * F.col("p") / cut).otherwise(
        F.lit(threshold) + F.lit(1 - threshold) * (F.col("p") - cut) / (1 - cut))
    got = docs.select(F.col(id_col).alias("id"), _features(F.col(text_col), model["lexicon"]).alias("f"))
    got = got.select("id", p.alias("p")).select("id", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("s"))
    return got.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("s").alias("score"),
                      (F.col("s") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns unchanged."""
    b0, b1, b2 = model["beta"]
    f = _features(F.col(text_col), model["lexicon"])
    p = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * f["total"] + F.lit(b2) * f["rate"])))
    return docs.where(p < model["cut"])
