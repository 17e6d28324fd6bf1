"""Periodic runs of words, by Baier grouping.

A run is a maximal stretch of words with a smallest period. Every run of two periods or more holds a
Lyndon word of the period's length that is the longest one starting at its place, under the order of
the words or under the reverse order. Phase one of Baier's suffix sorting groups the suffixes by their
longest Lyndon prefix, so the lengths of its group contexts are the Lyndon array; it is run once for each
order. The roots found are extended to both sides by longest common extensions (prefix fingerprints and
binary search; every accepted run is then compared word by word) and kept where the stretch is long enough.

One exact cut comes first: in a run of six words and four periods every three consecutive words occur
at least three times in the text. Only stretches made of such triples are grouped; no run crosses their
borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: Times that each triple of words of a run occurs in it: 4 q - 2 places for q periods, 4 places for one.
TRIPLES = 3
CHUNK_WORDS = 1 << 18
PRIME = (1 << 31) - 1
BASE = 1_000_003


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word starting at each place, by Baier's phase one.

    Suffixes start out grouped by their first number. Groups are taken from the greatest down. The context
    of the group at hand is its members' longest Lyndon prefix. Each member points to the nearest place
    before it that no group has taken yet; that place adds the context to its own, as many times as members
    point to it, and moves with its like into a new group just above the one it leaves."""
    n = len(word)
    before, after = list(range(-1, n)), list(range(1, n + 2))        # neighbours not yet taken
    letters = sorted(set(word))
    number = {c: g for g, c in enumerate(letters)}
    of = [number[c] for c in word]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(of):
        members[g].append(i)
    size = [1] * len(letters)                                         # length of each group's context
    lower, upper = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    upper[-1:] = [-1] * (len(letters) > 0)
    out = [0] * n
    g = len(letters) - 1
    while g >= 0:
        length, times = size[g], {}
        for i in members[g]:                                          # ascending
            if of[i] == g:
                out[i] = length
                a, b = before[i], after[i]
                after[a], before[b] = b, a
                if a >= 0:
                    times[a] = times.get(a, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for a, k in times.items():
            moved.setdefault((of[a], k), []).append(a)
        highest: dict[int, int] = {}
        for (own, k), places in sorted(moved.items()):                # more repetitions stand higher
            new, below = len(size), highest.get(own, own)
            size.append(size[own] + k * length)
            members.append(places)
            above = upper[below]
            lower.append(below)
            upper.append(above)
            upper[below] = highest[own] = new
            if above >= 0:
                lower[above] = new
            for a in places:
                of[a] = new
        g = lower[g]
    return out


def _fingerprints(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and prefix sums of the words' numbers times these, modulo the prime."""
    powers = np.ones(1, np.int64)
    while len(powers) <= len(word):
        powers = np.concatenate([powers, powers * pow(BASE, len(powers), PRIME) % PRIME])
    terms = (word + 1) * 7_919 % PRIME * powers[:len(word)] % PRIME
    return powers, np.concatenate([[0], np.cumsum(terms) % PRIME])


def _extensions(powers, sums, a, gap, most, step: int) -> np.ndarray:
    """Longest common extension from places ``a`` and ``a + gap``, at most ``most`` words, to the right
    (``step`` 1, from these places on) or to the left (-1, up to the places before them)."""
    got = np.zeros(len(a), np.int64)
    size = 1 << int(most.max()).bit_length() if len(most) else 0
    while size:
        try_ = np.minimum(got + size, most)
        lo, hi = (a, a + try_) if step > 0 else (a - try_, a)
        same = (sums[hi] - sums[lo]) % PRIME * powers[gap] % PRIME == (sums[hi + gap] - sums[lo + gap]) % PRIME
        got = np.where(same, try_, got)
        size >>= 1
    return got


def runs_of(word: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs in a sequence of numbers, by start, then period."""
    n = len(word)
    if n < LEAST_LENGTH:
        return []
    roots = np.concatenate([np.array(lyndon_array((s * word).tolist()), np.int64) for s in (1, -1)])
    at = np.tile(np.arange(n), 2)
    at, roots = np.unique(np.stack([at, roots])[:, at + roots < n], axis=1)
    powers, sums = _fingerprints(word)
    right = _extensions(powers, sums, at, roots, n - at - roots, 1)
    left = _extensions(powers, sums, at, roots, at, -1)
    length = left + right + roots
    long = length >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * roots)
    found = set()
    for i, s, size, q in zip(*(x[long].tolist() for x in (at, at - left, length, roots)), strict=True):
        if (s, size, q) in found:
            continue
        e = s + size
        if not np.array_equal(word[s:e - q], word[s + q:e]):
            # fingerprints of different stretches were equal: extend word by word
            differ = np.flatnonzero(word[:-q] != word[q:])
            k = np.searchsorted(differ, i)
            s = int(differ[k - 1]) + 1 if k else 0
            e = (int(differ[k]) if k < len(differ) else n - q) + q
            if k < len(differ) and differ[k] == i or e - s < max(LEAST_LENGTH, LEAST_PERIODS * q):
                continue
        found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(words: list, sizes: list[int]) -> list[tuple[int, int]]:
    """``(from, to)`` of the stretches of a chunk of texts whose triples of words all occur three times or
    more in their text. Hashes that collide only leave a stretch longer."""
    n = len(words)
    if n < LEAST_LENGTH:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    mix = np.uint64(0x9E3779B97F4A7C15)
    triple = ((h[:-2] * mix + h[1:-1]) * mix + h[2:]) * mix + text[:-2]
    _, where, counts = np.unique(triple, return_inverse=True, return_counts=True)
    live = np.zeros(n + 1, bool)
    live[:n - 2] = (counts[where] >= TRIPLES) & (text[:-2] == text[2:])
    edges = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0))
    return [(s, e + 2) for s, e in edges.reshape(-1, 2).tolist() if e + 2 - s >= LEAST_LENGTH]


def find_in_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    sizes = [len(t) for t in texts]
    words = [w for t in texts for w in t]
    ends = np.cumsum(sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e in _stretches(words, sizes):
        k = int(np.searchsorted(ends, s, side="right"))
        number: dict[bytes, int] = {}
        word = np.array([number.setdefault(w, len(number)) for w in words[s:e]], np.int64)
        first = s - int(ends[k]) + sizes[k]
        out[k] += [(first + a, size, q) for a, size, q in runs_of(word)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, size, q in runs:
            keep[s + q:s + size] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, runs, collapsed)``. ``runs`` is an array of ``(start, length,
    period)`` by start, then period, counted in words; ``collapsed`` the text's words without the repetitions.

    Words are stretches of anything but ASCII white space. Null, empty and blank texts have no run and
    an empty ``collapsed``. Overlapping runs of different periods are all reported. Repeated rows repeat; null
    ids stay null; other columns are ignored. A text is searched whole, in one task."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def search(batches):
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def result(ids, texts):
            found = find_in_texts(texts)
            return pa.RecordBatch.from_arrays([
                ids, pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], run),
                pa.array([collapse(t, f).decode("utf-8") for t, f in zip(texts, found, strict=True)], pa.string()),
            ], names=["id", "runs", "collapsed"])

        for b in batches:
            first, n, texts = 0, 0, []
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py().encode("utf-8").split())
                n += len(texts[-1])
                if n >= CHUNK_WORDS or i + 1 == b.num_rows:
                    yield result(b.column(0).slice(first, len(texts)), texts)
                    first, n, texts = i + 1, 0, []

    found = rows.mapInArrow(search, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` with the texts of every tenth id (by CRC-32 of the decimal id) made periodic from a
    word on that the hash chooses, with a period that it chooses."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    hit = docs.select(id_col, text_col, F.when(h % 10 == 0, words_of(F.col(text_col))).alias("__w"), g.alias("__g"))
    n = F.size("__w").cast("long")
    a = F.col("__g") % n
    p = F.lit(1) + F.floor((n - a) / (3 + F.col("__g") % 8)).cast("long")
    staged = hit.withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
    place = F.sequence(F.lit(0).cast("long"), n - 1)
    source = F.transform(place, lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")))
    text = F.array_join(F.transform(source, lambda i: F.get("__w", i.cast("int"))), " ")
    return staged.select(id_col, F.when(F.col("__a").isNotNull(), text).otherwise(F.col(text_col)).alias(text_col))


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``find_runs``: the number of runs, the run of the greatest exponent (ties: smallest
    start, then period), and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda s, r: F.when(
        s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"]), r).otherwise(s))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("__b"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        id_col, "n_runs", "__b.start", "__b.length", "__b.period",
        F.floor(F.lit(1000) * F.col("__b.length") / F.col("__b.period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
