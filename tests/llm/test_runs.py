import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bindscape.llm import runs as R
from tests.conftest import SMOKE


def plain_lyndon(w):
    """Longest Lyndon prefix of each suffix, from the definition of the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def plain_runs(w):
    """All maximal stretches of each period, smallest period first; those with a smaller one are left out."""
    n, found, seen = len(w), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and (i, j + q) not in seen and j + q - i >= max(6, 4 * q):
                seen.add((i, j + q))
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


words = st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60))
periodic = st.tuples(words, st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 12), words).map(
    lambda x: x[0] + x[1] * x[2] + x[3])


@settings(max_examples=300, deadline=None)
@given(words | periodic)
def test_lyndon_array(w):
    assert R.lyndon_array(w) == plain_lyndon(w)
    assert R.lyndon_array([-x for x in w]) == plain_lyndon([-x for x in w])


@settings(max_examples=300, deadline=None)
@given(words | periodic)
def test_runs(w):
    assert R.runs_of(np.array(w, np.int64)) == plain_runs(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(words | periodic, max_size=5))
def test_texts_of_a_chunk(texts):
    texts = [[b"w%d" % x for x in t] for t in texts]
    assert R.find_in_texts(texts) == [plain_runs(t) for t in texts]


def test_colliding_fingerprints(monkeypatch):
    monkeypatch.setattr(R, "PRIME", 5)
    monkeypatch.setattr(R, "BASE", 2)
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(rng.randrange(50))]
        assert R.runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_long_sequences():
    fib = [0], [0, 1]
    while len(fib[1]) < 5000:
        fib = fib[1], fib[1] + fib[0]
    assert R.runs_of(np.array(fib[1][:2000])) == plain_runs(fib[1][:2000])
    same = np.zeros(300_000, np.int64)
    assert R.runs_of(same) == [(0, 300_000, 1)]
    assert R.runs_of(np.arange(200_000) % 1000) == [(0, 200_000, 1000)]


def plain(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def report(docs):
    return sorted(map(tuple, R.run_report(R.find_runs(R.plant_periods(docs))).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000]
    short = docs.where("length(text) < 20000 or text is null")
    assert report(short) == sorted((plain(*r) for r in rows), key=str)


def test_odd_rows(docs_of, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000] + [
        (i, " ".join(f"w{k % 37}" for k in range(i * 13 % 90)) + "\n" + "ab " * (i % 11), "s") for i in range(100, 260)]
    docs = docs_of(rows, extra=True)
    assert report(docs) == sorted((plain(r[0], r[1]) for r in rows), key=str)
    assert report(docs_of([])) == []


def test_very_long_text(docs_of):
    text = " ".join(["x"] + ["a", "b", "c"] * 100_000 + ["y"])
    found = R.find_runs(docs_of([(1, text)])).first()
    assert [tuple(r) for r in found["runs"]] == [(1, 300_000, 3)]
    assert found["collapsed"] == "x a b c y"


def test_white_space_of_other_scripts(docs_of):
    row = R.find_runs(docs_of([(1, " a " * 8 + "\x1fb b")])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 1)] and row["collapsed"] == " a \x1fb b"


@pytest.mark.parametrize("kind", ["string", "long"])
def test_kinds_of_ids(spark, kind):
    df = spark.createDataFrame([("7", "z " * 6)], "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    row = R.find_runs(df).first()
    assert str(row["doc_id"]) == "7" and [tuple(r) for r in row["runs"]] == [(0, 6, 1)]
