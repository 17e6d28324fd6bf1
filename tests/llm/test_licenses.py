import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bindscape.llm import licenses as L
from tests.conftest import SMOKE


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_blocks(words, notices=L.NOTICES, threshold=L.THRESHOLD):
    """Every block against every notice."""
    out = []
    for k, (label, text) in enumerate(notices):
        own, n = set(plain_words(text)), len(plain_words(text))
        size = 16
        while size < 2 * n:
            size *= 2
        start = 0
        while True:
            common = len(own & set(words[start:start + size]))
            if common / len(own) >= threshold - 1e-9:
                out.append((label, k, start, min(size, len(words) - start), common / len(own)))
            start += size // 2
            if start >= len(words) - size // 2:
                break
    return out


def plain(i, text, **how):
    words = plain_words(text)
    places = [(at, label) for label, p in L.PHRASES for at in range(len(words))
              if words[at:at + len(p.split())] == p.split()]
    base = {label for _, label in places}
    met = plain_blocks(words, **how)
    at = [a for a, _ in places]
    return (i, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {m[0] for m in met})), 1.0 if base else max((m[4] for m in met), default=0.0))


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aZ9 -\né日\u001f ", max_size=40))
def test_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in L.words_of(text)] == plain_words(text)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    found = got(L.license_labels(docs))
    assert found == sorted((plain(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert any(r[5] for r in found) and any(r[6] != r[5] for r in found) == any("GNU General" in r["text"] for r in docs.collect())


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.6, 0.3])
def test_blocks_of_damaged_notices(spark, docs_of, threshold):
    """Notices with lost and foreign words, at any place, broken over lines."""
    rng, rows = random.Random(int(threshold * 10)), []
    for i in range(150):
        _, text = rng.choice(L.NOTICES)
        words = [w for w in text.split() if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), "foreign")
        around = [rng.choice(["the", "of", "software", "license", "x", "y"]) for _ in range(rng.randrange(120))]
        cut = rng.randrange(len(around) + 1)
        rows.append((i, rng.choice([" ", "\n", " - "]).join(around[:cut] + words + around[cut:])))
    docs = docs_of(rows)
    want = sorted(((i, *b) for i, t in rows for b in plain_blocks(plain_words(t), threshold=threshold)), key=str)
    assert got(L.license_blocks(docs, threshold=threshold)) == want
    assert want or threshold == 1.0
    assert got(L.license_labels(docs, threshold=threshold)) == sorted((plain(*r, threshold=threshold) for r in rows), key=str)


def test_notice_at_any_place(docs_of):
    """A notice is found whole, wherever it starts."""
    for _, text in L.NOTICES[:4]:
        rows = [(i, "word " * i + text + " word" * 50) for i in range(0, 70, 3)]
        assert {r["score"] for r in L.license_labels(docs_of(rows)).collect()} == {1.0}


def test_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(9, "under the MIT license " * 300), (10, "CC-BY-NC cc by nc"), (11, "under the mit licenses")]
    out = got(L.license_labels(docs_of(rows, extra=True)))
    assert out == sorted((plain(*r) for r in rows), key=str)
    assert (10, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0) in out
    assert L.license_labels(docs_of([])).count() == 0 == L.license_blocks(docs_of([])).count()


def test_own_notices(docs_of):
    docs = docs_of([(1, "alpha beta gamma"), (2, "alpha beta")])
    out = L.license_blocks(docs, notices=(("x", "Alpha beta gamma"), ("none", "...")), phrases=(), threshold=0.6)
    assert got(out.select("doc_id", "label", "share")) == [(1, "x", 1.0), (2, "x", 2 / 3)]
    with pytest.raises(ValueError):
        L.license_labels(docs, notices=[("x", " ".join(map(str, range(200_000))))])
