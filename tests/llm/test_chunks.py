import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bindscape.llm import chunks as C
from tests.conftest import SMOKE


def plain_ends(data):
    """The same boundaries, one byte at a time."""
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        bits = C.STRICT_BITS if size <= C.NORMAL else C.LOOSE_BITS
        if i + 1 < len(data) and size >= C.LEAST and (h >> (32 - bits) == 0 or size >= C.LARGEST):
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] * bool(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32 - 1), st.integers(1, 256))
def test_boundaries(n, seed, letters):
    data = np.random.default_rng(seed).integers(0, letters, n).astype(np.uint8).tobytes()
    assert C.chunk_ends(data) == plain_ends(data)


def test_pieces_of_a_long_text(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 20_000).astype(np.uint8).tobytes()
    want = C.chunk_ends(data)
    monkeypatch.setattr(C, "PIECE", 1000)
    assert C.chunk_ends(data) == want


def test_shift_resistance_and_containment():
    rng = np.random.default_rng(4)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 5000))
    own = C.chunk_set(text)
    assert C.containment(own, C.chunk_set("inserted " + text)) > 0.95
    assert 0.4 < C.containment(own, C.chunk_set(text[:2500])) < 0.6
    assert C.containment({}, {}) == 1.0 and C.containment({}, own) == 0.0 == C.containment(own, {})


def key(i):
    return float("-inf") if i is None else i


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-key(r[0]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = C.edited(t, n)
        half = len(t) // 2
        assert e == t[:len(t) - half] + n[:half]
        out.append((key(i), len(t), hashlib.sha256(e.encode()).hexdigest(), C.set_digest(C.chunk_set(t)),
                    C.set_digest(C.chunk_set(e)), C.containment(C.chunk_set(t), C.chunk_set(e)),
                    C.containment(C.chunk_set(t), C.chunk_set(n))))
    return sorted(out)


def got(df):
    return sorted((key(r[0]), *r[1:]) for r in df.collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    assert got(C.fingerprint_neighbours(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(docs_of, odd_rows):
    assert got(C.fingerprint_neighbours(docs_of(odd_rows, extra=True))) == brute(odd_rows)
    assert got(C.fingerprint_neighbours(docs_of(odd_rows[4:5]))) == brute(odd_rows[4:5])
    assert C.fingerprint_neighbours(docs_of([])).count() == 0
    table = C.chunk_table(docs_of(odd_rows)).collect()
    assert sum(r["length"] for r in table) == sum(len((t or "").encode()) for _, t in odd_rows)
