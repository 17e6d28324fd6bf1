import re
from collections import Counter

import numpy as np
import xxhash

from bindscape.llm.components import connected_components, spanning_links
from bindscape.llm.simhash import close_pairs, codeword_offsets, fingerprint_bits, keep_one, near_duplicates
from tests.conftest import SMOKE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids, label = sorted(fps), {}
    for i in ids:
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in label and (fps[x] ^ fps[y]).bit_count() <= 4:
                    label[y] = i
                    todo.append(y)
    return label


def test_fingerprints(odd_rows):
    texts = [t for _, t in odd_rows] + ["A b C d", "a\x0bb\x0cc d E", "Ä É UPPER lower x y z"]
    assert [fingerprint_bits(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_codewords_cover():
    words = {s: set(m) for t, s, m in codeword_offsets() if t == 2}
    assert len(words[0]) == 156 and all(len(w) == 156 for w in words.values())
    for w in words[0]:
        s = 0
        for i in range(31):
            if w >> i & 1:
                s ^= i + 1
        assert s == 0


def test_pairs_are_exact(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [base]
    for k in range(1, 7):
        x = base.copy()
        for i in range(len(x)):
            for b in rng.choice(64, k, replace=False):
                x[i] ^= np.uint64(1) << np.uint64(b)
        near.append(x)
    # a dense ball around one value
    ball = np.array([int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (200, 2))], np.uint64)
    u = np.unique(np.concatenate([*near, ball, np.array([0, 2**64 - 1], np.uint64)]))
    signed = u.view(np.int64)
    close = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    want = {(min(int(signed[i]), int(signed[j])), max(int(signed[i]), int(signed[j])))
            for i, j in zip(*np.where(close), strict=True) if i != j}
    got = [(r["a"], r["b"]) for r in close_pairs(spark.createDataFrame([(int(x),) for x in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 150)]
    e = spark.createDataFrame(chain, "src long, dst long")
    for links in (e, spanning_links(e, "src", "dst")):
        got = {r["node"]: r["root"] for r in connected_components(links).collect()}
        assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 150: 150, 200: 150}
    assert connected_components(e.limit(0)).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    label = plain_components(fps)
    rows = near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        i: (f"{fps[i]:016x}", label[i]) for i in texts}
    assert sorted(r["doc_id"] for r in keep_one(docs).collect()) == sorted(set(label.values()))


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows)
    got = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)} <= got
    assert {c for i, c in got if i is None} == {1, 4}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 6, 7, 8]
    assert near_duplicates(docs_of([])).count() == 0 and keep_one(docs_of([])).count() == 0


def test_one_large_component(docs_of):
    """Half of the rows in one component of many fingerprints, a third in one fingerprint."""
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(base[:200 + i % 3] + [f"x{i % 60}"] + base[200 + i % 3:])) for i in range(150)]
    rows += [(i, "") for i in range(150, 250)] + [(i, f"other text number {i} " * (i % 7 + 1)) for i in range(250, 300)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows)).collect()}
    want = plain_components({i: plain_fingerprint(t) for i, t in rows})
    assert got == want and max(Counter(got.values()).values()) >= 100
