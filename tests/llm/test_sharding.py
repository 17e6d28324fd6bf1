import itertools
import zlib
from collections import defaultdict

import pytest

from bindscape.llm.sharding import difference, number_slots, shard_documents
from tests.conftest import SMOKE


def loads(items, placed, shards):
    out = [0] * shards
    for item, w in items:
        out[placed[item]] += w
    return out


def test_textbook_two_way():
    items = list(enumerate([8, 7, 6, 5, 4]))
    assert sorted(loads(items, difference(items, 2), 2)) == [14, 16]


@pytest.mark.parametrize("weights,shards", [([9, 8, 7, 6, 5, 4, 3, 2, 1], 3), ([100, 1, 1, 1], 2), ([5, 5, 5, 5], 4)])
def test_against_all_partitions(weights, shards):
    items = list(enumerate(weights))
    got = loads(items, difference(items, shards), shards)
    best = min(max(loads(items, dict(enumerate(c)), shards)) - min(loads(items, dict(enumerate(c)), shards))
               for c in itertools.product(range(shards), repeat=len(weights)))
    assert sum(got) == sum(weights)
    assert max(got) - min(got) <= best + min(weights)


def test_naive_differencing_agrees():
    """The same merges, made by hand on lists of sets."""
    weights = [31, 29, 23, 19, 17, 13, 11, 7, 5, 3, 2]
    parts = [[(0, ())] * 2 + [(w, (i,))] for i, w in enumerate(weights)]
    parts = [(-(p[-1][0] - p[0][0]), i, p) for i, p in enumerate(parts)]
    new = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda x: x[:2])
        (_, _, a), (_, _, b) = parts[:2]
        m = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=lambda x: x[0])
        parts = parts[2:] + [(m[0][0] - m[-1][0], new, m)]
        new += 1
    placed = difference(list(enumerate(weights)), 3)
    assert sorted(loads(list(enumerate(weights)), placed, 3)) == sorted(p[0] for p in parts[0][2])


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((i if i is not None else -1), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["size"], r["text_crc32"]) for r in rows)
    assert got == want


def test_odd_rows(docs_of, odd_rows):
    check(shard_documents(docs_of(odd_rows, extra=True), 3).collect(), odd_rows, 3)
    assert shard_documents(docs_of([]), 3).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = shard_documents(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 40)
    load = defaultdict(int)
    for r in rows:
        load[r["shard"]] += r["size"]
    largest = max(r["size"] for r in rows)
    assert max(load.values()) <= max(largest * 1.1, 1.1 * sum(load.values()) / 40)


def test_repeated_rows_and_small_buckets(docs_of):
    texts = [(1, "same")] * 500 + [(i, f"t{i % 7}") for i in range(300)]
    from bindscape.llm.sharding import assign_shards
    rows = number_slots(assign_shards(docs_of(texts), 4, n_items=4), rows_per_bucket=20).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 800 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_stand_apart(docs_of):
    """100 documents of three copies each: few of the 200 copies are neighbours of another one."""
    from bindscape.llm.sharding import shard_documents
    rows = shard_documents(docs_of([(i // 3, f"text {i // 3} " * 9) for i in range(300)]), shards=2).collect()
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) < 15
