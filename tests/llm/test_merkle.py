import hashlib
import zlib

import pytest

from bindscape.llm import merkle as M
from tests.conftest import SMOKE


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text=None):
    out = ""
    for f in M.FIELDS:
        v = row[f] if f != "text" or text is None else text
        v = None if v is None else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return H(out)


def tree(nodes):
    """All levels of a tree, and per leaf the siblings left and right of its way."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[i - i % 3:i - i % 3 + 3]
            path.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    groups = {}
    for r in rows:
        claim = leaf(r)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
            claim = leaf(r, r["text"].replace("\n", ""))
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (known, i, own, claim), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            node = claim
            for a, b in path + top:
                node = H(a + node + b)
            out.append((i if known else None, own, trees[s][0], root, H("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


def got(docs, depth=M.DEPTH):
    return sorted(map(tuple, M.manifest(docs, claim=M.without_line_feeds(), depth=depth).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    found = got(docs)
    assert found == plain(docs.collect())
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28, 83])
def test_sizes_with_small_blocks(docs_of, n):
    """Several stages of superblocks; a last run of one; a source with most of the rows."""
    rows = [(i, f"a\nb {i}", None if i % 7 == 0 else "é" if i % 7 == 1 else f"s{i}" if i % 11 == 2 else "hot") for i in range(n)]
    docs = docs_of(rows)
    assert got(docs, depth=1) == plain(docs.collect())


def test_block_borders(docs_of):
    for n in (3 ** M.DEPTH, 3 ** M.DEPTH + 1):
        docs = docs_of([(i, f"t{i}\n", "hot") for i in range(n)])
        assert got(docs) == plain(docs.collect())


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    assert got(docs) == plain(docs.collect())
    assert got(docs_of(odd_rows[:1])) == plain(docs_of(odd_rows[:1]).collect())


def test_own_claims_verify(docs_of, odd_rows):
    assert {r["verified"] for r in M.manifest(docs_of(odd_rows)).collect()} == {True}
    assert M.manifest(docs_of([])).count() == 0


def test_other_fields(spark):
    df = spark.createDataFrame([("x", 1, "k"), ("y", 2, "k"), (None, 3, None)], "name string, n int, g string")
    out = M.manifest(df, fields=("name", "n"), id_col="name", group_col="g").collect()
    assert {r["name"]: r["leaf"] for r in out} == {"x": H("1:x1:1"), "y": H("1:y1:2"), None: H("-1:3")}
    assert out[0]["name"] is None or isinstance(out[0]["name"], str)
