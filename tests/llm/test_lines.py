import random
from collections import defaultdict

import pytest

from bindscape.llm import lines as L
from bindscape.llm.lines import dedup_lines
from tests.conftest import SMOKE


def brute(rows, t=0.8):
    """Line numbers to remove per document, comparing every line with every earlier one."""
    lines, gone = [], defaultdict(list)
    for d, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            words = set(line.lower().split())
            if not words:
                continue
            if any(len(words & w) >= t * len(words | w) - 1e-9 for w in lines):
                gone[d].append(i)
            lines.append(words)
    return dict(gone)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert {i: r["__removed"] for i, r in got.items() if r["__removed"]} == want
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())]
        assert got[i]["text"] == "\n".join(kept) and got[i]["__lines"] == len(t.split("\n"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_lines(spark, docs_of, seed):
    import random
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    base = [rng.sample(vocab, rng.randint(1, 12)) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(base))
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = rng.choice(vocab)
            lines.append(rng.choice([" ", "  ", "\t"]).join(x).upper() if rng.random() < 0.3 else " ".join(x))
        rows.append((d, "\n".join(lines)))
    got = {r["doc_id"]: r["__removed"] for r in dedup_lines(docs_of(rows)).collect() if r["__removed"]}
    assert got == brute(rows)


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows, extra=True)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "__lines", "__removed"]
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [(r["text"], r["__lines"]) for r in by[1]] == [(None, 0)] and by[2][0]["text"] == "" and by[2][0]["__lines"] == 1
    # the row without an id comes first; later copies go
    assert {r["text"] for r in by[None]} == {None, "one two three four five six"}
    assert [r["text"] for r in by[4] + by[5]] == ["", "", ""]
    assert by[7][0]["__removed"] == [3] and by[3][0]["__removed"] == []
    assert dedup_lines(docs_of([])).count() == 0


def test_native_plan(spark, docs_of):
    plan = dedup_lines(docs_of([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_long_lines_that_share_some_words_are_no_candidates(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.sample(words, 100)) for _ in range(60)]
    texts.append(texts[7].replace(texts[7].split()[50], "other"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    wide = L._wide(docs, "doc_id", "text", L.rarity(docs), 0.8).where("code is not null")
    assert L.similar_sets(wide.drop("id", "dh", "th", "line_no"), 0.8).count() == 1
    assert [(r.doc_id, r["__removed"]) for r in L.dedup_lines(docs).where("size(__removed) > 0").collect()] == [(60, [0])]


def test_near_copies_of_one_line_make_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(40)]
    rows = []
    for d in range(300):
        x = list(words)
        x[rng.randrange(40)] = f"new{d % 150}"
        rows.append((d, " ".join(x)))
    made, whole = [], L.similar_sets

    def counted(*args):
        pairs = whole(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(L, "similar_sets", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["__removed"] for r in dedup_lines(docs).collect() if r["__removed"]} == brute(rows)
    assert sum(made) <= 3 * len(rows)
