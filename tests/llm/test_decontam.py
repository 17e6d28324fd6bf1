import random

import pyarrow as pa
from pyspark.sql import functions as F

from bindscape.llm import decontam
from bindscape.llm.decontam import Matcher, budget, drop_leaks, find_leaks, letter_masks, myers_best, normalise, pieces
from bindscape.session import shared_dir
from tests.conftest import SMOKE


def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_myers_against_the_edit_matrix():
    rng = random.Random(1)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        k = rng.randint(0, len(p) - 1)
        assert myers_best(letter_masks(p), len(p), t, k)[0] == min(substring_distance(p, t), k + 1)


def test_pieces():
    for n in (1, 5, 81, 394):
        cut = pieces("x" * n, 0.1)
        assert len(cut) == budget(n, 0.1) + 1 and sum(len(p) for _, p in cut) == n and all(p for _, p in cut)


def test_matches_against_brute_force():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    for _ in range(300):
        items = tuple((i, word(rng.randint(1, 60))) for i in range(4))
        x = list(items[0][1])
        for _ in range(rng.randint(0, 9)):
            j = rng.randrange(len(x) + 1)
            x[j:j + rng.randint(0, 1)] = rng.choice(["a", "", "ff"])
        t = word(rng.randint(0, 40)) + "".join(x) + word(rng.randint(0, 40))
        for rate in (0.1, 0.25):
            want = [(i, d) for i, p in items if (d := substring_distance(p, t)) <= budget(len(p), rate)]
            assert [(i, d) for i, d, _ in Matcher(items, rate).matches(t)] == want


def test_documents(spark):
    docs, bench = (spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], normalise(r["text"])) for r in bench.collect()]
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in find_leaks(docs, bench).collect()}
    for r in docs.collect():
        exact = [i for i, p in items if p in normalise(r["text"])]
        assert set(exact) <= set(got[r["doc_id"]])
    assert sum(map(bool, got.values())) >= 1
    some = sorted(got)[:25]
    texts = {r["doc_id"]: normalise(r["text"])[:4000] for r in docs.collect() if r["doc_id"] in some}
    short = find_leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench)
    for r in short.collect():
        want = [i for i, p in items[:8] if substring_distance(p, texts[r["doc_id"]]) <= budget(len(p))]
        assert [x["item_id"] for x in r["leaks"] if x["item_id"] in dict(items[:8])] == want


def test_odd_rows_and_blocks(spark, docs_of, odd_rows):
    rows = [*odd_rows, (20, "before THE quick  brown fox\njumps ovr the lazy dog after")]
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "one two"), (3, "  "), (4, "one two three four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows, extra=True)
    a, b = (sorted(((r["doc_id"] or 0), [tuple(x) for x in r["leaks"]]) for r in
                   find_leaks(docs, bench, block_chars=c).collect()) for c in (1, 1 << 20))
    assert a == b and len(a) == len(rows)
    hit = {i: [x[0] for x in m] for i, m in a if m}
    assert hit[20] == [1] and hit[4] == [4] and set(hit) == {0, 4, 5, 20}
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert drop_leaks(docs_of([]), bench).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_five_blocks(spark, docs_of):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, word(rng.randint(20, 60))) for i in range(40)] + [(7, word(30)), (8, "")]
    texts = [word(30) + " ".join(t for _, t in rng.sample(items, rng.randint(0, 3))) + word(30) for _ in range(60)]
    rows = [(i, texts[0] if i % 2 else texts[i]) for i in range(60)] + [(None, texts[0]), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(rows, extra=True).withColumn("leaks", F.lit("old")).withColumn("kinds", F.create_map(F.lit(1), F.lit(2)))
    chars = sum(len(t) for _, t in items) // 5 + 1
    folder = f"{shared_dir(spark)}/blocks-{rng.random()}"
    blocks = decontam.write_blocks(bench, folder, block_chars=chars)
    assert len(blocks) == 5
    whole = Matcher(tuple(sorted((i, normalise(t)) for i, t in items if t)), 0.1)
    for limit in (chars, 1 << 20):
        got = find_leaks(docs, bench, block_chars=limit).collect()
        assert sorted(((r["doc_id"] or 0, r["text"] or "", [tuple(x) for x in r["leaks"]]) for r in got)) == sorted(
            (i or 0, t or "", whole.matches(t)) for i, t in rows)
    kept = drop_leaks(docs, bench, block_chars=chars)
    assert kept.columns == docs.columns and {r["leaks"] for r in kept.collect()} == {"old"}
    assert kept.count() == sum(not whole.matches(t) for _, t in rows)


def test_a_task_builds_its_automaton_once_and_plans_hold_no_item(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"benchmark passage of number {i * 7919}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x benchmark passage of number {i * 7919} y") for i in range(30)], "doc_id long, text string")
    folder = f"{shared_dir(spark)}/blocks-{random.random()}"
    blocks = decontam.write_blocks(bench, folder, block_chars=150)
    built = []
    monkeypatch.setattr(decontam, "Matcher", lambda items, rate: built.append(len(items)) or Matcher(items, rate))
    batch = pa.record_batch({"h": [str(i) for i in range(30)],
                             "text": [f"x benchmark passage of number {i * 7919} y" for i in range(30)]})
    hits = sum(b.num_rows for k in blocks for b in decontam.scan_block(f"{folder}/blocks", k, 0.1)([batch] * 4))
    assert len(blocks) >= 4 and len(built) == len(blocks) and sum(built) == 20 and hits >= 4 * 20
    for limit in (150, 1 << 20):
        plan = find_leaks(docs, bench, block_chars=limit)._jdf.queryExecution().toString()
        assert "number 7919" not in plan
