import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bindscape.llm.tokens import counter, longest_within, prefix_table, token_summary, tokens_of_prefix
from tests.conftest import SMOKE

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encode():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def same_everywhere(text, encode, step=1):
    counts = counter().prefixes(text)
    assert len(counts) == len(text) + 1
    for i in [*range(0, len(text) + 1, step), len(text)]:
        assert counts[i] == encode(text[:i]), (text[:i], i)


def test_every_prefix(encode):
    rng = random.Random(5)
    parts = ["a", "e", " ", "  ", "\n", "\t", "'re", "'s", "'ll", "é", "日本", "\U0001f600", "1", "23", "!",
             "<|endoftext|>", "the", "Ing", " ", "　", "\x1c", "\x85", "_", "<|", "endoftext", "|>", "́", "'", "\r\n"]
    for _ in range(400):
        same_everywhere("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), encode)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert counter().prefixes(text)[-1] == len(t.encode(text, add_special_tokens=False).ids)


def test_long_texts(encode, monkeypatch):
    from bindscape.llm import tokens
    text = "a" * 3000 + " b" + " " * 500 + "x" + "ab" * 300 + "  \n" + "é" * 200 + "1" * 100 + "'re" + "!" * 90
    same_everywhere(text, encode, 61)
    monkeypatch.setattr(tokens, "PIECE", 50)
    same_everywhere("the quick  brown\n\nfox's tail " * 40, encode, 17)


def test_summary_and_table(spark, docs_of, odd_rows, encode):
    rows = token_summary(docs_of(odd_rows, extra=True), limit=3).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows] == [
        (i, len((t or "").encode()), encode(t or ""), encode(t or "") > 3) for i, t in odd_rows]
    for r, (_, t) in zip(rows, odd_rows, strict=True):
        assert r["kept_tokens"] <= 3 and r["kept_tokens"] == encode((t or "")[:r["kept_chars"]])
        if r["kept_chars"] < len(t or ""):
            assert encode(t[:r["kept_chars"] + 1]) > 3
    assert token_summary(docs_of([])).count() == 0
    from pyspark.sql import functions as F
    table = prefix_table(docs_of([(1, "hello wonderful world"), (2, None)]))
    got = {r["doc_id"]: r for r in table.select("doc_id", tokens_of_prefix(F.col("counts"), F.lit(7)).alias("t"),
                                               longest_within(F.col("counts"), F.lit(2)).alias("m")).collect()}
    assert got[1]["t"] == encode("hello w") and got[1]["m"] == 15 and (got[2]["t"], got[2]["m"]) == (0, 0)


def test_documents(spark, encode):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    want = {r["doc_id"]: encode(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_summary(docs).collect()} == want


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 1_000_000, "\u4e2d\u6587\u5b57" * 120_000, "ab1" * 3 + "Zq" * 500_000, "\n" * 300_000 + "x"],
                         ids=["letter", "blanks", "chinese", "base64", "feeds"])
def test_a_long_run_costs_as_much_as_its_length(text, encode):
    import time
    began = time.process_time()
    counts = counter().prefixes(text)
    assert time.process_time() - began < 10
    for n in (0, 1, 59, 60, 61, 62, 119, 1000, 9_999):
        assert counts[n] == encode(text[:n])
    assert counts[-1] == encode(text)
