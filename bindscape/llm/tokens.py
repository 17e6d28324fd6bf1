"""Exact token counts of every prefix of a text, by dynamic programming.

For one pre-token the last token of the encoding of prefix ``p[:i]`` is the one
token ``t`` that ends there and may follow the last token of ``p[:i - len(t)]``;
two tokens may follow each other if their joined bytes encode to just those
two. So ``count[i] = count[i - len(t)] + 1``: one pass gives the count of every
prefix without encoding it. Pre-tokens are remembered per worker, and a
document's table is their counts plus a running base. Where a cut changes the
split itself (inside a white-space run, a contraction or a special token) the
count is that of the text as cut.

The table answers truncation and budget questions: ``counts[n]`` is the number
of tokens of the first ``n`` characters, and the longest prefix within a budget
is the last ``n`` with ``counts[n] <= budget``. The cost is linear in the text.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Pre-tokens remembered per generation and worker; those of over LONG characters never are.
REMEMBERED = 500_000
LONG = 60
PIECE = 1 << 20

# Fixed values of the tokenizer's format: its split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Latin-1 letters and numbers, for the same pattern with plain classes (a much faster scan).
LATIN, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT_LATIN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LATIN}{NUMBERS}]+"
               rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
START = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Prefix counts for one byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix")):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        if max(self.tokens) >= START:
            raise ValueError("a vocabulary of at most 65,536 tokens is needed")
        #: lengths of the tokens that end in two letters, the longest first
        self.lengths: dict[str, list[int]] = {}
        for t in self.vocab:
            if len(t) > 1:
                self.lengths.setdefault(t[-2:], []).append(len(t))
        self.lengths = {e: [*sorted(set(n), reverse=True), 1] for e, n in self.lengths.items()}
        special = [a["content"] for a in spec.get("added_tokens", [])]
        if any(a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip their surroundings aren't supported")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
                                     ) if special else None
        self.split = regex.compile(SPLIT)
        self.split_latin = re.compile(SPLIT_LATIN)
        self.run = regex.compile(r"\s\s")
        self.gap = regex.compile(r"(?<=\S) (?=\S)")
        self.letters = dict(enumerate(byte_letters()))
        self.follows: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        self.back: dict[str, array.array] = {}
        self.old_seen: dict[str, bytes] = {}
        self.old_back: dict[str, array.array] = {}

    def merge(self, s: str) -> list[str]:
        """Plain BPE of a short string: the lowest-ranked pair first, leftmost first."""
        parts, rank = list(s), self.rank.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, token: int) -> bool:
        """Whether a token can be the last one after the token ``before`` (START: the first)."""
        t = self.tokens[token]
        if before == START:
            ok = len(self.merge(t)) == 1
        else:
            b = self.tokens[before]
            ok = self.merge(b + t) == [b, t]
        if len(self.follows) >= 2 * REMEMBERED:
            self.follows.clear()
        self.follows[before << 17 | token] = ok
        return ok

    def _solve(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """Bytes, and per byte prefix the count and the last token. Goes on from the longest
        beginning of the pre-token that is remembered."""
        data = text.encode("utf-8")
        letters = data.decode("latin-1").translate(self.letters)
        vocab, follows, n = self.vocab.get, self.follows.get, len(letters)
        count, last = [0], [START]
        back, old = self.back.get, self.old_back.get
        for k in range(min(len(text) - 1, LONG), 0, -1):          # longer ones are never kept
            start = text[:k]
            known = back(start) or old(start)
            if known is not None:
                m = len(known) // 2
                last.extend(known[:m])
                count.extend(known[m:])
                break
        lengths, one = self.lengths.get, [1]
        for i in range(len(count), n + 1):
            for size in lengths(letters[i - 2:i], one) if i > 1 else one:
                j = i - size
                token = vocab(letters[j:i]) if j >= 0 else None
                if token is not None:
                    ok = follows(last[j] << 17 | token)
                    if ok or (ok is None and self.may_follow(last[j], token)):
                        count.append(count[j] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {i} of {text!r}")
        return data, count, last

    def pre_token(self, text: str) -> bytes:
        """Counts (uint8, or int32 for one of over ``LONG`` characters) of the prefixes of one
        pre-token that end at its characters."""
        found = self.old_seen.get(text)
        if found is not None:
            self.seen[text], self.back[text] = found, self.old_back[text]
            return found
        data, count, last = self._solve(text)
        n = len(data)
        if n == len(text):
            ends = count[1:]
        else:
            ends = [count[i] for i in range(1, n + 1) if i == n or (data[i] & 0xC0) != 0x80]
        if len(text) > LONG:
            return array.array("i", ends).tobytes()
        if len(self.seen) >= REMEMBERED:
            # the last two generations are remembered, so frequent words stay
            self.old_seen, self.old_back, self.seen, self.back = self.seen, self.back, {}, {}
        self.back[text] = array.array("H", last[1:] + count[1:])
        found = self.seen[text] = bytes(ends)
        return found

    def _segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes 1..n of a text without special tokens."""
        try:
            text.encode("latin-1")
            parts = self.split_latin.findall(text)
        except UnicodeEncodeError:
            parts = self.split.findall(text)
        known, learn = self.seen.get, self.pre_token
        got = [known(p) or learn(p) for p in parts]
        if len(text) > LONG and max(map(len, parts)) > LONG:
            local = np.concatenate([np.frombuffer(g, np.int32 if len(p) > LONG else np.uint8).astype(np.int64)
                                    for p, g in zip(parts, got, strict=True)])
        else:
            local = np.frombuffer(b"".join(got), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        totals = local[ends - 1].astype(np.int64)
        base = np.cumsum(totals) - totals
        counts = local + np.repeat(base, sizes)
        if "'" in text or self.run.search(text):
            starts = ends - sizes
            for k, p in enumerate(parts):
                if p in ("'re", "'ve", "'ll"):
                    counts[starts[k] + 1] = base[k] + 2          # a cut contraction is a quote and a letter
                elif k + 1 < len(parts) and parts[k + 1][0].isspace() and p.isspace():
                    # a run of white space is one pre-token when the text ends with it
                    counts[starts[k + 1]] = base[k] + self._solve(p + parts[k + 1][0])[1][-1]
        return counts

    def _ordinary(self, text: str) -> np.ndarray:
        if len(text) <= PIECE:
            return self._segment(text)
        # very long texts go in pieces, cut where a pre-token always starts
        out, start, base = [], 0, 0
        while start < len(text):
            m = self.gap.search(text, start + PIECE)
            end = m.start() if m else len(text)
            out.append(self._segment(text[start:end]) + base)
            base, start = int(out[-1][-1]), end
        return np.concatenate(out)

    def prefixes(self, text: str | None) -> np.ndarray:
        """``counts[n]``: tokens of the first ``n`` characters, n from 0 to the length."""
        if not text:
            return np.zeros(1, np.int64)
        out, start, base = [np.zeros(1, np.int64)], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > start:
                out.append(self._ordinary(text[start:m.start()]) + base)
            # a cut special token is ordinary text that goes on from the last pre-tokens
            part = text[start:m.end() - 1]
            cut = self._ordinary(part)[m.start() - start:] + base
            base = (int(out[-1][-1]) if m.start() > start else base) + 1
            out.append(np.append(cut, base))
            start = m.end()
        if start < len(text):
            out.append(self._ordinary(text[start:]) + base)
        return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def counter(tokenizer: str = TOKENIZER) -> PrefixCounter:
    """The counter of a vocabulary file: a path, or a name of the public tokenizers."""
    if not os.path.exists(tokenizer):
        import public_tokenizers
        tokenizer = public_tokenizers.path(tokenizer)
    return PrefixCounter(tokenizer)


def prefix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, counts)``: the stored table, ``counts[n]`` (from 0) being the tokens of the
    first ``n`` characters. Null and empty texts have ``[0]``; repeated rows repeat."""

    @F.arrow_udf("array<int>")
    def table(texts: pa.Array) -> pa.Array:
        c = counter(tokenizer)
        return pa.array([c.prefixes(t.as_py()).astype(np.int32) for t in texts], pa.list_(pa.int32()))

    return docs.select(F.col(id_col), table(F.col(text_col)).alias("counts"))


def tokens_of_prefix(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters (the whole text if it is shorter)."""
    return F.get(counts, F.least(F.greatest(n_chars.cast("int"), F.lit(0)), F.size(counts) - 1))


def longest_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits)


def token_summary(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                  tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, kept_chars, kept_tokens)`` per row, read off the prefix
    table without storing it: the count of the whole text, and the longest prefix
    of at most ``limit`` tokens. A null text is empty (0 bytes, 0 tokens); repeated
    rows repeat; other columns are ignored."""

    @F.arrow_udf("struct<n_tokens:bigint,kept_chars:bigint,kept_tokens:bigint>")
    def summary(texts: pa.Array) -> pa.Array:
        c = counter(tokenizer)
        rows = []
        for t in texts:
            counts = c.prefixes(t.as_py())
            n = len(counts) - 1
            kept = n if counts[n] <= limit else int(np.flatnonzero(counts <= limit)[-1])
            rows.append((int(counts[n]), kept, int(counts[kept])))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in cols],
                                          ["n_tokens", "kept_chars", "kept_tokens"])

    got = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
                      .cast("long").alias("n_bytes"), summary(F.col(text_col)).alias("s"))
    return got.select(F.col("id").alias(id_col), "n_bytes", "s.n_tokens",
                      (F.col("s.n_tokens") > limit).alias("over_limit"), "s.kept_chars", "s.kept_tokens")
