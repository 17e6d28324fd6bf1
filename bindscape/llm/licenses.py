"""License scan: exact phrases, and an exact set-similarity join of text blocks with license notices.

A notice of ``m`` words is compared with blocks of its size class: windows of ``s`` words every ``s / 2``
words, ``s`` the least power of two with ``s >= 2 m`` (16 at least), so that a notice that stands in a
text lies whole in one of them, wherever its lines are broken. A block meets a notice if it has the threshold's share
of the notice's distinct words.

The join: words of the notices are ordered by their count over all texts, rarest first (other words can
meet none and are left out of the blocks). If a block shares ``k`` words with a notice of ``m``, the first
shared one is among the first ``m - k + 1`` words of the notice and the first ``n - k + 1`` of the block; these prefixes
are joined, under a length filter and a positional filter, and the pairs left are counted in full.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

# The phrases of the scan and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Sentences of public license notices.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
                 "with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

THRESHOLD = 0.9
LEAST_BLOCK = 16
#: Words of all notices together, at most: their prefixes are broadcast.
MAX_NOTICE_WORDS = 100_000

# other ASCII characters part words; other scripts' letters belong to them
_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters (UTF-8)."""
    return (text or "").encode("utf-8").translate(_FOLD).split()


def block_size(n_words: int) -> int:
    """Size class of a notice of so many words."""
    return max(LEAST_BLOCK, 1 << (2 * n_words - 1).bit_length())


def block_starts(n_words: int, size: int) -> range:
    """First words of the blocks of a text; the last block may be shorter."""
    return range(0, max(n_words - size // 2, 1), size // 2)


def least_common(n: int, threshold: float) -> int:
    """Words that a block shares with a notice of ``n`` distinct words to meet it."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _notices(notices, threshold: float) -> list[dict]:
    out = []
    for label, text in notices:
        words = words_of(text)
        if words:
            own = sorted(set(words))
            out.append({"label": label, "size": block_size(len(words)), "words": own, "least": least_common(len(own), threshold)})
    if sum(len(x["words"]) for x in out) > MAX_NOTICE_WORDS:
        raise ValueError(f"the notices have more than {MAX_NOTICE_WORDS} words")
    return out


def _ranks(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Number of each word of the notices, in the order of their counts over all texts, rarest first."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(filter(vocabulary.__contains__, words_of(t.as_py())))
        yield pa.record_batch({"word": pa.array([w.decode() for w in seen], pa.string()),
                               "n": pa.array(list(seen.values()), pa.int64())})

    counts = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "word string, n long")
    # one row per word of the notices at most
    total = {r["word"].encode(): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (total.get(w, 0), w)))}


def find_phrases(words: list[bytes], phrases: list[tuple[str, bytes]]) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place where a phrase's words stand consecutively."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for label, needle in phrases:
        at, word, last = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", last, at)
            last = at
            out.append((word, label))
            at = joined.find(needle, at + 1)
    return out


def find_blocks(words: list[bytes], rank: dict[bytes, int], classes: list[tuple[int, int]]) -> list[dict]:
    """Blocks ``{size, start, tokens}`` of a text that have enough words of the notices for one of their
    size (the length filter); ``tokens`` are the distinct ranks, ascending."""
    places = [(i, r) for i, r in enumerate(map(rank.get, words)) if r is not None]
    if len(places) < min((least for _, least in classes), default=1):
        return []
    out = []
    for size, least in classes:
        half, blocks = size // 2, {}
        last = block_starts(len(words), size)[-1]
        for i, r in places:
            first = i - i % half
            if first <= last:
                blocks.setdefault(first, set()).add(r)
            if first >= half:
                blocks.setdefault(first - half, set()).add(r)
        out += [{"size": size, "start": s, "tokens": sorted(b)} for s, b in blocks.items() if len(b) >= least]
    return out


SCANNED = ("id {id}, n_words long, places array<struct<word:bigint,label:string>>, "
           "blocks array<struct<size:int,start:bigint,tokens:array<int>>>")


def _scan(docs: DataFrame, id_col: str, text_col: str, phrases, notices, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(scanned, prefixes)``: each row with its number ``row``, phrases and blocks; and the prefix entries of the notices."""
    known = _notices(notices, threshold)
    rank = _ranks(docs, text_col, {w for x in known for w in x["words"]})
    classes = [(s, min(x["least"] for x in known if x["size"] == s)) for s in sorted({x["size"] for x in known})]
    needles = [(label, b" " + b" ".join(words_of(p)) + b" ") for label, p in phrases]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
             pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))]))]

    def read(batches):
        for b in batches:
            n_words, places, blocks = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                n_words.append(len(words))
                places.append([{"word": w, "label": k} for w, k in find_phrases(words, needles)])
                blocks.append(find_blocks(words, rank, classes))
            cols = [pa.array(c, k) for c, k in zip((n_words, places, blocks), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_words", "places", "blocks"])

    kind = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(read, SCANNED.format(id=kind)).withColumn("row", F.monotonically_increasing_id())
    entries = []
    for k, x in enumerate(known):
        tokens = sorted(rank[w] for w in x["words"])
        first = tokens[:len(tokens) - x["least"] + 1]
        entries += [(k, x["label"], x["size"], x["least"], len(tokens), p, t, tokens) for p, t in enumerate(first)]
    prefixes = docs.sparkSession.createDataFrame(
        entries, "notice int, label string, size int, least int, m int, place int, token int, whole array<int>")
    # of the rows, the numbers stay as they were written when a task is repeated
    return cut_lineage(scanned), prefixes


def _matches(scanned: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(row, label, notice, start, n_words, share)`` of every block that meets a notice."""
    loosest = prefixes.groupBy("size").agg(F.min("least").alias("loosest"))
    blocks = scanned.select("row", "n_words", F.explode("blocks").alias("b")).select("row", "n_words", "b.*")
    block = blocks.join(F.broadcast(loosest), "size").withColumn("n", F.size("tokens"))
    entry = block.select("row", "n_words", "size", "start", "n", "tokens",
                         F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - F.col("loosest") + 1)).alias("pos", "token"))
    # at most MAX_NOTICE_WORDS entries
    pair = entry.join(F.broadcast(prefixes), ["size", "token"]).where(
        (F.col("n") >= F.col("least"))
        & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("place")) >= F.col("least")))
    shared = F.array_intersect("tokens", "whole")
    # a pair is reported at its first shared word, so once
    return pair.withColumn("shared", shared).where(
        (F.size("shared") >= F.col("least")) & (F.col("shared")[0] == F.col("token"))).select(
        "row", "label", "notice", "start", F.least(F.col("size"), F.col("n_words") - F.col("start")).alias("n_words"),
        (F.size("shared") / F.col("m")).alias("share"))


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES,
                   notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that meets a notice: ``(id, label, notice, start, n_words, share)``, words from 0;
    ``notice`` is its number in the list. Edge cases as in ``license_labels``."""
    scanned, prefixes = _scan(docs, id_col, text_col, phrases, notices, threshold)
    return (_matches(scanned, prefixes).join(scanned.select("row", F.col("id").alias(id_col)), "row")
            .select(id_col, "label", "notice", "start", "n_words", "share"))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES,
                   notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` places hold a phrase's words, the first at ``first_word``, the last at ``last_word`` (null if
    none). ``base_labels`` are the phrases' labels, ``labels`` those and the labels of the notices that a block
    meets, each distinct, sorted and comma-joined (empty if none). ``score`` is 1 with a phrase, else the largest share of a notice's
    words in a block that meets it, else 0.

    Null and empty texts have no words and no label. Repeated rows repeat, null ids stay null, an empty table gives an empty
    result, other columns are ignored."""
    scanned, prefixes = _scan(docs, id_col, text_col, phrases, notices, threshold)
    found = _matches(scanned, prefixes).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = F.array_distinct("places.label")
    every = F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))
    return scanned.drop("blocks").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
