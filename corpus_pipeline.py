"""Corpus pipeline: documents -> toxicity -> near duplicates -> benchmark leaks -> source mix -> shards.

Every stage reads what its predecessor wrote as Parquet; its decisions take effect in
the rows it returns. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from bindscape.llm.decontam import drop_leaks
from bindscape.llm.mixing import mix_sources
from bindscape.llm.sharding import shard_documents
from bindscape.llm.simhash import keep_one
from bindscape.llm.toxicity import fit, reject_toxic
from bindscape.session import read_table, shared_dir


def toxicity(spark, docs, sf_dir):
    """Rows predicted toxic go."""
    return reject_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark, docs, sf_dir):
    """One row of each SimHash group stays, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Rows that hold a benchmark item within its error budget go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Rows are repeated by their source's rate and globally shuffled."""
    return mix_sources(docs).drop("__copy", "__order")


def sharding(spark, docs, sf_dir):
    """Every row gets its shard and its slot in it; equal texts share a shard."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: SQL has no Aho-Corasick lexicon, SimHash or edit matching: tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``; each stage is written to the shared folder first."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
