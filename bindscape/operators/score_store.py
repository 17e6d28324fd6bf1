"""C10 with a kept score store: hits are read, distinct misses are scored once and kept.

The store is a folder of Parquet tables, one per run, with one row per (protein, compound) pair. A run
reads what other runs kept and writes its own part under its name, so a run that is repeated after a failure
writes the same part again, and the next run finds all pairs of the ones before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_scores(spark: SparkSession, store: str, keys: list[str], types: list[str], without: str | None = None) -> DataFrame:
    """``(keys, score)`` of all runs (but ``without``), one row per pair."""
    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, types, strict=True)) + ", score double"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/run=none")
    kept = spark.read.schema(schema + ", run string").parquet(store)
    if without is not None:
        kept = kept.where(F.col("run") != without)
    return kept.groupBy(*keys).agg(F.min("score").alias("score"))


def score_requests(requests: DataFrame, proteins: DataFrame, compounds: DataFrame, store: str, run: str, scorer,
                   protein_id: str = "protein_id", compound_id: str = "compound_id", protein: str = "protein",
                   compound: str = "compound") -> DataFrame:
    """``requests`` with ``score`` and ``cached`` (the pair was in the store before this run).

    Missing pairs are taken once each, scored from their sequences by the column expression ``scorer`` and written to the store's part ``run``. A scorer
    of descriptors (``of_protein``, ``of_compound`` and ``of``, as ``LinearAffinity``) gets them made once per row of the lists, so no sequence goes
    with the pairs; for others the strings meet only these pairs. Pairs with an id that a list does not have get a null score and are not kept. Requests with a null id likewise."""
    spark, keys = requests.sparkSession, [protein_id, compound_id]
    types = [requests.schema[k].dataType.simpleString() for k in keys]
    known = stored_scores(spark, store, keys, types, without=run)
    asked = requests.select(*keys).dropna().distinct()
    missing = asked.join(known, keys, "left_anti")
    described = all(hasattr(scorer, x) for x in ("of", "of_protein", "of_compound"))
    of_compound, of_protein = (scorer.of_compound, scorer.of_protein) if described else (F.col, F.col)
    c = compounds.select(compound_id, of_compound(compound).alias("_c"))
    p = proteins.select(protein_id, of_protein(protein).alias("_p"))
    score = scorer.of(F.col("_c"), F.col("_p")) if described else scorer(F.col("_p"), F.col("_c"))
    fresh = missing.join(c, compound_id).join(p, protein_id).select(*keys, score.alias("score"))
    fresh.write.mode("overwrite").parquet(f"{store}/run={run}")
    own = spark.read.schema(fresh.schema).parquet(f"{store}/run={run}")
    scores = known.withColumn("cached", F.lit(True)).unionByName(own.withColumn("cached", F.lit(False)))
    return requests.join(scores, keys, "left").select(*requests.columns, "score", F.coalesce("cached", F.lit(False)).alias("cached"))
