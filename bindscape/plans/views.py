"""Domain tables derived from the driver tables (deterministic views).

Each function takes ``(spark, sf_dir)`` and returns the view as a lazy
DataFrame, so every query built on it scans only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.functions.protein import AMINO_ACIDS
from bindscape.session import read_table

# The ten SMILES fragments of the benchmark input generator.
SMILES_FRAGMENTS = [
    "CCO", "CC(=O)O", "c1ccccc1", "CCN(CC)CC", "CC(C)O", "CCOCC", "CC(C)(C)O",
    "c1ccc(cc1)O", "CC(=O)N", "CCCCCCCCCCCCCCCCCC(=O)O",
]


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``protein_id long, protein string`` from ``documents``: letters only, upper
    case, invalid letters removed except on every fifth id, lower case on every
    seventh."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))
    # each letter is listed: Java looks a listed letter up in one table, many ranges one by one
    residues = F.upper(F.regexp_replace("text", f"[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]+", ""))
    q = F.when(F.col("doc_id") % 5 == 0, letters).otherwise(residues)
    return d.select(
        F.col("doc_id").alias("protein_id"),
        F.when(F.col("doc_id") % 7 == 0, F.lower(q)).otherwise(q).alias("protein"),
    )


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compound_id long, compound string`` from ``part``."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    frag = F.element_at(F.array(*[F.lit(s) for s in SMILES_FRAGMENTS]),
                        (F.col("p_partkey") % 10).cast("int") + 1)
    smiles = F.concat(
        frag,
        F.expr("repeat('C', cast(p_size % 4 as int))"),
        F.expr("repeat('N', cast(p_partkey % 3 as int))"),
        F.when(F.col("p_partkey") % 11 == 0, "Cl").when(F.col("p_partkey") % 11 == 1, "Br")
         .otherwise(""),
        F.when(F.col("p_partkey") % 13 == 0, "(").otherwise(""),
    )
    return p.select(F.col("p_partkey").alias("compound_id"), smiles.alias("compound"))


def compound_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given descriptors per compound (for the rule-based drug-likeness checks)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("compound_id"),
        F.col("p_retailprice").alias("molecular_weight"),
        (F.col("p_size") / F.lit(8.0)).alias("alogp"),
        (F.col("p_size") % 8).alias("hbd"),
        (F.col("p_size") % 14).alias("hba"),
        (F.col("p_partkey") % 5).cast("int").alias("max_phase"),
    )


def interactions_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction fact table keyed by ids (no string columns)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_partkey").alias("compound_id"),
        F.col("l_suppkey").alias("protein_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice"))
         .otherwise(F.col("l_quantity") / F.lit(5.0)).alias("affinity"),
        F.when(F.col("l_returnflag") == "R", "davis").when(F.col("l_returnflag") == "A", "kiba")
         .otherwise("bindingdb").alias("source_dataset"),
        F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("source_split"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction table with the compound and protein strings joined on.

    Both dimension joins are plain equi-joins: the planner broadcasts a side
    only when its measured size is under the broadcast threshold, otherwise it
    shuffles both sides on the id."""
    return with_strings(spark, sf_dir, interactions_ids(spark, sf_dir))


def with_strings(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """Rows with ``compound_id`` and ``protein_id`` and their strings, the sequences last."""
    return (ids.join(compounds(spark, sf_dir), "compound_id", "inner")
               .join(proteins(spark, sf_dir), "protein_id", "inner"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id long, y_true int, score double`` from ``labels``."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10) \
        .cast("double") / F.lit(4294967296.0)
    return lab.select(
        "doc_id",
        F.col("quality").alias("y_true"),
        F.round(F.lit(0.6) * u + F.lit(0.4) * F.col("quality") * u, 2).alias("score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-request log from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts",
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("event_type")).alias("cache_key"),
        F.col("value").alias("latency_ms"),
        (F.col("event_id") % 3).cast("int").alias("priority"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding array<double>, label``; elements cast to double."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    role = (F.when(F.col("c_custkey") % 4 == 0, "admin").when(F.col("c_custkey") % 4 == 1, "researcher")
             .when(F.col("c_custkey") % 4 == 2, "viewer").otherwise("guest"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
        (F.col("c_acctbal") > 0).alias("is_active"), role.alias("role"),
    )


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its members as ``array<struct<turn,user_id,role>>``.

    The member list of one workspace is one conversation's turns, so the
    collected array is bounded by the conversation length."""
    c = read_table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("description"),
        F.sort_array(F.collect_list(F.struct(
            "turn", ((F.col("conv_id") * 10 + F.col("turn")) % 97).alias("user_id"), "role")))
         .alias("members"),
    ).select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("name"),
        "description",
        (F.col("conv_id") % 3 == 0).alias("is_public"),
        "members",
    )
