"""Sinks: partitioned split tables, tab-separated pair/label text, metadata
and metrics JSON. All writes go under a folder the caller names (on a cluster,
a shared folder - never a machine-local one)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "bindscape-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def write_splits(df: DataFrame, out: str, split: str = "split") -> dict:
    """One table per split: parquet (the fast binary copy) and CSV with
    header, both partitioned by the split column. Returns the two paths."""
    pq, csv = os.path.join(out, "parquet"), os.path.join(out, "csv")
    df.write.mode("overwrite").partitionBy(split).parquet(pq)
    df.write.mode("overwrite").partitionBy(split).option("header", True).csv(csv)
    return {"parquet": pq, "csv": csv}


def write_pairs_txt(df: DataFrame, out: str, split: str = "split") -> dict:
    """A10: ``protein<TAB>compound`` and ``pKd<TAB>binding_label`` lines per split."""
    seq, lab = os.path.join(out, "sequences"), os.path.join(out, "labels")
    (df.select(split, F.concat_ws("\t", "protein", "compound").alias("value"))
       .write.mode("overwrite").partitionBy(split).text(seq))
    (df.select(split, F.concat_ws("\t", F.col("pKd").cast("string"), F.col("binding_label").cast("string"))
               .alias("value"))
       .write.mode("overwrite").partitionBy(split).text(lab))
    return {"sequences": seq, "labels": lab}


def metadata_frame(df: DataFrame, split: str = "split", with_time: bool = True) -> DataFrame:
    """One-row JSON text: total samples, per-split counts, feature columns,
    creation time. Per-split counts are one aggregate (one row per split)."""
    per = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    meta = per.agg(
        F.sum("n").alias("total_samples"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(split), F.col("n"))))).alias("splits"))
    meta = meta.withColumn("features", F.array(*[F.lit(c) for c in df.columns]))
    if with_time:
        meta = meta.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return meta.select(F.to_json(F.struct(*meta.columns)).alias("value"))


def write_metadata(df: DataFrame, out: str, split: str = "split") -> str:
    path = os.path.join(out, "metadata")
    metadata_frame(df, split).coalesce(1).write.mode("overwrite").text(path)
    return path


def metrics_frame(metrics: DataFrame, drop_prefixes=("roc_curve", "pr_curve")) -> DataFrame:
    """A metrics row as JSON text without curve columns (the confusion counts stay)."""
    keep = [c for c in metrics.columns if not any(c.startswith(p) for p in drop_prefixes)]
    return metrics.select(F.to_json(F.struct(*keep)).alias("value"))


def write_metrics(metrics: DataFrame, out: str) -> str:
    path = os.path.join(out, "metrics")
    metrics_frame(metrics).write.mode("overwrite").text(path)
    return path
