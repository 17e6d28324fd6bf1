"""Frame, rank and ordering operators over request logs and score tables.

Ordered running computations over one long sequence (the whole request log,
or one very large group) are cut into chunks of consecutive rows: each chunk
receives the ``width - 1`` rows before it as a flagged overlap, the frame is
evaluated per (group, chunk), and only unflagged rows are kept. Row numbers
come from range-partitioned ranking, so no step moves a whole sequence into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindscape.operators.ranking import partition_rank

CHUNK_ROWS = 200_000


def with_overlap(ranked: DataFrame, width: int, chunk_rows: int = CHUNK_ROWS, rn: str = "rn") -> DataFrame:
    """Tag rows with ``_chunk`` and duplicate the last ``width - 1`` rows of
    each chunk into the next one with ``_overlap = true``."""
    c = int(max(chunk_rows, width))
    base = ranked.withColumn("_chunk", F.floor((F.col(rn) - 1) / F.lit(c))).withColumn("_overlap", F.lit(False))
    tail = (base.filter(((F.col(rn) - 1) % F.lit(c)) >= F.lit(c - (width - 1)))
                .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_overlap", F.lit(True)))
    return base.unionByName(tail)


def rolling_mean(df: DataFrame, value: str, width: int, partition_cols=(), order_col: str = "ts",
                 tie_cols=(), out: str = "rolling_mean", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of the last ``width`` rows including the current one (native frame per chunk)."""
    ranked = partition_rank(df, partition_cols, order_col, tie_cols)
    ov = with_overlap(ranked, width, chunk_rows)
    w = (Window.partitionBy(*partition_cols, "_chunk").orderBy("rn")
         .rowsBetween(-(width - 1), Window.currentRow))
    return (ov.withColumn(out, F.avg(value).over(w)).withColumn("window_rows", F.count(value).over(w))
              .filter(~F.col("_overlap")).drop("_chunk", "_overlap"))


def rolling_latency(df: DataFrame, value: str = "latency_ms", width: int = 1000,
                    order_col: str = "ts_us", tie_cols=("event_id",),
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """after each request: running count, mean, p95 and p99 (linear) of
    the last ``width`` latencies including the current one.

    Quantiles over a sliding frame are computed per chunk with pandas
    ``rolling(width).quantile`` in ``applyInPandas`` (Arrow batches, each
    group bounded by ``chunk_rows + width - 1`` rows); a SQL percentile over
    the frame would re-sort 1000 values per row."""
    ranked = partition_rank(df, [], order_col, tie_cols)
    ov = with_overlap(ranked.select(*tie_cols, "rn", value), width, chunk_rows)
    keys = list(tie_cols)

    def roll(pdf):
        import pandas as pd
        pdf = pdf.sort_values("rn")
        r = pdf[value].astype("float64").rolling(width, min_periods=1)
        out = pd.DataFrame({k: pdf[k] for k in keys})
        out["request_count"] = pdf["rn"].astype("int64")
        out["avg_latency_ms"] = r.mean()
        out["p95_latency_ms"] = r.quantile(0.95, interpolation="linear")
        out["p99_latency_ms"] = r.quantile(0.99, interpolation="linear")
        return out[~pdf["_overlap"].astype(bool).values]

    schema = ", ".join(f"{k} long" for k in keys) + \
        ", request_count long, avg_latency_ms double, p95_latency_ms double, p99_latency_ms double"
    return ov.groupBy("_chunk").applyInPandas(roll, schema)


def rolling_model_score(df: DataFrame, model: str, latency: str = "latency_ms", width: int = 100,
                        order_col: str = "ts_us", tie_cols=("event_id",)) -> DataFrame:
    """per model, mean of the last ``width`` latencies and
    ``score = clamp(200 / max(1, mean), 0.1, 1)``."""
    r = rolling_mean(df, latency, width, [model], order_col, tie_cols, "avg_latency_ms")
    return r.withColumn("perf_score", F.greatest(F.lit(0.1), F.least(
        F.lit(1.0), F.lit(200.0) / F.greatest(F.lit(1.0), F.col("avg_latency_ms")))))


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int, rank_col: str = "rank") -> DataFrame:
    """N first rows per group by ``order_cols`` (ties broken by them).
    ``row_number() <= n`` plans a group limit before the shuffle, so each task
    forwards at most ``n`` rows per group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def normalize_and_argmax(df: DataFrame, group_cols, value: str, order_cols) -> DataFrame:
    """F8: value / group total, and a flag on the group's largest value
    (first by ``order_cols`` on ties; of nulls only, the first row). Group totals and the argmax come from one
    aggregate that combines map-side, joined back on the group key; a null key is a group."""
    agg = df.groupBy(*group_cols).agg(
        F.sum(value).alias("_total"),
        F.min(F.struct(F.col(value).isNull().alias("_none"), (-F.col(value)).alias("_nv"), *[F.col(c) for c in order_cols])).alias("_best"))
    agg = agg.select("_total", "_best", *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group_cols)])
    same = F.lit(True)
    for k, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    out = df.join(agg, same).drop(*[f"_g{k}" for k in range(len(group_cols))])
    is_best = F.lit(True)
    for c in order_cols:
        is_best = is_best & F.col(c).eqNullSafe(F.col(f"_best.{c}"))
    return (out.withColumn("share", F.when(F.col("_total") != 0, F.col(value) / F.col("_total")))
               .withColumn("is_max", is_best).drop("_total", "_best"))


def chunk(df: DataFrame, partition_cols, order_col: str, tie_cols=(), size: int = 32) -> DataFrame:
    """consecutive chunks of at most ``size`` rows per partition key."""
    r = partition_rank(df, partition_cols, order_col, tie_cols)
    return r.withColumn("chunk_id", F.floor((F.col("rn") - 1) / F.lit(size)))


def backlog_top(df: DataFrame, n: int, priority: str = "priority", arrival=("ts", "event_id")) -> DataFrame:
    """highest priority first, then arrival order; the first ``n`` (TakeOrdered)."""
    return df.orderBy(F.col(priority).desc(), *[F.col(c).asc() for c in arrival]).limit(int(n))


def page(df: DataFrame, order_cols, skip: int, limit: int) -> DataFrame:
    """a page of a stable order."""
    return df.orderBy(*order_cols).offset(int(skip)).limit(int(limit))


def cumulative_throughput(df: DataFrame, ts_us: str = "ts_us", tie_cols=("event_id",)) -> DataFrame:
    """running request count / seconds since the first request (0 while
    no time has passed). The first timestamp is one aggregate value."""
    first = df.agg(F.min(ts_us).alias("t0")).first()["t0"]
    r = partition_rank(df, [], ts_us, tie_cols)
    el = (F.col(ts_us) - F.lit(first)) / F.lit(1e6)
    return (r.withColumn("elapsed_s", el)
             .withColumn("throughput", F.when(F.col("elapsed_s") > 0, F.col("rn") / F.col("elapsed_s"))
                         .otherwise(F.lit(0.0))))


def pad_and_mask(df: DataFrame, ids: str, batch: str) -> DataFrame:
    """Right-pad token ids with 0 to the batch's longest list; mask = id != 0.
    The batch maximum is an aggregate per batch joined back on the batch key; null is a batch. A null list
    is an empty one."""
    df = df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast(df.schema[ids].dataType)))
    widths = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(ids)).alias("_w"))
    out = df.join(widths, F.col(batch).eqNullSafe(F.col("_batch")))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(0), (F.col("_w") - F.size(ids)).cast("int")))
    return (out.withColumn("input_ids", padded)
               .withColumn("attention_mask", F.transform("input_ids", lambda x: (x != 0).cast("int")))
               .drop("_w", "_batch"))
