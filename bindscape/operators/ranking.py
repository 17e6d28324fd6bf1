"""Exact global ranks and prefix sums without a single-partition window.

A global ``row_number() over (order by ...)`` moves every row into one task.
Here the rows are range-partitioned by the whole order (the tie columns
included, so a frequent value is spread over many tasks), sorted inside each
partition and numbered there; the numbered rows are cut from their lineage by
a reliable checkpoint, so partition and position stay fixed when a task is
recomputed. One count per partition then gives the offsets: a table with one
row per partition, which is broadcast.

The number of partitions is ``spark.sql.shuffle.partitions`` unless given, so
partitions keep their size as the data and the setting grow. Nulls sort first,
NaN and infinities last, and an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

_POSITION_BITS = 33      # layout of monotonically_increasing_id


def hash_key(cols, seed) -> Column:
    """md5 hex of ``col1|col2|...|seed`` (nulls skipped, as concat_ws does)."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ordered_rows(df: DataFrame, order, n_parts: int | None = None) -> DataFrame:
    """``df`` with ``_b`` (number of the range partition) and ``_i`` (position in
    it, from 0); positions of all partitions in turn are the global ``order``."""
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = _columns(order)
    rows = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_at", F.monotonically_increasing_id()))
    return (cut_lineage(rows)
            .withColumn("_b", F.shiftright("_at", _POSITION_BITS))
            .withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
            .drop("_at"))


def _offsets(rows: DataFrame, sums: dict) -> DataFrame:
    """Per partition: the sums of the partitions before it (``_off_<name>``) and
    the grand totals (``_all_<name>``). One row per partition."""
    per = rows.groupBy("_b").agg(*[s.alias(n) for n, s in sums.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return per.select("_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
                      *[F.sum(n).over(whole).alias(f"_all_{n}") for n in sums])


def global_rank(df: DataFrame, order, rank_col: str = "rank", total_col: str | None = None,
                n_parts: int | None = None) -> DataFrame:
    """1-based row number of the whole table by ``order``; ``total_col`` adds the row count."""
    rows = ordered_rows(df, order, n_parts)
    out = (rows.join(F.broadcast(_offsets(rows, {"n": F.count(F.lit(1))})), "_b")
               .withColumn(rank_col, F.col("_off_n") + F.col("_i") + 1))
    if total_col:
        out = out.withColumn(total_col, F.col("_all_n"))
    return out.drop("_b", "_i", "_off_n", "_all_n")


def hash_rank(df: DataFrame, key_cols, seed=42, rank_col: str = "rank", n_parts: int | None = None,
              with_total: bool = True) -> DataFrame:
    """1-based global rank ordered by ``(md5(key|seed), key...)``."""
    tagged = df.withColumn("_h", hash_key(key_cols, seed))
    return global_rank(tagged, ["_h", *key_cols], rank_col, "n_total" if with_total else None, n_parts).drop("_h")


def value_rank(df: DataFrame, order_col: str, tie_cols=(), rank_col: str = "rank",
               descending: bool = False, n_parts: int | None = None) -> DataFrame:
    """Exact 1-based global row number ordered by ``order_col`` then ``tie_cols``."""
    first = F.col(order_col).desc() if descending else F.col(order_col).asc()
    return global_rank(df, [first, *tie_cols], rank_col, None, n_parts)


def partition_rank(df: DataFrame, partition_cols, order_col: str, tie_cols=(), rank_col: str = "rn",
                   n_parts: int | None = None) -> DataFrame:
    """Exact 1-based row number within ``partition_cols`` ordered by ``order_col``
    then ``tie_cols``. A large group spans several range partitions; what it
    has in earlier partitions is an offset of at most one row per partition."""
    groups = list(partition_cols)
    if not groups:
        return value_rank(df, order_col, tie_cols, rank_col, n_parts=n_parts)
    rows = ordered_rows(df, [*groups, order_col, *tie_cols], n_parts)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_b", *groups).agg(F.count(F.lit(1)).alias("_n"))
    # only the first group of a partition can have rows in earlier ones: at most one row per partition
    carried = counts.withColumn("_off", F.sum("_n").over(before)).where("_off > 0").select(
        F.col("_b").alias("_cb"), *[F.col(g).alias(f"_c_{g}") for g in groups], "_off")
    same = F.col("_b") == F.col("_cb")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    local = F.row_number().over(Window.partitionBy("_b", *groups).orderBy("_i"))
    return (rows.withColumn("_local", local).join(F.broadcast(carried), same, "left")
                .withColumn(rank_col, F.col("_local") + F.coalesce("_off", F.lit(0)))
                .select(*df.columns, rank_col))


def prefix_sums(df: DataFrame, order_col: str, value_cols, descending: bool = False,
                n_parts: int | None = None, prefix: str = "cum_", bounded_domain: bool = False) -> DataFrame:
    """Running sums of ``value_cols`` in ``order_col`` order (values of
    ``order_col`` must be unique, e.g. after a group-by on it); also adds the
    grand totals as ``total_<v>``.

    ``bounded_domain`` is for a key whose number of distinct values has a
    fixed bound independent of the data size (e.g. a sequence length): the
    running sum is then one window over that small table."""
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    upto = (Window.unboundedPreceding, Window.currentRow)
    if bounded_domain:
        out = df
        for v in value_cols:
            out = (out.withColumn(f"{prefix}{v}", F.sum(v).over(Window.orderBy(o).rowsBetween(*upto)))
                      .withColumn(f"total_{v}", F.sum(v).over(Window.partitionBy())))
        return out
    rows = ordered_rows(df, [o], n_parts)
    w = Window.partitionBy("_b").orderBy("_i").rowsBetween(*upto)
    out = rows.join(F.broadcast(_offsets(rows, {v: F.sum(v) for v in value_cols})), "_b")
    for v in value_cols:
        out = (out.withColumn(f"{prefix}{v}", F.col(f"_off_{v}") + F.sum(v).over(w))
                  .withColumn(f"total_{v}", F.col(f"_all_{v}")))
    return out.select(*df.columns, *[f"{p}{v}" for v in value_cols for p in (prefix, "total_")])
