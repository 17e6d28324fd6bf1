"""Provenance union, de-duplication, exact-size splits and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.operators.ranking import global_rank, hash_key, hash_rank

# Load order of datasets and of split files ("first" wins on duplicates).
DATASET_ORDER = ["davis", "kiba", "bindingdb"]
SPLIT_ORDER = ["train", "test", "valid", "validation", "train_fold_0", "test_fold_0"]


def order_rank(col, values) -> Column:
    """Position of ``col`` in ``values`` (unknown values sort last)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        expr = F.when(c == v, F.lit(i)).otherwise(expr)
    return expr


def union_with_provenance(frames) -> DataFrame:
    """Concatenate frames with different columns, stamping each with its
    ``source_dataset`` / ``source_split``. ``frames`` = [(dataset, split, df)]."""
    stamped = [df.withColumn("source_dataset", F.lit(ds)).withColumn("source_split", F.lit(sp))
               for ds, sp, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stamped)


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Fail fast (driver-side schema check) when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def checked_columns(df: DataFrame, cols) -> tuple[DataFrame, str | None]:
    """B13 without a stop: the table and None, or an empty table that has all required columns (missing ones as
    strings) and the error."""
    missing = [c for c in cols if c not in df.columns]
    if not missing:
        return df, None
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}).where(F.lit(False)), f"Missing required columns: {missing}"


def dedup_pairs(df: DataFrame, keys=("compound", "protein"), order_cols=None) -> DataFrame:
    """keep the first row per ``keys``. "First" = dataset load order, then
    split-file order, then ``order_cols`` (row position).

    Written as ``min(struct(order..., row))`` per key instead of a
    ``row_number`` window: the aggregate combines map-side, so a key holding a
    large share of the rows is reduced before the shuffle and never buffered
    in one task."""
    order_cols = list(order_cols or [])
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(
        order_rank("source_dataset", DATASET_ORDER).alias("_ds"),
        order_rank("source_split", SPLIT_ORDER).alias("_sp"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
        *[F.col(c) for c in rest],
    )
    return (df.groupBy(*keys).agg(F.min(packed).alias("_first"))
              .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def _shuffled(df: DataFrame, key_cols, seed: int, n_parts: int | None, hash_col: str | None) -> DataFrame:
    if hash_col is None:
        return hash_rank(df, list(key_cols), seed, "shuffle_rank", n_parts)
    return global_rank(df, [hash_col, *key_cols], "shuffle_rank", "n_total", n_parts)


def ratio_split(df: DataFrame, key_cols=("compound", "protein"), ratios=(0.8, 0.1, 0.1),
                seed: int = 42, names=("train", "validation", "test"),
                n_parts: int | None = None, hash_col: str | None = None) -> DataFrame:
    """shuffle by ``md5(key|seed)`` and cut at exact counts
    ``int(n*r0)``, ``int(n*r1)``, rest. Adds ``split`` and ``shuffle_rank``.
    ``hash_col`` names a hash worked out before, so the keys can be ids."""
    ranked = _shuffled(df, key_cols, seed, n_parts, hash_col)
    n = F.col("n_total")
    n_train = F.floor(n * F.lit(float(ratios[0])))
    n_val = F.floor(n * F.lit(float(ratios[1])))
    split = (F.when(F.col("shuffle_rank") <= n_train, names[0])
              .when(F.col("shuffle_rank") <= n_train + n_val, names[1])
              .otherwise(names[2]))
    return ranked.withColumn("split", split).drop("n_total")


def two_stage_split(df: DataFrame, key_cols=("compound", "protein"), test_size: float = 0.2,
                    val_size: float = 0.25, seed: int = 42, n_parts: int | None = None,
                    hash_col: str | None = None) -> DataFrame:
    """test = ceil(test_size*n) first, then validation = ceil(val_size*rest)."""
    ranked = _shuffled(df, key_cols, seed, n_parts, hash_col)
    n = F.col("n_total")
    n_test = F.ceil(n * F.lit(float(test_size)))
    n_val = F.ceil((n - n_test) * F.lit(float(val_size)))
    split = (F.when(F.col("shuffle_rank") <= n_test, "test")
              .when(F.col("shuffle_rank") <= n_test + n_val, "validation")
              .otherwise("train"))
    return ranked.withColumn("split", split).drop("n_total")


def sample_n(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """exactly ``min(n, rows)`` rows, the ``n`` smallest ``md5(key|seed)``.
    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top ``n`` and only those are merged, no full sort."""
    return (df.withColumn("_h", hash_key(list(key_cols), seed))
              .orderBy("_h", *key_cols).limit(int(n)).drop("_h"))
