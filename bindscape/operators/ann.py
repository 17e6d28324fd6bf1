"""Similarity search for large tables: a centroid index for cosine kNN (C7) and banded min-hash
signatures for Tanimoto joins (C8). Both choose candidates approximately and score them exactly.

Centroid index. Centroids are fitted by spherical k-means on a sample of bounded size; every row of the table is
assigned to its nearest centroid's cell, large cells are split into blocks by a hash of the id. A query visits the cells of its
nearest centroids. How many it visits is chosen on the sample so that the visited cells hold
the wanted share of true neighbours; vectors without structure need many cells, clustered ones few.

Min-hash. A set's signature has ``bands * rows`` minima of seeded hashes; sets that agree in all rows of a band are
candidates: a pair of similarity s is missed with probability (1 - s ** rows) ** bands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.operators.similarity import TRAIN_ROWS, _matrix, _vectors, best_k, block_top_k, tanimoto
from bindscape.session import cut_lineage

SAMPLE_ROWS = 20_000
ROUNDS = 10
#: Sample rows per centroid, at least.
ROWS_PER_CELL = 16
TARGET = 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass(frozen=True)
class CentroidIndex:
    """Centroids (rows of unit length) and the number of cells that a query visits."""

    centroids: np.ndarray
    probes: int

    def cells(self, vec: Column, many: bool) -> Column:
        """The nearest cell of a vector (as an array of one), or those that a query visits."""
        centroids, n = self.centroids, self.probes if many else 1

        @F.arrow_udf("array<int>")
        def nearest(v: pa.Array) -> pa.Array:
            if not len(v):
                return pa.array([], pa.list_(pa.int32()))
            close = _matrix(v) @ centroids.T
            order = np.argsort(-close, axis=1, kind="stable")[:, :n].astype(np.int32)
            return pa.array(order.tolist(), pa.list_(pa.int32()))

        return nearest(vec)


def fit_index(train: DataFrame, t_id: str = "t_id", vec: str = "embedding", cells: int | None = None, k: int = 5,
              target: float = TARGET, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> CentroidIndex:
    """Fit centroids on the ``sample_rows`` rows of the smallest id hash (the only rows that reach the driver;
    20,000 by default). ``cells``: square root of the number of rows by default, at most a 16th of the sample. ``probes`` is the least
    number of cells that hold the share ``target`` of the ``k`` nearest sample rows of 500 sample rows."""
    rows = _vectors(train, t_id, vec, "t_id")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("t_id", F.lit(seed)), "t_id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return CentroidIndex(np.zeros((1, 0)), 1)
    x = _unit(_matrix(sample.column("v").combine_chunks()))
    want = cells or int(np.sqrt(total))
    n = max(1, min(want, -(-len(x) // ROWS_PER_CELL)))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=n) > 0
        centroids[some] = _unit(sums[some])
    own = np.argmax(x @ centroids.T, axis=1)
    ask = rng.choice(len(x), min(500, len(x)), replace=False)
    near = np.argsort(-(x[ask] @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(x[ask] @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    visited = np.take_along_axis(place, own[near], axis=1).ravel()
    probes = int(np.sort(visited)[max(0, int(np.ceil(target * len(visited))) - 1)]) + 1
    return CentroidIndex(centroids, probes)


def index_rows(index: CentroidIndex, train: DataFrame, t_id: str = "t_id", vec: str = "embedding") -> DataFrame:
    """Every row of the table with its cell: ``(cell, t_id, v)``, written to the shared folder."""
    rows = _vectors(train, t_id, vec, "t_id")
    return cut_lineage(rows.select(index.cells(F.col("v"), many=False)[0].alias("cell"), "t_id", "v"))


def knn_search(index: CentroidIndex, indexed: DataFrame, queries: DataFrame, k: int = 5, q_id: str = "q_id",
               vec: str = "embedding", block_rows: int = TRAIN_ROWS) -> DataFrame:
    """C7 by the index: ``(q_id, t_id, distance, rank)`` of the ``k`` nearest rows in the cells that a query
    visits, by exact distance (ties by train id). Cells are cut into blocks of about ``block_rows`` rows, the queries of a
    cell likewise. Rows with a null id or vector are left out; an empty side gives an empty result."""
    ask = _vectors(queries, q_id, vec, "q_id")
    asked = cut_lineage(ask.select("q_id", "v", F.explode(index.cells(F.col("v"), many=True)).alias("cell")))

    def blocks(df, name):
        # one row per cell: at most a 16th of the sample
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    split = F.broadcast(blocks(indexed, "tn").join(blocks(asked, "qn"), "cell"))

    def dealt(df, ident, own, n_own, other, n_other):
        every = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other)
        return df.join(split, "cell").select("cell", ident, "v", F.pmod(F.xxhash64(ident), F.col(n_own)).cast("int").alias(own), every)

    found = block_top_k(dealt(asked, "q_id", "qb", "qn", "tb", "tn"), dealt(indexed, "t_id", "tb", "tn", "qb", "qn"), ["cell", "qb", "tb"], k)
    return best_k(found, k).withColumnRenamed("q_id", q_id)


def recall(found: DataFrame, exact: DataFrame, q_id: str = "q_id", t_id: str = "t_id") -> DataFrame:
    """One row ``(n_queries, n_neighbours, recall)``: the share of the exact neighbours that were found."""
    both = exact.select(q_id, t_id).join(found.select(q_id, t_id, F.lit(1).alias("_hit")), [q_id, t_id], "left")
    return both.agg(F.count_distinct(q_id).alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
                    F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def signatures(sets: DataFrame, bands: int, rows: int, seed: int = 42) -> DataFrame:
    """``(id, band, key)`` per band of the min-hash signature of each non-empty set ``(id, e)`` of distinct elements.
    The minima are combined before the shuffle, so one row per set and task is moved."""
    spread = sets.select("id", F.explode("e").alias("x"))
    minima = [F.min(F.xxhash64(F.lit(seed + i), "x")).alias(f"m{i}") for i in range(bands * rows)]
    keys = F.array(*[F.xxhash64(*[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    return spread.groupBy("id").agg(*minima).select("id", F.posexplode(keys).alias("band", "key"))


def minhash_join(left: DataFrame, right: DataFrame, min_sim: float, l_id: str = "l_id", r_id: str = "r_id",
                 bits: str = "bits", bands: int = 40, rows: int = 3, self_join: bool = False) -> DataFrame:
    """C8 for large sides: pairs of Tanimoto ``min_sim`` (> 0) or more, found by banded min-hash signatures and
    scored exactly; a pair just at 0.7 is missed with probability 5e-8 at 40 bands of 3 rows. Options and edge cases as in
    ``tanimoto_join``. Equal sets are joined once, as one class, and their ids joined on at the end."""
    if not min_sim > 0:
        raise ValueError("min_sim must be > 0 for a threshold join")

    def side(df, ident):
        e = F.array_sort(F.array_distinct(F.filter(F.col(bits), lambda x: x.isNotNull())))
        own = df.select(F.col(ident).alias("own"), e.alias("e")).where(F.size("e") > 0)
        # the class of a set: its elements' hash
        return cut_lineage(own.withColumn("id", F.xxhash64("e")))

    one = side(left, l_id)
    two = one if self_join else side(right, r_id)
    classes = (one if self_join else one.unionByName(two)).groupBy("id").agg(F.first("e").alias("e"))
    classes = cut_lineage(classes)
    marks = cut_lineage(signatures(classes, bands, rows))
    a, b = marks.alias("a"), marks.alias("b")
    pairs = (a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
             .select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct())
    scored = (pairs.join(classes.select(F.col("id").alias("x"), F.col("e").alias("ex")), "x")
              .join(classes.select(F.col("id").alias("y"), F.col("e").alias("ey")), "y")
              .select("x", "y", tanimoto(F.col("ex"), F.col("ey")).alias("similarity")).where(F.col("similarity") >= min_sim))
    # both directions and each class with itself
    same = classes.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
    linked = cut_lineage(scored).unionByName(same)
    linked = linked.unionByName(scored.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))
    out = (linked.join(one.select(F.col("id").alias("x"), F.col("own").alias(l_id)), "x")
           .join(two.select(F.col("id").alias("y"), F.col("own").alias(r_id)), "y").select(l_id, r_id, "similarity"))
    return out.where(F.col(l_id) < F.col(r_id)) if self_join else out
