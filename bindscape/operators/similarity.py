"""Similarity joins: exact cosine kNN of a query table against a large train
table, and an exact Tanimoto threshold join with prefix filtering.

kNN (C7). Both sides are dealt into blocks of bounded size, and every pair of a query block and a train
block is scored as one group by matrix products, which keeps ``k`` rows per query. The work is
queries x train rows by definition of the exact answer; for a large table
against itself use ``operators/ann.py`` (``CentroidIndex``, ``minhash_join``) or a bounded set of queries.

Tanimoto (C8). Elements are ordered globally, rarest first (counts joined to
the elements, so any number of distinct elements will do). Two sets with
Jaccard >= t share an element in their first ``|A| - ceil(t |A|) + 1``
elements, so only prefix entries ``(element, id, size, position)`` are joined,
under a length and a position bound; the sets themselves meet only for the
candidate pairs left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

EPS = 1e-9
QUERY_ROWS = 4096
TRAIN_ROWS = 16_384
#: Queries scored by one matrix product: its matrices of 128 x 16,384 doubles are 16 MB each.
SCORE_ROWS = 128


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a, b):
    """1 - a.b / (|a| |b|) on double arrays (0-norm vectors give distance 1)."""
    den = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.lit(1.0) - F.when(den > 0, _dot(a, b) / den).otherwise(F.lit(0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Array column of equal lengths as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _vectors(df: DataFrame, ident: str, vec: str, name: str) -> DataFrame:
    """``(<name>, v)`` without rows that have a null id or vector."""
    return df.select(F.col(ident).cast("long").alias(name), F.col(vec).cast("array<double>").alias("v")).dropna()


def block_top_k(queries: DataFrame, train: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``(q_id, t_id, distance)``: of each block (rows of both sides with equal ``keys``) the ``k`` nearest
    train rows ``(keys, t_id, v)`` of every query ``(keys, q_id, v)``. A block meets in one task; callers bound its size."""

    def nearest(asked: pa.Table, known: pa.Table) -> pa.Table:
        ids, t_ids = asked.column("q_id").to_numpy(), known.column("t_id").to_numpy()
        out_q, out_t, out_d = [ids[:0]], [t_ids[:0]], [np.zeros(0)]
        if len(ids) and len(t_ids):
            q, x = (_matrix(c.column("v").combine_chunks()) for c in (asked, known))
            lengths, kk = np.linalg.norm(x, axis=1), min(k, len(x))
            for at in range(0, len(q), SCORE_ROWS):
                part = q[at:at + SCORE_ROWS]
                den = np.linalg.norm(part, axis=1)[:, None] * lengths[None, :]
                d = 1.0 - np.divide(part @ x.T, den, out=np.zeros(den.shape), where=den > 0)
                # rows within the k-th distance, ties included, then by (distance, id)
                near = d <= np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
                for i in range(len(part)):
                    js = np.flatnonzero(near[i])
                    js = js[np.lexsort((t_ids[js], d[i, js]))][:kk]
                    out_q.append(np.repeat(ids[at + i], kk))
                    out_t.append(t_ids[js])
                    out_d.append(d[i, js])
        return pa.table({"q_id": pa.array(np.concatenate(out_q), pa.int64()), "t_id": pa.array(np.concatenate(out_t), pa.int64()),
                         "distance": pa.array(np.concatenate(out_d), pa.float64())})

    return (queries.groupBy(*keys).cogroup(train.groupBy(*keys))
            .applyInArrow(nearest, "q_id long, t_id long, distance double"))


def best_k(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows per query by (distance, train id), with ``rank``."""
    w = Window.partitionBy("q_id").orderBy("distance", "t_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, train: DataFrame, k: int = 5, q_id: str = "q_id", t_id: str = "t_id",
             vec: str = "embedding", block_rows: int = QUERY_ROWS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The ``k`` nearest train vectors of every query by cosine distance
    (ties by train id); self is a legal neighbour. Output
    ``(q_id, t_id, distance, rank)``. Rows with a null id or vector are left
    out; an empty side gives an empty result.

    Both sides are dealt by a hash of the id into blocks of about ``block_rows`` and ``train_rows``; each pair of a
    query block and a train block is one group of a cogrouped job. Nothing goes through the driver but the two counts."""
    ask, tr = cut_lineage(_vectors(queries, q_id, vec, "q_id")), cut_lineage(_vectors(train, t_id, vec, "t_id"))
    n_ask, n_train = -(-max(ask.count(), 1) // block_rows), -(-max(tr.count(), 1) // train_rows)
    # as many groups as there are tasks, if the tables are small
    n_train = max(n_train, min(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_ask, 64), 1)

    def dealt(df, ident, own, n_own, other, n_other):
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select(ident, "v", F.pmod(F.xxhash64(ident), F.lit(n_own)).cast("int").alias(own), every)

    found = block_top_k(dealt(ask, "q_id", "qb", n_ask, "tb", n_train), dealt(tr, "t_id", "tb", n_train, "qb", n_ask), ["qb", "tb"], k)
    return best_k(found, k).withColumnRenamed("q_id", q_id).withColumnRenamed("t_id", t_id)


UNFITTED_RELIABILITY = 0.5


def reliability(neighbors: DataFrame, train_labels: DataFrame, q_id: str = "q_id", t_id: str = "t_id",
                label: str = "label", queries: DataFrame | None = None) -> DataFrame:
    """Per query, mean neighbour distance d and population variance v of
    neighbour labels; score = clip(.7 / (1 + d) + .3 / (1 + v), 0, 1). With
    ``queries`` every query is returned; one without neighbours (nothing was
    fitted for it) scores 0.5."""
    j = neighbors.join(train_labels.select(F.col(t_id), F.col(label).cast("double").alias("_lab")), t_id)
    g = j.groupBy(q_id).agg(F.avg("distance").alias("avg_distance"), F.var_pop("_lab").alias("label_variance"))
    if queries is not None:
        g = queries.select(q_id).distinct().join(g, q_id, "left")
    s = F.lit(0.7) / (F.lit(1.0) + F.col("avg_distance")) + F.lit(0.3) / (F.lit(1.0) + F.col("label_variance"))
    return g.withColumn("reliability", F.when(F.col("avg_distance").isNull(), F.lit(UNFITTED_RELIABILITY))
                        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def tanimoto(a, b):
    """|A n B| / |A u B| of set arrays; 0.0 when the union is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _ceil(x):
    return F.ceil(x - F.lit(EPS)).cast("int")


def ordered_sets(sides: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``(side, id, e)``: the distinct elements of each non-empty set of the ``(table, id, array)``
    sides as structs ``(count, element)``, rarest first by their count over all sides."""
    rows = None
    for k, (df, ident, elements) in enumerate(sides):
        part = df.select(F.lit(k).alias("side"), F.col(ident).alias("id"), F.explode(F.array_distinct(elements)).alias("e"))
        rows = part if rows is None else rows.union(part)
    freq = rows.groupBy(F.col("e").alias("fe")).agg(F.count(F.lit(1)).alias("f"))
    return rows.join(freq, F.col("e") == F.col("fe")).groupBy("side", "id").agg(
        F.sort_array(F.collect_list(F.struct("f", "e"))).alias("e"))


def tanimoto_candidates(left: DataFrame, right: DataFrame, t: float, self_join: bool) -> DataFrame:
    """Pairs ``(l, r)`` of ids, each once, of the ordered sets ``(id, e)`` that may reach ``t``: all that
    do, and some below."""
    def entries(df, i, n, pos, e):
        size = F.size("e")
        first = F.slice("e", 1, size - _ceil(F.lit(t) * size) + 1)
        return df.select(F.col("id").alias(i), size.alias(n), F.posexplode(first).alias(pos, e)).withColumn(e, F.col(f"{e}.e"))
    lp, rp = entries(left, "l", "ln", "lp", "le"), entries(right, "r", "rn", "rp", "re")
    near = F.least("ln", "rn") >= F.lit(t) * F.greatest("ln", "rn") - F.lit(EPS)
    placed = F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) >= _ceil(
        F.lit(t / (1 + t)) * (F.col("ln") + F.col("rn")))
    on = (F.col("le") == F.col("re")) & near & placed
    if self_join:
        on = on & (F.col("l") < F.col("r"))
    return lp.join(rp, on).select("l", "r").distinct()


def tanimoto_join(left: DataFrame, right: DataFrame, min_sim: float, l_id: str = "l_id", r_id: str = "r_id",
                  bits: str = "bits", self_join: bool = False) -> DataFrame:
    """All (left, right) pairs with Tanimoto >= ``min_sim`` (> 0), exact.
    With ``self_join`` the two sides are one table under two id names and only
    pairs ``l_id < r_id`` are returned. Empty and null sets match nothing."""
    if not min_sim > 0:
        raise ValueError("min_sim must be > 0 for a threshold join")
    t = float(min_sim)
    sides = [(left, l_id, bits)] if self_join else [(left, l_id, bits), (right, r_id, bits)]
    sets = cut_lineage(ordered_sets(sides))
    one = sets.where("side = 0").select("id", "e")
    two = one if self_join else sets.where("side = 1").select("id", "e")
    cand = tanimoto_candidates(one, two, t, self_join)
    out = (cand.join(one.select(F.col("id").alias("l"), F.col("e.e").alias("x")), "l")
               .join(two.select(F.col("id").alias("r"), F.col("e.e").alias("y")), "r")
               .select(F.col("l").alias(l_id), F.col("r").alias(r_id), tanimoto(F.col("x"), F.col("y")).alias("similarity")))
    return out.filter(F.col("similarity") >= F.lit(t))
