"""Connected components of an edge table, without a driver-side graph.

``spanning_links`` reduces the links seen by one task to a spanning forest, so
a dense group costs at most one link per member and task.
``connected_components`` alternates large-star and small-star steps; each step
is a grouped minimum (combined map-side, so a hub is no hot spot) and a join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

MAX_ROUNDS = 60


def spanning_links(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links ``(a, b)`` -> ``(src, dst)``: per input partition, each node linked to
    the smallest node it reaches there. Same components, no more links than nodes."""

    def forest(batches):
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while (p := parent.get(x, x)) != root:
                parent[x] = root
                x = p
            return root

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry:
                    lo, hi = (rx, ry) if rx < ry else (ry, rx)
                    parent[hi] = lo
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i:i + 50_000]
            yield pa.record_batch({"src": pa.array(part, pa.int64()),
                                   "dst": pa.array([find(x) for x in part], pa.int64())})

    pairs = links.select(F.col(a).cast("long"), F.col(b).cast("long")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return pairs.mapInArrow(forest, "src long, dst long").where("src <> dst")


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``."""
    nbr = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = nbr.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    joined = nbr.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
                            ).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of the edge table; ``root`` is the smallest
    node of its component. Nulls and self links are ignored; an empty table
    gives an empty result. Raises if the steps do not settle."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut_lineage(e)
    seen = None
    for _ in range(MAX_ROUNDS):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        e = cut_lineage(_step(_step(e, large=True), large=False))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
