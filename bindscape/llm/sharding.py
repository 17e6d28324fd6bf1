"""Sharding of indivisible groups by Karmarkar-Karp differencing.

Groups (rows with equal texts) are weighed by one map-side combined sum. Groups
lighter than 1/``n_items`` of the whole are packed by hash into ``n_items``
bundles; heavier ones (fewer than ``n_items`` can exist) stay alone. So the
differencing sees at most ``2 * n_items`` items at any data size, while every
item is small against a shard unless its group is not. Row slots are given by
hash buckets with prefix-summed offsets, so no shard is ranked in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bindscape.session import cut_lineage

SHARDS = 40
ITEMS = 16_384
ROW_OVERHEAD = 16
ROWS_PER_BUCKET = 50_000
CHUNK = 1 << 16


def difference(items: list[tuple], shards: int) -> dict:
    """Karmarkar-Karp: ``(item, weight)`` -> ``{item: shard}``.

    Every item starts as a partial partition with one loaded part. The two partials
    with the largest spread (heaviest minus lightest part) are combined, the
    heaviest part of one with the lightest of the other, until one is left; then
    the part orders are unrolled to the items. Ties go to the earlier partial;
    items are taken by weight, then id."""
    if not items:
        return {}
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    heap, loads, made = [], {}, []
    for k, (_, weight) in enumerate(order):
        parts = np.zeros(shards, np.int64)
        parts[-1] = weight
        loads[k] = parts
        heap.append((-int(weight if shards > 1 else 0), k))
    heapq.heapify(heap)
    new = len(order)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        parts = loads.pop(a) + loads.pop(b)[::-1]
        place = np.argsort(parts, kind="stable")
        loads[new] = parts = parts[place]
        made.append((new, a, b, place))
        heapq.heappush(heap, (int(parts[0] - parts[-1]), new))
        new += 1
    shard_of = {new - 1: np.arange(shards)}
    for node, a, b, place in reversed(made):
        mine = np.empty(shards, np.int64)
        mine[place] = shard_of.pop(node)
        shard_of[a], shard_of[b] = mine, mine[::-1]
    return {item: int(shard_of[k][-1]) for k, (item, _) in enumerate(order)}


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"),
                       (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("crc"),
                       F.xxhash64(text).alias("grp"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                  n_items: int = ITEMS) -> DataFrame:
    """``(id, size, crc, grp, shard)`` for each row; rows with equal texts share a shard and
    the shards' byte sums are near equal (a group heavier than a shard sets the maximum).

    ``size`` is the UTF-8 length of the text plus 16; a null text counts as empty and
    belongs to the same group. Null ids and repeated rows are placed like others;
    other columns are ignored; an empty table gives an empty result. (Two texts with
    equal 64-bit hashes would share a group, which keeps both laws.)"""
    if shards < 1 or n_items < 1:
        raise ValueError("shards and n_items must be positive")
    spark = docs.sparkSession
    rows = cut_lineage(_sized(docs, id_col, text_col))
    groups = cut_lineage(rows.groupBy("grp").agg(F.sum("size").alias("w")))
    total = groups.agg(F.sum("w")).first()[0] or 0
    alone = F.col("w") * n_items >= F.lit(total)
    heavy = [(r["grp"], int(r["w"])) for r in groups.where(alone).collect()]          # at most n_items rows
    packed = [(r["b"], int(r["w"])) for r in groups.where(~alone)
              .groupBy(F.pmod("grp", F.lit(n_items)).alias("b")).agg(F.sum("w").alias("w")).collect()]
    # ties go by group or bundle number, whatever the order in which the rows came
    placed = difference([((0, g), w) for g, w in heavy] + [((1, b), w) for b, w in packed], shards)
    # both tables have at most n_items rows of 12 bytes: a broadcast of proven size
    own = spark.createDataFrame([(g, placed[0, g]) for g, _ in heavy], "grp long, own int")
    shared = spark.createDataFrame([(b, placed[1, b]) for b, _ in packed], "bundle long, shared int")
    return (rows.withColumn("bundle", F.pmod("grp", F.lit(n_items)))
            .join(F.broadcast(own), "grp", "left").join(F.broadcast(shared), "bundle", "left")
            .select("id", "size", "crc", "grp", F.coalesce("own", "shared").alias("shard")))


def number_slots(placed: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps in each ``shard``, in an order given by a hash of the row and its
    copy, so that copies of a row stand apart. Equal rows are counted first and spread out again, so no id or
    group fills one task."""
    keys = ["shard", "id", "size", "crc", "grp"]
    counted = cut_lineage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    buckets = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // rows_per_bucket))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("c")
    one = F.explode(F.sequence("c", F.least(F.col("c") + CHUNK, F.col("n")) - 1)).alias("k")
    spread = counted.select(*keys, "n", chunk).select(*keys, one)
    tagged = spread.withColumn("place", F.xxhash64("id", "grp", "k")).withColumn("bucket", F.pmod("place", F.lit(buckets)))
    by_bucket = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("m"))
               .select("shard", "bucket", F.coalesce(F.sum("m").over(by_bucket), F.lit(0)).alias("before")))
    within = Window.partitionBy("shard", "bucket").orderBy("place", "id", "grp", "k")
    return (tagged.withColumn("ahead", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
            .withColumn("slot", (F.col("before") + F.col("ahead")).cast("long")).select(*keys, "slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    n_items: int = ITEMS) -> DataFrame:
    """One row per row of ``docs``: ``(id, size, text_crc32, law, shard, slot, grown_shard)``.
    The law is ``bytes``; ``grown_shard`` is null, since a balanced placement is made anew for
    another shard count. Edge cases as in ``assign_shards``."""
    return number_slots(assign_shards(docs, shards, id_col, text_col, n_items)).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))
