"""Anchored-TTL cache hits over a request log, in batch and as a stream.

Per key the first request is a miss and stores its time t0; a later request
with ``t - t0 < ttl`` is a hit (a hit does not extend t0); otherwise it is a
miss and t0 := t. The misses are the chain ``e1, nxt(e1), nxt(nxt(e1)), ...``
where ``nxt(e)`` is the first request of the key at or after ``t_e + ttl``.

Batch (no per-key buffering, so a key holding a large share of the log is
still spread over many tasks):

1. row numbers per key from range-partitioned ranking;
2. ``nxt`` by ranking each request's probe time ``t + ttl`` among the key's
   request times (a rank, not a join);
3. pointer doubling: ``J_{m+1} = J_m o J_m`` and the reached set
   ``S_{m+1} = S_m u J_m(S_m)`` (equi-joins on (key, row number), the two parts are disjoint), until no
   pointer is left; ``S`` is then the chain of misses. About log2(chain length)
   rounds; each round's new part is cut from its lineage by a reliable checkpoint.

Stream: ``transformWithState`` per bucket of keys, with the anchors in a value state, waiting requests in a map state of
time slices, and event-time timers (see ``ttl_hits_stream``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.operators.ranking import partition_rank
from bindscape.session import cut_lineage


def _next_pointers(ranked: DataFrame, t: str, ttl_us: int) -> DataFrame:
    """``(_k, src, dst)``: dst = row number of the key's first request at or after t + ttl, where there is one."""
    ev = ranked.select("_k", F.col(t).alias("_v"), F.lit(1).alias("_kind"), "rn")
    pr = ranked.select("_k", (F.col(t) + F.lit(ttl_us)).alias("_v"), F.lit(0).alias("_kind"), "rn")
    # probes sort before requests at the same time: a request exactly at t0 + ttl is a miss
    u = partition_rank(ev.unionByName(pr), ["_k"], "_v", ["_kind", "rn"], rank_col="_ur")
    last = ranked.groupBy("_k").agg(F.max("rn").alias("_n"))
    return (u.filter(F.col("_kind") == 0).select("_k", F.col("rn").alias("src"), (F.col("_ur") - F.col("rn") + 1).alias("dst"))
             .join(last, "_k").where(F.col("dst") <= F.col("_n")).select("_k", "src", "dst"))


def ttl_hits(df: DataFrame, key: str = "cache_key", t: str = "ts_us", ident: str = "event_id",
             ttl_us: int = 3600 * 1_000_000, max_rounds: int = 64) -> DataFrame:
    """Batch J1: the input rows with ``hit`` (boolean), by pointer doubling (no key is gathered
    into one task). A null key is a key; rows with equal ids are rows of their own. Raises if pointers are left after
    ``max_rounds`` rounds, enough for 2 ** max_rounds misses of one key."""
    keyed = df.withColumn("_k", F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(key).cast("string"))))
    ranked = cut_lineage(partition_rank(keyed, ["_k"], t, [ident], rank_col="rn"))
    jumps = cut_lineage(_next_pointers(ranked, t, ttl_us))
    # round m: the first 2 ** m misses of each key are reached, and a pointer leads 2 ** m misses on
    misses = [ranked.filter(F.col("rn") == 1).select("_k", "rn")]
    for m in range(max_rounds):
        if jumps.isEmpty():
            break
        reached = misses[0]
        for part in misses[1:]:
            reached = reached.unionByName(part)
        # these are new: nothing has to be compared with what was reached before
        found = reached.join(jumps.withColumnRenamed("src", "rn"), ["_k", "rn"]).select("_k", F.col("dst").alias("rn"))
        misses.append(cut_lineage(found))
        a, b = jumps.alias("a"), jumps.alias("b")
        twice = a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a.dst") == F.col("b.src"))).select(
            F.col("a._k").alias("_k"), F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        jumps = cut_lineage(twice)
    else:
        if not jumps.isEmpty():
            raise RuntimeError(f"pointers are left after {max_rounds} rounds")
    every = misses[0]
    for part in misses[1:]:
        every = every.unionByName(part)
    return (ranked.join(every.withColumn("_miss", F.lit(True)), ["_k", "rn"], "left")
                  .withColumn("hit", F.col("_miss").isNull()).select(*df.columns, "hit"))


SLICES = 4
PART_ROWS = 4096
#: Keys share the state of their bucket, so the calls to the state grow with buckets and slices, not with keys.
BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _fold(times, t0, ttl_us: int):
    """Hits among ascending ``times`` after an anchor ``t0`` (or None), and the last anchor. One step per miss."""
    from bisect import bisect_left
    hits, at = [True] * len(times), 0
    while at < len(times):
        at = 0 if t0 is None else bisect_left(times, t0 + ttl_us)
        if at < len(times):
            t0 = times[at]
            hits[at] = False
    return hits, t0


def _same(key):
    """A key as it is grouped: bytes can be hashed, and every NaN is one key."""
    if isinstance(key, bytearray):
        return bytes(key)
    return math.nan if key != key else key


def ttl_hits_stream(stream: DataFrame, key: str = "cache_key", ts: str = "ts", ident: str = "event_id",
                    ttl_seconds: int = 3600, watermark: str = "1 hour", slice_seconds: int | None = None,
                    buckets: int = BUCKETS) -> DataFrame:
    """Streaming J1 in event-time order with ``transformWithState``: ``(key, ident, hit)`` rows.

    Keys are dealt by their hash into ``buckets``, and a bucket has one state: the anchor times of its keys (a value), and the
    requests that the watermark has not passed, in
    time slices of ``slice_seconds`` (default: a quarter of the TTL) cut into parts of at most 4,096 requests (a
    map from slice and part). A timer at the end of the bucket's first waiting slice reads the slices that the watermark has passed one by one,
    sorts each key's requests by (time, id) and folds them into its anchor; so memory is one slice of one bucket and the bucket's live anchors,
    not all that waits. Files and batches may arrive in any order within the watermark delay;
    requests behind the watermark are dropped. Anchors older than the TTL are dropped when a timer fires, the last at t0 + ttl. A null
    key is a key. A finite log needs one later row of any key to move the watermark past its end.

    Sets the session's state store to RocksDB, which this kind of state needs."""
    from itertools import islice

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ttl_us = int(ttl_seconds) * 1_000_000
    width = max(1, int(slice_seconds) * 1_000_000 if slice_seconds else ttl_us // SLICES)
    kind = stream.schema[key].dataType.simpleString()

    class Hits(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            # the keys with an anchor and their times, and the earliest timer that is set (0: none)
            self.anchors = handle.getValueState("anchors", f"k array<{kind}>, t0 array<long>, due long")
            # the number of parts of each waiting slice; the parts
            self.slices = handle.getMapState("slices", "slice long", "parts int")
            self.parts = handle.getMapState("parts", "slice long, part int", f"k array<{kind}>, t array<long>, id array<long>")

        def _set(self, keys, times, due, at):
            """Keep the anchors, and one timer: the earliest that is needed."""
            if not due or at < due:
                self.handle.registerTimer(at)
                due = at
            self.anchors.update((keys, times, due))

        def handleInputRows(self, key, rows, timerValues):
            mark = timerValues.getCurrentWatermarkInMs()
            on_time = ((r["k"], r["t"], r["i"]) for r in rows if r["t"] // 1000 >= mark)
            first = None
            while some := list(islice(on_time, PART_ROWS)):
                by_slice = {}
                for row in some:
                    by_slice.setdefault(row[1] // width, []).append(row)
                for s, mine in by_slice.items():
                    known = self.slices.getValue((s,))
                    n = known[0] if known else 0
                    self.parts.updateValue((s, n), tuple(map(list, zip(*mine, strict=True))))
                    self.slices.updateValue((s,), (n + 1,))
                first = min(by_slice) if first is None else min(first, *by_slice)
            if first is not None:
                keys, times, due = self.anchors.get() or ([], [], 0)
                at = self._end(first)
                if not due or at < due:
                    self._set(keys, times, due, at)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            mark = timerValues.getCurrentWatermarkInMs()
            keys, times, _ = self.anchors.get() or ([], [], 0)
            anchors = {_same(k): t for k, t in zip(keys, times, strict=True)}
            waiting = sorted(r[0] for r in self.slices.keys())
            ready = [s for s in waiting if self._end(s) <= mark]
            for s in ready:                                               # in the order of time
                n = self.slices.getValue((s,))[0]
                found = {}
                for part in range(n):
                    for k, t, i in zip(*self.parts.getValue((s, part)), strict=True):
                        found.setdefault(_same(k), []).append((t, i is not None, i or 0))
                for k, mine in found.items():
                    mine.sort()
                    hits, anchors[k] = _fold([r[0] for r in mine], anchors.get(k), ttl_us)
                    for (_, known, i), hit in zip(mine, hits, strict=True):
                        yield Row(k=k, i=i if known else None, hit=hit)
                for part in range(n):
                    self.parts.removeKey((s, part))
                self.slices.removeKey((s,))
            later = waiting[len(ready):]
            # the watermark may stand within the first waiting slice; every later request of the other keys is a miss
            begin = min(mark, later[0] * width // 1000) if later else mark
            live = {k: t for k, t in anchors.items() if self._expires(t) > begin}
            if later or live:
                at = self._end(later[0]) if later else max(map(self._expires, live.values()))
                self._set(list(live), list(live.values()), 0, at)
            else:
                self.anchors.clear()

        @staticmethod
        def _end(s: int) -> int:
            return -(-(s + 1) * width // 1000)

        @staticmethod
        def _expires(t0: int) -> int:
            return (t0 + ttl_us) // 1000 + 1

        def close(self):
            pass

    bucket = F.pmod(F.xxhash64(key), F.lit(int(buckets))).cast("int")
    keyed = stream.withWatermark(ts, watermark).select(bucket.alias("b"), F.col(key).alias("k"), F.col(ident).cast("long").alias("i"),
                                                       F.unix_micros(F.col(ts)).alias("t"), ts)
    out = keyed.groupBy("b").transformWithState(
        Hits(), f"k {kind}, i long, hit boolean", "Append", "EventTime")
    return out.select(F.col("k").alias(key), F.col("i").alias(ident), "hit")
