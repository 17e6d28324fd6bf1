"""Streaming latency windows, rolling figures over an unbounded log, streaming scoring of new pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.functions import scoring as K
from bindscape.operators.clean import validate_pair
from bindscape.operators.ranking import prefix_sums
from bindscape.session import cut_lineage
from bindscape.streaming.ttl import ROCKSDB


def stream_latency(log: DataFrame, ts: str = "ts", latency: str = "latency_ms",
                   window: str = "1 hour", watermark: str = "10 minutes", exact: bool = False) -> DataFrame:
    """Per event-time window: requests, mean, max and p95 latency; rows
    later than the watermark are dropped. ``percentile_approx`` keeps a
    bounded sketch per window (the exact percentile would buffer a window);
    ``exact`` is for batch use. ``stream_latency_counts`` with
    ``latency_of_counts`` is the exact form for a stream."""
    w = log.withWatermark(ts, watermark) if log.isStreaming else log
    p95 = F.percentile(latency, 0.95) if exact else F.percentile_approx(latency, 0.95, 10000)
    return w.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.avg(latency).alias("avg_latency_ms"),
        F.max(latency).alias("max_latency_ms"), p95.alias("p95_latency_ms"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "n_requests", "avg_latency_ms", "max_latency_ms", "p95_latency_ms")


def stream_latency_counts(log: DataFrame, ts: str = "ts", latency: str = "latency_ms",
                          window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """J2, the stream's part: requests ``n`` per event-time window and latency
    (null latencies included); rows later than the watermark are dropped."""
    w = log.withWatermark(ts, watermark) if log.isStreaming else log
    return w.groupBy(F.window(ts, window).alias("w"), latency).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), latency, "n")


def latency_of_counts(counts: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """J2 from the counts that the sink holds: per window requests, mean, max and
    exact p95, the smallest latency that 95 % of the window's latencies do not
    exceed. Running counts go over all windows in one order, so a busy window
    is spread over many tasks; null latencies count as requests only."""
    known = F.when(F.col(latency).isNotNull(), F.col("n")).otherwise(F.lit(0))
    rows = prefix_sums(counts.withColumn("_m", known).withColumn("_place", F.struct("window_start", latency)), "_place", ["_m"])
    window = ["window_start", "window_end"]
    per = rows.groupBy(*window).agg(
        F.sum("n").alias("n_requests"),
        F.try_divide(F.sum(F.col(latency) * F.col("n")), F.sum("_m")).alias("avg_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.sum("_m").alias("_all"), F.min(F.col("cum__m") - F.col("_m")).alias("_before"))
    reached = F.col(latency).isNotNull() & ((F.col("cum__m") - F.col("_before")) * 20 >= F.col("_all") * 19)
    p95 = (rows.join(per.select(*window, "_all", "_before"), window).where(reached)
               .groupBy(*window).agg(F.min(latency).alias("p95_latency_ms")))
    return per.drop("_all", "_before").join(p95, window, "left")


FIGURES = ("avg_latency_ms", "median_latency_ms", "p95_latency_ms", "p99_latency_ms", "min_latency_ms", "max_latency_ms",
           "std_latency_ms", "sub_120ms_rate")


def sliding_report(panes: DataFrame, latency: str = "latency_ms", slide: str = "1 hour", n_panes: int = 6,
                   threshold_ms: float = 120.0) -> DataFrame:
    """J2 from the counts of ``stream_latency_counts`` with windows of one ``slide``: D13 (requests, mean, median, p95, p99,
    extremes, sample deviation, share under the threshold; exact, linear percentiles) for the overlapping windows of
    ``n_panes`` slides. The stream keeps every request in one count only; the windows that share
    a pane merge its counts here. Null latencies are left out, windows without requests do not appear.

    Running counts go over all windows in one order, so a busy window is spread over many tasks."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(n_panes - 1))).alias("_back")
    known = panes.where(F.col(latency).isNotNull() & ~F.isnan(latency)).select("window_start", latency, "n", starts)
    start = F.col("window_start") - F.col("_back") * F.expr(f"interval {slide}")
    merged = known.select(start.alias("window_start"), latency, "n").groupBy("window_start", latency).agg(F.sum("n").alias("n"))
    rows = prefix_sums(merged.withColumn("_place", F.struct("window_start", latency)), "_place", ["n"]).drop("_place")
    x, n = F.col(latency), F.col("n")
    per = cut_lineage(rows.groupBy("window_start").agg(
        F.sum("n").alias("n_requests"), (F.sum(x * n) / F.sum("n")).alias("avg_latency_ms"), F.min(x).alias("min_latency_ms"),
        F.max(x).alias("max_latency_ms"), (F.sum(F.when(x < threshold_ms, n).otherwise(0)) / F.sum("n")).alias("sub_120ms_rate"),
        F.min(F.col("cum_n") - n).alias("_before")))
    joined = rows.join(per.select("window_start", "n_requests", "_before", "avg_latency_ms"), "window_start")
    upto, total = F.col("cum_n") - F.col("_before"), F.col("n_requests")
    ranks = {f"{name}_{end}": (q, end) for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)) for end in ("lo", "hi")}

    def place(q):
        return F.lit(q) * (total - 1)

    at = [F.min(F.when(upto > (F.floor(place(q)) if end == "lo" else F.ceil(place(q))), x)).alias(name)
          for name, (q, end) in ranks.items()]
    square = (x - F.col("avg_latency_ms")) * (x - F.col("avg_latency_ms")) * n
    spread = joined.groupBy("window_start").agg(*at, F.sum(square).alias("_ss"))
    out = per.join(spread, "window_start")
    for name, q in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
        part = place(q) - F.floor(place(q))
        out = out.withColumn(f"{name}_latency_ms", F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part)
    out = out.withColumn("std_latency_ms", F.sqrt(F.when(total > 1, F.col("_ss") / (total - 1))))
    end = F.col("window_start") + F.lit(n_panes) * F.expr(f"interval {slide}")
    return out.select("window_start", end.alias("window_end"), "n_requests", *FIGURES)


def rolling_latency_stream(stream: DataFrame, root: str, delay: str = "1 hour", ts: str = "ts", value: str = "latency_ms",
                           ident: str = "event_id", width: int = 1000):
    """F5 (request count, mean, p95 and p99 of the last ``width`` latencies) over an unbounded log whose rows
    arrive in any order within ``delay``; returns the stream writer. Results are in ``root/out``, a folder per batch.

    Each micro-batch releases the requests older than the latest time seen less ``delay``, in the order of (time, id), and
    runs the batch operator over them and the ``width - 1`` released last; nothing runs in one task. Between
    batches it keeps, in ``root/state``, those last requests, the waiting ones, the number released and the time mark.
    All that a batch writes lies in folders of its number and is made from the folder before, so a batch that is
    repeated after a failure gives the same rows again. Requests behind the mark are dropped. Rows with a null
    time are dropped."""
    from bindscape.operators.windows import rolling_latency
    spark = stream.sparkSession
    schema = f"{ident} long, _t long, {value} double"

    def step(batch: DataFrame, number: int) -> None:
        here, last = f"{root}/state/{number}", f"{root}/state/{number - 1}"
        if number:
            carry, waiting = (spark.read.schema(schema).parquet(f"{last}/{x}") for x in ("carry", "waiting"))
            mark, released = spark.read.parquet(f"{last}/meta").first()
        else:
            carry = waiting = spark.createDataFrame([], schema)
            mark, released = None, 0
        rows = batch.select(F.col(ident).cast("long").alias(ident), F.unix_micros(F.col(ts)).alias("_t"),
                            F.col(value).cast("double").alias(value)).where("_t is not null")
        waiting = cut_lineage(waiting.unionByName(rows if mark is None else rows.where(F.col("_t") >= mark)))
        latest = waiting.agg((F.timestamp_micros(F.max("_t")) - F.expr(f"interval {delay}")).alias("m")).select(
            F.unix_micros("m")).first()[0]
        mark = max(x for x in (mark, latest, -(1 << 62)) if x is not None)
        ready = waiting.where(F.col("_t") < mark)
        held, n = carry.count(), ready.count()
        frame = cut_lineage(carry.unionByName(ready))
        # the last requests come first in the order, their figures were given before
        figures = rolling_latency(frame, value, width, "_t", (ident,)).where(F.col("request_count") > held)
        (figures.withColumn("request_count", F.col("request_count") + F.lit(released - held))
                .write.mode("overwrite").parquet(f"{root}/out/batch={number}"))
        # at most width - 1 rows
        frame.orderBy(F.desc("_t"), F.desc(ident)).limit(width - 1).write.mode("overwrite").parquet(f"{here}/carry")
        waiting.where(F.col("_t") >= mark).write.mode("overwrite").parquet(f"{here}/waiting")
        spark.createDataFrame([(mark, released + n)], "mark long, released long").write.mode("overwrite").parquet(f"{here}/meta")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/chk")


def _dimension(table: DataFrame, ident: str, text: str, of=None) -> DataFrame:
    """``ident``, ``text`` and, as ``_text``, what the scorer needs of a text, kept for all batches: made once per row, dealt
    by ``ident`` and in its order, so that a batch reads it and does not deal or sort it again (an adaptive plan would
    not pass on how the kept rows are dealt)."""
    conf = table.sparkSession.conf
    d = table.select(ident, text, *([] if of is None else [of(F.col(text)).alias(f"_{text}")])).where(F.col(ident).isNotNull())
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(d.repartition(int(conf.get("spark.sql.shuffle.partitions")), ident).sortWithinPartitions(ident))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def stream_score(requests: DataFrame, ts: str, protein: str = "protein", compound: str = "compound",
                 delay: str = "7 days", *, scorer, proteins: DataFrame | None = None, compounds: DataFrame | None = None,
                 protein_id: str = "protein_id", compound_id: str = "compound_id") -> DataFrame:
    """Validate -> pair key -> drop keys already seen within the watermark
    delay -> score the new pairs. Invalid pairs are dropped here (they carry
    the B6 error text in the batch form).

    Requests have the two strings, or, with the lists ``proteins`` and ``compounds``, their ids: the strings then meet the requests
    of each batch, where they are checked and make the key, and go no further. A scorer of descriptors (``of_protein``, ``of_compound`` and ``of``, as
    ``LinearAffinity``) gets those made once per row of the lists, so no sequence goes with the pairs to the state; for others
    the strings go along. Requests with an id that a list does not have are dropped.

    The keys of a stream are kept in RocksDB (the session's state store is set to it), so they need not fit an executor's memory."""
    if (proteins is None) != (compounds is None):
        raise ValueError("proteins and compounds are given together")
    described = proteins is not None and all(hasattr(scorer, x) for x in ("of", "of_protein", "of_compound"))
    if proteins is not None:
        of_protein, of_compound = (scorer.of_protein, scorer.of_compound) if described else (None, None)
        requests = (requests.join(_dimension(compounds, compound_id, compound, of_compound), compound_id)
                            .join(_dimension(proteins, protein_id, protein, of_protein), protein_id))
    v = validate_pair(requests, protein, compound).filter("is_valid")
    keyed = v.withColumn("pair_key", K.pair_key(protein, compound))
    if described:
        keyed = keyed.drop(protein, compound)
    if keyed.isStreaming:
        keyed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        keyed = keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["pair_key"])
    else:
        keyed = keyed.dropDuplicates(["pair_key"])
    if described:
        score = scorer.of(F.col(f"_{compound}"), F.col(f"_{protein}"))
        return keyed.withColumn("binding_affinity", score).drop(f"_{compound}", f"_{protein}")
    return keyed.withColumn("binding_affinity", scorer(F.col(protein), F.col(compound)))
