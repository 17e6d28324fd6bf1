"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a repetition rate: its target share of the output bytes over its own
bytes. Each document draws its number of copies from a Poisson distribution with
that mean, by inverting the distribution at a uniform number hashed from the seed
and its id: the draw is the same on every run, partitioning and retry. Copies are
exploded and put in one global random order by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

SEED = 42
#: Exponent of the default target: weights in proportion to bytes ** ALPHA.
ALPHA = 0.5
#: A larger rate is drawn as a sum of independent draws of at most this mean (exact, and free of underflow).
PIECE_RATE = 32.0
#: Copies exploded at a time.
CHUNK = 1 << 16
BROADCAST_BYTES = 16 << 20


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) with 52 bits from the md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_draw(u: Column, rate: Column) -> Column:
    """Smallest k with P(X <= k) > u for X ~ Poisson(rate), rate at most ``PIECE_RATE``: the terms are
    summed until they pass u or no longer change the sum. A rate of zero gives 0."""
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] > u, s).otherwise(F.struct(i.alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(steps, start, step, lambda s: s["k"])


def copies(seed: Column, ident: Column, rate: Column) -> Column:
    """Copies of a document: a Poisson draw of mean ``rate`` at the uniform number of (seed, id). A rate
    above ``PIECE_RATE`` is cut into equal pieces, the further ones drawn at (seed, id, number)."""
    pieces = F.greatest(F.ceil(rate / PIECE_RATE), F.lit(1)).cast("int")

    def draw(j: Column) -> Column:
        u = F.when(j == 0, uniform(seed, ident)).otherwise(uniform(seed, ident, j))
        return poisson_draw(u, rate / pieces).cast("long")

    one = poisson_draw(uniform(seed, ident), rate).cast("long")
    many = F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0).cast("long"), lambda s, j: s + draw(j))
    return F.when(pieces == 1, one).otherwise(many)


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                     text_col: str = "text", alpha: float = ALPHA, total_bytes: float | None = None) -> DataFrame:
    """``(src, rate)`` per source. ``weights`` is a table ``(source, weight)``; a source that it does
    not name gets weight 0 (dropped by design); without it weights are bytes ** ``alpha``.
    ``total_bytes`` is the wanted output size, by default the input's. Rates count the text's
    UTF-8 bytes plus one per document, so that empty texts have a size too; null is a source."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    sizes = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        named = weights.select(F.col("source").alias("name"), F.col("weight").cast("double").alias("w"))
        weighed = sizes.join(named, F.col("src").eqNullSafe(F.col("name")), "left").select(
            "src", "bytes", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = cut_lineage(weighed)
    sums = weighed.agg(F.sum("w").alias("w"), F.sum("bytes").alias("b")).first()
    if not sums["w"]:
        return weighed.select("src", F.lit(0.0).alias("rate"))
    out = float(total_bytes if total_bytes is not None else sums["b"])
    return weighed.select("src", (F.col("w") * F.lit(out) / F.lit(float(sums["w"])) / F.col("bytes")).alias("rate"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text", alpha: float = ALPHA,
                seed: int = SEED, total_bytes: float | None = None) -> DataFrame:
    """``docs`` with each row repeated by its draw, plus ``__copy`` (from 0) and ``__order`` (the
    hash by which rows are globally shuffled; the result comes in that order).

    Rows with equal ids draw alike; null ids draw as an empty id; a null source is a source of
    its own. Empty and null texts are kept at their source's rate. Columns keep their names;
    an empty table stays empty."""
    rates = repetition_rates(docs, weights, source_col, text_col, alpha, total_bytes)
    names = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("src") + 64), F.lit(0))).first()
    rates = rates.select(F.col("src").alias("__src"), F.col("rate").alias("__rate"))
    if names[1] + names[0] * 64 <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    drawn = (docs.join(rates, docs[source_col].eqNullSafe(F.col("__src")))
             .withColumn("__n", copies(F.lit(seed), F.col(id_col), F.col("__rate")))
             .where("__n > 0")
             .select(*cols, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))).alias("__c"))
             .select(*cols, F.explode(F.sequence("__c", F.least(F.col("__c") + CHUNK, F.col("__n")) - 1)).alias("__copy")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                            F.col("__copy").cast("string")))
    # the hash is uniform: equal ranges of its first digits need no sample, so every number is drawn once
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    return drawn.withColumn("__order", key).repartitionById(parts, part).sortWithinPartitions("__order")
