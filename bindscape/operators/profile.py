"""Profiles and summaries of interaction, protein, compound and embedding tables.

Every summary is a single aggregate (partial aggregation map-side, one small
shuffle); per-vector statistics stay inside the row as higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindscape.functions import protein as P
from bindscape.functions import smiles as S
from bindscape.operators.ranking import prefix_sums
from bindscape.operators.stats import percentile_aggs


def dataset_statistics(df: DataFrame, dataset: str = "source_dataset", split: str = "source_split",
                       compound: str = "compound", protein: str = "protein") -> DataFrame:
    """Per dataset the sorted split list, rows, distinct compounds and proteins."""
    return df.groupBy(dataset).agg(
        F.sort_array(F.collect_set(split)).alias("splits"),
        F.count(F.lit(1)).alias("total_interactions"),
        F.countDistinct(compound).alias("unique_compounds"),
        F.countDistinct(protein).alias("unique_proteins"),
    )


def protein_summary(df: DataFrame, protein: str = "protein") -> DataFrame:
    """Profile over distinct sequences (one row).

    A sequence is profiled where it is read and known by its md5 from then on, so no text is shuffled.
    Distinct sequences are reduced to a histogram keyed by valid length
    (invalid ones under key -1) with counts and sums; running counts over that
    histogram give the exact median, and one final aggregate gives the rest.
    No aggregate buffers raw values and no step joins two summaries."""
    norm = P.normalize_protein(protein)
    prof = df.select(
        F.md5(protein).alias("_h"),
        F.when(P.is_valid_protein(protein), F.length(norm)).otherwise(F.lit(-1)).alias("len_key"),
        P.property_groups(norm)["hydrophobic_pct"].alias("hydrophobic_pct"),
        P.residue_mw(norm).alias("molecular_weight"),
    ).distinct()
    hist = prof.groupBy("len_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hydrophobic_pct").alias("s_hyd"),
        F.sum("molecular_weight").alias("s_mw"))
    hist = hist.withColumn("nv", F.when(F.col("len_key") >= 0, F.col("n")).otherwise(F.lit(0)))
    # distinct lengths are bounded by the longest sequence, not by the row count
    cum = prefix_sums(hist, "len_key", ["nv"], bounded_domain=True)
    valid = F.col("len_key") >= 0
    nvalid = F.sum(F.when(valid, F.col("n")))
    return cum.agg(
        F.sum("n").alias("total_proteins"),
        F.coalesce(nvalid, F.lit(0)).alias("valid_proteins"),
        F.min(F.when(valid, F.col("len_key"))).alias("length_min"),
        F.max(F.when(valid, F.col("len_key"))).alias("length_max"),
        (F.sum(F.when(valid, F.col("len_key") * F.col("n"))) / nvalid).alias("length_mean"),
        *percentile_aggs_masked(cum),
        (F.sum(F.when(valid, F.col("s_hyd"))) / nvalid).alias("avg_hydrophobic_pct"),
        (F.sum(F.when(valid, F.col("s_mw"))) / nvalid).alias("avg_molecular_weight"),
    )


def percentile_aggs_masked(cum: DataFrame):
    key = F.when(F.col("len_key") >= 0, F.col("len_key"))
    return percentile_aggs(key, "cum_nv", "total_nv", [0.5], ["length_median"])


def drug_summary(df: DataFrame, compound: str = "compound") -> DataFrame:
    """D3: profile over distinct SMILES (one row)."""
    distinct = df.select(compound).distinct()
    s = S.strip(compound)
    lip = S.lipinski_estimated(s)
    est = S.estimated_properties(s)
    prof = distinct.select(S.is_valid_smiles(compound).alias("valid"),
                           lip["violations"].alias("violations"),
                           est["mw"].alias("mw"), est["logp"].alias("logp"))
    v = F.col("valid")
    return prof.agg(
        F.count(F.lit(1)).alias("total_drugs"),
        F.sum(v.cast("long")).alias("valid_drugs"),
        F.avg(F.when(v, F.col("violations"))).alias("avg_violations"),
        F.sum(F.when(v & (F.col("violations") <= 1), 1).otherwise(0)).cast("long").alias("drug_like_compounds"),
        F.try_divide(F.sum(F.when(v & (F.col("violations") <= 1), 1).otherwise(0)) * F.lit(100.0),
                     F.sum(v.cast("long"))).alias("drug_like_percentage"),
        F.avg(F.when(v, F.col("mw"))).alias("avg_molecular_weight"),
        F.avg(F.when(v, F.col("logp"))).alias("avg_logp"),
    )


def interaction_summary(df: DataFrame, protein: str = "protein", compound: str = "compound",
                        label: str = "binding_label", pkd: str = "pKd", weight: str | None = None) -> DataFrame:
    """Rows, distinct proteins and compounds, positives and ratio, pKd range.
    ``weight`` names a multiplicity column when the input is already grouped."""
    w = F.col(weight) if weight else F.lit(1)
    n = F.sum(w).cast("long")
    aggs = [n.alias("total_interactions"),
            F.countDistinct(protein).alias("unique_proteins"),
            F.countDistinct(compound).alias("unique_compounds")]
    if label in df.columns:
        pos = F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long")
        aggs += [pos.alias("positive_interactions"), (pos / n).alias("binding_ratio")]
    if pkd in df.columns:
        aggs += [F.min(pkd).alias("min_pkd"), F.max(pkd).alias("max_pkd"),
                 (F.sum(F.col(pkd) * w) / F.sum(F.when(F.col(pkd).isNotNull(), w))).alias("mean_pkd")]
    return df.agg(*aggs)


def data_quality(df: DataFrame, protein: str = "protein", compound: str = "compound",
                 count_col: str | None = None) -> DataFrame:
    """Long table ``(metric, value)``: valid shares of distinct proteins and
    compounds, overall score, null count per column, duplicate rows.

    Duplicates come from one group-by over whole rows (count - 1 per group);
    the share metrics from one aggregate with two distinct counts. The two
    branches are unioned, never joined."""
    if count_col:
        cols = [c for c in df.columns if c != count_col]
        grouped = df.withColumnRenamed(count_col, "_c")
    else:
        cols = df.columns
        grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    dup_nulls = grouped.agg(
        F.sum(F.col("_c") - 1).cast("double").alias("duplicate_interactions"),
        *[F.sum(F.when(F.col(c).isNull(), F.col("_c")).otherwise(0)).cast("double").alias(f"missing_{c}")
          for c in cols])
    names = ["duplicate_interactions"] + [f"missing_{c}" for c in cols]
    long1 = dup_nulls.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))).alias("metric", "value"))
    shares = grouped.agg(
        F.countDistinct(protein).alias("np"),
        F.countDistinct(F.when(P.is_valid_protein(protein), F.col(protein))).alias("vp"),
        F.countDistinct(compound).alias("nd"),
        F.countDistinct(F.when(S.is_valid_smiles(compound), F.col(compound))).alias("vd"),
    )
    pq = F.when(F.col("np") > 0, F.col("vp") / F.col("np")).otherwise(F.lit(0.0))
    dq = F.when(F.col("nd") > 0, F.col("vd") / F.col("nd")).otherwise(F.lit(0.0))
    long2 = shares.select(F.explode(F.map_from_arrays(
        F.array(F.lit("protein_quality"), F.lit("drug_quality"), F.lit("overall_quality_score")),
        F.array(pq * 100, dq * 100, (pq + dq) * 50))).alias("metric", "value"))
    return long1.unionByName(long2)


def embedding_stats(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Per vector dimension, mean, population std, min, max, range (in-row)."""
    v = F.col(vec)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumn("dim", n).withColumn("mean", mean)
    var = F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) \
        / F.col("dim")
    return (out.withColumn("std", F.sqrt(var))
               .withColumn("min", F.array_min(vec)).withColumn("max", F.array_max(vec))
               .withColumn("range", F.col("max") - F.col("min")))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], right-closed as pandas ``cut``
    (the first bin also holds the minimum); ``(bin, lower, upper, count)``.

    The range is one aggregate whose two numbers are read back (bounded);
    binning is then a projection with a partial aggregate per bin."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    lo, hi = float(lo), float(hi)
    w = (hi - lo) / bins
    if w == 0:
        b = F.lit(0)
    else:
        b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil((F.col(col) - F.lit(lo)) / F.lit(w)) - 1))
    return (df.select(b.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
              .withColumn("lower", F.lit(lo) + F.col("bin") * F.lit(w))
              .withColumn("upper", F.lit(lo) + (F.col("bin") + 1) * F.lit(w))
              .select("bin", "lower", "upper", "count"))


def _array_percentile(sorted_arr, p: float):
    n = F.size(sorted_arr)
    h = (n - 1) * F.lit(p)
    lo = F.floor(h)
    v_lo = F.element_at(sorted_arr, (lo + 1).cast("int"))
    v_hi = F.element_at(sorted_arr, (F.ceil(h) + 1).cast("int"))
    return v_lo + (h - lo) * (v_hi - v_lo)


def _let(value, body):
    """``body(value)`` with the value worked out once per row: a lambda's variable is never replaced by its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dimension_extremes(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Dimension indexes above the vector's p75 and below its p25 (in-row). The vector is sorted once per row."""
    v = F.col(vec)

    def extremes(p):
        idx = F.sequence(F.lit(0), F.size(v) - 1)
        return F.struct(p["p75"].alias("p75"), p["p25"].alias("p25"),
                        F.filter(idx, lambda i: v[i] > p["p75"]).alias("high_dims"),
                        F.filter(idx, lambda i: v[i] < p["p25"]).alias("low_dims"))

    def percentiles(s):
        return F.struct(_array_percentile(s, 0.75).alias("p75"), _array_percentile(s, 0.25).alias("p25"))

    one = _let(F.array_sort(v), lambda s: _let(percentiles(s), extremes))
    return df.withColumn("_x", one).select(*df.columns, *[F.col(f"_x.{c}").alias(c) for c in ("p75", "p25", "high_dims", "low_dims")])


def pooled_vectors(df: DataFrame, seq: str, vec: str, mask: str) -> DataFrame:
    """Per sequence the vector sum(v * mask) / sum(mask) over its tokens, ``(seq, pooled)``, null when every token
    is masked. One weighted vector mean per sequence, combined map-side; rows are never multiplied by dimensions. Null vectors and masks
    are left out; a null sequence is a sequence."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    live = df.where(F.col(vec).isNotNull() & (weight != 0)).groupBy(F.col(seq).alias("_seq")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)), weight)).alias("pooled"))
    every = df.groupBy(seq).agg(F.max(F.size(vec)).alias("_d"))
    return every.join(live, F.col(seq).eqNullSafe(F.col("_seq")), "left").select(
        seq, F.coalesce("pooled", F.array_repeat(F.lit(None).cast("double"), F.col("_d"))).alias("pooled"))


def masked_mean_pool(df: DataFrame, seq: str, vec: str, mask: str) -> DataFrame:
    """D18 in long form ``(seq, dim, value)``, from ``pooled_vectors``: one row per dimension of a result."""
    return pooled_vectors(df, seq, vec, mask).select(seq, F.posexplode("pooled").alias("dim", "value"))


def binding_coverage(sites: DataFrame, seqs: DataFrame, seq_id: str = "protein_id",
                     site_len: str = "site_len", seq: str = "protein") -> DataFrame:
    """Summed site residues / sequence length * 100 (overlaps not merged)."""
    per = sites.groupBy(seq_id).agg(F.sum(site_len).alias("binding_residues"))
    return (per.join(seqs.select(seq_id, F.length(seq).alias("sequence_length")), seq_id)
               .withColumn("coverage_pct",
                           F.when(F.col("sequence_length") > 0,
                                  F.col("binding_residues") * F.lit(100.0) / F.col("sequence_length"))))


def char_composition(df: DataFrame, col: str, top_n: int | None = None,
                     char_name: str = "residue", by=()) -> DataFrame:
    """Character counts with their share of all characters, over the
    corpus or per group of the ``by`` columns (e.g. per sequence), by count
    descending (ties by character). The explode feeds a partial aggregate in
    the same stage, so only (group, char, count) rows shuffle."""
    by = list(by)
    chars = df.select(*by, F.explode(F.split(F.col(col), "")).alias(char_name)).filter(F.col(char_name) != "")
    counts = chars.groupBy(*by, char_name).agg(F.count(F.lit(1)).alias("count"))
    # a group has one row per distinct character (bounded by the alphabet)
    out = counts.withColumn("percentage", F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy(*by)))
    if top_n is not None:
        out = out.orderBy(F.col("count").desc(), F.col(char_name)).limit(int(top_n))
    return out
