"""End-to-end compositions (P1-P5) as single lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.operators import clean, splits
from bindscape.session import cut_lineage


def prepare_training(df: DataFrame, ratios=(0.8, 0.1, 0.1), seed: int = 42,
                     threshold: float = 6.0, row_order=("l_orderkey", "l_linenumber"),
                     n_parts: int | None = None) -> DataFrame:
    """Require columns -> keep-first per pair -> exact-size shuffle split
    -> per-split length filters, pKd, range filter, label.

    The split is a column, so the three splits are one plan; the filters run
    after the cut, as in the reference, so final ratios drift. Two shuffles:
    the pair de-duplication and the range-partitioned rank."""
    splits.require_columns(df, ["compound", "protein", "affinity"])
    first = splits.dedup_pairs(df, ("compound", "protein"), row_order)
    cut = splits.ratio_split(first, ("compound", "protein"), ratios, seed, n_parts=n_parts)
    return clean.add_training_columns(cut, "affinity", threshold)


def interaction_profile_normalized(facts: DataFrame, compounds: DataFrame, proteins: DataFrame,
                                   threshold: float = 6.0, row_order=("l_orderkey", "l_linenumber")) -> DataFrame:
    """Minimum slice over the normalized star: keep-first per (compound,
    protein) string pair via canonical ids -> pKd -> range filter -> label.
    Rows keep ``canon_c`` / ``canon_p``, whose distinct counts equal the
    distinct string counts, so the summary needs no sequence column."""
    first = first_interactions(facts, compounds, proteins, row_order)
    out = clean.filter_pkd_range(first.withColumn("pKd", clean.to_pkd("affinity")))
    return out.withColumn("binding_label", clean.binding_label("pKd", threshold))


def preprocess_dataset(df: DataFrame, protein: str = "protein", compound: str = "compound"):
    """(protein summary, drug summary, interaction summary, quality, cleaned rows).

    All five outputs derive from one table of distinct rows with their
    multiplicity (``groupBy(all columns).count()``): one shuffle of the input;
    every later step shuffles distinct rows only, and the planner reuses the
    shared exchange when the outputs are evaluated in one plan."""
    from bindscape.operators import profile
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    rows = g.drop("_c")
    return (profile.protein_summary(rows.select(protein), protein),
            profile.drug_summary(rows.select(compound), compound),
            profile.interaction_summary(g, protein, compound, weight="_c"),
            profile.data_quality(g, protein, compound, count_col="_c"),
            clean.clean_interactions(rows, protein, compound, distinct_input=True))


def canonical_ids(compounds: DataFrame, proteins: DataFrame):
    """Canonical id per distinct string (its smallest id) for both dimensions:
    ``(cmap: compound_id -> canon_c, pmap: protein_id -> canon_p, canon_c, canon_p)``, the last two
    with one row and string per canonical id. Strings are compared by their md5, worked out once
    per row, so no shuffle groups or joins on a string. The canonical id of a null string is null:
    nulls group as one, are not counted as a distinct string and have no row in the last two."""
    def one(dim, ident, text, canon):
        keyed = dim.select(ident, F.md5(text).alias("_h"))
        first = keyed.where("_h is not null").groupBy("_h").agg(F.min(ident).alias(canon))
        named = dim.join(first.select(canon), F.col(ident) == F.col(canon)).select(canon, text)
        # a null meets nothing under its own id (no md5 is that short), so nulls are spread over the tasks
        own = keyed.withColumn("_h", F.coalesce("_h", F.col(ident).cast("string")))
        return own.join(first, "_h", "left").select(ident, canon), named
    cmap, canon_c = one(compounds, "compound_id", "compound", "canon_c")
    pmap, canon_p = one(proteins, "protein_id", "protein", "canon_p")
    return cmap, pmap, canon_c, canon_p


def keyed_interactions(facts: DataFrame, compounds: DataFrame, proteins: DataFrame) -> DataFrame:
    """Facts with ``canon_c`` and ``canon_p``: equality of the strings is (null-safe) equality of these ids."""
    cmap, pmap, _, _ = canonical_ids(compounds, proteins)
    return facts.join(cmap, "compound_id").join(pmap, "protein_id")


def first_interactions(facts: DataFrame, compounds: DataFrame, proteins: DataFrame,
                       row_order=("l_orderkey", "l_linenumber")) -> DataFrame:
    """F1 over the normalized star: the first row per pair of strings, found on canonical ids."""
    return splits.dedup_pairs(keyed_interactions(facts, compounds, proteins), ("canon_c", "canon_p"), row_order)


def with_pair_hash(rows: DataFrame, compounds: DataFrame, proteins: DataFrame, seed: int = 42) -> DataFrame:
    """Rows with ``canon_c`` / ``canon_p`` -> plus ``pair_hash`` (md5 of compound, protein and seed) and both
    lengths. The strings are met once, protein last, and dropped in the same stage; the rows are written to the shared
    folder, as the ranks that follow read them twice (a sample for the ranges, then the rows)."""
    _, _, canon_c, canon_p = canonical_ids(compounds, proteins)
    # lengths are counted once per string, not once per pair
    met = (rows.join(canon_c.withColumn("compound_length", F.length("compound")), "canon_c", "left")
               .join(canon_p.withColumn("protein_length", F.length("protein")), "canon_p", "left"))
    return cut_lineage(met.select(*rows.columns, F.md5(F.concat_ws("|", "compound", "protein", F.lit(str(seed)))).alias("pair_hash"),
                                  "compound_length", "protein_length"))


def preprocess_dataset_normalized(facts: DataFrame, compounds: DataFrame, proteins: DataFrame,
                                  attrs=("affinity", "source_dataset", "pKd", "binding_label")):
    """P2 over a normalized star (facts keyed by ids + the two dimensions).
    Same five outputs as ``preprocess_dataset`` on the joined table (whose
    columns are ``compound, protein`` + ``attrs``), but fact-side work groups
    canonical ids; sequences are touched once per distinct value."""
    from bindscape.functions import protein as PF
    from bindscape.functions import smiles as SF
    from bindscape.operators import profile
    cmap, pmap, canon_c, canon_p = canonical_ids(compounds, proteins)
    keyed = facts.join(cmap, "compound_id").join(pmap, "protein_id").select("canon_c", "canon_p", *attrs)
    # the distinct-row table (ids and attributes) feeds all five outputs: written once to the shared folder
    g = cut_lineage(keyed.groupBy("canon_c", "canon_p", *attrs).agg(F.count(F.lit(1)).alias("_c")))
    # the distinct sequences in use, written once: three of the outputs read them
    used_p = cut_lineage(g.select("canon_p").distinct().join(canon_p, "canon_p", "left"))
    used_c = g.select("canon_c").distinct().join(canon_c, "canon_c", "left")
    prot = profile.protein_summary(used_p.select("protein"))
    drug = profile.drug_summary(used_c.select("compound"))
    # interaction summary: one row assembled from three one-row aggregates by union + max
    w = F.col("_c")
    lab, pk = "binding_label", "pKd"
    n = F.sum(w).cast("long")
    pos = F.sum(F.when(F.col(lab) == 1, w).otherwise(0)).cast("long")
    a = g.agg(n.alias("total_interactions"), F.lit(None).cast("long").alias("unique_proteins"),
              F.lit(None).cast("long").alias("unique_compounds"), pos.alias("positive_interactions"),
              (pos / n).alias("binding_ratio"), F.min(pk).alias("min_pkd"), F.max(pk).alias("max_pkd"),
              (F.sum(F.col(pk) * w) / F.sum(F.when(F.col(pk).isNotNull(), w))).alias("mean_pkd"))
    b = used_p.agg(F.count("protein").alias("unique_proteins"))
    c = used_c.agg(F.count("compound").alias("unique_compounds"))
    inter = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    inter = inter.agg(*[F.max(x).alias(x) for x in a.columns])
    quality = quality_normalized(g, used_p, used_c, attrs)
    cols = ["compound", "protein", *attrs]
    # cleaned rows: distinct id rows whose strings pass, strings joined back once
    ok_p = used_p.filter((F.col("protein") == PF.normalize_protein("protein")) & PF.is_valid_protein("protein"))
    ok_c = used_c.filter((F.col("compound") == SF.strip("compound")) & SF.is_valid_smiles("compound"))
    cleaned = (g.drop("_c").join(ok_c, "canon_c").join(ok_p, "canon_p").select(*cols)
                .withColumn("protein_length", F.length("protein"))
                .withColumn("compound_length", F.length("compound")))
    return prot, drug, inter, quality, cleaned


def quality_normalized(g: DataFrame, used_p: DataFrame, used_c: DataFrame, attrs) -> DataFrame:
    """D5 from distinct id rows ``(canon_c, canon_p, attrs..., _c)`` and the distinct strings in use:
    duplicates and nulls from the rows, valid shares from the strings that are not null; ``(metric, value)``."""
    from bindscape.functions import protein as PF
    from bindscape.functions import smiles as SF
    w = F.col("_c")
    nulls = [("canon_c", "compound"), ("canon_p", "protein"), *[(x, x) for x in attrs]]
    q1 = g.agg(F.sum(w - 1).cast("double").alias("duplicate_interactions"),
               *[F.sum(F.when(F.col(x).isNull(), w).otherwise(0)).cast("double").alias(f"missing_{n}") for x, n in nulls])
    long1 = q1.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in q1.columns]),
                                                  F.array(*[F.col(x) for x in q1.columns]))).alias("metric", "value"))
    vp = used_p.where("protein is not null").agg(F.avg(PF.is_valid_protein("protein").cast("double")).alias("pq"))
    vd = used_c.where("compound is not null").agg(F.avg(SF.is_valid_smiles("compound").cast("double")).alias("dq"))
    shares = vp.unionByName(vd, allowMissingColumns=True).agg(
        F.coalesce(F.max("pq"), F.lit(0.0)).alias("pq"), F.coalesce(F.max("dq"), F.lit(0.0)).alias("dq"))
    long2 = shares.select(F.explode(F.map_from_arrays(
        F.array(F.lit("protein_quality"), F.lit("drug_quality"), F.lit("overall_quality_score")),
        F.array(F.col("pq") * 100, F.col("dq") * 100, (F.col("pq") + F.col("dq")) * 50))).alias("metric", "value"))
    return long1.unionByName(long2)


def clean_normalized(facts: DataFrame, compounds: DataFrame, proteins: DataFrame, attrs) -> DataFrame:
    """B7 over the normalized star: the distinct rows whose strings pass, as canonical ids, attributes and
    both lengths. The tests run once per dimension row; facts shuffle ids only."""
    from bindscape.functions import protein as PF
    from bindscape.functions import smiles as SF
    _, _, canon_c, canon_p = canonical_ids(compounds, proteins)
    ok_p = canon_p.where((F.col("protein") == PF.normalize_protein("protein")) & PF.is_valid_protein("protein")).select(
        "canon_p", F.length("protein").alias("protein_length"))
    ok_c = canon_c.where((F.col("compound") == SF.strip("compound")) & SF.is_valid_smiles("compound")).select(
        "canon_c", F.length("compound").alias("compound_length"))
    rows = keyed_interactions(facts, compounds, proteins).select("canon_c", "canon_p", *attrs).dropDuplicates()
    return rows.join(ok_c, "canon_c").join(ok_p, "canon_p")


def prepare_training_normalized(facts: DataFrame, compounds: DataFrame, proteins: DataFrame,
                                ratios=(0.8, 0.1, 0.1), seed: int = 42, threshold: float = 6.0,
                                row_order=("l_orderkey", "l_linenumber"), n_parts: int | None = None,
                                with_strings: bool = True) -> DataFrame:
    """P1 over a normalized star: facts keyed by ``compound_id`` / ``protein_id``
    plus the two dimension tables. Same result as ``prepare_training`` on the
    joined table, but keep-first, rank and filters run on ids, the pair hash
    and the two lengths; the strings join the final rows (or not at all, with
    ``with_strings=False``: the ids name them)."""
    # the sequences are read four times (md5, canonical ids, pair hash, final rows): written once
    proteins = cut_lineage(proteins.select("protein_id", "protein"))
    first = first_interactions(facts, compounds, proteins, row_order)
    hashed = with_pair_hash(first, compounds, proteins, seed)
    cut = splits.ratio_split(hashed, ("canon_c", "canon_p"), ratios, seed, n_parts=n_parts, hash_col="pair_hash")
    kept = cut.where(clean.lengths_in_range(F.col("protein_length"), F.col("compound_length")))
    out = clean.filter_pkd_range(kept.withColumn("pKd", clean.to_pkd("affinity")))
    out = out.withColumn("binding_label", clean.binding_label("pKd", threshold))
    if with_strings:
        out = (out.join(compounds.select("compound_id", "compound"), "compound_id")
                  .join(proteins.select("protein_id", "protein"), "protein_id"))
    return out.drop("canon_c", "canon_p", "pair_hash")


def parsed_predictions(scored: DataFrame, text_col: str | None = None, y: str = "y_true",
                       score: str = "score") -> DataFrame:
    """``(y_true, score)`` with the probability read out of generated text (I27; without a
    text column the score is rendered as the model line)."""
    from bindscape.functions.scoring import parse_probability
    text = F.col(text_col) if text_col else F.concat(F.lit("Binding Probability: "), F.col(score).cast("string"))
    return scored.select(F.col(y).alias("y_true"), parse_probability(text).alias("score"))


def evaluate_predictions(scored: DataFrame, text_col: str | None = None, y: str = "y_true",
                         score: str = "score", threshold: float = 0.5, out: str | None = None) -> DataFrame:
    """Classification, ROC and PR metrics of the parsed predictions as one long
    ``(metric, value)`` table (unioned one-row aggregates, no join). With ``out`` the metrics
    are also written there as one JSON row without curves (A12)."""
    from bindscape.operators import metrics as M
    from bindscape.sources.writers import write_metrics
    t = parsed_predictions(scored, text_col, y, score)
    cm = M.classification_metrics(t, "y_true", "score", threshold)
    names = ["accuracy", "precision", "recall", "f1_score", "specificity", "npv",
             "true_positives", "false_positives", "true_negatives", "false_negatives"]
    long = cm.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])))
        .alias("metric", "value"))
    for name, one in (("roc_auc", M.roc_auc(t)), ("pr_auc", M.pr_auc(t))):
        long = long.unionByName(one.select(F.lit(name).alias("metric"), F.col(name).alias("value")))
    if out is not None:
        # a dozen rows: one row with a column per metric
        write_metrics(long.groupBy().pivot("metric", [*names, "roc_auc", "pr_auc"]).agg(F.first("value")), out)
    return long


def evaluation_curves(scored: DataFrame, text_col: str | None = None, y: str = "y_true",
                      score: str = "score") -> DataFrame:
    """Both curves as ``(curve, threshold, x, y)``: ROC with x = fpr, y = tpr, and PR with
    x = recall, y = precision."""
    from bindscape.operators import metrics as M
    t = parsed_predictions(scored, text_col, y, score)
    roc = M.roc_curve(t).select(F.lit("roc").alias("curve"), "threshold", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    pr = M.pr_curve(t).select(F.lit("pr").alias("curve"), "threshold", F.col("recall").alias("x"), F.col("precision").alias("y"))
    return roc.unionByName(pr)


def score_with_uncertainty(samples: DataFrame, pair_cols, value: str, temperature: float | None,
                           reliability: DataFrame | None = None) -> DataFrame:
    """P5: Monte-Carlo aggregate per pair (D11) -> interval (E10) -> calibrated mean (E8), and with
    ``reliability`` (pair columns, ``reliability``; E9 over C7) the reliability score, 0.5 for a
    pair that has none."""
    from bindscape.operators import metrics as M
    from bindscape.operators import reports as R
    mc = R.uncertainty_interval(R.mc_aggregate(samples, pair_cols, value))
    out = M.calibrate(mc, "mean_prediction", temperature)
    if reliability is not None:
        out = out.join(reliability.select(*pair_cols, F.col("reliability").alias("reliability_score")), list(pair_cols), "left")
        out = out.withColumn("reliability_score", F.coalesce("reliability_score", F.lit(0.5)))
    return out


def screening_summary(preds: DataFrame, affinity: str = "binding_affinity") -> DataFrame:
    """Total, average, count above 8.0, max and min; zeros when empty."""
    a = F.col(affinity)
    return preds.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.coalesce(F.avg(a), F.lit(0.0)).alias("avg_binding_affinity"),
        F.coalesce(F.sum(F.when(a > 8.0, 1).otherwise(0)), F.lit(0)).cast("long").alias("high_affinity_count"),
        F.coalesce(F.max(a), F.lit(0.0)).alias("max_binding_affinity"),
        F.coalesce(F.min(a), F.lit(0.0)).alias("min_binding_affinity"))


def screened_scores(proteins: DataFrame, compounds: DataFrame, scorer) -> DataFrame:
    """The scores of the full screen of two lists as ``(binding_affinity, n)``, ``n`` pairs each (rows may repeat a
    score), without making pairs.

    The fitted scorer knows a compound by the number of its letters and a protein by its hydrophobic share. Compounds are
    counted per number of letters (as many rows as the longest SMILES has letters, at most), proteins per share; each
    share meets the small table as one array, and the score expression is the screen's own, rounding included.
    ``proteins`` may bring the share as ``_share`` in place of the text."""
    from bindscape.functions.affinity import LinearAffinity, hydrophobic_share, letter_count
    if not isinstance(scorer, LinearAffinity):
        raise TypeError("a summary without pairs needs a scorer of descriptors")
    letters = compounds.groupBy(letter_count("compound").alias("letters")).agg(F.count(F.lit(1)).alias("m"))
    every = letters.agg(F.collect_list(F.struct("letters", "m")).alias("h"))
    share = F.col("_share") if "_share" in proteins.columns else hydrophobic_share("protein")
    shares = cut_lineage(proteins.groupBy(share.alias("share")).agg(F.count(F.lit(1)).alias("k")))
    met = shares.withColumn("h", every.scalar()).select("share", "k", F.explode("h").alias("c"))
    return met.select(scorer.of(F.col("c.letters"), F.col("share")).alias("binding_affinity"), (F.col("k") * F.col("c.m")).alias("n"))


def counted_screening_summary(scores: DataFrame) -> DataFrame:
    """D6 of ``screened_scores``, and ``strong_pairs``."""
    from bindscape.functions.scoring import binding_strength
    a, n = F.col("binding_affinity"), F.col("n")
    strong = binding_strength("binding_affinity")["binding_strength"] == "Strong"

    def pairs(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("long")

    return scores.agg(
        pairs(F.lit(True)).alias("total_processed"),
        F.coalesce(F.sum(a * n) / F.sum(F.when(a.isNotNull(), n)), F.lit(0.0)).alias("avg_binding_affinity"),
        pairs(a > 8.0).alias("high_affinity_count"),
        F.coalesce(F.max(a), F.lit(0.0)).alias("max_binding_affinity"),
        F.coalesce(F.min(a), F.lit(0.0)).alias("min_binding_affinity"),
        pairs(strong).alias("strong_pairs"))


def run_screen(proteins: DataFrame, compounds: DataFrame, scorer) -> DataFrame:
    """Screen validated lists (C3 with the fitted scorer), classify strength
    (I21) and summarise (D6) as a long ``(metric, value)`` table; no pair is made for the summary."""
    agg = counted_screening_summary(screened_scores(proteins, compounds, scorer)).withColumnRenamed("total_processed", "total")
    names = ["total", "avg_binding_affinity", "high_affinity_count", "max_binding_affinity", "min_binding_affinity", "strong_pairs"]
    return agg.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("metric", "value"))


def approved_compounds(df: DataFrame, limit: int, phase: str = "max_phase") -> DataFrame:
    """Compounds with max_phase = 4, first ``limit`` by id."""
    return df.filter(F.col(phase) == 4).orderBy("compound_id").limit(int(limit))


def keyword_search(df: DataFrame, text: str, keyword: str, key: str, limit: int) -> DataFrame:
    """Case-insensitive substring match, first ``limit`` by id."""
    return df.filter(F.lower(F.col(text)).contains(keyword.lower())).orderBy(key).limit(int(limit))
