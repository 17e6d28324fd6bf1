"""Joins and pair generation: matrix melt, bounded pair samples, screening,
id resolution, per-target lookups and cache splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindscape.functions import protein as P
from bindscape.functions.affinity import LinearAffinity, hydrophobic_share, letter_count
from bindscape.operators.ranking import hash_key
from bindscape.session import cut_lineage


# A list of up to this many bytes is broadcast by the full screen.
BROADCAST_BYTES = 64 << 20


def residue_info_table(spark: SparkSession) -> DataFrame:
    """The fixed 20-row residue table as a dimension table (size bounded by the alphabet)."""
    rows = [(a, v[0], v[1], v[2], v[3], float(v[4])) for a, v in P.RESIDUE_INFO.items()]
    return spark.createDataFrame(rows, "aa string, name string, type string, charge string, "
                                       "hydrophobic boolean, mw double")


def lipinski_veber(df: DataFrame, mw="molecular_weight", logp="alogp", hbd="hbd", hba="hba",
                   rotatable=None, tpsa=None) -> DataFrame:
    """Violations on given descriptors (missing -> 0), compliance,
    Veber checks when those columns exist, score max(0, 1 - .25 v)."""
    def g(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    v = ((g(mw) > 500).cast("int") + (g(logp) > 5).cast("int") + (g(hbd) > 5).cast("int")
         + (g(hba) > 10).cast("int"))
    out = (df.withColumn("violations", v)
             .withColumn("lipinski_compliant", F.col("violations") <= 1)
             .withColumn("drug_likeness_score",
                         F.greatest(F.lit(0.0), F.lit(1.0) - F.col("violations") * F.lit(0.25))))
    if rotatable:
        out = out.withColumn("rotatable_bonds_ok", g(rotatable) <= 10)
    if tpsa:
        out = out.withColumn("tpsa_ok", g(tpsa) <= 140)
    return out


def melt_affinity(ligands: DataFrame, proteins: DataFrame, matrix: DataFrame, dataset: str) -> DataFrame:
    """Long matrix ``(i, j, affinity)`` joined positionally to ligand ``(i, compound)``
    and protein ``(j, protein)`` lists; invalid affinities dropped; ids
    ``DS_%04d`` and ``DS_PROT_%04d``. Equi-joins on the positions: the
    planner broadcasts a list only when it is measured small."""
    ds = dataset.upper()
    m = matrix.filter(~F.isnan("affinity") & (F.col("affinity") > 0))
    j = m.join(ligands, "i").join(proteins, "j")
    return j.select(
        "compound", "protein", "affinity",
        F.format_string(f"{ds}_%04d", F.col("i")).alias("compound_id"),
        F.format_string(f"{ds}_PROT_%04d", F.col("j")).alias("protein_id"),
        F.lit(dataset).alias("dataset"),
    )


def sample_pairs(ligands: DataFrame, proteins: DataFrame, n: int = 100, cap: int = 10000,
                 seed: int = 42, ligand_key: str = "compound_id", protein_key: str = "protein_id") -> DataFrame:
    """Deterministic sample of at most ``n`` rows per side (smallest
    ``md5(key|seed)``), all pairs in (ligand, protein) sample order, at most
    ``cap`` pairs, flagged ``synthetic``. Both sides are bounded by ``n`` before
    they meet, so the pair set is at most n*n rows."""
    ls = (ligands.withColumn("_lh", hash_key([ligand_key], seed)).orderBy("_lh", ligand_key).limit(n))
    ps = (proteins.withColumn("_ph", hash_key([protein_key], seed)).orderBy("_ph", protein_key).limit(n))
    pairs = ls.crossJoin(F.broadcast(ps))
    return (pairs.orderBy("_lh", ligand_key, "_ph", protein_key).limit(cap)
                 .drop("_lh", "_ph").withColumn("synthetic", F.lit(True)))


def _described(proteins: DataFrame, compounds: DataFrame, scorer):
    """Both lists, with the descriptors of a descriptor-based scorer worked out once per list row
    (written, as a generated loop over pairs would work them out again for each pair)."""
    if not isinstance(scorer, LinearAffinity):
        return proteins, compounds
    return (cut_lineage(proteins.withColumn("_share", hydrophobic_share("protein"))),
            compounds.withColumn("_letters", letter_count("compound")))


def _labelled(pairs: DataFrame, protein_idx: str, compound_idx: str, scorer) -> DataFrame:
    if isinstance(scorer, LinearAffinity):
        score = scorer.of(F.col("_letters"), F.col("_share"))
    else:
        score = scorer(F.col("protein"), F.col("compound"))
    return pairs.select(
        protein_idx, compound_idx, "protein", "compound",
        F.concat(F.lit("protein_"), F.col(protein_idx).cast("string")).alias("protein_label"),
        F.concat(F.lit("drug_"), F.col(compound_idx).cast("string")).alias("drug_label"),
        F.concat(F.substring("protein", 1, 50), F.lit("...")).alias("sequence_label"),
        score.alias("binding_affinity"))


def screen(proteins: DataFrame, compounds: DataFrame, protein_idx: str = "protein_idx",
           compound_idx: str = "compound_idx", *, scorer) -> DataFrame:
    """Every (protein, compound) pair of two request lists, scored. The full
    product is the operator's documented output; ``screen_pairs`` is the form
    for a large library. Labels are ``protein_<i>`` / ``drug_<j>`` and the
    sequence label is the first 50 residues plus ``...``."""
    proteins, compounds = _described(proteins, compounds, scorer)
    # the inner list is written once; up to BROADCAST_BYTES it is broadcast, else read by each task of the product
    inner = cut_lineage(compounds)
    size = inner.agg(F.sum(F.octet_length("compound") + 64)).first()[0] or 0
    pairs = proteins.crossJoin(F.broadcast(inner) if size <= BROADCAST_BYTES else inner)
    return _labelled(pairs, protein_idx, compound_idx, scorer)


def screen_pairs(pairs: DataFrame, proteins: DataFrame, compounds: DataFrame, protein_idx: str = "protein_idx",
                 compound_idx: str = "compound_idx", *, scorer) -> DataFrame:
    """C3 over a relation of requested pairs ``(protein_idx, compound_idx)``: each distinct pair once,
    by two equi-joins; ids that a list does not have are left out."""
    proteins, compounds = _described(proteins, compounds, scorer)
    asked = pairs.select(protein_idx, compound_idx).dropDuplicates()
    return _labelled(asked.join(compounds, compound_idx).join(proteins, protein_idx), protein_idx, compound_idx, scorer)


def resolve_by_id(requests: DataFrame, dim: DataFrame, ref: str, inline: str, dim_key: str,
                  dim_value: str, out: str) -> DataFrame:
    """C4: id given -> dimension lookup (missing -> status not_found), else the inline value."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_value).alias("_v"))
    j = requests.join(d, requests[ref] == d["_k"], "left")
    status = (F.when(F.col(ref).isNull(), F.lit("inline"))
               .when(F.col("_k").isNull(), F.lit("not_found")).otherwise(F.lit("resolved")))
    return (j.withColumn(out, F.when(F.col(ref).isNull(), F.col(inline)).otherwise(F.col("_v")))
             .withColumn("status", status).drop("_k", "_v"))


def compounds_for_target(activities: DataFrame, compounds: DataFrame, n: int = 10,
                         target: str = "protein_id", compound: str = "compound_id",
                         order_cols=("l_orderkey", "l_linenumber"), keep=("affinity",)) -> DataFrame:
    """Per target, each compound's first activity (input order), the first
    ``n`` compounds by that activity, joined to the compound record.

    The first activity is ``min(struct(order..., fields))`` per (target,
    compound) - combined map-side, so a hot target is reduced before the
    shuffle; the per-target top-n then runs on one row per pair."""
    first = activities.groupBy(target, compound).agg(
        F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in keep])).alias("_a"))
    w = Window.partitionBy(target).orderBy(*[F.col(f"_a.{c}") for c in order_cols], F.col(compound))
    top = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(compounds, compound)
               .select(target, compound, "rank", *[F.col(f"_a.{c}").alias(c) for c in (*order_cols, *keep)],
                       *[c for c in compounds.columns if c != compound]))


def binding_data(activities: DataFrame, pairs: DataFrame, keys=("compound_id", "protein_id")) -> DataFrame:
    """Every activity of the requested (compound, target) pairs (equi-join on both keys)."""
    return activities.join(pairs.select(*keys).distinct(), list(keys), "left_semi")


def split_cached(requests: DataFrame, cache: DataFrame, key: str = "cache_key",
                 value: str = "cached_score", *, scorer) -> DataFrame:
    """C10 over a cache of keys: hits take the cached value; a miss is scored from its key by ``scorer``. One left
    join. ``score_store.score_requests`` keeps scores of pairs between runs."""
    cache = cache.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(value).alias("v"))).alias("_c"))
    j = requests.join(cache, F.col(key) == F.col("_k"), "left")
    return j.select(*[F.col(c) for c in requests.columns],
                    F.when(F.col("_k").isNotNull(), F.col("_c.v")).otherwise(scorer(F.col(key))).alias(value),
                    F.col("_k").isNotNull().alias("cached"))
