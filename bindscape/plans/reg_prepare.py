"""Registered queries: preparation, de-duplication, splits, cleaning filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import clean, splits
from bindscape.plans import views as V
from bindscape.plans import workflows as W
from bindscape.plans.oracle_views import with_views
from bindscape.plans.registry import r6, register
from bindscape.session import cut_lineage

DS_RANK_SQL = "case source_dataset when 'davis' then 0 when 'kiba' then 1 when 'bindingdb' then 2 else 3 end"
SP_RANK_SQL = ("case source_split when 'train' then 0 when 'test' then 1 when 'valid' then 2 "
               "when 'validation' then 3 when 'train_fold_0' then 4 when 'test_fold_0' then 5 else 6 end")

F1_SQL_CORE = f"""
d as (select * from (
  select *, row_number() over (partition by compound, protein
     order by {DS_RANK_SQL}, {SP_RANK_SQL}, l_orderkey, l_linenumber) rn
  from t_interactions) x where rn = 1)"""

PKD_SQL = "case when affinity > 100 then -log10(affinity*1e-9) else affinity end"


@register("F1_dedup_pairs", with_views(f"""
with {F1_SQL_CORE}
select compound_id, protein_id, l_orderkey, l_linenumber, source_dataset, source_split from d""",
                                      "t_interactions"))
def q_f1(spark, sf):
    d = W.first_interactions(V.interactions_ids(spark, sf), V.compounds(spark, sf), V.proteins(spark, sf))
    return d.select("compound_id", "protein_id", "l_orderkey", "l_linenumber", "source_dataset",
                    "source_split")


@register("D4_interaction_summary", with_views(f"""
with {F1_SQL_CORE},
p as (select *, {PKD_SQL} as pKd from d),
f as (select *, cast(pKd >= 6.0 as int) as binding_label from p where pKd between 4.0 and 12.0 and not isnan(pKd))
select count(*) as total_interactions, count(distinct protein) as unique_proteins,
 count(distinct compound) as unique_compounds,
 cast(sum(case when binding_label = 1 then 1 else 0 end) as bigint) as positive_interactions,
 round(avg(case when binding_label = 1 then 1.0 else 0.0 end), 6) as binding_ratio,
 round(min(pKd), 6) as min_pkd, round(max(pKd), 6) as max_pkd, round(avg(pKd), 6) as mean_pkd
from f""", "t_interactions"))
def q_d4(spark, sf):
    from bindscape.operators.profile import interaction_summary
    prof = W.interaction_profile_normalized(V.interactions_ids(spark, sf), V.compounds(spark, sf),
                                            V.proteins(spark, sf))
    s = interaction_summary(prof, protein="canon_p", compound="canon_c")
    return s.select("total_interactions", "unique_proteins", "unique_compounds", "positive_interactions",
                    r6("binding_ratio").alias("binding_ratio"), r6("min_pkd").alias("min_pkd"),
                    r6("max_pkd").alias("max_pkd"), r6("mean_pkd").alias("mean_pkd"))


SPLIT_SQL = f"""
with {F1_SQL_CORE},
r as (select *, row_number() over (order by md5(concat_ws('|', compound, protein, '42')), compound, protein) as shuffle_rank,
             count(*) over () as n from d)"""


def _hashed_pairs(spark, sf):
    comp, prot = V.compounds(spark, sf), cut_lineage(V.proteins(spark, sf))     # read three times
    return W.with_pair_hash(W.first_interactions(V.interactions_ids(spark, sf), comp, prot), comp, prot)


@register("F2_ratio_split", with_views(SPLIT_SQL + """
select compound_id, protein_id, shuffle_rank,
 case when shuffle_rank <= floor(n*0.8) then 'train'
      when shuffle_rank <= floor(n*0.8) + floor(n*0.1) then 'validation' else 'test' end as split
from r""", "t_interactions"))
def q_f2(spark, sf):
    d = _hashed_pairs(spark, sf)
    return splits.ratio_split(d, ("canon_c", "canon_p"), hash_col="pair_hash").select(
        "compound_id", "protein_id", "shuffle_rank", "split")


@register("F3_two_stage_split", with_views(SPLIT_SQL + """
select compound_id, protein_id, shuffle_rank,
 case when shuffle_rank <= ceil(n*0.2) then 'test'
      when shuffle_rank <= ceil(n*0.2) + ceil((n - ceil(n*0.2))*0.25) then 'validation' else 'train' end as split
from r""", "t_interactions"))
def q_f3(spark, sf):
    d = _hashed_pairs(spark, sf)
    return splits.two_stage_split(d, ("canon_c", "canon_p"), hash_col="pair_hash").select(
        "compound_id", "protein_id", "shuffle_rank", "split")


@register("P1_prepare_training", with_views(SPLIT_SQL + f""",
s as (select *, case when shuffle_rank <= floor(n*0.8) then 'train'
      when shuffle_rank <= floor(n*0.8) + floor(n*0.1) then 'validation' else 'test' end as split from r),
p as (select *, {PKD_SQL} as pKd from s
      where length(protein) > 10 and length(protein) < 1024 and length(compound) > 5 and length(compound) < 200)
select compound_id, protein_id, l_orderkey, l_linenumber, split, round(pKd, 6) as pKd,
       cast(pKd >= 6.0 as int) as binding_label, md5(protein) as protein_md5, compound
from p where pKd between 4.0 and 12.0 and not isnan(pKd)""", "t_interactions"))
def q_p1(spark, sf):
    out = W.prepare_training_normalized(V.interactions_ids(spark, sf), V.compounds(spark, sf),
                                        V.proteins(spark, sf))
    return out.select("compound_id", "protein_id", "l_orderkey", "l_linenumber", "split",
                      r6("pKd").alias("pKd"), "binding_label", F.md5("protein").alias("protein_md5"), "compound")


@register("F4_sample_n", with_views("""
select l_orderkey, l_linenumber, compound_id, protein_id from t_interactions_ids
order by md5(concat_ws('|', l_orderkey, l_linenumber, '42')), l_orderkey, l_linenumber limit 1000""",
                                    "t_interactions_ids"))
def q_f4(spark, sf):
    ids = V.interactions_ids(spark, sf)
    return splits.sample_n(ids, 1000, ["l_orderkey", "l_linenumber"], 42) \
        .select("l_orderkey", "l_linenumber", "compound_id", "protein_id")


def _provenance_frames(spark, sf):
    ids = V.interactions_ids(spark, sf)
    frames = []
    for ds in splits.DATASET_ORDER:
        for sp in ("train", "test"):
            part = ids.filter((F.col("source_dataset") == ds) & (F.col("source_split") == sp))
            if ds == "davis":
                part = part.select("l_orderkey", "l_linenumber", "compound_id", "protein_id", "affinity")
            elif ds == "kiba":
                part = part.select("l_orderkey", "l_linenumber", "compound_id", "protein_id", "affinity",
                                   (F.col("l_linenumber") % 2).alias("kiba_flag"))
            else:
                part = part.select("l_orderkey", "l_linenumber", "compound_id", "protein_id")
            frames.append((ds, sp, part))
    return frames


@register("G2_union_with_provenance", with_views("""
select l_orderkey, l_linenumber, compound_id, protein_id, round(affinity, 6) as affinity,
       cast(null as bigint) as kiba_flag, source_dataset, source_split
from t_interactions_ids where source_dataset = 'davis'
union all
select l_orderkey, l_linenumber, compound_id, protein_id, round(affinity, 6), l_linenumber % 2,
       source_dataset, source_split
from t_interactions_ids where source_dataset = 'kiba'
union all
select l_orderkey, l_linenumber, compound_id, protein_id, null, null, source_dataset, source_split
from t_interactions_ids where source_dataset = 'bindingdb'""", "t_interactions_ids"))
def q_g2(spark, sf):
    u = splits.union_with_provenance(_provenance_frames(spark, sf))
    return u.select("l_orderkey", "l_linenumber", "compound_id", "protein_id", r6("affinity").alias("affinity"),
                    F.col("kiba_flag").cast("long").alias("kiba_flag"), "source_dataset", "source_split")


@register("G3_drop_exact_duplicates", with_views("""
select distinct compound_id, protein_id, source_dataset from t_interactions_ids""", "t_interactions_ids"))
def q_g3(spark, sf):
    return splits.drop_exact_duplicates(
        V.interactions_ids(spark, sf).select("compound_id", "protein_id", "source_dataset"))


VALID_PROT_SQL = "regexp_full_match(upper(replace(replace({c}, ' ', ''), chr(10), '')), '[ACDEFGHIKLMNPQRSTVWY]+')"
STRIP_SQL = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def valid_smiles_sql(c: str) -> str:
    s = STRIP_SQL.format(c=c)
    return (f"(length({s}) >= 3 and length({s}) - length(replace({s}, '(', '')) = "
            f"length({s}) - length(replace({s}, ')', '')) and length({s}) - length(replace({s}, '[', '')) = "
            f"length({s}) - length(replace({s}, ']', '')))")


@register("B7_clean_interactions", with_views(f"""
select compound, md5(protein) as protein_md5, round(affinity, 6) as affinity, source_dataset,
       length(protein) as protein_length, length(compound) as compound_length
from (select distinct compound, protein, affinity, source_dataset from t_interactions
      where protein = upper(replace(replace(protein, ' ', ''), chr(10), ''))
        and coalesce({VALID_PROT_SQL.format(c='protein')}, false)
        and compound = {STRIP_SQL.format(c='compound')} and coalesce({valid_smiles_sql('compound')}, false)) x""",
                                               "t_interactions"))
def q_b7(spark, sf):
    comp, prot = V.compounds(spark, sf), V.proteins(spark, sf)
    c = W.clean_normalized(V.interactions_ids(spark, sf), comp, prot, ["affinity", "source_dataset"])
    # a canonical id is an id of its dimension: the strings of the final rows come back by it
    c = (c.join(comp.select(F.col("compound_id").alias("canon_c"), "compound"), "canon_c")
          .join(prot.select(F.col("protein_id").alias("canon_p"), F.md5("protein").alias("protein_md5")), "canon_p"))
    return c.select("compound", "protein_md5", r6("affinity").alias("affinity"),
                    "source_dataset", F.col("protein_length").cast("long").alias("protein_length"),
                    F.col("compound_length").cast("long").alias("compound_length"))


@register("B8_filter_length_ranges", with_views("""
select l_orderkey, l_linenumber from t_interactions
where length(protein) > 10 and length(protein) < 1024 and length(compound) > 5 and length(compound) < 200""",
                                                 "t_interactions"))
def q_b8(spark, sf):
    return clean.filter_length_ranges(V.interactions(spark, sf)).select("l_orderkey", "l_linenumber")


@register("B9_to_pkd", with_views(f"""
select l_orderkey, l_linenumber, round({PKD_SQL}, 6) as pKd from t_interactions_ids""", "t_interactions_ids"))
def q_b9(spark, sf):
    return V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber",
                                                r6(clean.to_pkd("affinity")).alias("pKd"))


@register("B10_filter_pkd_range", with_views(f"""
select l_orderkey, l_linenumber from (select *, {PKD_SQL} as pKd from t_interactions_ids) x
where pKd between 4.0 and 12.0 and not isnan(pKd)""", "t_interactions_ids"))
def q_b10(spark, sf):
    d = V.interactions_ids(spark, sf).withColumn("pKd", clean.to_pkd("affinity"))
    return clean.filter_pkd_range(d).select("l_orderkey", "l_linenumber")


@register("B11_binding_label", with_views(f"""
select l_orderkey, l_linenumber, cast({PKD_SQL} >= 6.0 as int) as label_6,
       cast({PKD_SQL} >= 7.0 as int) as label_7 from t_interactions_ids""", "t_interactions_ids"))
def q_b11(spark, sf):
    d = V.interactions_ids(spark, sf).withColumn("pKd", clean.to_pkd("affinity"))
    return d.select("l_orderkey", "l_linenumber", clean.binding_label("pKd", 6.0).alias("label_6"),
                    clean.binding_label("pKd", 7.0).alias("label_7"))


@register("B12_valid_affinity", with_views("""
select l_orderkey, l_linenumber from t_interactions_ids where not isnan(affinity) and affinity > 0""",
                                            "t_interactions_ids"))
def q_b12(spark, sf):
    return clean.valid_affinity(V.interactions_ids(spark, sf)).select("l_orderkey", "l_linenumber")


@register("P2_preprocess_dataset", with_views(f"""
with t as (select compound, protein, affinity, source_dataset, {PKD_SQL} as pKd,
                  cast({PKD_SQL} >= 6.0 as int) as binding_label from t_interactions),
dp as (select distinct protein from t),
pv as (select protein, coalesce({VALID_PROT_SQL.format(c='protein')}, false) as v,
              length(upper(replace(replace(protein, ' ', ''), chr(10), ''))) as n from dp),
dc as (select distinct compound from t),
cv as (select compound, coalesce({valid_smiles_sql('compound')}, false) as v from dc),
g as (select compound, protein, affinity, source_dataset, pKd, binding_label, count(*) as c from t group by all),
cl as (select distinct compound, protein, affinity, source_dataset, pKd, binding_label from t
       where protein = upper(replace(replace(protein, ' ', ''), chr(10), ''))
         and coalesce({VALID_PROT_SQL.format(c='protein')}, false)
         and compound = {STRIP_SQL.format(c='compound')} and coalesce({valid_smiles_sql('compound')}, false))
select 'protein' as section, 'total_proteins' as metric, cast(count(*) as double) as value from pv
union all select 'protein', 'valid_proteins', cast(sum(cast(v as int)) as double) from pv
union all select 'protein', 'length_min', min(case when v then n end) from pv
union all select 'protein', 'length_max', max(case when v then n end) from pv
union all select 'protein', 'length_mean', round(avg(case when v then n end), 6) from pv
union all select 'protein', 'length_median', round(quantile_cont(case when v then n end, 0.5), 6) from pv
union all select 'drug', 'total_drugs', cast(count(*) as double) from cv
union all select 'drug', 'valid_drugs', cast(sum(cast(v as int)) as double) from cv
union all select 'interaction', 'total_interactions', cast(count(*) as double) from t
union all select 'interaction', 'unique_proteins', cast(count(protein) as double) from dp
union all select 'interaction', 'unique_compounds', cast(count(compound) as double) from dc
union all select 'interaction', 'positive_interactions', cast(sum(binding_label) as double) from t
union all select 'interaction', 'binding_ratio', round(avg(binding_label), 6) from t
union all select 'interaction', 'min_pkd', round(min(pKd), 6) from t
union all select 'interaction', 'max_pkd', round(max(pKd), 6) from t
union all select 'interaction', 'mean_pkd', round(avg(pKd), 6) from t
union all select 'quality', 'duplicate_interactions', cast(sum(c - 1) as double) from g
union all select 'quality', 'missing_compound', cast(sum(case when compound is null then c else 0 end) as double) from g
union all select 'quality', 'missing_protein', cast(sum(case when protein is null then c else 0 end) as double) from g
union all select 'quality', 'missing_affinity', cast(sum(case when affinity is null then c else 0 end) as double) from g
union all select 'quality', 'missing_source_dataset', cast(sum(case when source_dataset is null then c else 0 end) as double) from g
union all select 'quality', 'missing_pKd', cast(sum(case when pKd is null then c else 0 end) as double) from g
union all select 'quality', 'missing_binding_label', cast(sum(case when binding_label is null then c else 0 end) as double) from g
union all select 'quality', 'protein_quality', round(avg(cast(v as int)) * 100.0, 6) from pv where protein is not null
union all select 'quality', 'drug_quality', round(avg(cast(v as int)) * 100.0, 6) from cv where compound is not null
union all select 'quality', 'overall_quality_score', round(((select avg(cast(v as int)) from pv where protein is not null) + (select avg(cast(v as int)) from cv where compound is not null)) * 50.0, 6)
union all select 'cleaned', 'rows', cast(count(*) as double) from cl
union all select 'cleaned', 'protein_length', cast(sum(length(protein)) as double) from cl
union all select 'cleaned', 'compound_length', cast(sum(length(compound)) as double) from cl""", "t_interactions"))
def q_p2(spark, sf):
    facts = V.interactions_ids(spark, sf).select("compound_id", "protein_id", "affinity", "source_dataset")
    facts = facts.withColumn("pKd", clean.to_pkd("affinity")).withColumn("binding_label", clean.binding_label("pKd"))
    prot, drug, inter, quality, cleaned = W.preprocess_dataset_normalized(
        facts, V.compounds(spark, sf), V.proteins(spark, sf))

    def long(df, section, metrics):
        return df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics])))
            .alias("metric", "value")).select(F.lit(section).alias("section"), "metric", "value")

    parts = [
        long(prot, "protein", ["total_proteins", "valid_proteins", "length_min", "length_max", "length_mean",
                               "length_median"]),
        long(drug, "drug", ["total_drugs", "valid_drugs"]),
        long(inter, "interaction", inter.columns),
        quality.select(F.lit("quality").alias("section"), "metric", "value"),
        long(cleaned.agg(F.count(F.lit(1)).alias("rows"), F.sum("protein_length").alias("protein_length"),
                         F.sum("compound_length").alias("compound_length")), "cleaned",
             ["rows", "protein_length", "compound_length"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("section", "metric", r6("value").alias("value"))


@register("B13_required_columns", with_views("""
select 'complete' as input, count(*) as n_rows, null::varchar as error from t_interactions_ids
union all select 'no affinity', 0, 'Missing required columns: [''affinity'']'""", "t_interactions_ids"))
def q_b13(spark, sf):
    """A table with all required columns, and one without: an empty result and the error."""
    ids = V.interactions_ids(spark, sf)
    out = None
    for name, df in (("complete", ids), ("no affinity", ids.drop("affinity"))):
        rows, error = splits.checked_columns(df, ["compound_id", "protein_id", "affinity"])
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("input"), "n_rows", F.lit(error).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out
