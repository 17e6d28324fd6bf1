"""Registered queries: profiles and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions import protein as P
from bindscape.operators import profile
from bindscape.plans import views as V
from bindscape.plans import workflows as W
from bindscape.plans.oracle_views import with_views
from bindscape.plans.reg_prepare import VALID_PROT_SQL, valid_smiles_sql
from bindscape.plans.reg_scalar import SP, cnt
from bindscape.plans.registry import joined, r6, register
from bindscape.session import cut_lineage

NORM = "upper(replace(replace(protein, ' ', ''), chr(10), ''))"


@register("D1_dataset_statistics", with_views("""
select source_dataset, array_to_string(list_sort(list_distinct(list(source_split))), ',') as splits,
 count(*) as total_interactions, count(distinct compound) as unique_compounds,
 count(distinct protein) as unique_proteins
from t_interactions group by source_dataset""", "t_interactions"))
def q_d1(spark, sf):
    keyed = W.keyed_interactions(V.interactions_ids(spark, sf), V.compounds(spark, sf), V.proteins(spark, sf))
    d = profile.dataset_statistics(keyed, compound="canon_c", protein="canon_p")
    return d.select("source_dataset", joined("splits").alias("splits"), "total_interactions",
                    "unique_compounds", "unique_proteins")


@register("D2_protein_summary", with_views(f"""
with d as (select distinct protein from t_proteins),
p as (select coalesce({VALID_PROT_SQL.format(c='protein')}, false) as v, {NORM} as n from d)
select count(*) as total_proteins, cast(sum(cast(v as int)) as bigint) as valid_proteins,
 min(case when v then length(n) end) as length_min, max(case when v then length(n) end) as length_max,
 round(avg(case when v then length(n) end), 6) as length_mean,
 round(quantile_cont(case when v then length(n) end, 0.5), 6) as length_median,
 round(avg(case when v then {cnt('n', P.HYDROPHOBIC)} * 100.0 / length(n) end), 6) as avg_hydrophobic_pct,
 round(cast(avg(case when v then ({' + '.join(f"{cnt('n', a)} * {v[4]}" for a, v in P.RESIDUE_INFO.items())})
       end) as double), 6) as avg_molecular_weight
from p""", "t_proteins"))
def q_d2(spark, sf):
    s = profile.protein_summary(V.proteins(spark, sf))
    return s.select("total_proteins", F.col("valid_proteins").cast("long").alias("valid_proteins"),
                    F.col("length_min").cast("long").alias("length_min"),
                    F.col("length_max").cast("long").alias("length_max"),
                    r6("length_mean").alias("length_mean"), r6("length_median").alias("length_median"),
                    r6("avg_hydrophobic_pct").alias("avg_hydrophobic_pct"),
                    r6("avg_molecular_weight").alias("avg_molecular_weight"))


_SPS = {k: v.replace("compound", "s") for k, v in SP.items()}


@register("D3_drug_summary", with_views(f"""
with d as (select distinct compound from t_compounds),
p as (select {valid_smiles_sql('compound')} as v, regexp_replace(compound, '^\\s+|\\s+$', '', 'g') as s from d),
q as (select v, {_SPS['viol']} as viol, {_SPS['mw']} as mw, {_SPS['logp']} as logp from p)
select count(*) as total_drugs, cast(sum(cast(v as int)) as bigint) as valid_drugs,
 round(avg(case when v then viol end), 6) as avg_violations,
 cast(sum(case when v and viol <= 1 then 1 else 0 end) as bigint) as drug_like_compounds,
 round(sum(case when v and viol <= 1 then 1 else 0 end) * 100.0 / sum(cast(v as int)), 6) as drug_like_percentage,
 round(avg(case when v then mw end), 6) as avg_molecular_weight,
 round(avg(case when v then logp end), 6) as avg_logp
from q""", "t_compounds"))
def q_d3(spark, sf):
    s = profile.drug_summary(V.compounds(spark, sf))
    return s.select("total_drugs", "valid_drugs", r6("avg_violations").alias("avg_violations"),
                    "drug_like_compounds", r6("drug_like_percentage").alias("drug_like_percentage"),
                    r6("avg_molecular_weight").alias("avg_molecular_weight"), r6("avg_logp").alias("avg_logp"))


@register("D5_data_quality", with_views(f"""
with t as (select compound, protein, affinity, source_dataset, source_split from t_interactions),
g as (select compound, protein, affinity, source_dataset, source_split, count(*) as c
      from t group by all),
s as (select count(distinct protein) as np,
             count(distinct case when coalesce({VALID_PROT_SQL.format(c='protein')}, false) then protein end) as vp,
             count(distinct compound) as nd,
             count(distinct case when coalesce({valid_smiles_sql('compound')}, false) then compound end) as vd
      from t)
select 'duplicate_interactions' as metric, cast(sum(c - 1) as double) as value from g
union all select 'missing_compound', cast(sum(case when compound is null then c else 0 end) as double) from g
union all select 'missing_protein', cast(sum(case when protein is null then c else 0 end) as double) from g
union all select 'missing_affinity', cast(sum(case when affinity is null then c else 0 end) as double) from g
union all select 'missing_source_dataset', cast(sum(case when source_dataset is null then c else 0 end) as double) from g
union all select 'missing_source_split', cast(sum(case when source_split is null then c else 0 end) as double) from g
union all select 'protein_quality', round(vp * 100.0 / np, 6) from s
union all select 'drug_quality', round(vd * 100.0 / nd, 6) from s
union all select 'overall_quality_score', round((vp * 1.0 / np + vd * 1.0 / nd) * 50, 6) from s""",
                                       "t_interactions"))
def q_d5(spark, sf):
    comp, prot = V.compounds(spark, sf), V.proteins(spark, sf)
    attrs = ["affinity", "source_dataset", "source_split"]
    keyed = W.keyed_interactions(V.interactions_ids(spark, sf), comp, prot)
    g = cut_lineage(keyed.groupBy("canon_c", "canon_p", *attrs).agg(F.count(F.lit(1)).alias("_c")))
    _, _, canon_c, canon_p = W.canonical_ids(comp, prot)
    q = W.quality_normalized(g, g.select("canon_p").distinct().join(canon_p, "canon_p"),
                             g.select("canon_c").distinct().join(canon_c, "canon_c"), attrs)
    return q.select("metric", r6("value").alias("value"))


@register("D8_embedding_stats", with_views("""
select vec_id, len(embedding) as dim, round(list_avg(embedding), 6) as mean,
 round(sqrt(list_sum(list_transform(embedding, x -> (x - list_avg(embedding)) * (x - list_avg(embedding)))) / len(embedding)), 6) as std,
 round(list_min(embedding), 6) as min, round(list_max(embedding), 6) as max,
 round(list_max(embedding) - list_min(embedding), 6) as range
from t_emb""", "t_emb"))
def q_d8(spark, sf):
    s = profile.embedding_stats(V.embeddings(spark, sf))
    return s.select("vec_id", F.col("dim").cast("long").alias("dim"),
                    *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "range")])


@register("D9_histogram", with_views("""
with v as (select unnest(embedding) as x from t_emb),
r as (select min(x) as lo, max(x) as hi from v)
select cast(least(19, greatest(0, ceil((x - lo) / ((hi - lo) / 20)) - 1)) as int) as bin, count(*) as count
from v, r group by all""", "t_emb"))
def q_d9(spark, sf):
    v = V.embeddings(spark, sf).select(F.explode("embedding").alias("x"))
    return profile.histogram(v, "x", 20).select("bin", "count")


def _arr_pct_sql(p):
    return (f"(list_sort(embedding)[cast(floor((len(embedding) - 1) * {p}) as int) + 1] + "
            f"((len(embedding) - 1) * {p} - floor((len(embedding) - 1) * {p})) * "
            f"(list_sort(embedding)[cast(ceil((len(embedding) - 1) * {p}) as int) + 1] - "
            f"list_sort(embedding)[cast(floor((len(embedding) - 1) * {p}) as int) + 1]))")


@register("D10_dimension_extremes", with_views(f"""
select vec_id,
 array_to_string(list_filter(range(0, len(embedding)), i -> embedding[i + 1] > {_arr_pct_sql(0.75)}), ',') as high_dims,
 array_to_string(list_filter(range(0, len(embedding)), i -> embedding[i + 1] < {_arr_pct_sql(0.25)}), ',') as low_dims
from t_emb""", "t_emb"))
def q_d10(spark, sf):
    d = profile.dimension_extremes(V.embeddings(spark, sf))
    return d.select("vec_id", joined("high_dims").alias("high_dims"), joined("low_dims").alias("low_dims"))


@register("D18_masked_mean_pool", with_views("""
select label, dim, round(sum(v * m) / sum(m), 6) as value from (
  select label, case when vec_id % 7 = 0 then 0 else 1 end as m,
         unnest(range(0, len(embedding))) as dim, unnest(embedding) as v from t_emb) x
group by label, dim""", "t_emb"))
def q_d18(spark, sf):
    e = V.embeddings(spark, sf).withColumn("m", F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1))
    return profile.masked_mean_pool(e, "label", "embedding", "m").select(
        "label", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


SITES_SQL = """select l_suppkey as protein_id, cast(l_linenumber + 4 as bigint) as site_len from lineitem"""


@register("D19_binding_coverage", with_views(f"""
with s as ({SITES_SQL}),
per as (select protein_id, sum(site_len) as binding_residues from s group by protein_id)
select per.protein_id, cast(binding_residues as bigint) as binding_residues, length(p.protein) as sequence_length,
 round(case when length(p.protein) > 0 then binding_residues * 100.0 / length(p.protein) end, 6) as coverage_pct
from per join t_proteins p on p.protein_id = per.protein_id""", "t_proteins"))
def q_d19(spark, sf):
    from bindscape.session import read_table
    sites = read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("protein_id"), (F.col("l_linenumber") + 4).cast("long").alias("site_len"))
    c = profile.binding_coverage(sites, V.proteins(spark, sf))
    return c.select("protein_id", F.col("binding_residues").cast("long").alias("binding_residues"),
                    F.col("sequence_length").cast("long").alias("sequence_length"),
                    r6("coverage_pct").alias("coverage_pct"))


@register("D20_residue_composition", with_views("""
with c as (select ch as residue, count(*) as count from
  (select unnest(string_split(protein, '')) as ch from t_proteins) a where ch <> '' group by ch)
select residue, count, round(count * 100.0 / sum(count) over (), 6) as percentage from c""", "t_proteins"))
def q_d20(spark, sf):
    c = profile.char_composition(V.proteins(spark, sf), "protein")
    return c.select("residue", "count", r6("percentage").alias("percentage"))


@register("D20_residue_composition_per_sequence", with_views("""
with c as (select protein_id, ch as residue, count(*) as count from
  (select protein_id, unnest(string_split(protein, '')) as ch from t_proteins) a where ch <> '' group by protein_id, ch)
select protein_id, residue, count, round(count * 100.0 / sum(count) over (partition by protein_id), 6) as percentage
from c""", "t_proteins"))
def q_d20s(spark, sf):
    c = profile.char_composition(V.proteins(spark, sf), "protein", by=["protein_id"])
    return c.select("protein_id", "residue", "count", r6("percentage").alias("percentage"))


@register("D21_smiles_char_frequency", with_views("""
with c as (select ch as "character", count(*) as count from
  (select unnest(string_split(compound, '')) as ch from t_compounds) a where ch <> '' group by ch)
select "character", count, round(count * 100.0 / sum(count) over (), 6) as percentage from c
order by count desc, "character" limit 10""", "t_compounds"))
def q_d21(spark, sf):
    c = profile.char_composition(V.compounds(spark, sf), "compound", top_n=10, char_name="character")
    return c.select("character", "count", r6("percentage").alias("percentage"))
