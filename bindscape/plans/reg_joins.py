"""Registered queries: joins, pair generation, similarity, access and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions import smiles as S
from bindscape.operators import access, joins, similarity
from bindscape.operators import clean
from bindscape.plans import views as V
from bindscape.plans.oracle_views import with_views
from bindscape.plans.reg_scalar import FIT_SQL, HASH_SCORE_SQL, fit_score_sql, fitted_scorer
from bindscape.plans.registry import r6, register
from bindscape.session import read_table

# --------------------------------------------------------------- C1 .. C6, C10


def _melt_inputs(spark, sf):
    comp = V.compounds(spark, sf)
    ligands = comp.select(F.col("compound_id").alias("i"), "compound")
    prots = V.proteins(spark, sf).select(F.col("protein_id").alias("j"), "protein")
    matrix = V.interactions_ids(spark, sf).select(F.col("compound_id").alias("i"),
                                                  F.col("protein_id").alias("j"), "affinity")
    return ligands, prots, matrix


@register("C1_melt_affinity", with_views("""
select printf('DAVIS_%04d', m.i) as compound_id, printf('DAVIS_PROT_%04d', m.j) as protein_id,
       round(m.affinity, 6) as affinity, l.compound, md5(p.protein) as protein_md5
from (select compound_id as i, protein_id as j, affinity from t_interactions_ids) m
join (select compound_id as i, compound from t_compounds) l on l.i = m.i
join (select protein_id as j, protein from t_proteins) p on p.j = m.j
where not isnan(m.affinity) and m.affinity > 0""", "t_interactions_ids", "t_compounds", "t_proteins"))
def q_c1(spark, sf):
    lig, prot, mat = _melt_inputs(spark, sf)
    m = joins.melt_affinity(lig, prot, mat, "davis")
    return m.select("compound_id", "protein_id", r6("affinity").alias("affinity"), "compound",
                    F.md5("protein").alias("protein_md5"))


@register("C2_sample_pairs", with_views("""
with l as (select compound_id, md5(concat_ws('|', compound_id, '42')) as h from t_compounds order by h, compound_id limit 100),
p as (select protein_id, md5(concat_ws('|', protein_id, '42')) as h from t_proteins order by h, protein_id limit 100)
select l.compound_id, p.protein_id, true as synthetic from l, p
order by l.h, l.compound_id, p.h, p.protein_id limit 10000""", "t_compounds", "t_proteins"))
def q_c2(spark, sf):
    s = joins.sample_pairs(V.compounds(spark, sf), V.proteins(spark, sf), 100, 10000)
    return s.select("compound_id", "protein_id", "synthetic")


def _screen_inputs(spark, sf):
    """Distinct valid proteins and distinct valid compounds (B2, B4), each
    numbered by its smallest id. Proteins are grouped by their md5; the string of the
    smallest id is joined back once, so no text is shuffled to be compared."""
    from bindscape.functions import protein as P
    from bindscape.session import cut_lineage
    valid = V.proteins(spark, sf).filter(P.is_valid_protein_strict("protein"))
    ids = cut_lineage(valid.groupBy(F.md5("protein").alias("h")).agg(F.min("protein_id").alias("protein_idx"))).select("protein_idx")
    texts = V.proteins(spark, sf)
    prots = texts.join(ids, texts["protein_id"] == ids["protein_idx"]).select("protein", "protein_idx")
    comps = (V.compounds(spark, sf).filter(S.is_valid_smiles("compound"))
             .groupBy("compound").agg(F.min("compound_id").alias("compound_idx")))
    return prots, comps


def _screen_shares(spark, sf):
    """Distinct valid proteins by md5, as their hydrophobic share alone, and the distinct valid compounds: one
    reading of the texts, none of which is moved."""
    from bindscape.functions import protein as P
    from bindscape.functions.affinity import hydrophobic_share
    valid = V.proteins(spark, sf).filter(P.is_valid_protein_strict("protein"))
    prots = valid.select(F.md5("protein").alias("h"), hydrophobic_share("protein").alias("_share")).groupBy("h").agg(
        F.min("_share").alias("_share"))
    return prots, V.compounds(spark, sf).filter(S.is_valid_smiles("compound")).select("compound").distinct()


SCREEN_SQL = f"""
with {FIT_SQL},
p as (select protein, min(protein_id) as protein_idx from t_proteins
           where regexp_full_match(upper(protein), '[ACDEFGHIKLMNPQRSTVWY]+') group by protein),
c as (select compound, min(compound_id) as compound_idx from t_compounds
      where length(trim(compound)) >= 3
        and length(compound) - length(replace(compound, '(', '')) = length(compound) - length(replace(compound, ')', ''))
        and length(compound) - length(replace(compound, '[', '')) = length(compound) - length(replace(compound, ']', ''))
      group by compound),
s as (select protein_idx, compound_idx, {fit_score_sql('protein', 'compound')} as binding_affinity,
             'protein_' || protein_idx as protein_label, 'drug_' || compound_idx as drug_label,
             substr(protein, 1, 50) || '...' as sequence_label from p, c)"""


@register("C3_screen", with_views(SCREEN_SQL + """
select protein_idx, compound_idx, binding_affinity, protein_label, drug_label, md5(sequence_label) as label_md5 from s""",
                                  "t_proteins", "t_compounds", "t_interactions"))
def q_c3(spark, sf):
    p, c = _screen_inputs(spark, sf)
    s = joins.screen(p, c, scorer=fitted_scorer(spark, sf))
    return s.select("protein_idx", "compound_idx", "binding_affinity", "protein_label", "drug_label",
                    F.md5("sequence_label").alias("label_md5"))


@register("C3_screen_pairs", with_views(f"""
with {FIT_SQL}
select distinct i.protein_id as protein_idx, i.compound_id as compound_idx,
 {fit_score_sql('p.protein', 'c.compound')} as binding_affinity
from t_interactions_ids i join t_proteins p on p.protein_id = i.protein_id join t_compounds c on c.compound_id = i.compound_id""",
                                        "t_interactions_ids", "t_proteins", "t_compounds", "t_interactions"))
def q_c3p(spark, sf):
    s = joins.screen_pairs(
        V.interactions_ids(spark, sf).select(F.col("protein_id").alias("protein_idx"), F.col("compound_id").alias("compound_idx")),
        V.proteins(spark, sf).withColumnRenamed("protein_id", "protein_idx"),
        V.compounds(spark, sf).withColumnRenamed("compound_id", "compound_idx"), scorer=fitted_scorer(spark, sf))
    return s.select("protein_idx", "compound_idx", "binding_affinity")


@register("P3_run_screen", with_views(SCREEN_SQL + """
select 'total' as metric, cast(count(*) as double) as value from s
union all select 'avg_binding_affinity', round(coalesce(avg(binding_affinity), 0), 6) from s
union all select 'high_affinity_count', cast(sum(case when binding_affinity > 8.0 then 1 else 0 end) as double) from s
union all select 'max_binding_affinity', coalesce(max(binding_affinity), 0) from s
union all select 'min_binding_affinity', coalesce(min(binding_affinity), 0) from s
union all select 'strong_pairs', cast(sum(case when binding_affinity > 7 then 1 else 0 end) as double) from s""",
                                      "t_proteins", "t_compounds", "t_interactions"))
def q_p3(spark, sf):
    from bindscape.plans.workflows import run_screen
    p, c = _screen_shares(spark, sf)
    return run_screen(p, c, scorer=fitted_scorer(spark, sf)).select("metric", r6("value").alias("value"))


@register("D6_screening_summary", with_views(SCREEN_SQL + """
select count(*) as total_processed, round(coalesce(avg(binding_affinity), 0), 6) as avg_binding_affinity,
 cast(sum(case when binding_affinity > 8.0 then 1 else 0 end) as bigint) as high_affinity_count,
 coalesce(max(binding_affinity), 0) as max_binding_affinity, coalesce(min(binding_affinity), 0) as min_binding_affinity
from s""", "t_proteins", "t_compounds", "t_interactions"))
def q_d6(spark, sf):
    from bindscape.plans.workflows import counted_screening_summary, screened_scores
    p, c = _screen_shares(spark, sf)
    s = counted_screening_summary(screened_scores(p, c, fitted_scorer(spark, sf)))
    return s.select("total_processed", r6("avg_binding_affinity").alias("avg_binding_affinity"),
                    "high_affinity_count", r6("max_binding_affinity").alias("max_binding_affinity"),
                    r6("min_binding_affinity").alias("min_binding_affinity"))


@register("C4_resolve_by_id", with_views("""
with r as (select l_orderkey * 10 + l_linenumber as request_id,
                  case when l_linenumber % 2 = 0 then protein_id * 13 end as protein_ref,
                  'ACDEFGHIK' as inline_seq from t_interactions_ids)
select request_id, case when protein_ref is null then inline_seq else md5(p.protein) end as seq_md5,
       case when protein_ref is null then 'inline' when p.protein_id is null then 'not_found' else 'resolved' end as status
from r left join t_proteins p on p.protein_id = r.protein_ref""", "t_interactions_ids", "t_proteins"))
def q_c4(spark, sf):
    r = V.interactions_ids(spark, sf).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("protein_id") * 13).alias("protein_ref"),
        F.lit("ACDEFGHIK").alias("inline_seq"))
    res = joins.resolve_by_id(r, V.proteins(spark, sf), "protein_ref", "inline_seq", "protein_id", "protein", "seq")
    return res.select("request_id", F.when(F.col("protein_ref").isNull(), F.col("seq"))
                      .otherwise(F.md5("seq")).alias("seq_md5"), "status")


@register("C5_compounds_for_target", with_views("""
with f as (select protein_id, compound_id, min((l_orderkey, l_linenumber)) as first_act from t_interactions_ids
           group by protein_id, compound_id),
r as (select *, row_number() over (partition by protein_id order by first_act, compound_id) as rk from f)
select r.protein_id, r.compound_id, rk as rank, first_act[1] as l_orderkey, cast(first_act[2] as bigint) as l_linenumber,
       round(i.affinity, 6) as affinity, c.compound
from r join t_compounds c on c.compound_id = r.compound_id
join t_interactions_ids i on i.l_orderkey = first_act[1] and i.l_linenumber = first_act[2]
     and i.protein_id = r.protein_id and i.compound_id = r.compound_id
where rk <= 10""", "t_interactions_ids", "t_compounds"))
def q_c5(spark, sf):
    c = joins.compounds_for_target(V.interactions_ids(spark, sf), V.compounds(spark, sf), 10)
    return c.select("protein_id", "compound_id", F.col("rank").cast("long").alias("rank"), "l_orderkey",
                    F.col("l_linenumber").cast("long").alias("l_linenumber"),
                    r6("affinity").alias("affinity"), "compound")


@register("C6_binding_data", with_views("""
select i.compound_id, i.protein_id, count(*) as n_activities, round(min(affinity), 6) as min_affinity,
       round(max(affinity), 6) as max_affinity
from t_interactions_ids i
where exists (select 1 from orders o where o.o_orderkey = i.l_orderkey and o.o_orderpriority = '1-URGENT')
group by i.compound_id, i.protein_id""", "t_interactions_ids"))
def q_c6(spark, sf):
    acts = V.interactions_ids(spark, sf)
    urgent = read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.col("o_orderkey").alias("l_orderkey"))
    pairs = acts.join(urgent, "l_orderkey", "left_semi").select("compound_id", "protein_id")
    b = joins.binding_data(acts.join(urgent, "l_orderkey", "left_semi"), pairs)
    return b.groupBy("compound_id", "protein_id").agg(
        F.count(F.lit(1)).alias("n_activities"), r6(F.min("affinity")).alias("min_affinity"),
        r6(F.max("affinity")).alias("max_affinity"))


@register("C10_split_cached", with_views(f"""
with c as (select distinct cache_key, round(0.1 + (event_id % 90) / 10.0, 2) as cached_score
           from (select *, row_number() over (partition by cache_key order by event_id) as rn from t_requests
                 where ends_with(cache_key, '|view')) x where rn = 1)
select r.event_id, r.cache_key, coalesce(c.cached_score, {HASH_SCORE_SQL.format(p='r.cache_key', c="''")}) as cached_score,
       c.cache_key is not null as cached
from t_requests r left join c on c.cache_key = r.cache_key""", "t_requests"))
def q_c10(spark, sf):
    req = V.requests(spark, sf)
    cache = (req.filter(F.col("cache_key").endswith("|view")).groupBy("cache_key")
                .agg(F.min("event_id").alias("e"))
                .select("cache_key", F.round(F.lit(0.1) + (F.col("e") % 90) / F.lit(10.0), 2).alias("cached_score")))
    from bindscape.functions.scoring import hash_score
    # the keys are no sequences: a miss gets the reference's placeholder of its key (C10_score_store scores pairs)
    s = joins.split_cached(req.select("event_id", "cache_key"), cache, scorer=lambda k: hash_score(k, F.lit("")))
    return s.select("event_id", "cache_key", "cached_score", "cached")


@register("C10_score_store", with_views(f"""
with {FIT_SQL}
select i.l_orderkey, i.l_linenumber, {fit_score_sql('p.protein', 'c.compound')} as score,
 exists (select 1 from t_interactions_ids e where e.l_linenumber <= 2 and e.protein_id = i.protein_id and e.compound_id = i.compound_id) as cached
from t_interactions_ids i join t_proteins p on p.protein_id = i.protein_id join t_compounds c on c.compound_id = i.compound_id""",
                                        "t_interactions_ids", "t_proteins", "t_compounds", "t_interactions"))
def q_c10s(spark, sf):
    """Two runs on one store: the first asks for the pairs of the first two lines of each order, the second for all."""
    from bindscape.operators.score_store import score_requests
    from bindscape.sources.writers import scratch_dir
    store = scratch_dir(spark, "score-store") + "/scores"
    prots, comps, model = V.proteins(spark, sf), V.compounds(spark, sf), fitted_scorer(spark, sf)
    ids = V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber", "protein_id", "compound_id")
    score_requests(ids.where("l_linenumber <= 2"), prots, comps, store, "first", model)
    s = score_requests(ids, prots, comps, store, "second", model)
    return s.where("score is not null").select("l_orderkey", "l_linenumber", "score", "cached")


# --------------------------------------------------------------- C7, E9, C8

KNN_SQL = """
with q as (select vec_id as q_id, embedding as qv from t_emb),
t as (select vec_id as t_id, embedding as tv, label from t_emb),
d as (select q_id, t_id, label,
        1 - case when sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(tv, tv)) > 0
                 then list_dot_product(qv, tv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(tv, tv))) else 0 end as distance
      from q, t),
k as (select * from (select *, row_number() over (partition by q_id order by distance, t_id) as rank from d) x where rank <= 5)"""


@register("C7_knn_join", with_views(KNN_SQL + """
select q_id, t_id, round(distance, 6) as distance, rank from k""", "t_emb"))
def q_c7(spark, sf):
    e = V.embeddings(spark, sf)
    k = similarity.knn_join(e.withColumnRenamed("vec_id", "q_id"), e.withColumnRenamed("vec_id", "t_id"), 5)
    return k.select("q_id", "t_id", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@register("C7_knn_index", with_views(KNN_SQL + """
select q_id, t_id, round(distance, 6) as distance from k where q_id % 50 = 0 and rank = 1""", "t_emb"))
def q_c7i(spark, sf):
    """The nearest row by the centroid index, fitted on at most 20,000 sample rows; every row is indexed, the queries are the
    rows whose id 50 divides. The first neighbour of an indexed row is exact (it lies in the row's own cell);
    C7_index_recall measures all five."""
    found, _ = _indexed_search(spark, sf)
    return found.where("rank = 1").select("q_id", "t_id", r6("distance").alias("distance"))


def _indexed_search(spark, sf):
    from bindscape.operators import ann
    t = V.embeddings(spark, sf).withColumnRenamed("vec_id", "t_id")
    q = t.where("t_id % 50 = 0").withColumnRenamed("t_id", "q_id")
    index = ann.fit_index(t)
    return ann.knn_search(index, ann.index_rows(index, t), q, 5), similarity.knn_join(q, t, 5)


@register("C7_index_recall", """
select count(*) as n_queries, count(*) * least(5, (select count(*) from embeddings)) as n_neighbours, true as reached
from embeddings where vec_id % 50 = 0""")
def q_c7r(spark, sf):
    """Of the exact neighbours of those queries, 0.9 or more are found by the index."""
    from bindscape.operators import ann
    found, exact = _indexed_search(spark, sf)
    return ann.recall(found, exact).select("n_queries", "n_neighbours", (F.col("recall") >= 0.9).alias("reached"))


@register("E9_reliability", with_views(KNN_SQL + """
select q_id, round(avg(distance), 6) as avg_distance, round(var_pop(label), 6) as label_variance,
 round(least(1.0, greatest(0.0, 0.7 / (1 + avg(distance)) + 0.3 / (1 + var_pop(label)))), 6) as reliability
from k group by q_id""", "t_emb"))
def q_e9(spark, sf):
    e = V.embeddings(spark, sf)
    k = similarity.knn_join(e.withColumnRenamed("vec_id", "q_id"), e.withColumnRenamed("vec_id", "t_id"), 5)
    r = similarity.reliability(k, e.withColumnRenamed("vec_id", "t_id"))
    return r.select("q_id", *[r6(c).alias(c) for c in ("avg_distance", "label_variance", "reliability")])


C8_SQL = """
with d as (select distinct compound from t_compounds),
f as (select compound, list_distinct(list_transform(range(1, length(compound) - 1), i -> substr(compound, i::int, 3))) as grams from d),
p as (select a.compound as a, b.compound as b,
        len(list_intersect(a.grams, b.grams)) as inter, len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams)) as uni
      from f a join f b on a.compound < b.compound)
select a as compound_a, b as compound_b, round(case when uni > 0 then inter / uni else 0.0 end, 6) as similarity
from p where case when uni > 0 then inter / uni else 0.0 end >= 0.7"""


@register("C8_minhash_join", with_views(C8_SQL, "t_compounds"))
def q_c8m(spark, sf):
    """The same pairs by banded min-hash signatures, scored exactly."""
    from bindscape.functions.smiles import trigrams
    from bindscape.operators.ann import minhash_join
    d = V.compounds(spark, sf).select("compound").distinct().withColumn("bits", trigrams("compound"))
    j = minhash_join(d.withColumnRenamed("compound", "compound_a"), d.withColumnRenamed("compound", "compound_b"), 0.7,
                     "compound_a", "compound_b", self_join=True)
    return j.select("compound_a", "compound_b", r6("similarity").alias("similarity"))


@register("C8_tanimoto_join", with_views(C8_SQL, "t_compounds"))
def q_c8(spark, sf):
    """Compounds as sets of character trigrams, keyed by the SMILES text."""
    from bindscape.functions.smiles import trigrams
    d = V.compounds(spark, sf).select("compound").distinct().withColumn("bits", trigrams("compound"))
    left = d.select(F.col("compound").alias("compound_a"), "bits")
    right = d.select(F.col("compound").alias("compound_b"), "bits")
    j = similarity.tanimoto_join(left, right, 0.7, l_id="compound_a", r_id="compound_b", self_join=True)
    return j.select("compound_a", "compound_b", r6("similarity").alias("similarity"))


# --------------------------------------------------------------- access, lookups

@register("C9_visible_workspaces", with_views("""
select distinct cast(m.user_id as bigint) as user_id, w.id as workspace_id, 'member' as access
from t_workspaces w, unnest(w.members) as u(m)
where m.user_id in (select id from t_users)
union all
select cast(null as bigint), id, 'public' from t_workspaces where is_public""", "t_workspaces", "t_users"))
def q_c9(spark, sf):
    v = access.visible_workspaces_all(V.workspaces(spark, sf), V.users(spark, sf))
    return v.select(F.col("user_id").cast("long").alias("user_id"), "workspace_id", "access")


@register("G6_search_workspaces", with_views("""
select id, name, len(members) as member_count from t_workspaces
where (list_contains(list_transform(members, m -> m.user_id), 7) or is_public)
  and (contains(lower(name), 'conv 1') or coalesce(contains(lower(description), 'conv 1'), false))
order by id limit 20""", "t_workspaces"))
def q_g6(spark, sf):
    s = access.search_workspaces(V.workspaces(spark, sf), "conv 1", 7, 20)
    return s.select("id", "name", F.col("member_count").cast("long").alias("member_count"))


@register("B14_filter_role_at_least", with_views("""
select id, role from t_users where role = 'admin' or
  coalesce(case role when 'guest' then 0 when 'viewer' then 1 when 'researcher' then 2 when 'admin' then 3 end, 0) >= 2""",
                                                  "t_users"))
def q_b14(spark, sf):
    return clean.filter_role_at_least(V.users(spark, sf), "researcher").select("id", "role")


@register("D7_user_stats", with_views("""
with per as (select role, count(*) as n, sum(cast(is_active as int)) as a from t_users group by role)
select cast(sum(n) as bigint) as total_users, cast(sum(a) as bigint) as active_users,
       cast(sum(n) - sum(a) as bigint) as inactive_users,
       string_agg(role || ':' || n, ',' order by role) as role_distribution from per""", "t_users"))
def q_d7(spark, sf):
    s = access.user_stats(V.users(spark, sf))
    ent = F.transform(F.map_entries("role_distribution"),
                      lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return s.select(F.col("total_users").cast("long").alias("total_users"),
                    F.col("active_users").cast("long").alias("active_users"),
                    F.col("inactive_users").cast("long").alias("inactive_users"),
                    F.array_join(ent, ",").alias("role_distribution"))


@register("G4_approved_compounds", with_views("""
select compound_id, round(molecular_weight, 6) as molecular_weight from t_descriptors
where max_phase = 4 order by compound_id limit 100""", "t_descriptors"))
def q_g4(spark, sf):
    from bindscape.plans.workflows import approved_compounds
    a = approved_compounds(V.compound_descriptors(spark, sf), 100)
    return a.select("compound_id", r6("molecular_weight").alias("molecular_weight"))


@register("G5_keyword_search", with_views("""
select doc_id as protein_id, lang from documents where contains(lower(text), 'the') order by doc_id limit 10"""))
def q_g5(spark, sf):
    from bindscape.plans.workflows import keyword_search
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("protein_id"), "text", "lang")
    return keyword_search(d, "text", "the", "protein_id", 10).select("protein_id", "lang")
