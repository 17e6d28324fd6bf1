"""Registered queries: scalar column functions over proteins, compounds and interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions import protein as P
from bindscape.functions import scoring as K
from bindscape.functions import smiles as S
from bindscape.operators import clean
from bindscape.plans import views as V
from bindscape.plans.oracle_views import with_views
from bindscape.plans.reg_prepare import PKD_SQL, STRIP_SQL, VALID_PROT_SQL, valid_smiles_sql
from bindscape.plans.registry import joined, r6, register

NORM_SQL = "upper(replace(replace(protein, ' ', ''), chr(10), ''))"


def cnt(s: str, chars: str) -> str:
    """DuckDB text: number of characters of ``s`` in ``chars``."""
    esc = chars.replace("'", "''")
    return f"(length({s}) - length(translate({s}, '{esc}', '')))"


def csub(s: str, sub: str) -> str:
    return f"((length({s}) - length(replace({s}, '{sub}', ''))) // {len(sub)})"


# ---------------------------------------------------------------- proteins

@register("B1_normalize_protein", with_views(f"""
select protein_id, {NORM_SQL} as normalized from t_proteins""", "t_proteins"))
def q_b1(spark, sf):
    return V.proteins(spark, sf).select("protein_id", P.normalize_protein("protein").alias("normalized"))


@register("B2_is_valid_protein", with_views(f"""
select protein_id, coalesce({VALID_PROT_SQL.format(c='protein')}, false) as is_valid,
       coalesce(regexp_full_match(upper(protein), '[ACDEFGHIKLMNPQRSTVWY]+'), false) as is_valid_strict
from t_proteins""", "t_proteins"))
def q_b2(spark, sf):
    return V.proteins(spark, sf).select("protein_id", P.is_valid_protein("protein").alias("is_valid"),
                                        P.is_valid_protein_strict("protein").alias("is_valid_strict"))


@register("B3_invalid_characters", with_views(f"""
select protein_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split({NORM_SQL}, ''),
       x -> x <> '' and position(x in 'ACDEFGHIKLMNPQRSTVWY') = 0))), ','), '') as invalid_chars
from t_proteins""", "t_proteins"))
def q_b3(spark, sf):
    return V.proteins(spark, sf).select(
        "protein_id", F.coalesce(joined(P.invalid_characters("protein")), F.lit("")).alias("invalid_chars"))


AA = P.AMINO_ACIDS


def _mw_sql(s: str, table: dict) -> str:
    return "(" + " + ".join(f"{cnt(s, a)} * {w}" for a, w in table.items()) + ")"


@register("I3_I4_I5_protein_profile", with_views(f"""
select protein_id, length(n) as length,
 {cnt('n', P.HYDROPHOBIC)} as hydrophobic, {cnt('n', P.POLAR)} as polar, {cnt('n', P.CHARGED)} as charged,
 {cnt('n', P.AROMATIC)} as aromatic, {cnt('n', P.BASIC)} as basic, {cnt('n', P.ACIDIC)} as acidic,
 round(case when length(n) > 0 then {cnt('n', P.HYDROPHOBIC)} * 100.0 / length(n) end, 6) as hydrophobic_pct,
 round(case when length(n) > 0 then {cnt('n', P.CHARGED)} * 100.0 / length(n) end, 6) as charged_pct,
 round(cast({_mw_sql('n', {a: v[4] for a, v in P.RESIDUE_INFO.items()})} as double), 6) as molecular_weight,
 round(cast(case when {cnt('n', P.BASIC)} > {cnt('n', P.ACIDIC)} then 8.5 + ({cnt('n', P.BASIC)} - {cnt('n', P.ACIDIC)}) * 0.1
      when {cnt('n', P.ACIDIC)} > {cnt('n', P.BASIC)} then 5.5 - ({cnt('n', P.ACIDIC)} - {cnt('n', P.BASIC)}) * 0.1
      else 7.0 end as double), 6) as estimated_pi,
 {cnt('n', 'A')} as count_a, {cnt('n', 'L')} as count_l, {cnt('n', 'W')} as count_w
from (select protein_id, {NORM_SQL} as n from t_proteins) x""", "t_proteins"))
def q_i345(spark, sf):
    n = P.normalize_protein("protein")
    d = V.proteins(spark, sf).select("protein_id", n.alias("n"))
    g = P.property_groups("n")
    counts = P.residue_counts("n")
    return d.select(
        "protein_id", F.length("n").cast("long").alias("length"),
        *[g[k].cast("long").alias(k) for k in ("hydrophobic", "polar", "charged", "aromatic", "basic", "acidic")],
        r6(g["hydrophobic_pct"]).alias("hydrophobic_pct"), r6(g["charged_pct"]).alias("charged_pct"),
        r6(P.residue_mw("n")).alias("molecular_weight"), r6(P.estimated_pi("n")).alias("estimated_pi"),
        *[F.coalesce(F.element_at(counts, F.lit(a)), F.lit(0)).cast("long").alias(f"count_{a.lower()}")
          for a in "ALW"],
    )


@register("I2_residue_info", with_views("""
select r.residue, coalesce(i.name, 'Unknown') as name, coalesce(i.type, 'Unknown') as type,
       coalesce(i.charge, 'Unknown') as charge, coalesce(i.hydrophobic, false) as hydrophobic,
       round(cast(coalesce(i.mw, 0) as double), 6) as mw, r.n
from (select ch as residue, count(*) as n from (select unnest(string_split(protein, '')) as ch from t_proteins) a
      where ch <> '' group by ch) r
left join (values """ + ", ".join(
    f"('{a}', '{v[0]}', '{v[1]}', '{v[2]}', {str(v[3]).lower()}, {v[4]})" for a, v in P.RESIDUE_INFO.items())
    + """) i(residue, name, type, charge, hydrophobic, mw) on i.residue = upper(r.residue)""", "t_proteins"))
def q_i2(spark, sf):
    from bindscape.operators.joins import residue_info_table
    chars = (V.proteins(spark, sf).select(F.explode(F.split("protein", "")).alias("residue"))
             .filter(F.col("residue") != "").groupBy("residue").agg(F.count(F.lit(1)).alias("n")))
    info = residue_info_table(spark)
    j = chars.join(F.broadcast(info), F.upper(chars.residue) == info.aa, "left")
    return j.select(chars.residue, F.coalesce("name", F.lit("Unknown")).alias("name"),
                    F.coalesce("type", F.lit("Unknown")).alias("type"),
                    F.coalesce("charge", F.lit("Unknown")).alias("charge"),
                    F.coalesce("hydrophobic", F.lit(False)).alias("hydrophobic"),
                    r6(F.coalesce("mw", F.lit(0.0))).alias("mw"), "n")


# Residue weights of the sequence statistics, and the residues.
STATS_WEIGHTS_SQL = {
    "A": 89.1, "C": 121.0, "D": 133.1, "E": 147.1, "F": 165.2,
    "G": 75.1, "H": 155.2, "I": 131.2, "K": 146.2, "L": 131.2,
    "M": 149.2, "N": 132.1, "P": 115.1, "Q": 146.2, "R": 174.2,
    "S": 105.1, "T": 119.1, "V": 117.1, "W": 204.2, "Y": 181.2,
}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


@register("I3_residue_counts", with_views(f"""
with n as (select protein_id, {NORM_SQL} as n from t_proteins),
c as (select protein_id, length(n) as len, unnest(string_split(n, '')) as residue from n where length(n) > 0)
select protein_id, residue, count(*) as count, round(count(*) * 100.0 / max(len), 6) as percentage
from c group by protein_id, residue""", "t_proteins"))
def q_i3(spark, sf):
    d = V.proteins(spark, sf).select("protein_id", P.normalize_protein("protein").alias("n"))
    both = d.select("protein_id", P.residue_counts("n").alias("c"), P.residue_percentages("n").alias("p"))
    rows = both.select("protein_id", "p", F.explode("c").alias("residue", "count"))
    return rows.select("protein_id", "residue", F.col("count").cast("long").alias("count"),
                       r6(F.element_at("p", F.col("residue"))).alias("percentage"))


@register("I6_sequence_stats", with_views(f"""
select protein_id, v as valid, case when v then length(n) end as length,
 {", ".join(f"case when v then {cnt('n', a)} end as count_{a.lower()}" for a in RESIDUES)},
 round(cast(case when v then {_mw_sql('n', STATS_WEIGHTS_SQL)} end as double), 6) as molecular_weight,
 round(case when v then {cnt('n', 'AILMFPWV')} / length(n) end, 6) as hydrophobic_ratio,
 round(case when v then {cnt('n', 'DEKR')} / length(n) end, 6) as charged_ratio
from (select protein_id, {NORM_SQL} as n, coalesce({VALID_PROT_SQL.format(c='protein')}, false) as v
      from t_proteins) x""", "t_proteins"))
def q_i6(spark, sf):
    st = P.sequence_stats("protein")
    return V.proteins(spark, sf).select(
        "protein_id", st["valid"].alias("valid"), st["length"].cast("long").alias("length"),
        *[F.element_at(st["residue_counts"], F.lit(a)).cast("long").alias(f"count_{a.lower()}") for a in RESIDUES],
        r6(st["molecular_weight"]).alias("molecular_weight"),
        r6(st["hydrophobic_ratio"]).alias("hydrophobic_ratio"), r6(st["charged_ratio"]).alias("charged_ratio"))


@register("I7_residue_classes_ui", with_views("select protein_id, " + ", ".join(
    f"{cnt('u', s)} as {k}, round(case when length(u) > 0 then {cnt('u', s)} * 100.0 / length(u) end, 6) as {k}_pct"
    for k, s in (("hydrophobic", "AILMFPWV"), ("polar", "NQST"), ("charged", "DEKR"), ("aromatic", "FWY")))
    + " from (select protein_id, upper(protein) as u from t_proteins) x", "t_proteins"))
def q_i7(spark, sf):
    c = P.residue_classes_ui("protein")
    names = ("hydrophobic", "polar", "charged", "aromatic")
    return V.proteins(spark, sf).select("protein_id", *[c[k].cast("long").alias(k) for k in names],
                                        *[r6(c[f"{k}_pct"]).alias(f"{k}_pct") for k in names])


@register("I28_I29_tokenize_pad", with_views("""
with t as (select protein_id, protein_id % 10 as batch,
  case when len(full_ids) > 1024 then list_concat(full_ids[1:1023], [3]) else full_ids end as ids
  from (select protein_id, list_concat([2], list_transform(list_filter(string_split(upper(protein), ''), c -> c <> ''),
       c -> coalesce(map_extract_value(MAP {'A':5,'R':6,'N':7,'D':8,'C':9,'Q':10,'E':11,'G':12,'H':13,'I':14,'L':15,'K':16,'M':17,'F':18,'P':19,'S':20,'T':21,'W':22,'Y':23,'V':24}, c), 1)), [3]) as full_ids
        from t_proteins) a),
p as (select *, max(len(ids)) over (partition by batch) as width from t)
select protein_id, batch, len(ids) as n_tokens, width as padded_length,
       cast(list_sum(ids) as bigint) as id_sum, cast(ids[1] as bigint) as first_id,
       cast(ids[len(ids)] as bigint) as last_id,
       cast(len(ids) as bigint) as mask_sum
from p""", "t_proteins"))
def q_i28(spark, sf):
    from bindscape.operators.windows import pad_and_mask
    t = V.proteins(spark, sf).select("protein_id", (F.col("protein_id") % 10).alias("batch"),
                                     P.tokenize("protein").alias("ids"))
    p = pad_and_mask(t, "ids", "batch")
    return p.select(
        "protein_id", "batch", F.size("ids").cast("long").alias("n_tokens"),
        F.size("input_ids").cast("long").alias("padded_length"),
        F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.element_at("ids", 1).cast("long").alias("first_id"),
        F.element_at("ids", -1).cast("long").alias("last_id"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


@register("I33_sequence_quality", with_views("""
select protein_id, round(cast(least(greatest(0.9 - (length(protein) - 100) * 0.001, 0.7), 0.95) as double), 6) as quality
from t_proteins""", "t_proteins"))
def q_i33(spark, sf):
    return V.proteins(spark, sf).select("protein_id", r6(P.sequence_quality(F.length("protein"))).alias("quality"))


# ---------------------------------------------------------------- compounds

@register("B4_B5_is_valid_smiles", with_views(f"""
select compound_id, coalesce({valid_smiles_sql('compound')}, false) as is_valid,
 coalesce(length(compound) > 0 and not regexp_matches(compound, '[ \\n\\t]'), false) as is_valid_ui,
 coalesce(length(compound) >= 3 and regexp_matches(compound, '[A-Za-z]'), false) as is_valid_service
from t_compounds""", "t_compounds"))
def q_b4(spark, sf):
    return V.compounds(spark, sf).select(
        "compound_id", S.is_valid_smiles("compound").alias("is_valid"),
        S.is_valid_smiles_ui("compound").alias("is_valid_ui"),
        S.is_valid_smiles_service("compound").alias("is_valid_service"))


def _smiles_props_sql(s: str) -> dict:
    c, n, o, su = cnt(s, "Cc"), cnt(s, "Nn"), cnt(s, "Oo"), cnt(s, "Ss")
    mw = f"({c}*12.01 + {n}*14.01 + {o}*16.0 + {su}*32.07 + length({s})*0.5*1.01)"
    logp = f"({c}*0.2 - {n}*0.7 - {o}*0.4 + 1.5)"
    tpsa = f"cast({n}*12 + {o}*20 + {su}*25 as double)"
    hbd = f"({csub(s, 'OH')} + {csub(s, 'NH')})"
    hba = f"({n} + {o})"
    viol = (f"(cast({mw} > 500 as int) + cast({logp} > 5 as int) + cast({hbd} > 5 as int) "
            f"+ cast({hba} > 10 as int))")
    rings = cnt(s, "123")
    comp = f"(length({s}) / 20.0 + {rings} * 0.5 + {cnt(s, '(')} * 0.3)"
    return dict(c=c, n=n, o=o, su=su, mw=mw, logp=logp, tpsa=tpsa, hbd=hbd, hba=hba, viol=viol,
                rings=rings, comp=comp, sa=f"least(10.0, 1.0 + {comp})", rot=f"greatest({cnt(s, '-')} + {cnt(s, '=')} - {rings}, 0)")


SP = _smiles_props_sql("compound")


@register("I8_I9_atoms_and_estimates", with_views(f"""
select compound_id, {SP['c']} as carbon, {SP['n']} as nitrogen, {SP['o']} as oxygen, {SP['su']} as sulfur,
 {SP['c']} + {SP['n']} + {SP['o']} + {SP['su']} as heavy_atoms,
 round(cast({SP['mw']} as double), 6) as mw, round(cast({SP['logp']} as double), 6) as logp, round({SP['tpsa']}, 6) as tpsa
from t_compounds""", "t_compounds"))
def q_i89(spark, sf):
    a, e = S.atom_counts("compound"), S.estimated_properties("compound")
    return V.compounds(spark, sf).select(
        "compound_id", *[a[k].cast("long").alias(k) for k in ("carbon", "nitrogen", "oxygen", "sulfur", "heavy_atoms")],
        r6(e["mw"]).alias("mw"), r6(e["logp"]).alias("logp"), r6(e["tpsa"]).alias("tpsa"))


_FG = {k: f"len(regexp_extract_all(compound, '(?i){p}'))" for k, p in S.FUNCTIONAL_GROUPS.items()}


@register("I10_functional_groups", with_views(f"""
select compound_id, {', '.join(f"cast({v} as int) as {k}" for k, v in _FG.items())},
 cast({' + '.join(_FG.values())} as int) as total,
 cast({' + '.join(f'(case when {v} > 0 then 1 else 0 end)' for v in _FG.values())} as int) as diversity
from t_compounds""", "t_compounds"))
def q_i10(spark, sf):
    g = S.functional_groups("compound")
    return V.compounds(spark, sf).select("compound_id", *[g[k].alias(k) for k in S.FUNCTIONAL_GROUPS],
                                         g["total"].alias("total"), g["diversity"].alias("diversity"))


@register("I11_lipinski_estimated", with_views(f"""
select compound_id, {SP['hbd']} as hbd, {SP['hba']} as hba, cast({SP['viol']} as bigint) as violations,
 case {SP['viol']} when 0 then 'Excellent' when 1 then 'Good' when 2 then 'Poor' else 'Very Poor' end as label
from t_compounds""", "t_compounds"))
def q_i11(spark, sf):
    lp = S.lipinski_estimated("compound")
    return V.compounds(spark, sf).select("compound_id", lp["hbd"].cast("long").alias("hbd"),
                                         lp["hba"].cast("long").alias("hba"),
                                         lp["violations"].cast("long").alias("violations"), lp["label"].alias("label"))


@register("I14_I15_string_descriptors", with_views(f"""
select compound_id, {SP['rings']} as ring_count, {cnt('compound', 'c')} as aromatic_rings, {SP['rot']} as rotatable_bonds,
 length(compound) as length, len(list_distinct(list_filter(string_split(compound, ''), x -> x <> ''))) as char_diversity,
 round(least(10.0, {SP['comp']}), 6) as structural, round({SP['sa']}, 6) as sa_score,
 {cnt('compound', '(')} as branch_points
from t_compounds""", "t_compounds"))
def q_i14(spark, sf):
    d, c = S.string_descriptors("compound"), S.complexity("compound")
    return V.compounds(spark, sf).select(
        "compound_id", d["ring_count"].cast("long").alias("ring_count"),
        d["aromatic_rings"].cast("long").alias("aromatic_rings"),
        d["rotatable_bonds"].cast("long").alias("rotatable_bonds"), d["length"].cast("long").alias("length"),
        d["char_diversity"].cast("long").alias("char_diversity"), r6(c["structural"]).alias("structural"),
        r6(c["sa_score"]).alias("sa_score"), c["branch_points"].cast("long").alias("branch_points"))


@register("I16_atomic_composition", with_views(f"""
select compound_id, array_to_string(list_filter([
  'C:' || {cnt('compound', 'Cc')}, 'N:' || {cnt('compound', 'Nn')}, 'O:' || {cnt('compound', 'Oo')},
  'S:' || {cnt('compound', 'Ss')}, 'P:' || {cnt('compound', 'Pp')}, 'F:' || {cnt('compound', 'Ff')},
  'Cl:' || {csub('compound', 'Cl')}, 'Br:' || {csub('compound', 'Br')}, 'I:' || {cnt('compound', 'I')}],
  x -> not ends_with(x, ':0')), ',') as composition
from t_compounds""", "t_compounds"))
def q_i16(spark, sf):
    m = S.atomic_composition("compound")
    ent = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return V.compounds(spark, sf).select("compound_id", F.array_join(ent, ",").alias("composition"))


def _props_df(spark, sf):
    s = "compound"
    e, d, c, lp = (S.estimated_properties(s), S.string_descriptors(s), S.complexity(s),
                   S.lipinski_estimated(s))
    return V.compounds(spark, sf).select(
        "compound_id", e["mw"].alias("mw"), e["logp"].alias("logp"), e["tpsa"].alias("tpsa"),
        d["rotatable_bonds"].alias("rot"), c["sa_score"].alias("sa"), c["structural"].alias("structural"),
        c["ring_systems"].alias("rings"), lp["violations"].alias("violations"))


@register("I17_admet_flags", with_views(f"""
select compound_id, {SP['tpsa']} <= 140 as oral_tpsa_ok, {SP['mw']} <= 500 as oral_mw_ok,
 case when {SP['tpsa']} <= 90 then 'Likely' when {SP['tpsa']} <= 140 then 'Moderate' else 'Unlikely' end as bbb,
 {SP['rot']} <= 10 as metabolic_ok,
 case when {SP['sa']} <= 3 then 'Easy' when {SP['sa']} <= 6 then 'Moderate' else 'Difficult' end as synthesis,
 case when least(10.0, {SP['comp']}) < 2 then 'Low' when least(10.0, {SP['comp']}) < 4 then 'Medium' else 'High' end as complexity_class,
 case when {SP['rings']} = 0 then 'Acyclic' when {SP['rings']} <= 2 then 'Simple cyclic' else 'Polycyclic' end as ring_type
from t_compounds""", "t_compounds"))
def q_i17(spark, sf):
    p = _props_df(spark, sf)
    f = S.admet_flags("tpsa", "mw", "rot", "sa", "structural", "rings")
    return p.select("compound_id", *[f[k].alias(k) for k in (
        "oral_tpsa_ok", "oral_mw_ok", "bbb", "metabolic_ok", "synthesis", "complexity_class", "ring_type")])


_OVERALL_SQL = (f"((greatest(0.0, (4 - {SP['viol']}) / 4.0 * 100) + greatest(0.0, (10 - {SP['sa']}) / 10.0 * 100)"
                f" + case when {SP['mw']} <= 500 then 85.0 else 60.0 end) / 3.0)")


@register("I18_overall_score", with_views(f"""
select compound_id, round({_OVERALL_SQL}, 6) as score,
 case when {_OVERALL_SQL} >= 80 then 'Excellent' when {_OVERALL_SQL} >= 60 then 'Good' else 'Needs optimization' end as grade,
 case when {_OVERALL_SQL} >= 80 then 'High' when {_OVERALL_SQL} >= 60 then 'Medium' else 'Optimization needed' end as priority
from t_compounds""", "t_compounds"))
def q_i18(spark, sf):
    o = S.overall_score("violations", "sa", "mw")
    return _props_df(spark, sf).select("compound_id", r6(o["score"]).alias("score"), o["grade"].alias("grade"),
                                       o["priority"].alias("priority"))


@register("I19_advisories", with_views(f"""
select compound_id, array_to_string(list_filter([
 case when {SP['mw']} > 500 then 'High molecular weight may reduce oral bioavailability' end,
 case when {SP['logp']} > 5 then 'High lipophilicity may cause solubility issues' end,
 case when {SP['logp']} < 0 then 'Low lipophilicity may affect membrane permeability' end,
 case when {SP['tpsa']} > 140 then 'High TPSA may limit oral absorption' end,
 case when {SP['sa']} > 6 then 'High synthetic complexity may increase development costs' end,
 case when {SP['viol']} = 0 then 'Excellent drug-like properties - proceed with confidence'
      when {SP['viol']} = 1 then 'Good drug candidate with minor optimization needed'
      else 'Consider structural modifications to improve drug-likeness' end,
 case when {SP['tpsa']} <= 90 then 'Good CNS penetration potential for neurological targets' end,
 case when {SP['sa']} <= 3 then 'Favorable synthetic accessibility for development' end], x -> x is not null), ' | ') as advisories
from t_compounds""", "t_compounds"))
def q_i19(spark, sf):
    a = S.advisories("mw", "logp", "tpsa", "sa", "violations")
    return _props_df(spark, sf).select("compound_id", F.array_join(a, " | ").alias("advisories"))


@register("I20_smiles_text_summary", with_views(f"""
select compound_id, length(compound) as length,
 len(list_distinct(list_filter(string_split(compound, ''), x -> x <> ''))) as distinct_chars,
 len(list_distinct(list_filter(string_split(compound, ''), x -> regexp_full_match(x, '[A-Za-z]')))) as distinct_letters,
 {cnt('compound', '(')} as branches, {cnt('compound', '0123456789')} as digits
from t_compounds""", "t_compounds"))
def q_i20(spark, sf):
    t = S.text_summary("compound")
    return V.compounds(spark, sf).select("compound_id", *[t[k].cast("long").alias(k) for k in (
        "length", "distinct_chars", "distinct_letters", "branches", "digits")])


@register("I30_bit_fingerprint", with_views("""
select compound_id, array_to_string(list_filter(range(0, least(length(compound), 1024)),
       i -> ascii(substr(compound, i + 1, 1)) % 2 = 1), ',') as bits
from t_compounds""", "t_compounds"))
def q_i30(spark, sf):
    return V.compounds(spark, sf).select("compound_id", joined(S.bit_fingerprint("compound")).alias("bits"))


_VIOLATIONS_SQL = ("(cast(coalesce(molecular_weight, 0) > 500 as int) + cast(coalesce(alogp, 0) > 5 as int)"
                   " + cast(coalesce(hbd, 0) > 5 as int) + cast(coalesce(hba, 0) > 10 as int))")


@register("I12_I13_lipinski_veber", with_views(f"""
select compound_id, {_VIOLATIONS_SQL} as violations, {_VIOLATIONS_SQL} <= 1 as lipinski_compliant,
 round(cast(greatest(0.0, 1.0 - 0.25 * {_VIOLATIONS_SQL}) as double), 6) as drug_likeness_score,
 coalesce(p_size % 15, 0) <= 10 as rotatable_bonds_ok, coalesce(p_retailprice / 10.0::double, 0) <= 140 as tpsa_ok,
 max_phase = 4 as approved
from t_descriptors join part on p_partkey = compound_id""", "t_descriptors"))
def q_i12(spark, sf):
    from bindscape.operators.joins import lipinski_veber
    from bindscape.session import read_table
    more = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("compound_id"), (F.col("p_size") % 15).alias("rotatable_bonds"),
        (F.col("p_retailprice") / F.lit(10.0)).alias("tpsa"))
    d = lipinski_veber(V.compound_descriptors(spark, sf).join(more, "compound_id"), rotatable="rotatable_bonds", tpsa="tpsa")
    return d.select("compound_id", F.col("violations").cast("int").alias("violations"), "lipinski_compliant",
                    r6("drug_likeness_score").alias("drug_likeness_score"), "rotatable_bonds_ok", "tpsa_ok",
                    (F.col("max_phase") == 4).alias("approved"))


# ---------------------------------------------------------------- interactions

@register("B6_validate_pair", with_views("""
select l_orderkey, l_linenumber, v as is_valid, case when not v then 'Invalid input sequences' end as error
from (select l_orderkey, l_linenumber,
  coalesce(length(protein) > 0 and regexp_full_match(upper(protein), '[ACDEFGHIKLMNPQRSTVWY]+')
           and length(compound) >= 3 and regexp_matches(compound, '[A-Za-z]'), false) as v
  from t_interactions) x""", "t_interactions"))
def q_b6(spark, sf):
    return clean.validate_pair(V.interactions(spark, sf)).select("l_orderkey", "l_linenumber", "is_valid", "error")


@register("I1_pair_key", with_views("""
select l_orderkey, l_linenumber, md5(concat_ws('|', protein, compound)) as pair_key from t_interactions""",
                                    "t_interactions"))
def q_i1(spark, sf):
    return V.interactions(spark, sf).select("l_orderkey", "l_linenumber",
                                            K.pair_key("protein", "compound").alias("pair_key"))


# the fitted scorer in SQL: one row of weights, from the interactions with a pKd of 4 to 12
_LETTERS_SQL = "coalesce(length(regexp_replace({c}, '[^A-Za-z]', '', 'g')), 0)::double"
_SHARE_SQL = ("coalesce(case when length({p}) > 0 then (length({p}) - length(translate(upper({p}), 'AILMFWV', '')))"
              " / length({p}) end, 0.0)::double")
FIT_SQL = f"""fit_in as (select a, b, y from (select {_LETTERS_SQL.format(c='compound')} as a, {_SHARE_SQL.format(p='protein')} as b,
  {PKD_SQL} as y from t_interactions) z where y between 4.0 and 12.0 and not isnan(y)),
fit_s as (select avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab,
  covar_pop(a, y) as ay, covar_pop(b, y) as by_ from fit_in),
fit_w as (select *, (bb * ay - ab * by_) / (aa * bb - ab * ab) as wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) as wb from fit_s)"""


def fit_score_sql(p: str, c: str) -> str:
    return (f"round((select my - wa * ma - wb * mb from fit_w) + (select wa from fit_w) * {_LETTERS_SQL.format(c=c)}"
            f" + (select wb from fit_w) * {_SHARE_SQL.format(p=p)}, 4)")


def described_interactions(spark, sf):
    """Interactions by id with the scorer's descriptors, worked out once per dimension row."""
    from bindscape.functions.affinity import hydrophobic_share, letter_count
    comp = V.compounds(spark, sf).select("compound_id", letter_count("compound").alias("letters"))
    prot = V.proteins(spark, sf).select("protein_id", hydrophobic_share("protein").alias("share"))
    return V.interactions_ids(spark, sf).join(comp, "compound_id").join(prot, "protein_id")


def fitted_scorer(spark, sf):
    """The linear scorer fitted to the interactions with a pKd of 4 to 12."""
    from bindscape.functions.affinity import fit_affinity
    facts = clean.filter_pkd_range(described_interactions(spark, sf).withColumn("pKd", clean.to_pkd("affinity")))
    return fit_affinity(facts, letters=F.col("letters"), hydrophobic=F.col("share"))


HASH_SCORE_SQL = ("round(0.1 + 9.4 * cast(cast('0x' || substr(md5(concat_ws('|', {p}, {c})), 1, 8) as bigint) "
                  "as double) / 4294967296.0, 2)")


@register("I31_hash_score", with_views(f"""
select l_orderkey, l_linenumber, {HASH_SCORE_SQL.format(p='protein', c='compound')} as score
from t_interactions""", "t_interactions"))
def q_i31(spark, sf):
    return V.interactions(spark, sf).select("l_orderkey", "l_linenumber",
                                            K.hash_score("protein", "compound").alias("score"))


@register("I21_binding_strength", with_views(f"""
select l_orderkey, l_linenumber,
 case when a > 7 then 'Strong' when a > 5 then 'Moderate' when a > 3 then 'Weak' else 'Very Weak' end as binding_strength,
 round(a / 10.0, 6) as interaction_probability,
 case when a > 7 then 'High' when a > 5 then 'Medium' else 'Low' end as affinity_bin,
 case when a / 10.0 > 0.7 then 'High' when a / 10.0 > 0.4 then 'Medium' else 'Low' end as probability_bin,
 case when l_linenumber / 7.0 > 0.8 then 'High' when l_linenumber / 7.0 > 0.6 then 'Medium' else 'Low' end as confidence_bin
from (select l_orderkey, l_linenumber, {PKD_SQL} as a from t_interactions_ids) x""", "t_interactions_ids"))
def q_i21(spark, sf):
    d = V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber", clean.to_pkd("affinity").alias("a"))
    b = K.binding_strength("a")
    u = K.ui_bins("a", b["interaction_probability"], F.col("l_linenumber") / F.lit(7.0))
    return d.select("l_orderkey", "l_linenumber", b["binding_strength"].alias("binding_strength"),
                    r6(b["interaction_probability"]).alias("interaction_probability"),
                    u["affinity_bin"].alias("affinity_bin"), u["probability_bin"].alias("probability_bin"),
                    u["confidence_bin"].alias("confidence_bin"))


@register("I23_property_categories", with_views(f"""
select l_orderkey, l_linenumber, cast(case when lab = 1 then 1.0 else 0.3 end as double) as binding_prob,
 round(least(0.9, greatest(0.1, 1.0 - abs(p - 6.0) / 6.0)), 6) as confidence,
 case when p > 6.5 then 'Low' when p > 5.0 then 'Medium' else 'High' end as toxicity_risk,
 case when p < 8.0 then 'Good' else 'Moderate' end as solubility,
 case when p > 5.0 and p < 9.0 then 'High' else 'Moderate' end as druglikeness
from (select l_orderkey, l_linenumber, {PKD_SQL} as p, cast({PKD_SQL} >= 6.0 as int) as lab
      from t_interactions_ids) x""", "t_interactions_ids"))
def q_i23(spark, sf):
    d = V.interactions_ids(spark, sf).withColumn("p", clean.to_pkd("affinity")) \
        .withColumn("lab", clean.binding_label("p"))
    c = K.property_categories("p", "lab")
    return d.select("l_orderkey", "l_linenumber", c["binding_prob"].alias("binding_prob"),
                    r6(c["confidence"]).alias("confidence"), c["toxicity_risk"].alias("toxicity_risk"),
                    c["solubility"].alias("solubility"), c["druglikeness"].alias("druglikeness"))


def _text_examples(spark, sf):
    d = V.interactions(spark, sf).withColumn("pKd", clean.to_pkd("affinity")) \
        .withColumn("binding_label", clean.binding_label("pKd"))
    return d.select("l_orderkey", "l_linenumber", "protein", "compound", "pKd", "binding_label",
                    K.format_text_example("protein", "compound", "pKd", "binding_label").alias("text"))


_INSTR_SQL = ("'You are a protein-drug interaction prediction expert. Given a protein sequence and drug SMILES, "
              "predict the binding affinity and properties.' || chr(10) || chr(10) || '### Protein Sequence:' || chr(10) "
              "|| substr(protein, 1, 500) || chr(10) || chr(10) || '### Drug SMILES:' || chr(10) || compound || chr(10) "
              "|| chr(10) || '### Task:' || chr(10) || 'Predict the binding affinity (pKd), binding probability, "
              "and drug properties.'")
_TEXT_SQL = f"""
select l_orderkey, l_linenumber, md5({_INSTR_SQL}) as instruction_md5, round(pKd, 2) as pkd_text,
 cast(case when pKd >= 6.0 then 1.0 else 0.3 end as double) as prob_text,
 case when pKd > 6.5 then 'Low' when pKd > 5.0 then 'Medium' else 'High' end as toxicity_risk,
 case when pKd < 8.0 then 'Good' else 'Moderate' end as solubility,
 case when pKd > 5.0 and pKd < 9.0 then 'High' else 'Moderate' end as druglikeness
from (select *, {PKD_SQL} as pKd from t_interactions) x"""


@register("I24_format_text_example", with_views(_TEXT_SQL, "t_interactions"))
def q_i24(spark, sf):
    t = _text_examples(spark, sf)
    instr = F.substring_index("text", "\n\nBased on the protein-drug interaction analysis", 1)
    num = lambda label: F.regexp_extract("text", label + r":\*\* (-?[0-9.]+)", 1).cast("double")
    word = lambda label: F.regexp_extract("text", label + r": (\w+)", 1)
    return t.select("l_orderkey", "l_linenumber", F.md5(instr).alias("instruction_md5"),
                    num(r"Binding Affinity \(pKd\)").alias("pkd_text"),
                    num("Binding Probability").alias("prob_text"),
                    word("Toxicity Risk").alias("toxicity_risk"), word("Solubility").alias("solubility"),
                    word("Drug-likeness").alias("druglikeness"))


@register("I25_format_chat_example", with_views(f"""
select l_orderkey, l_linenumber, 'human' as from_0, 'gpt' as from_1, md5({_INSTR_SQL}) as human_md5, 2 as n_turns,
 round(pKd, 2) as pkd_text, cast(case when pKd >= 6.0 then 1.0 else 0.3 end as double) as prob_text,
 case when pKd > 6.5 then 'Low' when pKd > 5.0 then 'Medium' else 'High' end as toxicity_risk,
 case when pKd < 8.0 then 'Good' else 'Moderate' end as solubility,
 case when pKd > 5.0 and pKd < 9.0 then 'High' else 'Moderate' end as druglikeness
from (select *, {PKD_SQL} as pKd from t_interactions) x""", "t_interactions"))
def q_i25(spark, sf):
    d = V.interactions(spark, sf).withColumn("pKd", clean.to_pkd("affinity")) \
        .withColumn("binding_label", clean.binding_label("pKd"))
    c = K.format_chat_example("protein", "compound", "pKd", "binding_label")
    d = d.select("l_orderkey", "l_linenumber", c.alias("c")).withColumn("text", F.col("c")[1]["value"])
    num = lambda label: F.regexp_extract("text", label + r":\*\* (-?[0-9.]+)", 1).cast("double")
    word = lambda label: F.regexp_extract("text", label + r": (\w+)", 1)
    return d.select("l_orderkey", "l_linenumber", F.col("c")[0]["from"].alias("from_0"), F.col("c")[1]["from"].alias("from_1"),
                    F.md5(F.col("c")[0]["value"]).alias("human_md5"), F.size("c").alias("n_turns"),
                    num(r"Binding Affinity \(pKd\)").alias("pkd_text"), num("Binding Probability").alias("prob_text"),
                    word("Toxicity Risk").alias("toxicity_risk"), word("Solubility").alias("solubility"),
                    word("Drug-likeness").alias("druglikeness"))


@register("I26_parse_prediction", with_views(f"""
select l_orderkey, l_linenumber, round(coalesce(try_cast(nullif(regexp_extract(t, '(\\d+\\.\\d+)', 1), '') as double),
       {HASH_SCORE_SQL.format(p='protein', c='compound')}), 6) as prediction
from (select *, 'Affinity ' || case when l_linenumber % 4 = 0 then 'unknown'
                 else cast(round(l_quantity / 5.0, 2) as varchar) end as t from t_interactions
      join (select l_orderkey as ok, l_linenumber as ln, l_quantity from lineitem) li
        on li.ok = l_orderkey and li.ln = l_linenumber) x""", "t_interactions"))
def q_i26(spark, sf):
    from bindscape.session import read_table
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # ids and numbers meet first: no sequence goes through the join by row key
    ids = V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber", "compound_id", "protein_id")
    d = V.with_strings(spark, sf, ids.join(li, ["l_orderkey", "l_linenumber"]))
    text = F.concat(F.lit("Affinity "), F.when(F.col("l_linenumber") % 4 == 0, F.lit("unknown"))
                    .otherwise(F.round(F.col("l_quantity") / F.lit(5.0), 2).cast("string")))
    return d.select("l_orderkey", "l_linenumber",
                    r6(K.parse_prediction(text, K.hash_score("protein", "compound"))).alias("prediction"))


@register("I27_parse_probability", with_views("""
select l_orderkey, l_linenumber,
 coalesce(try_cast(trim(regexp_extract(regexp_extract(t, '(?m)^(.*Binding Probability:.*)$', 1), '^[^:]*:(.*)$', 1)) as double), 0.5) as strict_prob,
 coalesce(try_cast(trim(replace(regexp_extract(regexp_extract(t, '(?m)^(.*Binding Probability:.*)$', 1), '^[^:]*:(.*)$', 1), '*', '')) as double), 0.5) as prob
from (select l_orderkey, l_linenumber,
  case when l_linenumber % 2 = 0
       then 'x' || chr(10) || '**Binding Probability:** ' || case when pk >= 6.0 then '1.000' else '0.300' end || chr(10) || 'y'
       else 'Binding Probability: ' || case when pk >= 6.0 then '1.0' else '0.3' end end as t
  from (select *, case when affinity > 100 then -log10(affinity*1e-9) else affinity end as pk from t_interactions_ids) a) x""",
                                               "t_interactions_ids"))
def q_i27(spark, sf):
    d = V.interactions_ids(spark, sf).withColumn("pk", clean.to_pkd("affinity"))
    prob = F.when(F.col("pk") >= 6.0, F.lit("1.000")).otherwise(F.lit("0.300"))
    prob2 = F.when(F.col("pk") >= 6.0, F.lit("1.0")).otherwise(F.lit("0.3"))
    t = F.when(F.col("l_linenumber") % 2 == 0,
               F.concat(F.lit("x\n**Binding Probability:** "), prob, F.lit("\ny"))) \
        .otherwise(F.concat(F.lit("Binding Probability: "), prob2))
    return d.select("l_orderkey", "l_linenumber", K.parse_probability(t, strict=True).alias("strict_prob"),
                    K.parse_probability(t).alias("prob"))


@register("I32_dissociation_rate", with_views(f"""
select l_orderkey, l_linenumber, round(1e6 / pow(10.0, p) * 1e6, 6) as koff_scaled
from (select l_orderkey, l_linenumber, {PKD_SQL} as p from t_interactions_ids) x""", "t_interactions_ids"))
def q_i32(spark, sf):
    d = V.interactions_ids(spark, sf).select("l_orderkey", "l_linenumber", clean.to_pkd("affinity").alias("p"))
    return d.select("l_orderkey", "l_linenumber",
                    r6(K.dissociation_rate(F.lit(1e6), "p") * F.lit(1e6)).alias("koff_scaled"))


@register("I22_heuristic_affinity", with_views("""
with m as (select vec_id, list_avg(embedding) as m from t_emb),
j as (select p.protein_id, length(p.protein) as len, m.m from t_proteins p join m on m.vec_id = p.protein_id)
select protein_id,
 round(greatest(4.0, least(9.0, 6.5 + (len - 65) * 0.01 + m * 2)), 6) as binding_affinity,
 round(1.0 / (1.0 + exp(-(greatest(4.0, least(9.0, 6.5 + (len - 65) * 0.01 + m * 2)) - 5.5))), 6) as binding_probability,
 round(least(0.95, greatest(0.6, 0.8 + abs(m) * 0.1)), 6) as confidence
from j""", "t_proteins", "t_emb"))
def q_i22(spark, sf):
    emb = V.embeddings(spark, sf).select(
        F.col("vec_id").alias("protein_id"),
        (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) / F.size("embedding")).alias("m"))
    j = V.proteins(spark, sf).join(emb, "protein_id")
    h = K.heuristic_affinity(F.length("protein"), "m")
    return j.select("protein_id", r6(h["binding_affinity"]).alias("binding_affinity"),
                    r6(h["binding_probability"]).alias("binding_probability"), r6(h["confidence"]).alias("confidence"))


@register("K1_score_batch", with_views(f"""
with {FIT_SQL}
select l_orderkey, l_linenumber, {fit_score_sql('protein', 'compound')} as native_score,
       {fit_score_sql('protein', 'compound')} as model_score
from t_interactions""", "t_interactions"))
def q_k1(spark, sf):
    """The model gets the descriptors, made once per dimension row, so no text goes with the facts."""
    from bindscape.operators.scoring import score_by_capability
    model = fitted_scorer(spark, sf)
    d = described_interactions(spark, sf).select("l_orderkey", "l_linenumber", "letters", "share")
    native = d.withColumn("native_score", model.of(F.col("letters"), F.col("share")))
    both = score_by_capability(native, _predictor(model, "batch"), ("letters", "share"))
    return both.select("l_orderkey", "l_linenumber", "native_score", F.round("binding_affinity", 4).alias("model_score"))


def _predictor(model, capability: str):
    """A factory of predictors with one capability over the fitted scorer's descriptors; rows of 16 letters or more fail
    in the single one."""
    def of(letters, share):
        return model.intercept + model.letters * letters + model.hydrophobic * share

    class Batch:
        def predict_batch(self, letters, share):
            return [(of(a, b), 0.9) for a, b in zip(letters, share, strict=True)]

    class Single:
        def predict_single(self, letters, share):
            if letters >= 16:
                raise ValueError("too long")
            return of(letters, share), 0.8

    class Basic:
        def predict_interaction(self, letters, share):
            return of(letters, share)

    class Nothing:
        pass

    return {"batch": Batch, "single": Single, "basic": Basic, "constant": Nothing}[capability]


@register("K1_capabilities", with_views(f"""
with {FIT_SQL},
s as (select protein_id % 4 as kind, {_LETTERS_SQL.format(c='compound')} as letters, {fit_score_sql('protein', 'compound')} as score from t_interactions),
k as (select case kind when 0 then 'batch' when 1 then case when letters >= 16 then 'fallback' else 'single' end when 2 then 'basic' else 'constant' end as capability,
 case when kind = 3 or (kind = 1 and letters >= 16) then 0.75 else score end as affinity,
 case kind when 0 then 0.9 when 1 then case when letters >= 16 then 0.85 else 0.8 end else 0.85 end as confidence from s)
select capability, count(*) as n_rows, round(sum(affinity), 4) as sum_affinity, min(confidence) as confidence from k group by capability""",
                                        "t_interactions"))
def q_k1c(spark, sf):
    """A quarter of the interactions for each kind of predictor: rows, affinities and confidence per capability used."""
    from bindscape.operators.scoring import score_by_capability
    model = fitted_scorer(spark, sf)
    d = described_interactions(spark, sf).select(F.pmod("protein_id", F.lit(4)).alias("kind"), "letters", "share")
    out = None
    for k, capability in enumerate(("batch", "single", "basic", "constant")):
        part = score_by_capability(d.where(F.col("kind") == k), _predictor(model, capability), ("letters", "share"), on_error="constant")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("capability").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.round("binding_affinity", 4)), 4).alias("sum_affinity"),
        F.min("confidence").alias("confidence"))
