"""SMILES string column expressions: validation, string-level descriptors and
rule-based drug-likeness (no chemistry library; counts over the text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindscape.functions.protein import count_chars

# Atomic weights used by the text-based estimates.
ATOMIC_WEIGHTS = {"C": 12.01, "N": 14.01, "O": 16.00, "S": 32.07,
                  "P": 30.97, "F": 19.00, "Cl": 35.45, "Br": 79.90, "I": 126.90}

# Functional-group patterns, matched case-insensitively and
# counted without overlap.
FUNCTIONAL_GROUPS = {
    "hydroxyl": r"O[H]",
    "carbonyl": r"C=O",
    "carboxyl": r"C\(=O\)O",
    "amino": r"N\([^=]",
    "benzene": r"c1ccccc1",
    "pyridine": r"c1ccncc1",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(s) -> Column:
    """Trim all leading/trailing whitespace (space, tab, newline, ...)."""
    return F.regexp_replace(_col(s), r"^\s+|\s+$", "")


def count_sub(s, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    s = _col(s)
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub))) \
        .cast("int")


def is_valid_smiles(smiles) -> Column:
    """After strip, length >= 3 and balanced counts of () and []."""
    s = strip(smiles)
    ok = ((F.length(s) >= 3)
          & (count_chars(s, "(") == count_chars(s, ")"))
          & (count_chars(s, "[") == count_chars(s, "]")))
    return F.coalesce(ok, F.lit(False))


def is_valid_smiles_ui(smiles) -> Column:
    """B5 (UI): non-empty and no space, newline or tab."""
    s = _col(smiles)
    return F.coalesce((F.length(s) > 0) & ~s.rlike("[ \n\t]"), F.lit(False))


def is_valid_smiles_service(smiles) -> Column:
    """B5 (service): length >= 3 and at least one letter."""
    s = _col(smiles)
    return F.coalesce((F.length(s) >= 3) & s.rlike(r"\p{IsAlphabetic}"), F.lit(False))


def atom_counts(smiles) -> Column:
    """I8: C, N, O, S counts (both cases, so 'Cl' counts a carbon) and heavy-atom sum."""
    s = _col(smiles)
    c, n, o, su = (count_chars(s, "Cc"), count_chars(s, "Nn"), count_chars(s, "Oo"),
                   count_chars(s, "Ss"))
    return F.struct(c.alias("carbon"), n.alias("nitrogen"), o.alias("oxygen"),
                    su.alias("sulfur"), (c + n + o + su).alias("heavy_atoms"))


def estimated_properties(smiles) -> Column:
    """Estimated molecular weight, logP and TPSA from atom counts and length."""
    s = _col(smiles)
    c, n, o, su = (count_chars(s, "Cc"), count_chars(s, "Nn"), count_chars(s, "Oo"),
                   count_chars(s, "Ss"))
    mw = (c * F.lit(ATOMIC_WEIGHTS["C"]) + n * F.lit(ATOMIC_WEIGHTS["N"])
          + o * F.lit(ATOMIC_WEIGHTS["O"]) + su * F.lit(ATOMIC_WEIGHTS["S"])
          + F.length(s) * F.lit(0.5) * F.lit(1.01))
    logp = c * F.lit(0.2) - n * F.lit(0.7) - o * F.lit(0.4) + F.lit(1.5)
    tpsa = n * F.lit(12) + o * F.lit(20) + su * F.lit(25)
    return F.struct(mw.alias("mw"), logp.alias("logp"), tpsa.cast("double").alias("tpsa"))


def functional_groups(smiles) -> Column:
    """Per-group match counts, total and number of groups present."""
    s = _col(smiles)
    counts = [F.regexp_count(s, F.lit("(?i)" + p)).cast("int").alias(k)
              for k, p in FUNCTIONAL_GROUPS.items()]
    raw = [F.regexp_count(s, F.lit("(?i)" + p)) for p in FUNCTIONAL_GROUPS.values()]
    total = sum(raw, F.lit(0))
    diversity = sum((F.when(r > 0, 1).otherwise(0) for r in raw), F.lit(0))
    return F.struct(*counts, total.cast("int").alias("total"), diversity.cast("int").alias("diversity"))


def lipinski_estimated(smiles) -> Column:
    """Estimated HBD (#OH + #NH), HBA (N + O), violation count and label."""
    s = _col(smiles)
    p = estimated_properties(s)
    hbd = count_sub(s, "OH") + count_sub(s, "NH")
    hba = count_chars(s, "Nn") + count_chars(s, "Oo")
    v = ((p["mw"] > 500).cast("int") + (p["logp"] > 5).cast("int")
         + (hbd > 5).cast("int") + (hba > 10).cast("int"))
    label = (F.when(v == 0, "Excellent").when(v == 1, "Good").when(v == 2, "Poor")
              .otherwise("Very Poor"))
    return F.struct(hbd.alias("hbd"), hba.alias("hba"), v.alias("violations"), label.alias("label"))


def ring_count(smiles) -> Column:
    return count_chars(_col(smiles), "123")


def string_descriptors(smiles) -> Column:
    """Rings, aromatic atoms, rotatable bonds, length, distinct characters."""
    s = _col(smiles)
    rings = ring_count(s)
    rot = F.greatest(count_chars(s, "-") + count_chars(s, "=") - rings, F.lit(0))
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda ch: ch != "")
    return F.struct(rings.alias("ring_count"), count_chars(s, "c").alias("aromatic_rings"),
                    rot.alias("rotatable_bonds"), F.length(s).alias("length"),
                    F.size(chars).alias("char_diversity"))


def complexity(smiles) -> Column:
    """Structural complexity, synthetic accessibility, ring systems, branch points."""
    s = _col(smiles)
    rings = ring_count(s)
    branches = count_chars(s, "(")
    c = F.length(s) / F.lit(20.0) + rings * F.lit(0.5) + branches * F.lit(0.3)
    return F.struct(F.least(F.lit(10.0), c).alias("structural"),
                    F.least(F.lit(10.0), F.lit(1.0) + c).alias("sa_score"),
                    rings.alias("ring_systems"), branches.alias("branch_points"))


def atomic_composition(smiles) -> Column:
    """I16: element -> count for C N O S P F (both cases) and Cl Br I as written;
    zero entries removed."""
    s = _col(smiles)
    entries = [("C", count_chars(s, "Cc")), ("N", count_chars(s, "Nn")), ("O", count_chars(s, "Oo")),
               ("S", count_chars(s, "Ss")), ("P", count_chars(s, "Pp")), ("F", count_chars(s, "Ff")),
               ("Cl", count_sub(s, "Cl")), ("Br", count_sub(s, "Br")), ("I", count_chars(s, "I"))]
    kv = []
    for k, v in entries:
        kv += [F.lit(k), v.cast("int")]
    return F.map_filter(F.create_map(*kv), lambda k, v: v > 0)


def admet_flags(tpsa, mw, rotatable, sa_score, structural, rings) -> Column:
    """Rule-based ADMET categories."""
    tpsa, mw, rotatable = _col(tpsa), _col(mw), _col(rotatable)
    sa_score, structural, rings = _col(sa_score), _col(structural), _col(rings)
    return F.struct(
        (tpsa <= 140).alias("oral_tpsa_ok"),
        (mw <= 500).alias("oral_mw_ok"),
        F.when(tpsa <= 90, "Likely").when(tpsa <= 140, "Moderate").otherwise("Unlikely").alias("bbb"),
        (rotatable <= 10).alias("metabolic_ok"),
        F.when(sa_score <= 3, "Easy").when(sa_score <= 6, "Moderate").otherwise("Difficult")
         .alias("synthesis"),
        F.when(structural < 2, "Low").when(structural < 4, "Medium").otherwise("High")
         .alias("complexity_class"),
        F.when(rings == 0, "Acyclic").when(rings <= 2, "Simple cyclic").otherwise("Polycyclic")
         .alias("ring_type"),
    )


def overall_score(violations, sa_score, mw) -> Column:
    """Mean of three sub-scores and its grade."""
    v, sa, mw = _col(violations), _col(sa_score), _col(mw)
    lip = F.greatest(F.lit(0.0), (F.lit(4) - v) / F.lit(4.0) * F.lit(100))
    syn = F.greatest(F.lit(0.0), (F.lit(10) - sa) / F.lit(10.0) * F.lit(100))
    mws = F.when(mw <= 500, F.lit(85.0)).otherwise(F.lit(60.0))
    score = (lip + syn + mws) / F.lit(3.0)
    grade = F.when(score >= 80, "Excellent").when(score >= 60, "Good").otherwise("Needs optimization")
    priority = F.when(score >= 80, "High").when(score >= 60, "Medium").otherwise("Optimization needed")
    return F.struct(score.alias("score"), grade.alias("grade"), priority.alias("priority"))


def advisories(mw, logp, tpsa, sa_score, violations) -> Column:
    """Warnings then recommendations, in rule order; absent rules are skipped."""
    mw, logp, tpsa, sa, v = map(_col, (mw, logp, tpsa, sa_score, violations))
    # Advisory texts, in the order they are emitted.
    rules = [
        F.when(mw > 500, F.lit("High molecular weight may reduce oral bioavailability")),
        F.when(logp > 5, F.lit("High lipophilicity may cause solubility issues")),
        F.when(logp < 0, F.lit("Low lipophilicity may affect membrane permeability")),
        F.when(tpsa > 140, F.lit("High TPSA may limit oral absorption")),
        F.when(sa > 6, F.lit("High synthetic complexity may increase development costs")),
        F.when(v == 0, F.lit("Excellent drug-like properties - proceed with confidence"))
         .when(v == 1, F.lit("Good drug candidate with minor optimization needed"))
         .otherwise(F.lit("Consider structural modifications to improve drug-likeness")),
        F.when(tpsa <= 90, F.lit("Good CNS penetration potential for neurological targets")),
        F.when(sa <= 3, F.lit("Favorable synthetic accessibility for development")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def text_summary(smiles) -> Column:
    """Length, distinct characters, distinct letters, branch count, digit count."""
    s = _col(smiles)
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda ch: ch != "")
    letters = F.filter(chars, lambda ch: ch.rlike(r"^\p{IsAlphabetic}$"))
    return F.struct(F.length(s).alias("length"), F.size(chars).alias("distinct_chars"),
                    F.size(letters).alias("distinct_letters"), count_chars(s, "(").alias("branches"),
                    count_chars(s, "0123456789").alias("digits"))


def bit_fingerprint(smiles, n_bits: int = 1024) -> Column:
    """Set-bit positions of the text fingerprint: bit i (i < n_bits) is set
    when the code point of character i is odd."""
    s = _col(smiles)
    idx = F.sequence(F.lit(0), F.least(F.length(s), F.lit(n_bits)) - 1)
    return F.when(F.length(s) > 0,
                  F.filter(idx, lambda i: F.ascii(F.substr(s, i + 1, F.lit(1))) % 2 == 1)) \
        .otherwise(F.array().cast("array<int>"))


def trigrams(smiles) -> Column:
    """Distinct runs of three characters of a SMILES string (empty for shorter strings)."""
    s = _col(smiles)
    at = F.when(F.length(s) >= 3, F.sequence(F.lit(1), F.length(s) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(s, i, F.lit(3))))
