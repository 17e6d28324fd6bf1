"""Protein-sequence column expressions.

Letters are counted in one pass over a sequence, whatever the number of sets and weights that are
asked for: ``letter_tally`` gets Arrow batches and bins the bytes of a row (equal calls in one
projection are evaluated once). Sequences are never exploded into rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The twenty standard residues.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Residue table of the profiling analyzer
# residue: (name, type, charge, hydrophobic, molecular weight)
RESIDUE_INFO = {
    "A": ("Alanine", "Nonpolar", "Neutral", True, 89.1),
    "R": ("Arginine", "Basic", "Positive", False, 174.2),
    "N": ("Asparagine", "Polar", "Neutral", False, 132.1),
    "D": ("Aspartic acid", "Acidic", "Negative", False, 133.1),
    "C": ("Cysteine", "Polar", "Neutral", False, 121.2),
    "Q": ("Glutamine", "Polar", "Neutral", False, 146.1),
    "E": ("Glutamic acid", "Acidic", "Negative", False, 147.1),
    "G": ("Glycine", "Nonpolar", "Neutral", False, 75.1),
    "H": ("Histidine", "Basic", "Positive", False, 155.2),
    "I": ("Isoleucine", "Nonpolar", "Neutral", True, 131.2),
    "L": ("Leucine", "Nonpolar", "Neutral", True, 131.2),
    "K": ("Lysine", "Basic", "Positive", False, 146.2),
    "M": ("Methionine", "Nonpolar", "Neutral", True, 149.2),
    "F": ("Phenylalanine", "Aromatic", "Neutral", True, 165.2),
    "P": ("Proline", "Nonpolar", "Neutral", False, 115.1),
    "S": ("Serine", "Polar", "Neutral", False, 105.1),
    "T": ("Threonine", "Polar", "Neutral", False, 119.1),
    "W": ("Tryptophan", "Aromatic", "Neutral", True, 204.2),
    "Y": ("Tyrosine", "Aromatic", "Neutral", False, 181.2),
    "V": ("Valine", "Nonpolar", "Neutral", True, 117.1),
}

# Residue weights of the sequence-statistics helper (a second,
# different table; unknown residues weigh 110.0 there but never occur because
# invalid sequences are rejected first).
STATS_WEIGHTS = {
    "A": 89.1, "C": 121.0, "D": 133.1, "E": 147.1, "F": 165.2,
    "G": 75.1, "H": 155.2, "I": 131.2, "K": 146.2, "L": 131.2,
    "M": 149.2, "N": 132.1, "P": 115.1, "Q": 146.2, "R": 174.2,
    "S": 105.1, "T": 119.1, "V": 117.1, "W": 204.2, "Y": 181.2,
}

# Residue groups.
HYDROPHOBIC = "".join(a for a, v in RESIDUE_INFO.items() if v[3])          # AILMFWV
POLAR = "".join(a for a, v in RESIDUE_INFO.items() if v[1] in ("Polar", "Basic", "Acidic"))
CHARGED = "".join(a for a, v in RESIDUE_INFO.items() if v[2] in ("Positive", "Negative"))
AROMATIC = "".join(a for a, v in RESIDUE_INFO.items() if v[1] == "Aromatic")
BASIC = "".join(a for a, v in RESIDUE_INFO.items() if v[1] == "Basic")
ACIDIC = "".join(a for a, v in RESIDUE_INFO.items() if v[1] == "Acidic")
STATS_HYDROPHOBIC = "AILMFPWV"
STATS_CHARGED = "DEKR"
UI_HYDROPHOBIC = "AILMFPWV"
UI_POLAR = "NQST"
UI_CHARGED = "DEKR"
UI_AROMATIC = "FWY"

# Tokenizer ids (cls, pad, eos, unknown, residues in id order).
TOKEN_CLS, TOKEN_PAD, TOKEN_EOS, TOKEN_UNK = 2, 0, 3, 1
TOKEN_RESIDUES = "ARNDCQEGHILKMFPSTWYV"          # ids 5 .. 24
TOKEN_FIRST_ID = 5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_chars(s, chars: str) -> Column:
    """Number of characters of ``s`` that are in ``chars``."""
    s = _col(s)
    return F.length(s) - F.length(F.translate(s, chars, ""))


_TALLY = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("c", T.ArrayType(T.IntegerType()))])


def _bytes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


@F.arrow_udf(_TALLY)
def _tally(v: pa.Array) -> pa.Array:
    lengths, letters = np.zeros(len(v), np.int32), np.zeros((len(v), 26), np.int32)
    for i, value in enumerate(v):
        if value.is_valid and (x := _bytes(value)).size:
            bins = np.bincount(x, minlength=256)
            lengths[i] = x.size - bins[128:192].sum()                   # a code point has one byte that continues none
            letters[i] = bins[65:91]
    c = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * 26), pa.array(letters.ravel()))
    return pa.StructArray.from_arrays([pa.array(lengths), c], names=["n", "c"], mask=v.is_null())


def _character_maps(v: pa.Array, shares: bool) -> pa.Array:
    """Per string a map from each of its characters, in order, to its count or its percentage of the length."""
    offsets, keys, counts = [0], [], []
    for value in v:
        if value.is_valid:
            bins = np.bincount(_bytes(value), minlength=256)
            if bins[128:].any():
                found = sorted(Counter(value.as_py()).items())
            else:
                found = [(chr(b), bins[b]) for b in np.flatnonzero(bins)]
            keys += [k for k, _ in found]
            length = sum(int(n) for _, n in found)
            counts += [int(n) * 100.0 / length if shares else int(n) for _, n in found]
        offsets.append(len(keys))
    flat = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()),
                                   pa.array(counts, pa.float64() if shares else pa.int32()))
    if not v.null_count:
        return flat
    return pa.array([None if null else m for null, m in zip(v.is_null().to_pylist(), flat.to_pylist(), strict=True)], flat.type)


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def _characters(v: pa.Array) -> pa.Array:
    return _character_maps(v, shares=False)


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def _character_shares(v: pa.Array) -> pa.Array:
    return _character_maps(v, shares=True)


def letter_tally(seq) -> Column:
    """``(n, c)``: the number of characters, and the counts of the letters A to Z; null for a null sequence."""
    return _tally(_col(seq))


def tallied(tally: Column, letters: str) -> Column:
    """Number of characters among capital ``letters`` in a tallied sequence."""
    return sum((tally["c"][ord(a) - 65] for a in letters[1:]), tally["c"][ord(letters[0]) - 65])


def normalize_protein(seq) -> Column:
    """B1: upper case, spaces and newlines removed."""
    return F.upper(F.replace(F.replace(_col(seq), F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def is_valid_protein(seq) -> Column:
    """B2: non-empty and every residue in the standard alphabet after B1."""
    n = normalize_protein(seq)
    return F.coalesce(n.rlike(f"^[{AMINO_ACIDS}]+$"), F.lit(False))


def is_valid_protein_strict(seq) -> Column:
    """Service variant: no whitespace removal before the alphabet check."""
    s = _col(seq)
    return F.coalesce(F.upper(s).rlike(f"^[{AMINO_ACIDS}]+$"), F.lit(False))


def invalid_characters(seq) -> Column:
    """Sorted distinct characters of the normalized sequence outside the alphabet."""
    n = normalize_protein(seq)
    chars = F.array_distinct(F.split(n, ""))
    return F.sort_array(F.filter(chars, lambda ch: ~F.lit(AMINO_ACIDS).contains(ch) | (ch == "")))


def residue_mw(seq) -> Column:
    """Molecular weight, sum of residue weights (unknown residues weigh 0)."""
    t = letter_tally(seq)
    return sum((tallied(t, a) * F.lit(v[4]) for a, v in RESIDUE_INFO.items()), F.lit(0.0))


def estimated_pi(seq) -> Column:
    """Simplified isoelectric point from basic minus acidic counts."""
    t = letter_tally(seq)
    b, a = tallied(t, BASIC), tallied(t, ACIDIC)
    return (F.when(b > a, F.lit(8.5) + (b - a) * F.lit(0.1))
             .when(a > b, F.lit(5.5) - (a - b) * F.lit(0.1))
             .otherwise(F.lit(7.0)))


def property_groups(seq) -> Column:
    """I4: residue-group counts and percentages of length (null percentages when empty)."""
    t = letter_tally(seq)
    n = t["n"]
    fields = []
    for name, chars in (("hydrophobic", HYDROPHOBIC), ("polar", POLAR), ("charged", CHARGED),
                        ("aromatic", AROMATIC), ("basic", BASIC), ("acidic", ACIDIC)):
        cnt = tallied(t, chars)
        fields.append(cnt.alias(name))
        fields.append(F.when(n > 0, cnt * F.lit(100.0) / n).alias(f"{name}_pct"))
    return F.struct(*fields)


def residue_counts(seq) -> Column:
    """Map residue -> count for every character present (sorted keys)."""
    return _characters(_col(seq))


def residue_percentages(seq) -> Column:
    """Map residue -> percentage of the length for every character present."""
    return _character_shares(_col(seq))


def sequence_stats(seq) -> Column:
    """``valid`` and, for a valid sequence, its length, the counts of the 20 residues
    (map), weight (second table) and ratios; these are null when it is invalid."""
    n = normalize_protein(seq)
    ok = is_valid_protein(seq)
    t = letter_tally(n)
    ln = t["n"]
    mw = sum((tallied(t, a) * F.lit(w) for a, w in STATS_WEIGHTS.items()), F.lit(0.0))
    counts = F.create_map(*[x for a in STATS_WEIGHTS for x in (F.lit(a), tallied(t, a))])
    return F.struct(
        F.coalesce(ok, F.lit(False)).alias("valid"),
        F.when(ok, ln).alias("length"),
        F.when(ok, counts).alias("residue_counts"),
        F.when(ok, mw).alias("molecular_weight"),
        F.when(ok, tallied(t, STATS_HYDROPHOBIC) / ln).alias("hydrophobic_ratio"),
        F.when(ok, tallied(t, STATS_CHARGED) / ln).alias("charged_ratio"),
    )


def residue_classes_ui(seq) -> Column:
    """UI residue classes, counts and percentages of the upper-cased sequence."""
    t = letter_tally(F.upper(_col(seq)))
    n = t["n"]
    fields = []
    for name, chars in (("hydrophobic", UI_HYDROPHOBIC), ("polar", UI_POLAR),
                        ("charged", UI_CHARGED), ("aromatic", UI_AROMATIC)):
        cnt = tallied(t, chars)
        fields.append(cnt.alias(name))
        fields.append(F.when(n > 0, cnt * F.lit(100.0) / n).alias(f"{name}_pct"))
    return F.struct(*fields)


def sequence_quality(length) -> Column:
    """clamp(0.9 - (len - 100) * 0.001, 0.7, 0.95)."""
    x = F.lit(0.9) - (_col(length) - F.lit(100)) * F.lit(0.001)
    return F.least(F.greatest(x, F.lit(0.7)), F.lit(0.95))


def token_map() -> Column:
    """Residue -> token id literal map."""
    kv = []
    for i, a in enumerate(TOKEN_RESIDUES):
        kv += [F.lit(a), F.lit(TOKEN_FIRST_ID + i)]
    return F.create_map(*kv)


def tokenize(seq, max_len: int = 1024) -> Column:
    """Cls + residue ids (unknown -> 1) + eos; a longer sequence keeps the
    first ``max_len - 1`` tokens and ends with eos."""
    chars = F.filter(F.split(F.upper(_col(seq)), ""), lambda ch: ch != "")
    m = token_map()
    ids = F.transform(chars, lambda ch: F.coalesce(F.element_at(m, ch), F.lit(TOKEN_UNK)))
    full = F.concat(F.array(F.lit(TOKEN_CLS)), ids, F.array(F.lit(TOKEN_EOS)))
    cut = F.concat(F.slice(full, 1, max_len - 1), F.array(F.lit(TOKEN_EOS)))
    return F.when(F.size(full) > max_len, cut).otherwise(full)
