"""Row filters and derived columns of the preparation and cleaning steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.functions import protein as P
from bindscape.functions import smiles as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def validate_pair(df: DataFrame, protein: str = "protein", smiles: str = "compound") -> DataFrame:
    """Service validation; invalid rows stay, flagged with an error text."""
    ok = (F.coalesce(F.length(protein) > 0, F.lit(False))
          & P.is_valid_protein_strict(protein) & S.is_valid_smiles_service(smiles))
    return (df.withColumn("is_valid", ok)
              .withColumn("error", F.when(~ok, F.lit("Invalid input sequences"))))


def clean_interactions(df: DataFrame, protein: str = "protein", compound: str = "compound",
                       distinct_input: bool = False) -> DataFrame:
    """Keep rows whose raw protein equals its normalized form and is valid,
    whose raw compound equals its stripped form and is valid; drop exact
    duplicate rows; add lengths.

    The reference tests membership of the raw value in the set of normalized
    valid values; normalization is idempotent, so that membership is exactly
    ``raw == normalize(raw) AND valid(raw)`` - a filter, no join."""
    keep = ((F.col(protein) == P.normalize_protein(protein)) & P.is_valid_protein(protein)
            & (F.col(compound) == S.strip(compound)) & S.is_valid_smiles(compound))
    kept = df.filter(keep)
    kept = kept if distinct_input else kept.dropDuplicates()
    return (kept
              .withColumn("protein_length", F.length(protein))
              .withColumn("compound_length", F.length(compound)))


# Strict length bounds of a training row.
PROTEIN_LENGTHS, COMPOUND_LENGTHS = (10, 1024), (5, 200)


def lengths_in_range(protein_length: Column, compound_length: Column, protein_range=PROTEIN_LENGTHS,
                     compound_range=COMPOUND_LENGTHS) -> Column:
    """B8 on given lengths: strict bounds."""
    return ((protein_length > protein_range[0]) & (protein_length < protein_range[1])
            & (compound_length > compound_range[0]) & (compound_length < compound_range[1]))


def filter_length_ranges(df: DataFrame, protein: str = "protein", compound: str = "compound",
                         protein_range=PROTEIN_LENGTHS, compound_range=COMPOUND_LENGTHS) -> DataFrame:
    """Strict bounds on protein and compound lengths."""
    return df.filter(lengths_in_range(F.length(protein), F.length(compound), protein_range, compound_range))


def to_pkd(affinity) -> Column:
    """Values above 100 are read as Kd in nM and converted; others kept."""
    a = _col(affinity)
    return F.when(a > 100, -F.log10(a * F.lit(1e-9))).otherwise(a)


def filter_pkd_range(df: DataFrame, pkd: str = "pKd", lo: float = 4.0, hi: float = 12.0) -> DataFrame:
    """``lo <= pKd <= hi``; NaN and null fail the test and are dropped."""
    return df.filter(F.col(pkd).between(lo, hi) & ~F.isnan(pkd))


def binding_label(pkd, threshold: float = 6.0) -> Column:
    """1 when pKd >= threshold else 0."""
    return (_col(pkd) >= F.lit(threshold)).cast("int")


def valid_affinity(df: DataFrame, affinity: str = "affinity") -> DataFrame:
    """Drop NaN, null and non-positive affinities."""
    return df.filter(~F.isnan(affinity) & (F.col(affinity) > 0))


def add_training_columns(df: DataFrame, affinity: str = "affinity", threshold: float = 6.0) -> DataFrame:
    """B8 -> B9 -> B10 -> B11 as one projection and two filters."""
    out = filter_length_ranges(df).withColumn("pKd", to_pkd(affinity))
    out = filter_pkd_range(out)
    return out.withColumn("binding_label", binding_label("pKd", threshold))


# Role hierarchy for access checks.
ROLE_LEVELS = {"guest": 0, "viewer": 1, "researcher": 2, "admin": 3}


def role_level(role) -> Column:
    m = F.create_map(*[x for k, v in ROLE_LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _col(role)), F.lit(0))


def filter_role_at_least(df: DataFrame, required: str, role: str = "role") -> DataFrame:
    """Keep users whose role level reaches ``required``; admins always pass."""
    need = ROLE_LEVELS.get(required, 0)
    return df.filter((F.col(role) == "admin") | (role_level(role) >= F.lit(need)))
