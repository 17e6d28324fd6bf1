"""A fitted affinity scorer: least squares of pKd on two string descriptors.

The fit is one aggregate (means, variances and covariances), whatever the size
of the training table; the score is a column expression, so it stays in the JVM
wherever pairs are scored. ``linear_model`` is the same model for the batch
scorer's Python path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HYDROPHOBIC = "AILMFWV"
DECIMALS = 4


@dataclass(frozen=True)
class LinearAffinity:
    """``score = intercept + letters * (letters of the SMILES) + hydrophobic * (share of the sequence)``."""

    intercept: float
    letters: float
    hydrophobic: float

    def of(self, letters: Column, share: Column) -> Column:
        """Score from the two descriptors."""
        return F.round(F.lit(self.intercept) + F.lit(self.letters) * letters + F.lit(self.hydrophobic) * share, DECIMALS)

    def of_compound(self, compound) -> Column:
        """What the score needs of a compound: one number, worked out once per string."""
        return letter_count(compound)

    def of_protein(self, protein) -> Column:
        """What the score needs of a protein: one number, worked out once per string."""
        return hydrophobic_share(protein)

    def __call__(self, protein, compound) -> Column:
        return self.of(self.of_compound(compound), self.of_protein(protein))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letter_count(compound) -> Column:
    """Letters of a SMILES string (its heavy atoms, roughly); null counts as none."""
    return F.coalesce(F.length(F.regexp_replace(_col(compound), "[^A-Za-z]", "")), F.lit(0)).cast("double")


def hydrophobic_share(protein) -> Column:
    """Share of hydrophobic residues in a sequence; 0 for a null or empty one."""
    s = F.upper(_col(protein))
    n = F.length(s)
    return F.coalesce(F.when(n > 0, (n - F.length(F.translate(s, HYDROPHOBIC, ""))) / n), F.lit(0.0))


def fit_affinity(pairs: DataFrame, pkd: str = "pKd", letters: Column | None = None,
                 hydrophobic: Column | None = None) -> LinearAffinity:
    """Least squares over rows with a pKd. The descriptors are worked out from ``compound`` and ``protein``
    unless given (as columns that a dimension table holds once per string). A descriptor that
    doesn't vary gets weight 0; without rows the score is 0."""
    a = letter_count("compound") if letters is None else letters
    b = hydrophobic_share("protein") if hydrophobic is None else hydrophobic
    d = pairs.where(F.col(pkd).isNotNull() & ~F.isnan(pkd)).select(
        a.alias("a"), b.alias("b"), F.col(pkd).cast("double").alias("y"))
    s = d.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("y").alias("my"), F.var_pop("a").alias("aa"),
              F.var_pop("b").alias("bb"), F.covar_pop("a", "b").alias("ab"), F.covar_pop("a", "y").alias("ay"),
              F.covar_pop("b", "y").alias("by")).first()
    if s["my"] is None:
        return LinearAffinity(0.0, 0.0, 0.0)
    det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
    if det > 1e-12 * s["aa"] * s["bb"] and det > 0:
        wa, wb = (s["bb"] * s["ay"] - s["ab"] * s["by"]) / det, (s["aa"] * s["by"] - s["ab"] * s["ay"]) / det
    else:
        wa, wb = (s["ay"] / s["aa"], 0.0) if s["aa"] > 0 else (0.0, s["by"] / s["bb"] if s["bb"] > 0 else 0.0)
    return LinearAffinity(s["my"] - wa * s["ma"] - wb * s["mb"], wa, wb)


def linear_model(model: LinearAffinity):
    """Factory for ``score_batch``: the same scores from Arrow batches."""
    def build():
        def predict(proteins, compounds):
            out = []
            for p, c in zip(proteins, compounds, strict=True):
                p, c = (p or "").upper(), c or ""
                share = sum(p.count(x) for x in HYDROPHOBIC) / len(p) if p else 0.0
                letters = sum(x.isascii() and x.isalpha() for x in c)
                out.append(model.intercept + model.letters * letters + model.hydrophobic * share)
            return out
        return predict
    return build
