"""Scoring-side column expressions: cache keys, the deterministic default
scorer, affinity categories, training-text formatting and text parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pair_key(protein, smiles) -> Column:
    """md5 hex of ``protein|smiles``."""
    return F.md5(F.concat_ws("|", _col(protein), _col(smiles)))


def unit_hash(*cols) -> Column:
    """Deterministic uniform value in [0, 1) from the first 32 bits of an md5."""
    h = F.md5(F.concat_ws("|", *[_col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_score(protein, smiles) -> Column:
    """Default scorer, uniform on 0.1 .. 9.5 with two decimals, seeded by
    md5 of the pair so a score is the same on every run and every executor."""
    return F.round(F.lit(0.1) + F.lit(9.4) * unit_hash(protein, smiles), 2)


def binding_strength(affinity) -> Column:
    """Strength class and probability = affinity / 10."""
    a = _col(affinity)
    cls = (F.when(a > 7, "Strong").when(a > 5, "Moderate").when(a > 3, "Weak")
            .otherwise("Very Weak"))
    return F.struct(cls.alias("binding_strength"), (a / F.lit(10.0)).alias("interaction_probability"))


def ui_bins(affinity, probability, confidence) -> Column:
    """I21 (UI): high/medium/low bins for affinity (7/5), probability (.7/.4), confidence (.8/.6)."""
    def bins(c, hi, lo):
        c = _col(c)
        return F.when(c > hi, "High").when(c > lo, "Medium").otherwise("Low")
    return F.struct(bins(affinity, 7, 5).alias("affinity_bin"),
                    bins(probability, 0.7, 0.4).alias("probability_bin"),
                    bins(confidence, 0.8, 0.6).alias("confidence_bin"))


def heuristic_affinity(length, emb_mean) -> Column:
    """clamp(6.5 + (len - 65) * .01 + 2m, 4, 9); probability = sigmoid(aff - 5.5);
    confidence = clamp(.8 + .1|m|, .6, .95)."""
    ln, m = _col(length), _col(emb_mean)
    aff = F.greatest(F.lit(4.0), F.least(F.lit(9.0), F.lit(6.5) + (ln - 65) * F.lit(0.01) + m * 2))
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(aff - F.lit(5.5))))
    conf = F.least(F.lit(0.95), F.greatest(F.lit(0.6), F.lit(0.8) + F.abs(m) * F.lit(0.1)))
    return F.struct(aff.alias("binding_affinity"), prob.alias("binding_probability"),
                    conf.alias("confidence"))


def property_categories(pkd, label) -> Column:
    """Probability, confidence and property classes derived from pKd and label."""
    p, lab = _col(pkd), _col(label)
    return F.struct(
        F.when(lab == 1, F.lit(1.0)).otherwise(F.lit(0.3)).alias("binding_prob"),
        F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.lit(1.0) - F.abs(p - 6.0) / F.lit(6.0)))
         .alias("confidence"),
        F.when(p > 6.5, "Low").when(p > 5.0, "Medium").otherwise("High").alias("toxicity_risk"),
        F.when(p < 8.0, "Good").otherwise("Moderate").alias("solubility"),
        F.when((p > 5.0) & (p < 9.0), "High").otherwise("Moderate").alias("druglikeness"),
    )


# Instruction and response templates of the training text.
INSTRUCTION_TEMPLATE = (
    "You are a protein-drug interaction prediction expert. Given a protein sequence and drug "
    "SMILES, predict the binding affinity and properties.\n\n### Protein Sequence:\n%s\n\n"
    "### Drug SMILES:\n%s\n\n### Task:\nPredict the binding affinity (pKd), binding probability, "
    "and drug properties."
)
RESPONSE_TEMPLATE = (
    "Based on the protein-drug interaction analysis:\n\n**Binding Affinity (pKd):** %.2f\n"
    "**Binding Probability:** %.3f\n**Confidence Score:** %.3f\n**Predicted Properties:**\n"
    "- Toxicity Risk: %s\n- Solubility: %s\n- Drug-likeness: %s\n\n**Explanation:** This "
    "prediction is based on protein-drug interaction patterns, molecular properties, and "
    "binding site analysis."
)


def instruction_text(protein, compound) -> Column:
    return F.format_string(INSTRUCTION_TEMPLATE, F.substring(_col(protein), 1, 500), _col(compound))


def response_text(pkd, label) -> Column:
    c = property_categories(pkd, label)
    return F.format_string(RESPONSE_TEMPLATE, _col(pkd), c["binding_prob"], c["confidence"],
                           c["toxicity_risk"], c["solubility"], c["druglikeness"])


def format_text_example(protein, compound, pkd, label) -> Column:
    """Instruction, blank line, response."""
    return F.concat(instruction_text(protein, compound), F.lit("\n\n"), response_text(pkd, label))


def format_chat_example(protein, compound, pkd, label) -> Column:
    """``array<struct<from, value>>`` with one human and one gpt turn."""
    return F.array(
        F.struct(F.lit("human").alias("from"), instruction_text(protein, compound).alias("value")),
        F.struct(F.lit("gpt").alias("from"), response_text(pkd, label).alias("value")),
    )


def parse_prediction(text, fallback=None) -> Column:
    """First ``digits.digits`` number in the text as double, else the fallback."""
    num = F.nullif(F.regexp_extract(_col(text), r"(\d+\.\d+)", 1), F.lit(""))
    parsed = num.try_cast("double")
    return parsed if fallback is None else F.coalesce(parsed, _col(fallback))


def parse_probability(text, default: float = 0.5, strict: bool = False) -> Column:
    """Value after the first ':' of the first line containing
    ``Binding Probability:``; unparsable -> default. ``strict`` keeps the
    reference's behaviour where the markdown ``**`` makes the parse fail;
    otherwise ``*`` is stripped before the number is read."""
    line = F.regexp_extract(_col(text), r"(?m)^(.*Binding Probability:.*)$", 1)
    after = F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
    if not strict:
        after = F.translate(after, "*", "")
    val = F.trim(after).try_cast("double")
    return F.coalesce(val, F.lit(default))


def dissociation_rate(kon, affinity) -> Column:
    """I32: koff = kon / 10 ** affinity."""
    return _col(kon) / F.pow(F.lit(10.0), _col(affinity))
