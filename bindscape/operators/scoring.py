"""K1: pluggable scoring of (protein, compound) rows.

A model is a factory: it runs once per task, so the model is built once, and it is called per Arrow batch, or per
row if that is all it can do (``score_by_capability``). Native scorers are column expressions and need none of this.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# What a predictor of single affinities, and no predictor, give.
BASIC_CONFIDENCE = 0.85
CONSTANT_AFFINITY, CONSTANT_CONFIDENCE = 0.75, 0.85


def score_batch(df: DataFrame, model_factory, protein: str = "protein", compound: str = "compound",
                out: str = "binding_affinity", fallback: float | None = None) -> DataFrame:
    """Add ``out`` = the model's score of every row; ``model_factory()`` gives ``predict(proteins, compounds) ->
    scores``. ``fallback`` replaces a failed batch (the constant fallback) instead of failing the task."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def run(batches):
        predict = model_factory()            # once per task
        for pdf in batches:
            try:
                scores = predict(pdf[protein].tolist(), pdf[compound].tolist())
            except Exception:               # noqa: BLE001 - any fault of the model falls back to a constant
                if fallback is None:
                    raise
                scores = [fallback] * len(pdf)
            pdf = pdf.copy()
            pdf[out] = scores
            yield pdf

    return df.mapInPandas(run, schema)


def _scorer(predictor):
    """``(capability, score)`` by what a predictor can do, the best first; ``score`` takes two lists and gives
    pairs (affinity, confidence)."""
    if hasattr(predictor, "predict_batch"):
        return "batch", predictor.predict_batch
    if hasattr(predictor, "predict_single"):
        return "single", lambda a, b: [predictor.predict_single(x, y) for x, y in zip(a, b, strict=True)]
    if hasattr(predictor, "predict_interaction"):
        return "basic", lambda a, b: [(predictor.predict_interaction(x, y), BASIC_CONFIDENCE) for x, y in zip(a, b, strict=True)]
    return "constant", lambda a, b: [(CONSTANT_AFFINITY, CONSTANT_CONFIDENCE)] * len(a)


def score_by_capability(df: DataFrame, factory, inputs: tuple[str, str] = ("protein", "compound"),
                        on_error: str = "raise") -> DataFrame:
    """K1: ``df`` with ``binding_affinity``, ``confidence`` and ``capability``. ``factory()`` builds a predictor once per
    task; what it can do is asked once, in this order: ``predict_batch(list, list)`` and ``predict_single(a, b)`` give
    (affinity, confidence), ``predict_interaction(a, b)`` an affinity; without any of them every row gets the constants.
    ``inputs`` are the two columns that it is given (strings, or descriptors made per dimension row). ``close()`` is called at
    the end of the task if there is one. With ``on_error="constant"`` the rows of a failed call get the constants and the capability
    ``fallback`` (a batch fails as a whole); otherwise the task fails. Null inputs are passed as None."""
    if on_error not in ("raise", "constant"):
        raise ValueError("on_error must be raise or constant")
    added = [T.StructField("binding_affinity", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
             T.StructField("capability", T.StringType())]
    first, second = (df.columns.index(c) for c in inputs)

    def run(batches):
        predictor = factory()
        try:
            kind, score = _scorer(predictor)
            for batch in batches:
                a, b = batch.column(first).to_pylist(), batch.column(second).to_pylist()
                kinds = [kind] * len(a)
                try:
                    found = score(a, b)
                except Exception:           # noqa: BLE001 - any fault of the predictor falls back to the constants
                    if on_error == "raise":
                        raise
                    found, kinds = _one_by_one(kind, score, a, b)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([float(x[0]) for x in found], pa.float64()),
                     pa.array([float(x[1]) for x in found], pa.float64()), pa.array(kinds, pa.string())],
                    names=[*batch.schema.names, *[f.name for f in added]])
        finally:
            if hasattr(predictor, "close"):
                predictor.close()

    return df.mapInArrow(run, T.StructType(list(df.schema.fields) + added))


def _one_by_one(kind: str, score, a: list, b: list) -> tuple[list, list]:
    """A failed batch: constants for all; rows of a predictor without batches are tried singly."""
    found, kinds = [], []
    for x, y in zip(a, b, strict=True):
        try:
            if kind == "batch":
                raise ValueError
            found += score([x], [y])
            kinds.append(kind)
        except Exception:                   # noqa: BLE001
            found.append((CONSTANT_AFFINITY, CONSTANT_CONFIDENCE))
            kinds.append("fallback")
    return found, kinds
