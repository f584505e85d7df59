"""Scoring from coefficient tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.functions.columns import ColumnLike, as_col

MAX_TERMS = 10_000


def coefficient_map(table: DataFrame) -> dict[str, float]:
    """Term table as a mapping; aliased terms (null estimate) are left out. Its size is checked."""
    rows = table.select("term", "estimate").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r["term"]: r["estimate"] for r in rows if r["estimate"] is not None}


def score_expr(coefs: Mapping[str, float], columns: Mapping[str, Column] | None = None) -> Column:
    """Linear score as one expression; ``columns`` maps terms to expressions (default: same-named)."""
    columns = columns or {}
    out = F.lit(float(coefs.get("(Intercept)", 0.0)))
    for term, b in coefs.items():
        if term != "(Intercept)":
            out = out + F.lit(float(b)) * columns.get(term, F.col(f"`{term}`")).cast("double")
    return out


def score_long(df: DataFrame, key: str, features: Sequence[str], coefs: DataFrame) -> DataFrame:
    """Score by melting the features and joining the term table: (key, eta, probability).

    Row sums are combined before the shuffle; features without a coefficient add nothing.
    """
    long = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [key], list(features), "term", "val"
    )
    table = coefs.where(F.col("estimate").isNotNull()).select("term", "estimate")
    intercept = coefficient_map(table.where(F.col("term") == "(Intercept)")).get("(Intercept)", 0.0)
    terms = table.where(F.col("term") != "(Intercept)")
    if terms.limit(MAX_TERMS + 1).count() <= MAX_TERMS:
        terms = F.broadcast(terms)  # else all rows of a term would meet in one task
    joined = long.join(terms, "term", "left")
    eta = F.coalesce(F.sum(F.col("val") * F.col("estimate")), F.lit(0.0)) + F.lit(float(intercept))
    return joined.groupBy(key).agg(eta.alias("eta")).withColumn("prob", 1.0 / (1.0 + F.exp(-F.col("eta"))))


def predict_clip(prediction: ColumnLike, floor: float = 0.0) -> Column:
    return F.greatest(as_col(prediction), F.lit(floor))


def predict_class(prob: ColumnLike, threshold: float = 0.5, labels: tuple[str, str] = ("Yes", "No")) -> Column:
    prob = as_col(prob)
    return F.when(prob > threshold, labels[0]).when(prob.isNotNull(), labels[1])


def apply_eligibility_score(
    survey: DataFrame, coefs: Mapping[str, float], columns: Mapping[str, Column] | None = None,
    base_weight: str | None = None,
) -> DataFrame:
    """Probability from a model trained elsewhere, and the weight it implies for each respondent."""
    eta = score_expr(coefs, columns)
    scored = survey.withColumn("p_receipt", 1.0 / (1.0 + F.exp(-eta)))
    w = F.col(base_weight).cast("double") if base_weight else F.lit(1.0)
    return scored.withColumn("eligibility_weight", w * F.col("p_receipt"))
