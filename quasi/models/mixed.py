"""Logistic regression with a random intercept per group.

Penalised iteratively reweighted least squares with a Laplace-type update of the intercept variance. An
iteration is one grouped aggregate: the sums of each group are all that the fixed effects, the group
intercepts and the variance need. They stay in Spark, checkpointed, however many groups there are. The variance of
the working model is solved in each iteration by secant steps on its logarithm, as closely as the last iteration
calls for. Each step is one aggregate of the group sums that returns two small matrices; the intercepts are joined
back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.models.design import build_design
from quasi.models.linear import Fit, _sources, complete_rows, compress
from quasi.operators.skew import null_safe
from quasi.session import cut_lineage

INNER_STEPS = 200
LEAST_VARIANCE = 1e-8


@dataclass
class RandomIntercept:
    fit: Fit
    variance: float
    effects: DataFrame
    iterations: int


def solve_variance(profile: Callable[[float], tuple], variance: float, tol: float) -> tuple[float, tuple]:
    """The variance that its own update returns, and ``profile`` there; ``profile`` returns (update, ...)."""
    floor, last = math.log(LEAST_VARIANCE), None
    x = max(math.log(variance), floor)
    for _ in range(INNER_STEPS):
        found = profile(math.exp(x))
        gap = math.log(max(found[0], LEAST_VARIANCE)) - x
        if abs(gap) < tol or (x <= floor and gap <= 0):
            return math.exp(x), found
        step = gap
        if last is not None and gap != last[1]:
            secant = -gap * (x - last[0]) / (gap - last[1])
            step = secant if secant * gap > 0 else gap
        last = (x, gap)
        x = max(x + max(-2.0, min(2.0, step)), floor)
    raise RuntimeError(f"the variance has not converged in {INNER_STEPS} steps")


def _group_products(sums: DataFrame, p: int, variance: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Cross-products of the groups' (sx, sz) over their precision, means of those over its square, and mean 1 / precision."""
    z = [*[f"sx{i}" for i in range(p)], "sz"]
    places = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    share = sums.select(*z, (1.0 / (F.col("sw") + F.lit(1.0 / variance))).alias("r"))
    found = share.agg(
        F.avg("r"), *[F.expr(f"sum(r * {z[i]} * {z[j]})") for i, j in places], *[F.expr(f"avg(r * r * {z[i]} * {z[j]})") for i, j in places]
    ).first()
    once, twice = np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1))
    for at, (i, j) in enumerate(places):
        once[i, j] = once[j, i] = found[1 + at]
        twice[i, j] = twice[j, i] = found[1 + len(places) + at]
    return once, twice, found[0]


def random_intercept_logit(
    df: DataFrame, y: str, terms: Sequence, group: str, positive: object = 1, max_iter: int = 60, tol: float = 1e-6,
) -> RandomIntercept:
    """Fit fixed effects, the variance of the intercepts, and each group's intercept.

    Rows with a null in a used column take no part. Raises when the fit has not settled after ``max_iter`` iterations.
    """
    used = [y, group, *_sources(terms)]
    rows = complete_rows(df, used).withColumn("__y", (F.col(y) == F.lit(positive)).cast("double"))
    design = build_design(rows, terms)
    p = len(design.columns)
    if design.discrete:
        source = compress(rows, design.sources, "__y", None, [group])
    else:
        source = rows.select(*dict.fromkeys([*design.sources, group]), F.lit(1.0).alias("__w"), F.col("__y").alias("__wy"), F.lit(1).alias("__n"))
    source = source.withColumn("__gkey", F.col(group).cast("string")).persist()
    n, total, ysum = source.agg(F.sum("__n"), F.sum("__w"), F.sum("__wy")).first()
    rate = ysum / total
    beta = np.zeros(p)
    beta[0] = np.log(rate / (1 - rate))
    variance = 0.25
    effects = None
    w, yb = F.col("__w"), F.col("__wy") / F.col("__w")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def eta_of(b: np.ndarray, offset: Column) -> Column:
        out = offset
        for v, c in zip(b, design.columns):
            out = out + F.lit(float(v)) * c
        return out

    def group_sums(state: DataFrame, eta: Column) -> DataFrame:
        mu = 1.0 / (1.0 + F.exp(-eta))
        curve = F.greatest(mu * (1.0 - mu), F.lit(1e-10))
        parts = state.select(
            "__gkey", (w * curve).alias("v"), (eta + (yb - mu) / curve).alias("z"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(design.columns)]
        )
        return parts.groupBy("__gkey").agg(
            F.expr("sum(v)").alias("sw"), F.expr("sum(v * z)").alias("sz"),
            *[F.expr(f"sum(v * x{i})").alias(f"sx{i}") for i in range(p)],
            *[F.expr(f"sum(v * z * x{i})").alias(f"sxz{i}") for i in range(p)],
            *[F.expr(f"sum(v * x{i} * x{j})").alias(f"sxx{i}_{j}") for i, j in pairs],
        )

    used_iterations, vcov, moved = 0, np.zeros((p, p)), 1.0
    for used_iterations in range(1, max_iter + 1):
        if effects is None:
            state, offset = source, F.lit(0.0)
        else:
            side = effects.select(F.col("__gkey").alias("__side"), "b")
            state = source.join(side, null_safe(source, side, [("__gkey", "__side")]), "left")
            offset = F.coalesce(F.col("b"), F.lit(0.0))
        sums = cut_lineage(group_sums(state, eta_of(beta, offset)))
        totals = sums.agg(
            *[F.sum(f"sxx{i}_{j}").alias(f"sxx{i}_{j}") for i, j in pairs], *[F.sum(f"sxz{i}").alias(f"sxz{i}") for i in range(p)]
        ).first()
        xx = np.zeros((p, p))
        for i, j in pairs:
            xx[i, j] = xx[j, i] = totals[f"sxx{i}_{j}"]
        xz = np.array([totals[f"sxz{i}"] for i in range(p)])

        def profile(v: float):
            once, twice, spread = _group_products(sums, p, v)
            a = xx - once[:p, :p]
            new = np.linalg.solve(a, xz - once[:p, p])
            # The intercepts are (sz - sx'new) / precision, so their mean square is a quadratic form of the sums.
            along = np.append(-new, 1.0)
            return along @ twice @ along + spread, a, new

        new_variance, (_, a, new) = solve_variance(profile, variance, max(tol * 0.01, min(moved, 1.0) * 0.01))
        rest = F.col("sz") - sum((F.lit(float(c)) * F.col(f"sx{i}") for i, c in enumerate(new)), F.lit(0.0))
        effects = sums.select("__gkey", (rest / (F.col("sw") + F.lit(1.0 / new_variance))).alias("b"))
        moved = max(float(np.max(np.abs(new - beta))), abs(new_variance - variance) / max(variance, 1e-8))
        beta, variance = new, new_variance
        vcov = np.linalg.inv(a)
        if moved < tol:
            break
    else:
        source.unpersist()
        raise RuntimeError(f"the model has not converged in {max_iter} iterations")
    effects = effects.select(F.col("__gkey").alias("group"), F.col("b").alias("effect"))
    source.unpersist()
    return RandomIntercept(Fit(design, design.names, beta, vcov, float(n), None, {}, "binomial"), variance, effects, used_iterations)
