"""Generalised linear models: logistic, gamma and multinomial.

Logistic and log-link gamma models use Spark's iteratively reweighted least squares, multinomial models
its unpenalised logistic regression. The inverse gamma link has its own iterations here, because a step
can leave the valid range of the link and has to be halved. Factor-only models are merged into cells
first, so iterations run over the distinct regressor combinations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.models.design import Design, build_design, factor, interaction
from quasi.models.linear import Fit, _sources, array_sum, complete_rows, compress, gram, independent_columns, solve_kept


def _assembled(source: DataFrame, design: Design, keep: Sequence[int], extra: Sequence[Column]) -> DataFrame:
    names = [f"x{i}" for i in keep]
    wide = source.select(*[design.columns[i].alias(n) for i, n in zip(keep, names)], *extra)
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).select(
        "features", *[c for c in wide.columns if c not in names]
    )


ROWS_PER_TASK = 50_000
GLM_STEPS = 100
RECTIFIER_STEPS = 200
RECTIFIER_WEIGHT = 1e6
RECTIFIER_ZERO = 1e-5
MAX_COEFFICIENTS = 3000


class NotConverged(RuntimeError):
    """A fit without an optimum in the allowed steps."""


class Separated(NotConverged):
    """A logistic model without a finite optimum: some rows' outcome is certain."""


def compact(cells: DataFrame) -> DataFrame:
    """Persisted cells in as few partitions as their number needs, for the iterations that follow."""
    kept = cells.persist()
    return kept.coalesce(kept.count() // ROWS_PER_TASK + 1)


def _spark_glm(source: DataFrame, design: Design, label: Column, weight: Column, family: str, link: str):
    """Fit on the independent non-constant columns; returns coefficients and covariance pieces."""
    g = gram(source, design.columns, weight)
    kept = [i for i in independent_columns(g) if i != 0]
    coef = np.full(len(design.names), np.nan)
    se = np.full(len(design.names), np.nan)
    data = _assembled(source, design, kept, [label.alias("label"), weight.alias("weight")])
    if not kept:
        total = data.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        coef[0] = {"logit": lambda m: np.log(m / (1 - m)), "log": np.log}[link](total)
        return coef, None, kept
    model = GeneralizedLinearRegression(
        family=family, link=link, maxIter=GLM_STEPS, tol=1e-8, labelCol="label", weightCol="weight"
    ).fit(data)
    if model.summary.numIterations >= GLM_STEPS:
        raise NotConverged(f"the {family} model has not converged in {GLM_STEPS} steps")
    coef[0] = model.intercept
    coef[kept] = model.coefficients.toArray()
    return coef, model, kept


def _combinations(terms: Sequence) -> list[tuple[str, ...]]:
    """The columns of each factor term, and of each interaction of factors."""
    found = [t.members if isinstance(t, interaction) else (t,) for t in terms]
    return [tuple(m.column for m in group) for group in found if all(isinstance(m, factor) for m in group)]


def separated_levels(source: DataFrame, terms: Sequence, label: Column, weight: Column) -> list[tuple[str, Column, float]]:
    """Levels, and combinations of levels, in which every outcome is 0 or every outcome is 1: (name, rows, outcome).

    One aggregate over all terms together; the levels were counted when the design was built.
    """
    groups = list(dict.fromkeys(_combinations(terms)))
    if not groups:
        return []
    keys = [
        F.struct(F.lit(i).alias("i"), F.array(*[F.col(c).cast("string") for c in group]).alias("v")) for i, group in enumerate(groups)
    ]
    sums = source.select(F.explode(F.array(*keys)).alias("k"), label.alias("y"), weight.alias("w")).where("w > 0")
    sums = sums.groupBy("k.i", "k.v").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    out = []
    for r in sums.where("high = 0 OR low = 1").orderBy("i", "v").collect():
        pairs = list(zip(groups[r["i"]], r["v"]))
        at = reduce(lambda a, b: a & b, [F.col(c).cast("string") == F.lit(v) for c, v in pairs])
        out.append((":".join(f"{c}_{v}" for c, v in pairs), at, float(r["low"])))
    return out


def separating_direction(source: DataFrame, design: Design, label: Column, weight: Column) -> np.ndarray | None:
    """Coefficients along which the likelihood grows without bound, or None (iterative rectifier).

    Such a direction is at least zero on rows that are all 1, at most zero on rows that are all 0, and zero on
    mixed cells. Repeated least squares on its positive part find it or shrink to nothing; each step is one
    cross-product pass.
    """
    sign = F.when(label == 1.0, 1.0).when(label == 0.0, -1.0).otherwise(0.0)
    w = F.when(weight > 0, F.when(sign == 0, RECTIFIER_WEIGHT).otherwise(1.0)).otherwise(0.0)
    wanted, p = F.lit(1.0), len(design.columns)
    for _ in range(RECTIFIER_STEPS):
        g = gram(source, [*design.columns, sign * wanted], w)
        along = np.nan_to_num(solve_kept(g[:p, :p], g[:p, p])[0])
        eta = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(along, design.columns)])
        fitted = sign * eta
        low, high = source.where(weight > 0).agg(F.min(F.when(sign != 0, fitted)), F.max(F.when(sign != 0, fitted))).first()
        if high is None or high < RECTIFIER_ZERO:
            return None
        if low > -RECTIFIER_ZERO:
            return along
        wanted = F.greatest(fitted, F.lit(0.0))
    return None


def logit(
    df: DataFrame, y: str, terms: Sequence, weight: str | None = None, positive: object = 1, separated: str = "raise"
) -> Fit:
    """Logistic regression of ``y == positive``; coefficients are always for the positive level.

    Levels whose outcomes are all alike, and rows that a combination of terms separates, leave no finite optimum:
    ``separated='raise'`` names them; ``'drop'`` leaves their rows out, fits the rest (whose coefficients are the
    limits they have with those rows), reports the levels' own coefficients as null and lists them in
    ``stats['separated']``. Predicted probabilities of left-out rows are 0 or 1.
    """
    if separated not in ("raise", "drop"):
        raise ValueError(separated)
    used = [y, *_sources(terms), *([weight] if weight else [])]
    rows = complete_rows(df, used).withColumn("__y", (F.col(y) == F.lit(positive)).cast("double"))
    design = build_design(rows, terms)
    if design.discrete:
        source = compress(rows, design.sources, "__y", weight)
        label, w = F.col("__wy") / F.col("__w"), F.col("__w")
    else:
        source = rows
        label, w = F.col("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0))
    held = source.persist()
    source = compact(held) if design.discrete else held
    certain: list[tuple[str, Column, float]] = []
    try:
        while True:
            found = separated_levels(source, terms, label, w)
            if not found:
                try:
                    coef, _, kept = _spark_glm(source, design, label, w, "binomial", "logit")
                    break
                except NotConverged:
                    along = separating_direction(source, design, label, w)
                    if along is None:
                        raise
                    eta = reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(along, design.columns)])
                    name = " + ".join(n for n, b in zip(design.names, along) if abs(b) > RECTIFIER_ZERO)
                    found = [(name, eta > RECTIFIER_ZERO, 1.0), (name, eta < -RECTIFIER_ZERO, 0.0)]
            if separated == "raise":
                names = ", ".join(dict.fromkeys(n for n, _, _ in found))
                raise Separated(f"no finite optimum, the outcome is certain by {names}; separated='drop' fits the rest")
            certain += found
            source = source.where(reduce(lambda a, b: a & b, [~at for _, at, _ in found]))
            if source.isEmpty():
                raise Separated("no finite optimum, the outcome of every row is certain")
        stats = {"separated": list(dict.fromkeys(n for n, _, _ in certain))} if certain else {}
        fit = Fit(design, design.names, coef, np.zeros((len(coef), len(coef))), 0.0, None, stats, "binomial")
        fit.certain = [(at, value) for _, at, value in certain]
        mu = fit.mean()
        info = gram(source, [*design.columns], w * mu * (1.0 - mu))
        fit.vcov = _inverse(info, coef)
        fit.n = float(source.agg(F.sum("__n" if design.discrete else F.lit(1))).first()[0])
    finally:
        held.unpersist()
    return fit


def _inverse(info: np.ndarray, coef: np.ndarray) -> np.ndarray:
    live = [i for i in range(len(coef)) if not np.isnan(coef[i])]
    block = info[np.ix_(live, live)]
    # A diagonal of zero is a separated level: its information is empty and its error unbounded.
    scale = 1.0 / np.sqrt(np.maximum(np.diag(block), 1e-12))
    out = np.zeros_like(info)
    out[np.ix_(live, live)] = np.linalg.pinv(block * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)
    return out


def gamma_glm(df: DataFrame, y: str, terms: Sequence, link: str = "inverse", max_iter: int = 50) -> Fit:
    """Gamma regression with log or inverse link and Pearson dispersion.

    stats: dispersion, shape = 1/dispersion. Scale at a row is mean * dispersion.
    """
    rows = complete_rows(df, [y, *_sources(terms)])
    design = build_design(rows, terms)
    p = len(design.names)
    source = compress(rows, design.sources, y, None) if design.discrete else rows.select(
        *dict.fromkeys([*design.sources, y]),
        F.lit(1.0).alias("__w"), F.col(y).cast("double").alias("__wy"),
        (F.col(y).cast("double") * F.col(y).cast("double")).alias("__wyy"), F.lit(1).alias("__n"),
    )
    held = source.persist()
    source = compact(held) if design.discrete else held
    w, ybar = F.col("__w"), F.col("__wy") / F.col("__w")
    n, total = source.agg(F.sum("__n"), F.sum("__wy")).first()
    overall = float(total) / float(n)
    if link == "log":
        coef, _, _ = _spark_glm(source, design, ybar, w, "gamma", "log")
    else:
        coef = _inverse_link_fit(source, design, w, ybar, overall, max_iter)
    fit = Fit(design, design.names, coef, np.zeros((p, p)), float(n), None, {}, f"gamma_{link}")
    mu = fit.mean()
    working = w if link == "log" else w * mu * mu
    info = gram(source, design.columns, working)
    pearson = source.agg(F.sum((F.col("__wyy") - 2.0 * mu * F.col("__wy") + mu * mu * w) / (mu * mu))).first()[0]
    held.unpersist()
    live = int(np.sum(~np.isnan(coef)))
    fit.df_resid = float(n) - live
    dispersion = float(pearson) / fit.df_resid
    fit.vcov = _inverse(info, coef) * dispersion
    fit.stats = {"dispersion": dispersion, "shape": 1.0 / dispersion, "mean": overall}
    return fit


def _inverse_link_fit(source, design, w, ybar, overall, max_iter):
    """Reweighted least squares for 1/mu = x'b on the mean-scaled outcome, halving invalid steps."""
    scaled = ybar / overall
    coef = np.zeros(len(design.names))
    coef[0] = 1.0

    def predictor(b):
        return reduce(lambda a, c: a + c, [F.lit(float(v)) * c for v, c in zip(b, design.columns) if not np.isnan(v)])

    def deviance(b):
        eta = predictor(b)
        row = source.agg(F.min(eta), F.sum(w * (scaled * eta - F.log(F.when(eta > 0, eta).otherwise(F.lit(1.0))) ))).first()
        return float("inf") if row[0] <= 0 else 2.0 * row[1]

    current = deviance(coef)
    for _ in range(max_iter):
        eta = predictor(coef)
        mu = 1.0 / eta
        z = eta - (scaled - mu) / (mu * mu)
        g = gram(source, [*design.columns, z], w * mu * mu)
        proposal, _, kept = solve_kept(g[:-1, :-1], g[:-1, -1])
        base = np.where(np.isnan(proposal), np.nan, np.nan_to_num(coef))
        step, value = proposal, deviance(proposal)
        halvings = 0
        while (value > current + 1e-10 * abs(current)) and halvings < 30:
            step = (base + step) / 2.0
            value = deviance(step)
            halvings += 1
        moved = np.nanmax(np.abs(step - base))
        coef, previous, current = step, current, value
        if moved < 1e-10 * max(1.0, float(np.nanmax(np.abs(coef)))) or abs(previous - current) < 1e-14 * (abs(current) + 0.1):
            break
    else:
        raise RuntimeError(f"the gamma model has not converged in {max_iter} steps")
    return coef / overall


@dataclass
class Multinomial:
    """Class probabilities from the linear predictors of all levels; the first level's are zero.

    The predictors are added as columns first and combined in a second projection, so an expression
    grows with the number of levels and not with its square.
    """

    design: Design
    levels: list
    coef: np.ndarray
    #: whether the last Newton step was negligible; not so with separated levels, whose optimum is not finite
    converged: bool = True

    def _predictors(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        named = {
            f"__eta{i}": reduce(lambda a, c: a + c, [F.lit(float(b)) * x for b, x in zip(row, self.design.columns)])
            for i, row in enumerate(self.coef)
        }
        return df.withColumns(named), [F.col(n) for n in named]

    def add_probabilities(self, df: DataFrame, prefix: str = "p_") -> DataFrame:
        """One probability column per level."""
        wide, eta = self._predictors(df)
        wide = wide.withColumn("__top", F.greatest(*eta) if len(eta) > 1 else eta[0])
        total = reduce(lambda a, b: a + b, [F.exp(e - F.col("__top")) for e in eta])
        wide = wide.withColumn("__total", total)
        return wide.select(
            *df.columns, *[(F.exp(e - F.col("__top")) / F.col("__total")).alias(f"{prefix}{v}") for v, e in zip(self.levels, eta)]
        )

    def add_observed(self, df: DataFrame, y: str, to: str) -> DataFrame:
        """Probability of the level each row actually has, without a join."""
        wide, eta = self._predictors(df)
        own = None
        for level, e in zip(self.levels, eta):
            own = (F if own is None else own).when(F.col(y).cast("string") == F.lit(level), e)
        wide = wide.withColumn("__own", own)
        return wide.select(*df.columns, (1.0 / reduce(lambda a, b: a + b, [F.exp(e - F.col("__own")) for e in eta])).alias(to))

    def add_predicted(self, df: DataFrame, to: str = "pred") -> DataFrame:
        """Most probable level; ties go to the earlier level."""
        wide, eta = self._predictors(df)
        wide = wide.withColumn("__top", F.greatest(*eta) if len(eta) > 1 else eta[0])
        out = None
        for level, e in zip(self.levels, eta):
            out = (F if out is None else out).when(e == F.col("__top"), F.lit(level))
        return wide.select(*df.columns, out.alias(to))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (level, name, float(b))
            for level, row in zip(self.levels, self.coef)
            for name, b in zip(self.design.names, row)
        ]
        return spark.createDataFrame(rows, "level string, term string, estimate double")


def multinomial(
    df: DataFrame, y: str, terms: Sequence, weight: str | None = None, max_coefficients: int = MAX_COEFFICIENTS
) -> Multinomial:
    """Unpenalised multinomial logistic regression, polished by Newton steps.

    These keep a matrix of all coefficients squared in a task, so more than ``max_coefficients`` are refused.
    """
    used = [y, *_sources(terms), *([weight] if weight else [])]
    rows = complete_rows(df, used)
    from quasi.models.design import find_levels

    levels = find_levels(rows, [y])[y]
    design = build_design(rows, terms)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    label = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(y).cast("string")) - 1
    source = rows.withColumn("__label", label.cast("double"))
    if design.discrete:
        source = source.groupBy(*design.sources, "__label").agg(F.sum(w).alias("__w"))
    else:
        source = source.withColumn("__w", w)
    held = source.persist()
    source = compact(held) if design.discrete else held
    coef, converged = np.zeros((len(levels), len(design.names))), True
    kept = [i for i in independent_columns(gram(source, design.columns, F.col("__w"))) if i != 0]
    if (len(levels) - 1) * (len(kept) + 1) > max_coefficients:
        held.unpersist()
        raise ValueError(f"the model has more than {max_coefficients} coefficients")
    if not kept:
        counts = {int(r[0]): r[1] for r in source.groupBy("__label").agg(F.sum("__w")).collect()}
        coef[:, 0] = [np.log(counts[i]) for i in range(len(levels))]
    else:
        data = _assembled(source, design, kept, [F.col("__label").alias("label"), F.col("__w").alias("weight")])
        model = LogisticRegression(
            family="multinomial", regParam=0.0, maxIter=200, tol=1e-8, weightCol="weight", standardization=True
        ).fit(data)
        coef[:, 0] = model.interceptVector.toArray()
        coef[:, kept] = model.coefficientMatrix.toArray()
        coef, converged = _polish(source, design, coef - coef[0], kept)
    held.unpersist()
    coef = coef - coef[0]
    return Multinomial(design, levels, coef, converged)


def _polish(source: DataFrame, design: Design, coef: np.ndarray, kept: Sequence[int], steps: int = 10) -> tuple[np.ndarray, bool]:
    """Newton steps from the optimiser's solution, each one pass of gradient and Hessian sums; and if they converged."""
    used = [0, *kept]
    k, p = len(coef) - 1, len(used)
    named = source.select("__label", "__w", *[design.columns[i].cast("double").alias(f"x{i}") for i in used])

    def derivatives(beta: np.ndarray):
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grad, hess = np.zeros((k, p)), np.zeros((k, p, k, p))
            for batch in batches:
                label, w, x = batch["__label"].to_numpy(int), batch["__w"].to_numpy(float), batch.iloc[:, 2:].to_numpy(float)
                eta = np.column_stack([np.zeros(len(x)), x @ beta.T])
                prob = np.exp(eta - eta.max(1, keepdims=True))
                prob = (prob / prob.sum(1, keepdims=True))[:, 1:]
                hit = (label[:, None] == np.arange(1, k + 1)[None, :]).astype(float)
                grad += (w[:, None] * (hit - prob)).T @ x
                for a in range(k):
                    for b in range(k):
                        curve = w * (prob[:, a] * float(a == b) - prob[:, a] * prob[:, b])
                        hess[a, :, b, :] += (x * curve[:, None]).T @ x
            yield pd.DataFrame({"v": [np.concatenate([grad.ravel(), hess.ravel()])]})

        total = array_sum(named.mapInPandas(partial, "v array<double>"), k * p + (k * p) ** 2)
        return total[: k * p], total[k * p:].reshape(k * p, k * p)

    beta, converged = coef[1:, used].copy(), False
    for _ in range(steps):
        grad, hess = derivatives(beta)
        move = np.linalg.lstsq(hess, grad, rcond=1e-10)[0].reshape(k, p)
        # A separated level has no finite optimum; leave the optimiser's answer.
        if not np.all(np.isfinite(move)) or np.max(np.abs(move)) > 1.0:
            break
        beta = beta + move
        if np.max(np.abs(move)) < 1e-9:
            converged = True
            break
    out = coef.copy()
    out[1:, used] = beta
    return out, converged
