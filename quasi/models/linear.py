"""Least squares from cross-product matrices accumulated by Spark.

The rows contribute only to a p x p matrix. When every regressor is a factor, rows are first merged into
cells (count, sum and sum of squares of the outcome), which leaves all results unchanged and makes later
passes independent of the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.functions.columns import ColumnLike, as_col
from quasi.functions.tails import normal_quantile, normal_two_sided, t_quantile, t_two_sided
from quasi.models.design import Design, build_design

JVM_SUMS = 150
MERGE_WAYS = 64
ALIAS_TOLERANCE = 1e-9


@dataclass
class Fit:
    """Coefficients of one model; NaN marks a coefficient aliased with earlier terms."""

    design: Design
    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: float
    df_resid: float | None = None
    stats: dict = field(default_factory=dict)
    family: str = "gaussian"
    #: rows whose mean is known without the coefficients, and that mean
    certain: list[tuple[Column, float]] = field(default_factory=list)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0.0))

    def eta(self) -> Column:
        """Linear predictor as one generated expression."""
        kept = [
            F.lit(float(b)) * c for b, c in zip(self.coef, self.design.columns) if not math.isnan(b)
        ]
        return reduce(lambda a, b: a + b, kept, F.lit(0.0))

    def mean(self) -> Column:
        eta = self.eta()
        out = {
            "gaussian": lambda: eta,
            "binomial": lambda: 1.0 / (1.0 + F.exp(-eta)),
            "gamma_log": lambda: F.exp(eta),
            "gamma_inverse": lambda: 1.0 / eta,
        }[self.family]()
        for at, value in reversed(self.certain):
            out = F.when(at, F.lit(value)).otherwise(out)
        return out

    def rows(self, level: float = 0.95) -> list[tuple]:
        out = []
        for name, b, s in zip(self.names, self.coef, self.se):
            if math.isnan(b):
                out.append((name, None, None, None, None, None, None))
                continue
            stat = b / s if s > 0 else float("inf") if b else float("nan")
            finite = self.df_resid is not None and self.df_resid < 1e7
            p = t_two_sided(stat, self.df_resid) if finite else normal_two_sided(stat)
            q = t_quantile((1 + level) / 2, self.df_resid) if finite and self.df_resid > 0 else normal_quantile((1 + level) / 2)
            out.append((name, float(b), float(s), float(stat), float(p), float(b - q * s), float(b + q * s)))
        return out

    def table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """Term table: term, estimate, std_error, statistic, p_value, ci_lo, ci_hi."""
        return spark.createDataFrame(
            self.rows(level),
            "term string, estimate double, std_error double, statistic double, p_value double, ci_lo double, ci_hi double",
        )


# ---------------------------------------------------------------- cross products


def array_sum(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays in column ``v``, all of length ``size``, merged whole in two levels (zeros without any)."""
    ways = parts.select(array_to_vector("v").alias("v"), (F.spark_partition_id() % MERGE_WAYS).alias("way"))
    ways = ways.groupBy("way").agg(Summarizer.sum(F.col("v")).alias("v"))
    row = ways.groupBy(F.lit(0).alias("way")).agg(Summarizer.sum(F.col("v")).alias("v")).first()
    return np.zeros(size) if row is None else row["v"].toArray()


def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """Weighted cross-product matrix of expressions.

    Rows with a null in any of the columns or the weight are left out. A few columns are summed by one JVM
    aggregate. Wider designs go through Arrow batches: each task keeps one matrix and emits it once.
    """
    p = len(columns)
    w = weight if weight is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    named = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], w.cast("double").alias("w"))
    named = named.where(" and ".join(f"{c} is not null" for c in named.columns))
    out = np.zeros((p, p))
    if len(pairs) <= JVM_SUMS:
        row = named.agg(*[F.expr(f"sum(x{i} * x{j} * w)").alias(f"s{i}_{j}") for i, j in pairs]).first()
        values = [v or 0.0 for v in row]
    else:
        upper = np.triu_indices(p)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((p, p))
            for batch in batches:
                x = batch.to_numpy(dtype=float)
                total += (x[:, :p] * x[:, p:]).T @ x[:, :p]
            yield pd.DataFrame({"v": [total[upper]]})

        values = array_sum(named.mapInPandas(partial, "v array<double>"), len(pairs))
    for (i, j), v in zip(pairs, values):
        out[i, j] = out[j, i] = v
    return out


def independent_columns(g: np.ndarray, tolerance: float = ALIAS_TOLERANCE) -> list[int]:
    """Indexes of columns not linearly dependent on earlier ones, by sweeping the scaled matrix."""
    scale = np.sqrt(np.maximum(np.diag(g), 0.0))
    scale[scale == 0] = 1.0
    a = g / np.outer(scale, scale)
    kept = []
    for j in range(len(a)):
        if a[j, j] > tolerance:
            kept.append(j)
            a = a - np.outer(a[:, j], a[j, :]) / a[j, j]
    return kept


def solve_kept(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Coefficients (NaN when aliased), inverse of X'X on the kept block (zeros elsewhere), kept."""
    kept = independent_columns(xx)
    block = xx[np.ix_(kept, kept)]
    scale = 1.0 / np.sqrt(np.diag(block))
    inverse = np.linalg.inv(block * np.outer(scale, scale)) * np.outer(scale, scale)
    coef = np.full(len(xx), np.nan)
    coef[kept] = inverse @ xy[kept]
    full = np.zeros_like(xx)
    full[np.ix_(kept, kept)] = inverse
    return coef, full, kept


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no null in any used column, read without the unused ones."""
    used = list(dict.fromkeys(columns))
    return df.select(*used).dropna(subset=used)


def compress(df: DataFrame, sources: Sequence[str], y: str, weight: str | None, extra: Sequence[str] = ()) -> DataFrame:
    """Merge rows with equal regressors: __w, __wy, __wyy sums and __n rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yy = F.col(y).cast("double")
    return df.groupBy(*dict.fromkeys([*sources, *extra])).agg(
        F.sum(w).alias("__w"), F.sum(w * yy).alias("__wy"), F.sum(w * yy * yy).alias("__wyy"),
        F.count(F.lit(1)).alias("__n"),
    )


# ---------------------------------------------------------------- estimators


def ols(df: DataFrame, y: str, terms: Sequence, weight: str | None = None, intercept: bool = True, merge: bool | None = None) -> Fit:
    """Ordinary or weighted least squares with model standard errors and R squared.

    ``merge`` forces or forbids merging rows with equal regressors (default: when all are factors).
    """
    rows = complete_rows(df, [y, *_sources(terms), *([weight] if weight else [])])
    design = build_design(rows, terms, intercept)
    p = len(design.columns)
    yc = F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = F.lit(1.0)
    if design.sources and (design.discrete if merge is None else merge):
        cells = compress(rows, design.sources, y, weight).persist()
        g = gram(cells, [*design.columns, F.col("__wy") / F.col("__w"), one], F.col("__w"))
        g[p, p], n = cells.agg(F.sum("__wyy"), F.sum("__n")).first()
        cells.unpersist()
    else:
        g = gram(rows, [*design.columns, yc, one], w)
        n = g[-1, -1] if weight is None else rows.count()
    wsum, wy = g[-1, -1], g[-1, p]
    xx, xy, yy = g[:p, :p], g[:p, p], g[p, p]
    coef, inverse, kept = solve_kept(xx, xy)
    rss = float(max(yy - coef[kept] @ xy[kept], 0.0))
    tss = float(yy - wy * wy / wsum) if intercept else float(yy)
    dof = float(n - len(kept))
    sigma2 = rss / dof if dof > 0 else float("nan")
    return Fit(
        design, design.names, coef, inverse * sigma2, float(n), dof,
        {"sigma2": sigma2, "rss": rss, "tss": tss, "r_squared": 1.0 - rss / tss if tss > 0 else float("nan")},
    )


def _sources(terms) -> list[str]:
    from quasi.models.design import _members

    return [m if isinstance(m, str) else m.column for m in _members(terms)]


def survey_glm(df: DataFrame, y: str, terms: Sequence, weight: str | None, cluster: str) -> Fit:
    """Weighted linear model with linearised variance over clusters (n_c / (n_c - 1) scaling).

    Scores are summed per cluster by a map-side combined aggregate, so one very large cluster costs no
    more than its rows; the cluster totals then form the p x p middle matrix.
    """
    used = [y, cluster, *_sources(terms), *([weight] if weight else [])]
    rows = complete_rows(df, used)
    fit = ols(rows, y, terms, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    resid = F.col(y).cast("double") - fit.eta()
    scores = rows.groupBy(cluster).agg(
        *[F.sum(w * c * resid).alias(f"s{i}") for i, c in enumerate(fit.design.columns)]
    )
    cols = [F.col(f"s{i}") for i in range(len(fit.names))]
    meat = gram(scores, [*cols, F.lit(1.0)])
    clusters = meat[-1, -1]
    k = len(fit.names)
    total = meat[:k, -1]
    centred = meat[:k, :k] - np.outer(total, total) / clusters
    bread = fit.vcov / fit.stats["sigma2"]
    vcov = bread @ (centred * clusters / (clusters - 1)) @ bread
    live = int(np.sum(~np.isnan(fit.coef)))
    return Fit(fit.design, fit.names, fit.coef, vcov, fit.n, float(clusters - live), {**fit.stats, "clusters": clusters})


def aliased_terms(df: DataFrame, terms: Sequence, intercept: bool = True) -> DataFrame:
    """Terms that are linear combinations of earlier ones (1) or not (0)."""
    rows = complete_rows(df, _sources(terms))
    design = build_design(rows, terms, intercept)
    source = rows
    w = F.lit(1.0)
    if design.discrete and design.sources:
        source = rows.groupBy(*design.sources).agg(F.count(F.lit(1)).cast("double").alias("__w"))
        w = F.col("__w")
    kept = set(independent_columns(gram(source, design.columns, w)))
    return df.sparkSession.createDataFrame(
        [(n, int(i not in kept)) for i, n in enumerate(design.names)], "term string, aliased long"
    )
