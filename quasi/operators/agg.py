"""Grouped statistics: household totals, weighted rates and shares, moments, histograms, tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quasi.functions.columns import ColumnLike, as_col
from quasi.functions.tails import t_quantile
from quasi.operators.skew import attach_totals, exact_quantiles, null_safe


def household_totals(
    df: DataFrame, keys: Sequence[str], sums: Mapping[str, str] = {}, maxes: Mapping[str, str] = {},
    counts: Mapping[str, Column] = {},
) -> DataFrame:
    """Group sums, maxima and conditional counts on every member row (new name to source)."""
    totals = (
        [F.sum(src).alias(name) for name, src in sums.items()]
        + [F.max(src).alias(name) for name, src in maxes.items()]
        + [F.count(F.when(cond, 1)).alias(name) for name, cond in counts.items()]
    )
    return attach_totals(df, keys, totals)


def weighted_rate(df: DataFrame, by: Sequence[str], flag: ColumnLike, weight: ColumnLike, to: str = "rate") -> DataFrame:
    """Weighted mean of a flag per group; rows with a null flag count in neither sum."""
    x, w = as_col(flag).cast("double"), as_col(weight).cast("double")
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias(to)
    )


def weighted_share(df: DataFrame, by: Sequence[str], category: str, weight: ColumnLike = None, to: str = "share") -> DataFrame:
    """Share of each category in its group's weight. The window runs on aggregated rows only."""
    w = as_col(weight).cast("double") if weight is not None else F.lit(1.0)
    cells = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.sum(w).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(*by))
    return cells.withColumn(to, F.try_divide(F.col("weight"), total))


def group_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], sd: bool = False) -> DataFrame:
    """Null-skipping means (and standard deviations) per group."""
    out = [F.avg(c).alias(c if not sd else f"{c}_mean") for c in columns]
    if sd:
        out += [F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
    return df.groupBy(*by).agg(*out)


def mean_se(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean with one standard error either side."""
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    se = F.col("sd") / F.sqrt("n")
    return m.select(
        *by, "n", "mean", se.alias("se"), (F.col("mean") - se).alias("lo"), (F.col("mean") + se).alias("hi")
    )


@F.pandas_udf(DoubleType())
def _t975(df: pd.Series) -> pd.Series:
    known = {d: t_quantile(0.975, float(d)) if d > 0 else float("nan") for d in df.unique()}
    return df.map(known)


def mean_cl_normal(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean with a 95 % t interval; the quantile is looked up once per group row."""
    m = mean_se(df, by, value)
    half = _t975(F.col("n") - 1) * F.col("se")
    return m.select(*by, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def missing_rate(df: DataFrame, columns: Sequence[str], codes: Sequence[int] = (-9, -8)) -> DataFrame:
    """Share of sentinel or null values per column, all columns in one pass."""
    missing = {c: F.avg((F.col(c).isNull() | F.col(c).isin(list(codes))).cast("double")) for c in columns}
    wide = df.agg(*[m.alias(c) for c, m in missing.items()])
    return wide.unpivot([], list(columns), "column", "missing")


def quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact type-7 quantiles in long form (by, prob, value)."""
    wide = exact_quantiles(df, column, probs, by)
    entries = [
        F.struct(F.lit(float(p)).alias("prob"), F.col(f"q{i}").alias("value")) for i, p in enumerate(probs)
    ]
    return wide.select(*by, F.explode(F.array(*entries)).alias("__e")).select(*by, "__e.*")


def approximate_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    """Sketch-based quantiles in one pass, rank error 1/accuracy."""
    values = df.groupBy(*by).agg(F.percentile_approx(column, list(probs), accuracy).alias("__v"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("__v").alias("value"))
    return values.select(*by, F.explode(pairs).alias("__e")).select(
        *by, F.col("__e.prob"), F.col("__e.value")
    )


def trim_above_quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """Rows strictly below the quantile of the column."""
    cutoff = exact_quantiles(df, column, [prob]).select("q0")
    return df.where(F.col(column) < cutoff.scalar())


def histogram(
    df: DataFrame, column: str, bins: int = 30, weight: ColumnLike = None, norm: str = "count",
    by: Sequence[str] = (), bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Equal-width histogram over the observed range (last bin closed).

    norm: 'count', 'proportion' of all weight, or 'density' within each ``by`` group. Empty bins are
    not listed.
    """
    w = as_col(weight).cast("double") if weight is not None else F.lit(1.0)
    rows = df.where(F.col(column).isNotNull())
    if bounds is None:
        bounds = tuple(rows.agg(F.min(column).cast("double"), F.max(column).cast("double")).first())
        if bounds[0] is None:
            bounds = (0.0, 1.0)
    lo, hi = bounds
    width = (hi - lo) / bins or 1.0
    rows = rows.where(F.col(column).between(lo, hi))
    index = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("bigint")
    cells = rows.groupBy(*by, index.alias("bin")).agg(F.sum(w).alias("count"))
    out = cells.withColumn("x_lo", lo + F.col("bin") * width).withColumn("x_hi", lo + (F.col("bin") + 1) * width)
    if norm == "count":
        return out
    group = [] if norm == "proportion" else list(by)
    total = F.sum("count").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    share = F.col("count") / total
    return out.withColumn(norm, share if norm == "proportion" else share / width)


def crosstab(df: DataFrame, a: str, b: str, weight: ColumnLike = None, margin: str = "row") -> DataFrame:
    """Counts of each pair with its proportion of the ``a`` row, the ``b`` column or the total, as ``{margin}_share``."""
    group = {"row": a, "column": b, "total": F.lit(0)}[margin]
    w = as_col(weight) if weight is not None else F.lit(1)
    cells = df.groupBy(a, b).agg(F.sum(w).alias("n"))
    return cells.withColumn(f"{margin}_share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def category_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rows_at_max(df: DataFrame, column: str) -> DataFrame:
    """All rows that carry the largest value."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group in a total order, as a map-side combined minimum of row structs."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*df.columns)


def drop_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows but the last of each group in a total order."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__r"))
    last = last.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(f"__r.{o}").alias(f"__{o}") for o in order])
    return df.join(last, null_safe(df, last, [(c, f"__{c}") for c in [*keys, *order]]), "left_anti")


def moments(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, means, variances and covariance of two columns."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"),
    )


def summary_numbers(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum."""
    by = list(by)
    q = exact_quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0], by).select(
        *[F.col(c).alias(f"__{c}") for c in by],
        F.col("q0").alias("min"), F.col("q1").alias("q25"), F.col("q2").alias("median"),
        F.col("q3").alias("q75"), F.col("q4").alias("max"),
    )
    m = df.groupBy(*by).agg(F.avg(column).alias("mean"))
    if not by:
        return q.crossJoin(F.broadcast(m))
    return m.join(q, null_safe(m, q, [(c, f"__{c}") for c in by]), "inner").drop(*[f"__{c}" for c in by])
