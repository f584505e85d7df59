"""Inverse-probability weights for binary, multinomial and continuous exposures, and balance checks.

A weight is a column expression over fitted coefficients: probabilities and densities are computed on the
row itself, so no prediction table is joined back. Rows with a null in any model column are dropped first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.functions.columns import cut, interval_labels
from quasi.functions.special import log_gamma_density, log_normal_density
from quasi.models.design import build_design, factor, find_levels
from quasi.models.glm import gamma_glm, logit, multinomial
from quasi.models.linear import _sources, gram, ols, solve_kept
from quasi.operators.skew import exact_quantiles


def _complete(df: DataFrame, exposure: str, *term_lists: Sequence) -> DataFrame:
    used = [exposure, *[s for terms in term_lists for s in _sources(terms)]]
    return df.dropna(subset=list(dict.fromkeys(used)))


def iptw_binary(df: DataFrame, d: str, num: Sequence, den: Sequence, positive: object = 1, to: str = "weight") -> DataFrame:
    """Stabilised weight: numerator over denominator probability of the observed level."""
    rows = _complete(df, d, num, den)
    p0, p1 = (logit(rows, d, terms, positive=positive).mean() for terms in (num, den))
    hit = F.col(d) == F.lit(positive)
    return rows.withColumn(to, F.when(hit, p0 / p1).otherwise((1.0 - p0) / (1.0 - p1)))


def ipw_binary(df: DataFrame, d: str, den: Sequence, positive: object = 1, to: str = "weight") -> DataFrame:
    """Unstabilised weight: 1/p for the treated, 1/(1-p) for the others."""
    rows = _complete(df, d, den)
    p = logit(rows, d, den, positive=positive).mean()
    return rows.withColumn(to, F.when(F.col(d) == F.lit(positive), 1.0 / p).otherwise(1.0 / (1.0 - p)))


def iptw_multinomial(df: DataFrame, d: str, num: Sequence, den: Sequence, to: str = "weight") -> DataFrame:
    rows = _complete(df, d, num, den)
    both = multinomial(rows, d, num).add_observed(rows, d, "__p0")
    both = multinomial(rows, d, den).add_observed(both, d, "__p1")
    return both.withColumn(to, F.col("__p0") / F.col("__p1")).drop("__p0", "__p1")


def iptw_gamma(df: DataFrame, y: str, num: Sequence, den: Sequence, link: str = "inverse", shift: float = 1.0, to: str = "weight") -> DataFrame:
    """Ratio of gamma densities of the shifted exposure, formed on the log scale."""
    rows = _complete(df, y, num, den).withColumn("__shifted", F.col(y).cast("double") + F.lit(shift))
    logs = []
    for terms in (num, den):
        fit = gamma_glm(rows, "__shifted", terms, link)
        shape = fit.stats["shape"]
        logs.append(log_gamma_density("__shifted", shape, fit.mean() / shape))
    return rows.withColumn(to, F.exp(logs[0] - logs[1])).drop("__shifted")


def iptw_normal(df: DataFrame, y: str, num: Sequence, den: Sequence, to: str = "weight") -> DataFrame:
    """Ratio of normal densities with one overall standard deviation."""
    rows = _complete(df, y, num, den)
    sd = rows.agg(F.stddev_samp(y)).first()[0]
    logs = [log_normal_density(y, ols(rows, y, terms).mean(), F.lit(float(sd))) for terms in (num, den)]
    return rows.withColumn(to, F.exp(logs[0] - logs[1]))


def iptw_heteroscedastic(df: DataFrame, y: str, num: Sequence, den: Sequence, to: str = "weight") -> DataFrame:
    """Ratio of normal densities whose sd is exp of a model for log|residual|.

    This is a geometric scale of the residuals, smaller than their root mean square. Rows with a zero
    residual do not enter the scale model.
    """
    rows = _complete(df, y, num, den)
    logs = []
    for terms in (num, den):
        mean = ols(rows, y, terms).mean()
        resid = F.abs(F.col(y).cast("double") - mean)
        scale = ols(rows.withColumn("__lr", F.when(resid > 0, F.log(resid))), "__lr", terms).mean()
        logs.append(log_normal_density(y, mean, F.exp(scale)))
    return rows.withColumn(to, F.exp(logs[0] - logs[1]))


def quantile_bins(df: DataFrame, y: str, bins: int = 15) -> tuple[list[float], Column]:
    """Breaks 0 and the bins-quantiles of the non-zero values, and the bin of each row.

    Intervals are (a, b] with the lowest closed. Repeated breaks are merged.
    """
    probs = [i / bins for i in range(bins + 1)]
    row = exact_quantiles(df.where(F.col(y) != 0), y, probs).first()
    breaks = sorted({0.0, *[float(row[f"q{i}"]) for i in range(bins + 1)]})
    labels = [f"{i:02d} {name}" for i, name in enumerate(interval_labels(breaks, True, True))]
    return breaks, cut(y, breaks, right=True, include_lowest=True, labels=labels)


def iptw_binned(df: DataFrame, y: str, num: Sequence, den: Sequence, bins: int = 15, to: str = "weight") -> DataFrame:
    """Multinomial weights on quantile bins of a continuous exposure (adds ``<y>_bin``)."""
    rows = _complete(df, y, num, den)
    _, bin_of = quantile_bins(rows, y, bins)
    return iptw_multinomial(rows.withColumn(f"{y}_bin", bin_of), f"{y}_bin", num, den, to)


# ---------------------------------------------------------------- weights themselves


def weight_status(weight: str) -> Column:
    w = F.col(weight)
    infinite = (w == float("inf")) | (w == -float("inf"))
    return (
        F.when(w.isNull() | F.isnan(w), "Missing").when(infinite, "Infinite").when(w == 0, "Zero").otherwise("Positive weight")
    )


def weight_diagnostics(df: DataFrame, weight: str) -> DataFrame:
    """Rows by kind of weight, with mean and maximum of the usable ones."""
    usable = F.when(weight_status(weight).isin("Positive weight", "Zero"), F.col(weight))
    return df.groupBy(weight_status(weight).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(usable).alias("mean"), F.max(usable).alias("max")
    )


def trim_weights(df: DataFrame, weight: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Drop rows without a finite weight, and those outside the given bounds."""
    kept = df.where(~weight_status(weight).isin("Missing", "Infinite"))
    if lower is not None:
        kept = kept.where(F.col(weight) >= lower)
    return kept if upper is None else kept.where(F.col(weight) <= upper)


# ---------------------------------------------------------------- balance


def _continuous_stats(df: DataFrame, strata: str, variables: Sequence[str], weight: str | None) -> DataFrame:
    """Weighted mean and variance (n/(n-1) scaled) per stratum and variable, from one grouped pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs = []
    for v in variables:
        x = F.col(v).cast("double")
        known = F.when(x.isNotNull(), w)
        aggs += [
            F.sum(known).alias(f"w_{v}"), F.sum(w * x).alias(f"s_{v}"), F.sum(w * x * x).alias(f"q_{v}"), F.count(x).alias(f"n_{v}"),
        ]
    wide = df.where(F.col(strata).isNotNull()).groupBy(F.col(strata).cast("string").alias("stratum")).agg(*aggs)
    entries = []
    for v in variables:
        mean = F.col(f"s_{v}") / F.col(f"w_{v}")
        n = F.col(f"n_{v}").cast("double")
        var = F.try_divide((F.col(f"q_{v}") / F.col(f"w_{v}") - mean * mean) * n, n - 1)
        entries.append(
            F.struct(F.lit(v).alias("variable"), mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"), F.col(f"n_{v}").alias("n"))
        )
    return wide.select("stratum", F.explode(F.array(*entries)).alias("e")).select("stratum", "e.*")


def _proportions(df: DataFrame, strata: str, variables: Sequence[str], weight: str | None) -> DataFrame:
    """Weighted level proportions per stratum and categorical variable, all variables in one pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    entries = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables]
    from pyspark.sql import Window

    cells = (
        df.where(F.col(strata).isNotNull())
        .select(F.col(strata).cast("string").alias("stratum"), w.alias("w"), F.explode(F.array(*entries)).alias("e"))
        .where("e.level IS NOT NULL")
        .groupBy("stratum", F.col("e.variable").alias("variable"), F.col("e.level").alias("level"))
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    )
    return cells.withColumn("mean", F.col("w") / F.sum("w").over(Window.partitionBy("stratum", "variable"))).drop("w")


def table_one(df: DataFrame, strata: str, variables: Sequence[str] = (), categorical: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mean and sd, or level proportions, per stratum: (variable, level, stratum, n, mean, sd)."""
    parts = []
    if variables:
        parts.append(
            _continuous_stats(df, strata, variables, weight).select(
                "variable", F.lit(None).cast("string").alias("level"), "stratum", "n", "mean", F.sqrt("var").alias("sd")
            )
        )
    if categorical:
        parts.append(
            _proportions(df, strata, categorical, weight).select(
                "variable", "level", "stratum", "n", "mean", F.lit(None).cast("double").alias("sd")
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def smd(df: DataFrame, strata: str, variables: Sequence[str] = (), categorical: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Standardised mean difference per variable, averaged over pairs of strata.

    Continuous: absolute mean difference over the root of the average variance. Categorical: Mahalanobis
    distance between the level proportions. Only stratum statistics are paired.
    """
    spark = df.sparkSession
    out = None
    if variables:
        s = _continuous_stats(df, strata, variables, weight)
        a = s.select("variable", F.col("stratum").alias("a"), F.col("mean").alias("ma"), F.col("var").alias("va"))
        b = s.select("variable", F.col("stratum").alias("b"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
        gap = F.try_divide(F.abs(F.col("ma") - F.col("mb")), F.sqrt((F.col("va") + F.col("vb")) / 2.0))
        out = a.join(b, "variable").where("a < b").groupBy("variable").agg(F.avg(gap).alias("smd"))
    if categorical:
        find_levels(df, [strata, *categorical])
        p = _proportions(df, strata, categorical, weight).toPandas()
        rows = []
        for v, part in p.groupby("variable"):
            wide = part.pivot(index="stratum", columns="level", values="mean").fillna(0.0).sort_index(axis=1)
            values = wide.to_numpy()[:, 1:]
            found = []
            for i in range(len(values)):
                for j in range(i + 1, len(values)):
                    diff = values[i] - values[j]
                    cov = sum(np.diag(x) - np.outer(x, x) for x in (values[i], values[j])) / 2.0
                    found.append(math.sqrt(max(float(diff @ np.linalg.pinv(cov) @ diff), 0.0)))
            rows.append((str(v), float(np.mean(found))))
        table = spark.createDataFrame(rows, "variable string, smd double")
        out = table if out is None else out.unionByName(table)
    return out


def _known(df: DataFrame, column: str) -> Column:
    held = F.col(column).isNotNull()
    return held & ~F.isnan(column) if df.schema[column].dataType.typeName() in ("float", "double") else held


def balance_tstats(df: DataFrame, exposure: str, covariates: Sequence, weight: str, cluster: str) -> DataFrame:
    """t statistic of the exposure on each covariate, unweighted and weighted, with cluster variances.

    One model per covariate and design, all fitted together: a cross-product matrix per design holds the moments of
    every covariate, and one aggregate by cluster the scores of all models. A model leaves out rows with a null in its
    own columns only. Levels of a factor are those of the whole table; a term that a model cannot tell from others has
    a null statistic.
    """
    used = list(dict.fromkeys([exposure, weight, cluster, *_sources(covariates)]))
    rows = df.select(*used).dropna(subset=[exposure, cluster])
    wanted = [c.column for c in covariates if isinstance(c, factor) and not c.levels]
    levels = find_levels(rows, wanted)
    pinned = [factor(c.column, tuple(levels[c.column]), c.ref) if isinstance(c, factor) and not c.levels else c for c in covariates]
    designs = [build_design(rows, [c]) for c in pinned]
    # Columns of a covariate are zero where it is unknown, so such rows add nothing to its block.
    columns, blocks = [], []
    for d in designs:
        held = F.lit(True)
        for name in d.sources:
            held = held & _known(rows, name)
        block = [F.when(held, c.cast("double")).otherwise(0.0) for c in [*d.columns, F.col(exposure)]]
        blocks.append(slice(len(columns), len(columns) + len(block)))
        columns += block
    weights = {"unweighted": F.lit(1.0), "weighted": F.when(_known(rows, weight), F.col(weight).cast("double")).otherwise(0.0)}
    present = {"unweighted": F.lit(True), "weighted": _known(rows, weight)}
    fits, sums = [], []
    for design, w in weights.items():
        products = gram(rows, columns, w)
        for block, d in zip(blocks, designs):
            m = products[block, block]
            coef, bread, _ = solve_kept(m[:-1, :-1], m[:-1, -1])
            *x, y = columns[block]
            resid = y - sum((F.lit(float(b)) * c for b, c in zip(np.nan_to_num(coef), x)), F.lit(0.0))
            at = len(sums)
            sums += [F.sum(w * c * resid) for c in x]
            sums.append(F.max(F.when((x[0] > 0) & present[design], 1.0).otherwise(0.0)))
            fits.append((design, d, coef, bread, slice(at, at + len(x)), at + len(x)))
    scores = rows.groupBy(cluster).agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)])
    meat = gram(scores, [F.col(f"s{i}") for i in range(len(sums))])
    out = []
    for design, d, coef, bread, own, counted in fits:
        clusters, total = meat[counted, counted], meat[own, counted]
        spread = bread @ ((meat[own, own] - np.outer(total, total) / clusters) * clusters / (clusters - 1)) @ bread
        for name, b, v in list(zip(d.names, coef, np.diag(spread)))[1:]:
            t = float(b / math.sqrt(v)) if v > 0 else None
            out.append((d.sources[0], name, design, None if math.isnan(b) else t))
    return df.sparkSession.createDataFrame(out, "variable string, term string, design string, t_val double")
