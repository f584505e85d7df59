"""Difference-in-differences under staggered rollout.

Everything is built from cohort-by-period cells. Spark reduces the rows to cell moments, and to one short
influence vector per cluster for variances; the contrasts between cells are small matrices on the driver.

Cohort 0 (or null) means never treated. Cohort and time must be in the same unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quasi.functions.tails import chi2_upper, normal_quantile, normal_two_sided
from quasi.models.design import Design, build_design, crossed, factor, find_levels, interaction
from quasi.models.fe import (
    FixedEffectsFit, _total, add_level_effects, between_products, fe_ols, level_products, level_slots, unit_profiles,
    with_relative_key,
)
from quasi.models.glm import logit
from quasi.models.linear import Fit, _sources, gram, ols, solve_kept
from quasi.operators.reshape import cohort_pairs
from quasi.operators.skew import attach_totals

MAX_CELLS = 20_000


# ---------------------------------------------------------------- two groups, two periods


def did_2x2(df: DataFrame, y: str, group: str, period: str, weight: str | None = None) -> Fit:
    """Group by period interaction; rows collapse to four cells before the fit."""
    return ols(df, y, crossed(factor(group), factor(period)), weight)


def twfe(df: DataFrame, y: str, d: str, unit: str, time: str, weight: str | None = None, cluster: str | None = None) -> FixedEffectsFit:
    """Two-way fixed effects with a treatment indicator, clustered by unit unless named otherwise."""
    return fe_ols(df, y, [d], [unit, time], weight, cluster or unit)


def triple_difference(df: DataFrame, y: str, group: str, period: str, subgroup: str, weight: str | None = None) -> Fit:
    """Three-way interaction of group, period and subgroup (eight cells)."""
    return ols(df, y, crossed(factor(group), factor(period), factor(subgroup)), weight)


# ---------------------------------------------------------------- cells


def cell_means(df: DataFrame, y: str, time: str, cohort: str, weight: str | None = None) -> pd.DataFrame:
    """Cohort-by-period weight, mean and row count; the number of cells is checked."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = (
        df.where(F.col(y).isNotNull())
        .groupBy(F.coalesce(F.col(cohort), F.lit(0)).cast("long").alias("g"), F.col(time).cast("long").alias("t"))
        .agg(F.sum(w).alias("w"), (F.sum(w * F.col(y)) / F.sum(w)).alias("mean"), F.count(F.lit(1)).alias("n"))
        .limit(MAX_CELLS + 1)
        .toPandas()
    )
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cohort-by-period cells")
    return cells.sort_values(["g", "t"]).reset_index(drop=True)


def check_units(cells: pd.DataFrame) -> None:
    """Treated cohorts must start inside the range of the time column (same unit)."""
    starts = [g for g in cells.g.unique() if g != 0]
    if starts and not any(cells.t.min() <= g <= cells.t.max() for g in starts):
        raise ValueError("no cohort starts within the observed periods: cohort and time units differ")


def bacon(df: DataFrame, y: str, unit: str, time: str, cohort: str) -> DataFrame:
    """All two-by-two comparisons behind a two-way fixed effects estimate on a balanced panel.

    Columns: type, treated, control, estimate, weight. The weighted sum is the fixed effects coefficient.
    """
    spark = df.sparkSession
    cells = cell_means(df, y, time, cohort)
    check_units(cells)
    if cells.groupby("g").n.nunique().max() != 1:
        raise ValueError("the decomposition needs a balanced panel")
    periods = sorted(cells.t.unique())
    mean = {(r.g, r.t): r["mean"] for _, r in cells.iterrows()}
    size = {g: s.n.iloc[0] for g, s in cells.groupby("g")}
    total = sum(size.values())
    share = {g: s / total for g, s in size.items()}
    exposed = {g: (0.0 if g == 0 else float(np.mean([t >= g for t in periods]))) for g in share}

    d = {(g, t): float(g != 0 and t >= g) for g in share for t in periods}
    by_time = {t: sum(share[g] * d[g, t] for g in share) for t in periods}
    grand = float(np.mean(list(by_time.values())))
    variance = sum(
        share[g] * np.mean([(d[g, t] - exposed[g] - by_time[t] + grand) ** 2 for t in periods]) for g in share
    )

    def avg(g, keep):
        return float(np.mean([mean[g, t] for t in periods if keep(t)]))

    def two_by_two(a, b, before, after):
        return (avg(a, after) - avg(a, before)) - (avg(b, after) - avg(b, before))

    rows = []
    base = [g for g in share if exposed[g] == 0.0]
    always = [g for g in share if exposed[g] == 1.0]
    timed = sorted(g for g in share if 0.0 < exposed[g] < 1.0)
    for k in timed:
        for u, kind in [*((u, "Treated vs Untreated") for u in base), *((u, "Later vs Always Treated") for u in always)]:
            n = share[k] + share[u]
            mix = share[k] / n
            weight = n**2 * mix * (1 - mix) * exposed[k] * (1 - exposed[k]) / variance
            rows.append((kind, k, u, two_by_two(k, u, lambda t: t < k, lambda t: t >= k), weight))
    for i, k in enumerate(timed):
        for l in timed[i + 1:]:
            n = share[k] + share[l]
            mix = share[k] / n
            dk, dl = exposed[k], exposed[l]
            early = (n * (1 - dl)) ** 2 * mix * (1 - mix) * ((dk - dl) / (1 - dl)) * ((1 - dk) / (1 - dl)) / variance
            late = (n * dk) ** 2 * mix * (1 - mix) * (dl / dk) * ((dk - dl) / dk) / variance
            rows.append(("Earlier vs Later Treated", k, l, two_by_two(k, l, lambda t: t < k, lambda t: k <= t < l), early))
            rows.append(("Later vs Earlier Treated", l, k, two_by_two(l, k, lambda t: k <= t < l, lambda t: t >= l), late))
    return spark.createDataFrame(
        [(kind, int(a), int(b), float(e), float(w)) for kind, a, b, e, w in rows],
        "type string, treated long, control long, estimate double, weight double",
    )


def comparison_windows(df: DataFrame, time: str, cohort: str) -> DataFrame:
    """Rows of every treated-against-other cohort pair, restricted to clean periods.

    A pair (a, b) keeps a as treated and b as control. A later-treated control is used before its own
    start; an earlier-treated control is used from its own start on.
    """
    cohorts = [int(c) for c in find_levels(df, [cohort])[cohort]]
    pairs = [(a, b) for a in cohorts for b in cohorts if a != b and a != 0]
    paired = cohort_pairs(df.withColumn(cohort, F.col(cohort).cast("long")), cohort, pairs)
    a, b, t = F.col("a"), F.col("b"), F.col(time)
    clean = F.when(b == 0, True).when(b > a, t < b).otherwise(t >= b)
    return paired.where(clean).withColumn("comparison", F.concat_ws("v", a.cast("string"), b.cast("string")))


# ---------------------------------------------------------------- group-time effects


@dataclass
class GroupTime:
    """Group-time effects with what aggregation and inference need.

    ``contrast`` maps the vector of cell means to the effects, where they are such a function. ``vcov`` is the covariance of the effects
    (None when no variance was asked for) and ``draws`` holds multiplier-bootstrap deviations.
    """

    table: pd.DataFrame
    cells: pd.DataFrame
    contrast: np.ndarray | None
    shares: dict
    vcov: np.ndarray | None = None
    draws: np.ndarray | None = None
    clusters: float = 0.0
    #: of the effects and, after them, the cohort shares
    joint_vcov: np.ndarray | None = None
    joint_draws: np.ndarray | None = None
    options: dict = field(default_factory=dict)

    def frame(self, spark: SparkSession, level: float = 0.95, uniform: bool = False) -> DataFrame:
        return _effects_frame(spark, self.table[["g", "t"]], self.table.att.to_numpy(), self.vcov, self.draws, level, uniform)


def _effects_frame(spark, keys: pd.DataFrame, effects, vcov, draws, level, uniform) -> DataFrame:
    se = np.sqrt(np.maximum(np.diag(vcov), 0.0)) if vcov is not None else np.full(len(effects), np.nan)
    crit = normal_quantile((1 + level) / 2)
    if draws is not None:
        # Interquartile-range scale of the bootstrap deviations, as is usual for these estimators.
        q75, q25 = np.quantile(draws, [0.75, 0.25], axis=0)
        se = (q75 - q25) / (normal_quantile(0.75) - normal_quantile(0.25))
        if uniform:
            live = se > 0
            crit = float(np.quantile(np.max(np.abs(draws[:, live]) / se[live], axis=1), level))
    rows = []
    for i, key in enumerate(keys.itertuples(index=False)):
        known = not math.isnan(se[i])
        rows.append(
            (*[str(k) if isinstance(k, str) else int(k) for k in key], float(effects[i]),
             *((float(se[i]), float(effects[i] - crit * se[i]), float(effects[i] + crit * se[i])) if known else (None, None, None)))
        )
    kinds = ", ".join(f"{c} {'string' if keys[c].dtype == object else 'long'}" for c in keys.columns)
    return spark.createDataFrame(rows, f"{kinds}, att double, se double, ci_lo double, ci_hi double")


def balanced_units(df: DataFrame, unit: str, time: str, n_periods: int) -> DataFrame:
    """Rows of units seen in every period."""
    counted = attach_totals(df, [unit], [F.count_distinct(time).alias("__k")])
    return counted.where(F.col("__k") == n_periods).drop("__k")


def _comparisons(cells: pd.DataFrame, control: str) -> tuple[list, list, list]:
    """Contrasts (g, t, base, control cohorts), the periods, and what was left out as (g, t, reason)."""
    periods = sorted(int(t) for t in cells.t.unique())
    cohorts = sorted(int(g) for g in cells.g.unique())
    if 0 not in cohorts:
        if control == "never":
            raise ValueError("no never-treated cohort; use control='notyet'")
        last = max(cohorts)
        periods = [t for t in periods if t < last]
    treated = [g for g in cohorts if g != 0 and periods[0] < g <= periods[-1]]
    omitted = [(g, None, "starts outside the compared periods") for g in cohorts if g != 0 and g not in treated]
    present = {(int(r.g), int(r.t)) for r in cells.itertuples()}
    out = []
    for g in treated:
        before = [t for t in periods if t < g]
        for i, t in enumerate(periods):
            if t >= g:
                base = before[-1]
            elif i == 0:
                continue
            else:
                base = periods[i - 1]
            late = max(t, base)
            if control == "never":
                pool = [0]
            else:
                pool = [h for h in cohorts if h != g and (h == 0 or h > late)]
            pool = [h for h in pool if (h, t) in present and (h, base) in present]
            if not {(g, t), (g, base)} <= present:
                omitted.append((g, t, "no rows of the cohort in the period or its base"))
            elif not pool:
                omitted.append((g, t, "no control cohort with rows in both periods"))
            else:
                out.append((g, t, base, tuple(pool)))
    return out, periods, omitted


def att_gt(
    df: DataFrame, y: str, time: str, cohort: str, unit: str | None = None, control: str = "never",
    panel: bool = True, covariates: Sequence = (), est: str = "reg", weight: str | None = None,
    cluster: str | None = None, draws: int = 0, seed: int = 1,
) -> GroupTime:
    """Group-time average effects (Callaway and Sant'Anna 2021) with a varying base period.

    control: 'never' or 'notyet'. panel=True keeps units seen in every period (``att_gt_changes`` also uses the
    others, and covariates that vary); panel=False treats rows as repeated cross-sections. Variances come from one influence vector per cluster (the unit, the named
    cluster, or the row itself), which also holds the cohort shares, and ``draws`` adds a Rademacher
    multiplier bootstrap. With covariates, which in a panel must not vary over time, est='reg' adjusts by
    outcome regression on controls, with variances by the delta method from the moments of each cluster;
    est='dr' adds odds-weighted control residuals, and its influence carries the estimated outcome
    regressions and the estimated propensity. Rows without an outcome or a covariate take no part.
    """
    base = df.dropna(subset=list(dict.fromkeys([y, *_sources(covariates)]))).withColumns(
        {"__g": F.coalesce(F.col(cohort), F.lit(0)).cast("long"), "__t": F.col(time).cast("long")}
    )
    if panel:
        if unit is None:
            raise ValueError("panel=True needs a unit column")
        n_periods = base.select("__t").distinct().count()
        base = balanced_units(base, unit, "__t", n_periods)
        cluster = cluster or unit
    needed = [y, *_sources(covariates), *[c for c in (weight, cluster) if c]]
    base = base.select("__g", "__t", *dict.fromkeys(needed)).persist()
    cells = cell_means(base, y, "__t", "__g", weight)
    check_units(cells)
    todo, periods, omitted = _comparisons(cells, control)
    index = {(int(r.g), int(r.t)): i for i, r in enumerate(cells.itertuples())}
    w = cells.w.to_numpy()
    contrast, mixing = np.zeros((len(todo), len(cells))), np.zeros((len(todo), len(cells)))
    mean = cells["mean"].to_numpy()
    for row, (g, t, b, pool) in enumerate(todo):
        contrast[row, index[g, t]] += 1.0
        contrast[row, index[g, b]] -= 1.0
        for at, sign in ((t, -1.0), (b, 1.0)):
            spots = [index[h, at] for h in pool]
            total = w[spots].sum()
            contrast[row, spots] += sign * w[spots] / total
            # How the mean of the pooled controls moves with the weight of each of their cohorts.
            mixing[row, spots] += sign * (mean[spots] - w[spots] @ mean[spots] / total) / total
    weight_by_cohort = cells.groupby("g").w.sum()
    shares = {int(g): float(v / weight_by_cohort.sum()) for g, v in weight_by_cohort.items()}
    table = pd.DataFrame([(g, t) for g, t, _, _ in todo], columns=["g", "t"])
    out = GroupTime(table, cells, contrast, shares, options={"control": control, "periods": periods, "omitted": omitted})
    if covariates:
        design = build_design(base, covariates)
        table["att"], influence = _adjusted(base, y, design, covariates, est, todo, weight, panel)
        summed = _adjusted_covariance if est == "reg" else _robust_covariance
        spread = summed(base, y, design, influence, len(todo), weight, cluster, draws, seed, shares, float(w.sum()))
    else:
        table["att"] = contrast @ mean
        spread = _cell_covariance(base, y, cells, index, weight, cluster, contrast, mixing, draws, seed, shares)
    base.unpersist()
    # Effects come first, the cohort shares after them.
    k = len(todo)
    out.joint_vcov, out.joint_draws, out.clusters = spread
    out.vcov = out.joint_vcov[:k, :k]
    out.draws = None if out.joint_draws is None else out.joint_draws[:, :k]
    return out


def _share_influence(weights: np.ndarray, shares: dict, total: float) -> np.ndarray:
    """Influence on the cohort shares of clusters with these weights by cohort (columns in the order of ``shares``)."""
    p = np.array(list(shares.values()))
    return (weights - weights.sum(axis=1, keepdims=True) * p) / total


def _mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit integer mixer, for repeatable signs."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _cell_covariance(base, y, cells, index, weight, cluster, contrast, mixing, draws, seed, shares):
    """Covariance of the effects and the cohort shares from per-cluster influence on the cell means.

    Rows shrink to (cluster, cell) sums by map-side combine. A cluster touches at most one entry per
    cell, so its influence vector is short; tasks multiply it by the contrasts and add up one small
    matrix of cross-products (and one of signed sums per draw).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    keys = F.array(*[F.lit(f"{g}|{t}") for g, t in index])
    cell = F.array_position(keys, F.concat_ws("|", "__g", "__t")) - 1
    mean, total = cells["mean"].to_numpy(), cells.w.to_numpy()
    # Which cohort a cell belongs to, one column each.
    of_cohort = np.array([[float(g == h) for h in shares] for g in cells.g])
    if cluster is None:
        # Independent rows: cell variances in closed form, no covariance between cells.
        ww = base.groupBy(cell.alias("cell")).agg(
            F.sum(w * w).alias("s0"), F.sum(w * w * F.col(y)).alias("s1"), F.sum(w * w * F.col(y) * F.col(y)).alias("s2")
        ).collect()
        var, both, square = np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells))
        for r in ww:
            i = r["cell"]
            var[i] = (r["s2"] - 2 * mean[i] * r["s1"] + mean[i] ** 2 * r["s0"]) / total[i] ** 2
            both[i] = (r["s1"] - mean[i] * r["s0"]) / total[i]
            square[i] = r["s0"]
        # A row of a cell moves the shares by the same vector, times its weight.
        moved = _share_influence(of_cohort, shares, float(total.sum()))
        cross = (contrast * both + mixing * square) @ moved
        mixed = (contrast * both) @ mixing.T
        own = (contrast * var) @ contrast.T + mixed + mixed.T + (mixing * square) @ mixing.T
        vcov = np.block([[own, cross], [cross.T, (moved.T * square) @ moved]])
        return vcov, _normal_draws(vcov, draws, seed) if draws else None, float(cells.n.sum())
    per = (
        base.groupBy(F.col(cluster).alias("c"), cell.alias("cell"))
        .agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("s"))
        .groupBy("c")
        .agg(F.collect_list(F.struct("cell", "w", "s")).alias("parts"))
        .select(F.xxhash64("c").alias("h"), F.col("parts.cell").alias("cell"), F.col("parts.w").alias("w"), F.col("parts.s").alias("s"))
    )
    def effects(batch: pd.DataFrame) -> np.ndarray:
        psi, held = np.zeros((len(batch), len(mean))), np.zeros((len(batch), len(mean)))
        for i, (ids, ws, ss) in enumerate(zip(batch.cell, batch.w, batch.s)):
            at = np.asarray(ids, dtype=int)
            held[i, at] = ws
            psi[i, at] = (np.asarray(ss) - mean[at] * np.asarray(ws)) / total[at]
        return np.hstack([psi @ contrast.T + held @ mixing.T, _share_influence(held @ of_cohort, shares, float(total.sum()))])

    return _influence_sums(per, effects, contrast.shape[0] + len(shares), draws, seed)


def _normal_draws(vcov: np.ndarray, draws: int, seed: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(vcov)
    normal = np.random.default_rng(seed).standard_normal((draws, len(vcov)))
    return (normal * np.sqrt(np.maximum(values, 0.0))) @ vectors.T


def _influence_sums(per: DataFrame, effects: Callable[[pd.DataFrame], np.ndarray], k: int, draws: int, seed: int):
    """Covariance, signed sums per draw, and count, from rows that ``effects`` turns into influence on k effects.

    Column ``h`` gives the signs. Tasks add up one matrix of cross-products and one of signed sums.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cross, signed, count = np.zeros((k, k)), np.zeros((draws, k)), 0
        for batch in batches:
            effect = effects(batch)
            cross += effect.T @ effect
            count += len(batch)
            if draws:
                h = batch.h.to_numpy().astype(np.int64).view(np.uint64)
                for b in range(draws):
                    sign = np.where(_mix(h ^ np.uint64(seed * 1_000_003 + b)) & np.uint64(1), 1.0, -1.0)
                    signed[b] += sign @ effect
        yield pd.DataFrame({"v": [np.concatenate([[float(count)], cross.ravel(), signed.ravel()])]})

    summed = (
        per.mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("pos", "v"))
        .groupBy("pos").agg(F.sum("v").alias("v")).toPandas().sort_values("pos").v.to_numpy()
    )
    count, cross = summed[0], summed[1:1 + k * k].reshape(k, k)
    boot = summed[1 + k * k:].reshape(draws, k) if draws else None
    return cross * count / max(count - 1, 1), boot, float(count)


def _moment_pairs(p: int) -> list[tuple[int, int]]:
    """Places of the upper triangle of the cross-products of p regressors and the outcome."""
    return [(i, j) for i in range(p + 1) for j in range(i, p + 1)]


def _adjusted_covariance(base, y, design, influence, k, weight, cluster, draws, seed, shares, total):
    """Covariance of regression-adjusted effects by the delta method.

    Effects are smooth functions of the cells' moment matrices. Rows shrink to (cluster, cell) moments, and a
    cluster's influence is the sum of those times the derivatives, which have mean zero by construction.
    Without a cluster each row is its own, and draws are normal with the covariance found.
    """
    p = len(design.columns)
    pairs = _moment_pairs(p)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    z = [f"x{i}" for i in range(p + 1)]
    named = base.select(
        "__g", "__t", w.alias("w"), *[c.alias(n) for c, n in zip([*design.columns, F.col(y).cast("double")], z)],
        *([F.col(cluster).alias("c")] if cluster else []),
    )
    products = [F.col("w") * F.col(z[i]) * F.col(z[j]) for i, j in pairs]
    if cluster:
        sums = named.groupBy("c", "__g", "__t").agg(*[F.sum(m).alias(f"m{q}") for q, m in enumerate(products)])
        entry = F.struct("__g", "__t", F.array(*[f"m{q}" for q in range(len(pairs))]).alias("m"))
        per = sums.groupBy("c").agg(F.collect_list(entry).alias("parts")).select(F.xxhash64("c").alias("h"), "parts")
    else:
        per = named.select(F.lit(0).cast("long").alias("h"), F.array(F.struct("__g", "__t", F.array(*products).alias("m"))).alias("parts"))
    per = per.select(
        "h", F.col("parts.__g").alias("g"), F.col("parts.__t").alias("t"), F.col("parts.m").alias("m")
    )

    place = {g: i for i, g in enumerate(shares)}

    def effects(batch: pd.DataFrame) -> np.ndarray:
        out, held = np.zeros((len(batch), k)), np.zeros((len(batch), len(shares)))
        for i, (gs, ts, ms) in enumerate(zip(batch.g, batch.t, batch.m)):
            for g, t, m in zip(gs, ts, ms):
                held[i, place[g]] += m[0]
                if (g, t) in influence:
                    ids, derivative = influence[g, t]
                    out[i, ids] += np.asarray(m) @ derivative
        return np.hstack([out, _share_influence(held, shares, total)])

    vcov, boot, count = _influence_sums(per, effects, k + len(shares), draws if cluster else 0, seed)
    return vcov, _normal_draws(vcov, draws, seed) if draws and not cluster else boot, count


@dataclass
class _Treated:
    """A treated cell's rows in effect ``at``: residuals around their mean, over the cell's weight."""

    at: int
    sign: float
    beta: np.ndarray
    centre: float
    weight: float

    def of(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.sign * w * (y - x @ self.beta - self.centre) / self.weight


@dataclass
class _Control:
    """A control cell's rows: odds-weighted residuals, and their pull on the outcome regression."""

    at: int
    sign: float
    beta: np.ndarray
    centre: float
    weight: float
    odds: np.ndarray
    pull: np.ndarray

    def of(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        residual = y - x @ self.beta
        direct = np.exp(x @ self.odds) * (residual - self.centre) / self.weight
        return self.sign * w * (residual * (x @ self.pull) - direct)


@dataclass
class _Score:
    """Rows the propensity was fitted on: their scores times what the effect changes by with its coefficients."""

    at: int
    treated: bool
    odds: np.ndarray
    pull: np.ndarray

    def of(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w * (float(self.treated) - 1.0 / (1.0 + np.exp(-(x @ self.odds)))) * (x @ self.pull)


def _robust_covariance(base, y, design, influence, k, weight, cluster, draws, seed, shares, total, share=None):
    """Covariance of doubly robust effects: a row's influence follows from its cell's parts; clusters add up theirs.

    Tasks add up the influence of the rows they hold by cluster before anything moves. Sums of ``share`` (the weight,
    unless named) by cohort are what the shares were taken from.
    """
    p, size = len(design.columns), k + len(shares)
    place = {g: i for i, g in enumerate(shares)}
    names = [f"e{i}" for i in range(size)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = F.xxhash64(cluster) if cluster else F.monotonically_increasing_id()
    named = base.select(
        "__g", "__t", own.alias("h"), w.alias("w"), (F.col(share) if share else w).alias("u"), F.col(y).cast("double").alias("y"),
        *[c.cast("double").alias(f"x{i}") for i, c in enumerate(design.columns)],
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, held = np.zeros((len(batch), k)), np.zeros((len(batch), len(shares)))
            for cell, at in batch.groupby(["__g", "__t"]).indices.items():
                part = batch.iloc[at]
                x, outcome, weights = part[[f"x{i}" for i in range(p)]].to_numpy(), part.y.to_numpy(), part.w.to_numpy()
                held[at, place[cell[0]]] = part.u.to_numpy()
                for piece in influence.get(cell, ()):
                    found[at, piece.at] += piece.of(x, outcome, weights)
            out = pd.DataFrame(np.hstack([found, _share_influence(held, shares, total)]), columns=names)
            out["h"] = batch.h.to_numpy()
            yield out.groupby("h", as_index=False).sum()

    each = named.mapInPandas(rows, ", ".join(f"{n} double" for n in names) + ", h long")
    if cluster:
        each = each.groupBy("h").agg(*[F.sum(n).alias(n) for n in names])
    vcov, boot, count = _influence_sums(each, lambda batch: batch[names].to_numpy(), size, draws if cluster else 0, seed)
    return vcov, _normal_draws(vcov, draws, seed) if draws and not cluster else boot, count


def _pinned(term, levels: dict):
    """A term with the levels of the whole table, so that a part of it is coded alike."""
    if isinstance(term, factor):
        return factor(term.column, tuple(term.levels) or tuple(levels[term.column]), term.ref)
    return interaction(*[_pinned(m, levels) for m in term.members]) if isinstance(term, interaction) else term


def _adjusted(base, y, design, covariates, est, todo, weight, panel):
    """Covariate-adjusted effects from cell moments (and odds-weighted cell moments for 'dr').

    Also, per cell, what its rows do to the effects: derivatives by its moments for 'reg', parts of the
    influence of a row for 'dr'.
    """
    cols = [*design.columns, F.col(y).cast("double")]
    p = len(design.columns)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)

    def moments(rows: DataFrame, wt: Column) -> dict:
        named = rows.select("__g", "__t", wt.alias("w"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
        pairs = _moment_pairs(p)
        grouped = named.groupBy("__g", "__t").agg(
            *[F.expr(f"sum(w * x{i} * x{j})").alias(f"s{i}_{j}") for i, j in pairs]
        )
        out = {}
        for r in grouped.collect():
            m = np.zeros((p + 1, p + 1))
            for i, j in pairs:
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
            out[r["__g"], r["__t"]] = m
        return out

    plain = moments(base, w)
    cache: dict = {}
    # The propensity has the columns of the design: pinned factors, or else the columns themselves.
    terms = [_pinned(c, design.levels) for c in covariates] if design.discrete else [f"__x{i}" for i in range(1, p)]
    numeric = [] if design.discrete else [c.cast("double").alias(f"__x{i}") for i, c in enumerate(design.columns) if i]
    effects = []
    parts: dict = {}
    for at, (g, t, b, pool) in enumerate(todo):
        solved = {s: solve_kept(m[:p, :p], m[:p, p]) for s, m in ((s, sum(plain[h, s] for h in pool)) for s in (t, b))}
        beta = {s: np.nan_to_num(coef) for s, (coef, _, _) in solved.items()}

        def residual(m, s):
            """Weighted mean of y - x'beta over the rows behind a moment matrix."""
            return (m[0, p] - m[0, :p] @ beta[s]) / m[0, 0]

        treated = residual(plain[g, t], t) - residual(plain[g, b], b)
        if est == "reg":
            # Both treated periods share one covariate distribution.
            pooled = plain[g, t] + plain[g, b]
            xbar = pooled[0, :p] / pooled[0, 0]
            means = plain[g, t][0, p] / plain[g, t][0, 0] - plain[g, b][0, p] / plain[g, b][0, 0]
            effects.append(float(means - xbar @ (beta[t] - beta[b])))
            shift = beta[t] - beta[b]
            for s, sign in ((t, 1.0), (b, -1.0)):
                own = np.zeros((p + 1, p + 1))
                own[0, p] = sign / plain[g, s][0, 0]
                own[0, 0] = -sign * plain[g, s][0, p] / plain[g, s][0, 0] ** 2 + xbar @ shift / pooled[0, 0]
                own[0, :p] -= shift / pooled[0, 0]
                parts.setdefault((g, s), []).append((at, own))
                along = solved[s][1] @ xbar
                other = np.zeros((p + 1, p + 1))
                other[:p, p] = -sign * along
                other[:p, :p] = sign * np.outer(along, beta[s])
                for h in pool:
                    parts.setdefault((h, s), []).append((at, other))
            continue
        # In a panel the covariates are fixed, so one period gives the propensity for all of them.
        key = (g, pool) if panel else (g, pool, t, b)
        if key not in cache:
            rows = base.where(F.col("__g").isin(g, *pool)).withColumn("__d", (F.col("__g") == g).cast("int"))
            if not panel:
                rows = rows.where(F.col("__t").isin(t, b))
            fitted = rows.where(F.col("__t") == b) if panel else rows
            score = logit(fitted.select("*", *numeric), "__d", terms, weight)
            odds = np.nan_to_num(score.coef)
            eta = reduce(lambda m, n: m + n, [F.lit(float(v)) * c for v, c in zip(odds, design.columns)])
            cache[key] = moments(rows.where("__d = 0"), w * F.exp(eta)), odds, score.vcov, [b] if panel else [t, b]
        reweighted, odds, spread, fitted_at = cache[key]
        turn, effect = np.zeros(p), treated
        for s, sign in ((t, 1.0), (b, -1.0)):
            m, own = sum(reweighted[h, s] for h in pool), plain[g, s]
            centre = residual(m, s)
            effect -= sign * centre
            turn -= sign * (m[:p, p] - m[:p, :p] @ beta[s] - centre * m[0, :p]) / m[0, 0]
            pull = solved[s][1] @ (m[0, :p] / m[0, 0] - own[0, :p] / own[0, 0])
            parts.setdefault((g, s), []).append(_Treated(at, sign, beta[s], residual(own, s), own[0, 0]))
            for h in pool:
                parts.setdefault((h, s), []).append(_Control(at, sign, beta[s], centre, m[0, 0], odds, pull))
        effects.append(float(effect))
        for h in (g, *pool):
            for s in fitted_at:
                parts.setdefault((h, s), []).append(_Score(at, h == g, odds, spread @ turn))
    if est != "reg":
        return effects, parts
    influence = {
        cell: ([at for at, _ in found], np.array([[d[i, j] + (d[j, i] if i != j else 0.0) for i, j in _moment_pairs(p)] for _, d in found]).T)
        for cell, found in parts.items()
    }
    return effects, influence


def aggte(gt: GroupTime, kind: str = "simple") -> GroupTime:
    """Weighted averages of group-time effects: 'simple', 'dynamic' (by t - g) or 'group'.

    The last row, keyed ``overall``, averages the others as the source paper does. Variances carry the
    uncertainty of the effects and of the cohort shares that weigh them.
    """
    t = gt.table
    share, att = t.g.map(gt.shares).to_numpy(), t.att.to_numpy()
    post = (t.t >= t.g).to_numpy()
    rows, keys, turns = [], [], []

    def by_shares(mask):
        """Derivatives of the share-weighted mean of the masked effects by the shares of all cohorts."""
        total = (share * mask).sum()
        mean = (share * mask) @ att / total
        return np.array([((att - mean) * mask * (t.g == g).to_numpy()).sum() / total for g in gt.shares])

    def normal(v):
        return v / v.sum()

    if kind == "simple":
        rows.append(normal(share * post))
        turns.append(by_shares(post))
        keys.append("overall")
    elif kind == "dynamic":
        event = (t.t - t.g).to_numpy()
        for e in sorted(set(event)):
            rows.append(normal(share * (event == e)))
            turns.append(by_shares(event == e))
            keys.append(str(e))
        live = [i for i, e in enumerate(sorted(set(event))) if e >= 0]
        rows.append(np.mean([rows[i] for i in live], axis=0))
        turns.append(np.mean([turns[i] for i in live], axis=0))
        keys.append("overall")
    elif kind == "group":
        groups = sorted(set(t.g[post]))
        for g in groups:
            rows.append(normal(((t.g == g).to_numpy() & post).astype(float)))
            turns.append(np.zeros(len(gt.shares)))
            keys.append(str(g))
        held = np.array([gt.shares[g] for g in groups])
        means = np.array(rows) @ att
        whole = normal(held) @ means
        turns.append(np.array([(means[groups.index(g)] - whole) / held.sum() if g in groups else 0.0 for g in gt.shares]))
        rows.append(normal(held) @ np.array(rows))
        keys.append("overall")
    else:
        raise ValueError(kind)
    a = np.array(rows)
    table = pd.DataFrame({"key": pd.Series(keys, dtype=object), "att": a @ att})
    along = np.hstack([a, np.array(turns)])
    vcov = along @ gt.joint_vcov @ along.T
    draws = gt.joint_draws @ along.T if gt.joint_draws is not None else None
    contrast = None if gt.contrast is None else a @ gt.contrast
    return GroupTime(table, gt.cells, contrast, gt.shares, vcov, draws, gt.clusters, options=gt.options)


def aggregated_frame(agg: GroupTime, spark: SparkSession, level: float = 0.95, uniform: bool = False) -> DataFrame:
    return _effects_frame(spark, agg.table[["key"]], agg.table.att.to_numpy(), agg.vcov, agg.draws, level, uniform)


def pretrend_test(gt: GroupTime) -> dict:
    """Wald test that every pre-treatment group-time effect is zero; needs effects with a covariance."""
    pre = np.flatnonzero((gt.table.t < gt.table.g).to_numpy())
    effects = gt.table.att.to_numpy()[pre]
    v = gt.vcov[np.ix_(pre, pre)]
    values, vectors = np.linalg.eigh(v)
    live = values > values.max() * 1e-10
    z = vectors[:, live].T @ effects
    statistic = float(np.sum(z * z / values[live]))
    return {"statistic": statistic, "df": int(live.sum()), "p_value": chi2_upper(statistic, float(live.sum()))}


# ---------------------------------------------------------------- two-stage estimator


def did2s(
    df: DataFrame, y: str, unit: str, time: str, d: str, cluster: str | None = None, rel: str | None = None,
    refs: Sequence[int] = (-1,), keep: Sequence[int] | None = None, weight: str | None = None,
) -> Fit:
    """Two-stage difference-in-differences (Gardner 2021), static or by relative time.

    Unit and time effects are fitted on untreated rows, removed from all rows, and the rest is regressed
    on treatment (``rel`` None) or on relative-time dummies. Cluster variances carry the first-stage
    error. Work happens on (unit, time, cluster) cells: unit effects stay in Spark, time effects form a
    small system on the driver. Units or periods without an untreated row drop out.
    """
    cluster = cluster or unit
    keyed = with_relative_key(df, rel, refs, keep) if rel else df.withColumn("__rel", F.when(F.col(d) == 1, "D").otherwise("base"))
    keys = list(dict.fromkeys([unit, time, cluster, d, "__rel"]))
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = keyed.where(F.col(y).isNotNull()).select(*keys, w0.alias("__w0"), F.col(y).cast("double").alias("__y"))
    cells = used.groupBy(*keys).agg(
        F.sum("__w0").alias("__w"), F.sum(F.col("__w0") * F.col("__y")).alias("m0"), F.count(F.lit(1)).alias("__n")
    ).persist()
    levels = find_levels(cells.where(F.col(d) == 0), [time])
    names = [v for v in find_levels(cells, ["__rel"])["__rel"] if v != "base"]
    names = names if not rel else sorted(names, key=int)
    k, p = len(names), len(levels[time])
    x2 = [F.when(F.col("__rel") == v, 1.0).otherwise(0.0) for v in names]
    slot = level_slots(levels)[time]
    usable = cells.withColumn("__slot_0", slot).where(F.col("__slot_0") >= 0)
    untreated = usable.where(F.col(d) == 0)
    r_cols = [f"r{j}" for j in range(k)]
    u_all = usable.groupBy(F.col(unit).alias("__unit")).agg(*[F.sum(F.col("__w") * x).alias(r) for r, x in zip(r_cols, x2)])
    u0 = unit_profiles(untreated, unit, ["__slot_0"], ["m0"])
    units = u0.join(u_all, u0[unit] == u_all["__unit"], "inner").persist()

    # Time effects of stage one: sweep units out of the untreated normal equations.
    raw = level_products(untreated, ["__slot_0"], p, ["m0"])
    between = between_products(units, p, ["u_m0", *r_cols])
    delta, inverse, _ = solve_kept(raw[:p, :p] - between[:p, :p], raw[:p, p] - between[:p, p])
    delta = np.nan_to_num(delta)
    by_period = np.zeros((p, k))
    for row in usable.groupBy("__slot_0").agg(*[F.sum(F.col("__w") * x).alias(r) for r, x in zip(r_cols, x2)]).collect():
        by_period[row["__slot_0"]] = [row[r] for r in r_cols]
    # Units without an untreated row drop out of the second stage, hence of its period sums.
    dropped = usable.join(units.select(F.col(unit).alias("__uid")), F.col(unit) == F.col("__uid"), "left_anti")
    for row in dropped.groupBy("__slot_0").agg(*[F.sum(F.col("__w") * x).alias(r) for r, x in zip(r_cols, x2)]).collect():
        by_period[row["__slot_0"]] -= [row[r] for r in r_cols]
    g_t = inverse @ (by_period - between[:p, p + 1:])

    # Unit effects (alpha) and unit parts of the correction (h) from untreated cells.
    effects = ["delta", *[f"g{j}" for j in range(k)]]
    table = np.column_stack([delta, g_t])
    rows = add_level_effects(usable, ["__slot_0"], table, effects)
    own = F.when(F.col(d) == 0, F.col("__w"))
    sides = rows.groupBy(F.col(unit).alias("__uid")).agg(
        F.sum(own).alias("w_own"),
        (F.sum(F.when(F.col(d) == 0, F.col("m0") - F.col("__w") * F.col("delta"))) / F.sum(own)).alias("alpha"),
        *[
            ((F.sum(F.col("__w") * x) - F.sum(own * F.col(f"g{j}"))) / F.sum(own)).alias(f"h{j}")
            for j, x in enumerate(x2)
        ],
    ).where("w_own > 0")
    joined = rows.join(sides, rows[unit] == sides["__uid"], "inner").withColumn(
        "ry", F.col("m0") - F.col("__w") * (F.col("alpha") + F.col("delta"))
    )
    cross = joined.groupBy("__rel").agg(F.sum("__w").alias("w"), F.sum("ry").alias("ry")).collect()
    weight_of, sum_of = ({r["__rel"]: r[c] for r in cross} for c in ("w", "ry"))
    bread = np.diag([1.0 / weight_of[v] if v in weight_of else 0.0 for v in names])
    coef = np.array([sum_of[v] / weight_of[v] if v in weight_of else np.nan for v in names])

    # Influence of each cluster: second-stage score less the first-stage correction.
    fitted = _total([F.lit(float(b)) * x for b, x in zip(np.nan_to_num(coef), x2)])
    u2 = F.col("ry") - F.col("__w") * fitted
    scores = [
        F.sum(x * u2 - F.when(F.col(d) == 0, (F.col(f"h{j}") + F.col(f"g{j}")) * F.col("ry")).otherwise(0.0)).alias(f"s{j}")
        for j, x in enumerate(x2)
    ]
    per_cluster = joined.groupBy(cluster).agg(*scores, F.sum("__n").alias("n"))
    meat = gram(per_cluster, [*[F.col(f"s{j}") for j in range(k)], F.lit(1.0)])
    n, clusters = float(joined.agg(F.sum("__n")).first()[0]), float(meat[-1, -1])
    vcov = bread @ meat[:k, :k] @ bread
    units.unpersist()
    cells.unpersist()
    labels = ["D"] if not rel else [f"rel_{v}" for v in names]
    return Fit(Design(labels, x2, [], True), labels, coef, vcov, n, None, {"clusters": clusters})


# ---------------------------------------------------------------- switchers


def did_m(df: DataFrame, y: str, unit: str, time: str, d: str) -> DataFrame:
    """Switchers estimator: (kind, time, effect, switchers) per period, and one 'overall' row.

    Outcome changes of units that switch in (or out) less those of units whose treatment stays the same
    at the earlier level, weighted by the number of switchers. Rows are first averaged to unit-periods,
    so the lag window holds one row per observed period of a unit.
    """
    cells = df.where(F.col(y).isNotNull()).groupBy(unit, time).agg(F.avg(y).alias("y"), F.max(d).cast("int").alias("d"))
    w = Window.partitionBy(unit).orderBy(time)
    moves = cells.select(
        time, (F.col("y") - F.lag("y").over(w)).alias("dy"), F.lag("d").over(w).alias("d0"), F.col("d").alias("d1")
    ).where("dy IS NOT NULL")
    means = moves.groupBy(time, "d0").agg(
        F.avg(F.when(F.col("d0") != F.col("d1"), F.col("dy"))).alias("switch"),
        F.avg(F.when(F.col("d0") == F.col("d1"), F.col("dy"))).alias("stay"),
        F.count(F.when(F.col("d0") != F.col("d1"), 1)).alias("switchers"),
    ).where("switch IS NOT NULL AND stay IS NOT NULL")
    effect = F.when(F.col("d0") == 0, F.col("switch") - F.col("stay")).otherwise(F.col("stay") - F.col("switch"))
    rows = means.select(
        F.when(F.col("d0") == 0, "in").otherwise("out").alias("kind"), F.col(time).cast("long").alias("time"),
        effect.alias("effect"), "switchers",
    )
    overall = rows.agg(
        (F.sum(F.col("effect") * F.col("switchers")) / F.sum("switchers")).alias("effect"), F.sum("switchers").alias("switchers")
    ).select(F.lit("overall").alias("kind"), F.lit(None).cast("long").alias("time"), "effect", "switchers")
    return rows.unionByName(overall)
