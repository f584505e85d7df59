"""Group-time effects from changes within units, for panels with gaps and covariates that vary over time.

A comparison of period t with its base b uses the units that are seen in both, so a unit with a gap is missing from
some comparisons only. Covariates and weights are those of the base period. Spark turns the rows into one change per
unit and pair of periods; the driver holds moments by cohort and pair, and coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.models.design import Design, build_design
from quasi.models.did import (
    MAX_CELLS, GroupTime, _comparisons, _Control, _moment_pairs, _robust_covariance, _Score, _Treated, check_units,
)
from quasi.models.linear import _sources, solve_kept

NEWTON_STEPS = 50


@dataclass
class _Regressed:
    """Rows an outcome regression was fitted on, by what they do to its mean over the treated."""

    at: int
    beta: np.ndarray
    pull: np.ndarray

    def of(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -w * (y - x @ self.beta) * (x @ self.pull)


def unit_histories(
    df: DataFrame, y: str, time: str, cohort: str, unit: str, columns: Sequence, weight: str | None, cluster: str | None
) -> DataFrame:
    """One row per unit: cohort g, cluster c, mean weight u, and a map from period to (w, y, x).

    Repeated rows of a unit in a period are replaced by their mean before units are put together, so a history is never
    longer than the number of periods. Rows without unit, period or outcome, or with a weight that is not positive,
    take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xs = [f"x{i}" for i in range(len(columns))]
    seen = (
        df.select(
            F.col(unit).alias("unit"), F.coalesce(F.col(cohort), F.lit(0)).cast("long").alias("g"), F.col(time).cast("long").alias("t"),
            F.col(cluster or unit).alias("c"), w.alias("w"), F.col(y).cast("double").alias("y"),
            *[c.cast("double").alias(n) for c, n in zip(columns, xs)],
        )
        .where("unit IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL AND w > 0")
        .groupBy("unit", "t")
        .agg(
            F.min("g").alias("g"), F.max("g").alias("last"), F.min("c").alias("c"), F.avg("w").alias("w"),
            *[F.expr(f"sum(w * {n}) / sum(w)").alias(n) for n in ("y", *xs)],
        )
    )
    return seen.groupBy("unit").agg(
        F.min("g").alias("g"), F.max("last").alias("last"), F.min("c").alias("c"), F.avg("w").alias("u"),
        F.map_from_entries(F.collect_list(F.struct("t", F.struct("w", "y", F.array(*xs).alias("x"))))).alias("seen"),
    )


def _cells(units: DataFrame) -> pd.DataFrame:
    """Cohort-by-period weight, mean and count of units; refuses units that change cohort."""
    each = units.select("g", "last", F.explode("seen").alias("t", "v"))
    cells = (
        each.groupBy("g", "t")
        .agg(
            F.sum("v.w").alias("w"), (F.sum(F.col("v.w") * F.col("v.y")) / F.sum("v.w")).alias("mean"),
            F.count(F.lit(1)).alias("n"), F.max(F.col("last") != F.col("g")).alias("moved"),
        )
        .limit(MAX_CELLS + 1).toPandas()
    )
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cohort-by-period cells")
    if cells.moved.any():
        raise ValueError("some units belong to more than one cohort")
    return cells.drop(columns="moved").sort_values(["g", "t"]).reset_index(drop=True)


def unit_changes(units: DataFrame, pairs: Sequence[tuple[int, int]], used: dict[int, set[int]], p: int) -> DataFrame:
    """Changes of the units seen in both periods of a pair, for the pairs their cohort is used in.

    ``pairs`` are (t, b); the number of a pair goes to column __t, the cohort to __g. Weight and the p covariates are
    those of the base. Each unit also has a row of pair -1 and weight zero, which carries its part of the shares (u).
    """
    # At most one entry per cohort and pair, both bounded by the number of cells.
    plan = units.sparkSession.createDataFrame(
        [(g, [(k, *pairs[k]) for k in sorted(ks)]) for g, ks in used.items()], "g long, pairs array<struct<k:int,t:long,b:long>>"
    )
    periods = F.map_keys("seen")
    known = F.filter("pairs", lambda q: F.array_contains(periods, q.t) & F.array_contains(periods, q.b))
    met = units.join(F.broadcast(plan), "g").select("c", "g", "seen", F.explode(known).alias("q"))
    now, before = F.col("seen")[F.col("q.t")], F.col("seen")[F.col("q.b")]
    changes = met.select(
        "c", F.col("g").alias("__g"), F.col("q.k").alias("__t"), F.lit(0.0).alias("u"), before.w.alias("w"),
        (now.y - before.y).alias("y"), *[before.x[i].alias(f"x{i}") for i in range(p)],
    )
    return changes.unionByName(units.select(
        "c", F.col("g").alias("__g"), F.lit(-1).alias("__t"), "u", F.lit(0.0).alias("w"), F.lit(0.0).alias("y"),
        *[F.lit(0.0).alias(f"x{i}") for i in range(p)],
    ))


def _moments(changes: DataFrame, p: int) -> dict:
    """Weighted cross-products of covariates and change by cohort and pair."""
    z = [*[f"x{i}" for i in range(p)], "y"]
    places = _moment_pairs(p)
    out = {}
    sums = [F.expr(f"sum(w * {z[i]} * {z[j]})").alias(f"s{i}_{j}") for i, j in places]
    for r in changes.where("__t >= 0").groupBy("__g", "__t").agg(*sums).collect():
        m = np.zeros((p + 1, p + 1))
        for i, j in places:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["__g"], r["__t"]] = m
    return out


def _sums_by_effect(changes: DataFrame, roles: dict, n: int, size: int, p: int, each) -> np.ndarray:
    """Sums of a vector per effect over the rows of its cohorts.

    ``roles`` maps (cohort, pair) to the effects it serves and whether as treated; ``each(at, treated, x, y, w)`` gives
    the part of a cell's rows. Tasks add up one n by size matrix each.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n, size))
        for batch in batches:
            for cell, where in batch.groupby(["__g", "__t"]).indices.items():
                part = batch.iloc[where]
                x, y, w = part[[f"x{i}" for i in range(p)]].to_numpy(), part.y.to_numpy(), part.w.to_numpy()
                for at, treated in roles.get(cell, ()):
                    sums[at] += each(at, treated, x, y, w)
        yield pd.DataFrame({"v": [sums.ravel()]})

    rows = (
        changes.where("__t >= 0").drop("c", "u").mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("pos", "v"))
        .groupBy("pos").agg(F.sum("v").alias("v")).toPandas().sort_values("pos")
    )
    return rows.v.to_numpy().reshape(n, size)


def _propensities(changes: DataFrame, roles: dict, names: list, p: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logistic fits of treated against control units, one per effect, all stepped in one pass over the changes.

    A step that lowers the likelihood of a fit is halved. Fits that do not settle are named in the error.
    """
    n = len(names)
    coef, step, best = np.zeros((n, p)), np.zeros((n, p)), np.full(n, -np.inf)
    spread, open_ = [np.zeros((p, p))] * n, np.ones(n, dtype=bool)
    for _ in range(NEWTON_STEPS):
        tried = coef + step

        def each(at, treated, x, y, w, tried=tried):
            eta = x @ tried[at]
            chance = 1.0 / (1.0 + np.exp(-eta))
            likelihood = -(w * np.logaddexp(0.0, -eta if treated else eta)).sum()
            gradient = x.T @ (w * (float(treated) - chance))
            return np.concatenate([[likelihood], gradient, ((x * (w * chance * (1 - chance))[:, None]).T @ x).ravel()])

        sums = _sums_by_effect(changes, roles, n, 1 + p + p * p, p, each)
        for at in np.flatnonzero(open_):
            if sums[at, 0] < best[at] - 1e-10 * (1.0 + abs(best[at])):
                step[at] /= 2
                continue
            coef[at], best[at] = tried[at], sums[at, 0]
            found, spread[at], _ = solve_kept(sums[at, 1 + p:].reshape(p, p), sums[at, 1:1 + p])
            step[at] = np.nan_to_num(found)
            if np.abs(step[at]).max() < 1e-9 * (1.0 + np.abs(coef[at]).max()):
                open_[at], step[at] = False, 0.0
        if not open_.any():
            return coef, spread
    raise ValueError(f"covariates separate treated and control units of the effects {[names[i] for i in np.flatnonzero(open_)]}")


def att_gt_changes(
    df: DataFrame, y: str, time: str, cohort: str, unit: str, control: str = "never", covariates: Sequence = (),
    est: str = "reg", weight: str | None = None, cluster: str | None = None, draws: int = 0, seed: int = 1,
) -> GroupTime:
    """Group-time effects of an unbalanced panel from the changes of units seen in both periods of a comparison.

    Options and result are those of ``att_gt``; ``cells`` hold all units seen and ``contrast`` is None, as effects are
    no function of cell means when units come and go. Covariates may vary over time: those of the base period count, as
    do its weights. est='reg' regresses the controls' changes on the covariates; est='dr' adds odds-weighted residuals,
    with one propensity per effect. Variances come from one influence vector per cluster (the unit, unless named) that
    carries both fits and the cohort shares, which are shares of units by mean weight.

    Rows without unit, period, outcome or a covariate take no part; a null cohort is never treated; repeated rows of a
    unit and period count once, as their mean. Comparisons without units are listed in ``options['omitted']``.
    """
    if est not in ("reg", "dr"):
        raise ValueError(est)
    base = df.dropna(subset=list(dict.fromkeys([y, *_sources(covariates)])))
    design = build_design(base, covariates)
    p = len(design.columns)
    units = unit_histories(base, y, time, cohort, unit, design.columns, weight, cluster).persist()
    cells = _cells(units)
    if not len(cells):
        raise ValueError("no rows with unit, period, outcome and covariates")
    check_units(cells)
    wanted, periods, omitted = _comparisons(cells, control)
    pairs = sorted({(t, b) for _, t, b, _ in wanted})
    number = {pair: k for k, pair in enumerate(pairs)}
    used: dict[int, set[int]] = {}
    for g, t, b, pool in wanted:
        for h in (g, *pool):
            used.setdefault(h, set()).add(number[t, b])
    changes = unit_changes(units, pairs, used, p).persist()
    plain = _moments(changes, p)
    todo = []
    for g, t, b, pool in wanted:
        k = number[t, b]
        pool = tuple(h for h in pool if (h, k) in plain)
        if (g, k) not in plain:
            omitted.append((g, t, "no unit of the cohort seen in both the period and its base"))
        elif not pool:
            omitted.append((g, t, "no control unit seen in both periods"))
        else:
            todo.append((g, t, k, pool))

    fits = []
    for g, _, k, pool in todo:
        own, other = plain[g, k], sum(plain[h, k] for h in pool)
        coef, inverse, _ = solve_kept(other[:p, :p], other[:p, p])
        fits.append((own, np.nan_to_num(coef), inverse))

    roles: dict = {}
    for at, (g, _, k, pool) in enumerate(todo):
        for h in (g, *pool):
            roles.setdefault((h, k), []).append((at, h == g))
    effects, parts = [], {}
    if est == "dr" and todo:
        odds, spread = _propensities(changes, roles, [(g, t) for g, t, _, _ in todo], p)

        def reweighted(at, treated, x, y, w):
            if treated:
                return np.zeros((p + 1) ** 2)
            z = np.column_stack([x, y])
            return ((z * (w * np.exp(x @ odds[at]))[:, None]).T @ z).ravel()

        tilted = _sums_by_effect(changes, roles, len(todo), (p + 1) ** 2, p, reweighted).reshape(-1, p + 1, p + 1)
    for at, (g, _, k, pool) in enumerate(todo):
        own, beta, inverse = fits[at]
        xbar = own[0, :p] / own[0, 0]
        treated = own[0, p] / own[0, 0] - xbar @ beta
        parts.setdefault((g, k), []).append(_Treated(at, 1.0, beta, treated, own[0, 0]))
        if est == "reg":
            effects.append(float(treated))
            found = _Regressed(at, beta, inverse @ xbar)
        else:
            m = tilted[at]
            centre = (m[0, p] - m[0, :p] @ beta) / m[0, 0]
            effects.append(float(treated - centre))
            turn = -(m[:p, p] - m[:p, :p] @ beta - centre * m[0, :p]) / m[0, 0]
            found = _Control(at, 1.0, beta, centre, m[0, 0], odds[at], inverse @ (m[0, :p] / m[0, 0] - xbar))
            for h in (g, *pool):
                parts.setdefault((h, k), []).append(_Score(at, h == g, odds[at], spread[at] @ turn))
        for h in pool:
            parts.setdefault((h, k), []).append(found)

    held = {int(r["g"]): float(r["u"]) for r in units.groupBy("g").agg(F.sum("u").alias("u")).orderBy("g").collect()}
    total = sum(held.values())
    shares = {g: v / total for g, v in held.items()}
    table = pd.DataFrame([(g, t) for g, t, _, _ in todo], columns=["g", "t"]).assign(att=np.array(effects, dtype=float))
    out = GroupTime(table, cells, None, shares, options={"control": control, "periods": periods, "omitted": omitted})
    whole = Design(design.names, [F.col(f"x{i}") for i in range(p)], [], False)
    n = len(todo)
    out.joint_vcov, out.joint_draws, out.clusters = _robust_covariance(
        changes, "y", whole, parts, n, "w", "c", draws, seed, shares, total, share="u"
    )
    out.vcov = out.joint_vcov[:n, :n]
    out.draws = None if out.joint_draws is None else out.joint_draws[:, :n]
    changes.unpersist()
    units.unpersist()
    return out
