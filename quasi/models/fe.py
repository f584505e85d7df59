"""Least squares with absorbed fixed effects, exact on unbalanced data.

Rows are aggregated once, by map-side combined sums, into cells of equal fixed effects (and cluster). Each
cell keeps the first and second moments of outcome and regressors, which is all that coefficients,
residual variance and cluster scores need; nothing afterwards reads the rows.

The first fixed effect (usually the unit) is swept out through its group sums. What is left is a linear system in
the levels of the others, of any number, solved by conjugate gradients: the vectors stay in Spark, one row per
level, and each step is one pass over the cells. The preconditioner inverts the block of the HELD heaviest levels
and divides by the weight elsewhere. With few levels the block is the whole system, and its solution is the start:
steps are taken only if it leaves more than the tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.models.design import MAX_LEVELS, Design, build_design, factor, find_levels
from quasi.models.linear import Fit, _sources, array_sum, complete_rows, gram, solve_kept
from quasi.session import cut_lineage

HELD = MAX_LEVELS
SPREAD = 64
TOLERANCE = 1e-20


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def moment_cells(rows: DataFrame, keys: Sequence[str], values: Sequence[Column], weight: str | None) -> DataFrame:
    """Cells of equal keys with __w, __n, first moments m{i} and second moments q{i}_{j}."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    k = len(values)
    named = rows.select(*dict.fromkeys(keys), w.alias("__w"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    return named.groupBy(*dict.fromkeys(keys)).agg(
        F.sum("__w").alias("__w"),
        F.count(F.lit(1)).alias("__n"),
        *[F.expr(f"sum(__w * v{i})").alias(f"m{i}") for i in range(k)],
        *[F.expr(f"sum(__w * v{i} * v{j})").alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)],
    )


def second(i: int, j: int) -> str:
    return f"q{min(i, j)}_{max(i, j)}"


def combined(names: Sequence[str], beta: np.ndarray) -> str:
    """SQL text of the last name less the beta-weighted others."""
    return names[-1] + "".join(f" - ({float(b)!r}D) * {n}" for b, n in zip(beta, names))


def level_slots(levels: dict[str, list]) -> dict[str, Column]:
    """Position of each effect's level in one joint numbering of all levels."""
    out, offset = {}, 0
    for c, values in levels.items():
        found = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c).cast("string"))
        out[c] = (found + F.lit(offset - 1)).cast("int")
        offset += len(values)
    return out


def level_table(spark, values: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Slot and its coefficients; at most MAX_LEVELS rows, so it may be broadcast."""
    rows = [(i, *[float(v) for v in row]) for i, row in enumerate(values)]
    return F.broadcast(spark.createDataFrame(rows, "__slot int, " + ", ".join(f"{n} double" for n in names)))


def add_level_effects(cells: DataFrame, slots: Sequence[str], values: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Add, per cell, the coefficients of its levels summed over the effects."""
    out = cells
    for i, slot in enumerate(slots):
        part = [f"__{n}_{i}" for n in names]
        side = level_table(cells.sparkSession, values, part)
        out = out.join(side, out[slot] == side["__slot"], "left").drop("__slot")
    sums = [F.expr(" + ".join(f"coalesce(__{n}_{i}, 0D)" for i in range(len(slots)))).alias(n) for n in names]
    return out.select(*cells.columns, *sums)


def level_products(cells: DataFrame, slots: Sequence[str], p: int, moments: Sequence[str]) -> np.ndarray:
    """Cross-products of level dummies with each other and with moment columns (moment block empty); null slots are skipped."""
    q = len(moments)
    out = np.zeros((p + q, p + q))
    for i, a in enumerate(slots):
        for r in cells.where(F.col(a).isNotNull()).groupBy(a).agg(F.sum("__w").alias("w"), *[F.sum(m).alias(m) for m in moments]).collect():
            out[r[a], r[a]] = r["w"]
            for j, m in enumerate(moments):
                out[r[a], p + j] = out[p + j, r[a]] = r[m]
        for b in slots[i + 1:]:
            for r in cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.sum("__w").alias("w")).collect():
                out[r[a], r[b]] = out[r[b], r[a]] = r["w"]
    return out


def unit_profiles(cells: DataFrame, unit: str, slots: Sequence[str], moments: Sequence[str]) -> DataFrame:
    """Per unit: weight u_w, moment sums u_<m>, and its short list of (slots, weight) pairs.

    Cells are first merged to unit and level, so a list is never longer than the level combinations.
    """
    merged = cells.groupBy(unit, *slots).agg(F.sum("__w").alias("__w"), *[F.sum(m).alias(m) for m in moments])
    ids = F.array_compact(F.array(*[F.col(x) for x in slots])) if slots else F.array().cast("array<int>")
    return merged.groupBy(unit).agg(
        F.sum("__w").alias("u_w"), *[F.sum(m).alias(f"u_{m}") for m in moments],
        F.collect_list(F.struct(ids.alias("ids"), F.col("__w").alias("w"))).alias("levels"),
    )


def between_products(units: DataFrame, p: int, values: Sequence[str]) -> np.ndarray:
    """Sum over units of z z' / u_w, where z holds the unit's weight by level and its value sums."""
    q = len(values)
    named = units.select(
        "u_w", F.flatten(F.col("levels.ids")).alias("ids"),
        F.flatten(F.transform("levels", lambda x: F.array_repeat(x["w"], F.size(x["ids"])))).alias("ws"),
        F.array(*[F.col(v).cast("double") for v in values]).cast("array<double>").alias("v"),
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + q, p + q))
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start:start + 512]
                ids, ws = (np.concatenate(x.to_numpy()) if len(x) else np.empty(0) for x in (part.ids, part.ws))
                at = np.repeat(np.arange(len(part)) * (p + q), part.ids.str.len().to_numpy()) + ids.astype(np.int64)
                z = np.bincount(at, ws.astype(float), len(part) * (p + q)).reshape(len(part), p + q)
                z[:, p:] = np.vstack(part.v.to_numpy())
                total += (z / part.u_w.to_numpy(dtype=float)[:, None]).T @ z
        yield pd.DataFrame({"v": [total.ravel()]})

    return array_sum(named.mapInPandas(partial, "v array<double>"), (p + q) ** 2).reshape(p + q, p + q)


@dataclass
class FixedEffectsFit(Fit):
    """Slope coefficients; ``stats`` holds sigma2, rss, within R squared, and level counts."""

    extra: dict = field(default_factory=dict)


def fe_ols(
    df: DataFrame, y: str, x: Sequence, fe: Sequence[str], weight: str | None = None, cluster: str | None = None
) -> FixedEffectsFit:
    """Regression of y on x with fixed effects ``fe``; cluster-robust covariance if a cluster is named."""
    used = [y, *_sources(x), *fe, *([weight] if weight else []), *([cluster] if cluster else [])]
    rows = complete_rows(df, used)
    design = build_design(rows, x, intercept=False)
    keys = [*fe, *([cluster] if cluster else [])]
    cells, release = _placed(moment_cells(rows, keys, [*design.columns, F.col(y)], weight), fe)
    fitted = _absorbed(cells, design, fe, len(design.columns), cluster)
    release()
    return fitted


def _placed(cells: DataFrame, fe: Sequence[str]) -> tuple[DataFrame, Callable[[], None]]:
    """Kept cells and what lets go of them.

    If no unit holds a large share, the cells are dealt by unit: all later sums and means by unit find theirs in one place.
    """
    kept = cells.persist()
    if len(fe) > 1:
        units, most, total = kept.groupBy(fe[0]).agg(F.count(F.lit(1)).alias("n")).agg(F.count("n"), F.max("n"), F.sum("n")).first()
        if units and most * SPREAD <= total:
            dealt = kept.repartition(fe[0]).persist()
            dealt.count()
            kept.unpersist()
            return dealt, dealt.unpersist
    return kept, kept.unpersist


def fe_ols_split(
    df: DataFrame, split: str, values: Sequence, y: str, x: Sequence, fe: Sequence[str], weight: str | None = None, cluster: str | None = None
) -> dict:
    """The same model on the whole sample and on each value of a split column.

    The rows are read once, into cells that also tell the values apart; a sample whose factors lack a level has
    regressors of its own and is read again.
    """
    used = [y, *_sources(x), *fe, *([weight] if weight else []), *([cluster] if cluster else [])]
    rows = df.select(*dict.fromkeys([*used, split])).dropna(subset=list(dict.fromkeys(used)))
    design = build_design(rows, x, intercept=False)
    k, keys = len(design.columns), [*fe, *([cluster] if cluster else [])]
    cells, release = _placed(moment_cells(rows, [*keys, split], [*design.columns, F.col(y)], weight), fe)
    out = {"all": _absorbed(cells, design, fe, k, cluster)}
    for v in values:
        part = rows.where(F.col(split) == F.lit(v))
        own = build_design(part, x, intercept=False)
        if own.names == design.names:
            out[v] = _absorbed(cells.where(F.col(split) == F.lit(v)), own, fe, k, cluster)
        else:
            out[v] = fe_ols(part, y, x, fe, weight, cluster)
    release()
    return out


def _finish(design, k, xx, xy, yy, n, absorbed, extra) -> FixedEffectsFit:
    """Solve the within-transformed system; x columns explained by the effects become NaN."""
    coef, inverse, kept = solve_kept(xx, xy)
    rss = float(max(yy - np.nansum(np.where(np.isnan(coef), 0.0, coef) * xy), 0.0))
    dof = float(n - absorbed - len(kept))
    sigma2 = rss / dof if dof > 0 else float("nan")
    stats = {"sigma2": sigma2, "rss": rss, "r_squared_within": 1 - rss / yy if yy > 0 else float("nan"), "absorbed": absorbed}
    return FixedEffectsFit(design, design.names, coef, inverse * sigma2, float(n), dof, stats, "gaussian", extra={"inverse": inverse, **extra})


def _clustered(fit: FixedEffectsFit, scores: DataFrame, k: int, nested: int) -> FixedEffectsFit:
    """Sandwich covariance from per-cluster score sums; ``nested`` absorbed effects are not counted."""
    meat = gram(scores, [*[F.col(f"s{i}") for i in range(k)], F.lit(1.0)])
    clusters = meat[-1, -1]
    inverse = fit.extra["inverse"]
    live = int(np.sum(~np.isnan(fit.coef)))
    used = live + fit.stats["absorbed"] - nested
    adjust = clusters / (clusters - 1) * (fit.n - 1) / max(fit.n - used, 1.0)
    fit.vcov = inverse @ meat[:k, :k] @ inverse * adjust
    fit.df_resid = float(clusters - 1)
    fit.stats["clusters"] = clusters
    return fit


def nested_levels(cells: DataFrame, fe: Sequence[str], cluster: str) -> int:
    """Levels of the effects whose every level lies inside one cluster."""
    found = 0
    for effect in fe:
        levels = cells.groupBy(effect).agg((F.min(cluster) == F.max(cluster)).alias("nested"))
        count, nested = levels.agg(F.count(F.lit(1)), F.min("nested")).first()
        if effect == cluster or nested:
            found += count
    return found


def connected_blocks(cells: DataFrame, a: str, b: str) -> int:
    """Blocks of levels of two effects that no cell connects; the smallest label spreads until none changes."""
    state = cut_lineage(cells.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(a).cast("string").alias("label")).distinct())
    changed = 1
    while changed:
        old = state.withColumn("old", F.col("label"))
        for side in ("a", "b"):
            least = old.groupBy(F.col(side).alias("__side")).agg(F.min("label").alias("__least"))
            old = old.join(least, F.col(side) == F.col("__side")).withColumn("label", F.col("__least")).drop("__side", "__least")
        old = cut_lineage(old)
        changed = old.where("label <> old").count()
        state = old.drop("old")
    return state.select("label").distinct().count()


def _at(i: int) -> str:
    return f"__level_{i}"


def level_sums(rows: DataFrame, effects: int, sums: Sequence[Column]) -> DataFrame:
    """Sums by (__e, __l), effect and level, over all effects but the first."""
    pairs = F.array(*[F.struct(F.lit(i).alias("__e"), F.col(_at(i)).alias("__l")) for i in range(effects)])
    return rows.withColumn("__pair", F.explode(pairs)).groupBy("__pair.__e", "__pair.__l").agg(*sums)


def off_units(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns less their weighted means by the first effect."""
    w = F.col("__w")
    means = rows.groupBy(F.col("__u").alias("__v")).agg(*[(F.sum(w * F.col(n)) / F.sum(w)).alias(f"__mean_{n}") for n in names])
    side = rows.join(means, F.col("__u") == F.col("__v"))
    return side.select(*[c for c in rows.columns if c not in names], *[(F.col(n) - F.col(f"__mean_{n}")).alias(n) for n in names])


def add_levels(rows: DataFrame, effects: int, state: DataFrame, names: Sequence[str], cold: bool) -> DataFrame:
    """Add per row the values ``names`` of its levels, summed over the effects.

    The levels with a slot (HELD at most, the heaviest) are broadcast; only the others, if any, go by shuffle, where the
    rows of heavy levels pass under a salt.
    """
    out = rows
    for i in range(effects):
        mine = state.where(F.col("__e") == i).select(F.col("__l").alias("__key"), "__slot", F.struct(*names).alias("__v"))
        hot = mine.where("__slot IS NOT NULL").select(F.col("__key").alias("__hot_key"), F.col("__v").alias(f"__hot_{i}"))
        out = out.join(F.broadcast(hot), F.col(_at(i)) == F.col("__hot_key"), "left").drop("__hot_key")
        found = F.col(f"__hot_{i}")
        if cold:
            rest = mine.where("__slot IS NULL").select("__key", F.lit(0).alias("__zero"), F.col("__v").alias(f"__cold_{i}"))
            out = out.withColumn("__salt", F.when(found.isNull(), 0).otherwise(1 + F.spark_partition_id()))
            out = out.join(rest, (F.col(_at(i)) == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left").drop("__key", "__zero", "__salt")
            found = F.coalesce(found, F.col(f"__cold_{i}"))
        out = out.withColumn(f"__found_{i}", found)
    sums = {n: _total([F.col(f"__found_{i}")[n] for i in range(effects)]) for n in names}
    return out.select(*rows.columns, *[c.alias(n) for n, c in sums.items()])


@dataclass
class LevelSystem:
    """Levels of all effects but the first: ``state`` has one row per level with the right sides b{i}, the solutions x{i}
    and what the solutions leave, r{i}; ``rank`` is known where every level is held."""

    state: DataFrame
    total: int
    rank: int | None
    cold: bool


def solve_levels(edges: DataFrame, effects: int, q: int, floor: Sequence[float], max_steps: int = 1000) -> LevelSystem:
    """Conjugate gradients for ``q`` right sides at once; a side stops at its ``floor``.

    ``edges`` holds __u, the levels, __w and the cell means z{i}. Raises when a side has not converged.
    """
    spark, w, sides = edges.sparkSession, F.col("__w"), range(q)
    xs, zs, rs, ps = ([f"{c}{i}" for i in sides] for c in "xzrp")
    right = level_sums(
        off_units(edges, zs), effects, [F.sum("__w").alias("__weight"), *[F.sum(w * F.col(z)).alias(f"b{i}") for i, z in enumerate(zs)]]
    )
    state = cut_lineage(right)
    held = state.orderBy(F.desc("__weight"), "__e", "__l").limit(HELD).select("__e", "__l").collect()
    total = state.count() if len(held) == HELD else len(held)
    slots = F.broadcast(spark.createDataFrame([(r["__e"], r["__l"], i) for i, r in enumerate(held)], "__e int, __l string, __slot int"))
    state = state.join(slots, ["__e", "__l"], "left").withColumns({f"{c}{i}": F.col(f"b{i}") if c == "r" else F.lit(0.0) for i in sides for c in "xrp"})

    # The block of the held levels.
    cold, p, names = total > len(held), len(held), [f"__slot_{i}" for i in range(effects)]
    placed = edges
    for i, name in enumerate(names):
        mine = slots.where(F.col("__e") == i).select(F.col("__l").alias("__key"), F.col("__slot").alias(name))
        placed = placed.join(F.broadcast(mine), F.col(_at(i)) == F.col("__key"), "left").drop("__key")
    block, inverse, kept = np.zeros((0, 0)), np.zeros((0, 0)), []
    if p:
        block = level_products(placed, names, p, []) - between_products(unit_profiles(placed, "__u", names, []), p, [])
        _, inverse, kept = solve_kept(block, np.zeros(p))

    def held_rest(state: DataFrame) -> np.ndarray:
        rest = np.zeros((p, q))
        for row in state.where("__slot IS NOT NULL").select("__slot", *rs).collect():
            rest[row[0]] = row[1:]
        return rest

    def with_held(state: DataFrame, found: np.ndarray, names: Sequence[str]) -> DataFrame:
        """Add columns ``names`` of the held levels, null elsewhere."""
        rows = [(i, *map(float, v)) for i, v in enumerate(found)]
        near = spark.createDataFrame(rows, "__s int, " + ", ".join(f"{n} double" for n in names))
        return state.join(F.broadcast(near), F.col("__slot") == F.col("__s"), "left").drop("__s")

    def preconditioned(state: DataFrame) -> DataFrame:
        """Add z{i}."""
        out = with_held(state, inverse @ held_rest(state), [f"__n{i}" for i in sides])
        return out.select(*state.columns, *[F.coalesce(F.col(f"__n{i}"), F.col(f"r{i}") / F.col("__weight")).alias(z) for i, z in enumerate(zs)])

    if p and not cold:
        right = held_rest(state)
        start = inverse @ right
        state = cut_lineage(with_held(state.drop(*xs, *rs), np.hstack([start, right - block @ start]), [*xs, *rs]))

    def products(state: DataFrame, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        return np.array(state.agg(*[F.sum(F.col(x) * F.col(y)) for x, y in zip(a, b)]).first(), dtype=float)

    size, turn = np.zeros(q), np.zeros(q)
    for step in range(max_steps):
        left = np.array(state.agg(*[F.sum(F.col(r) * F.col(r) / F.col("__weight")) for r in rs]).first(), dtype=float)
        live = left > np.asarray(floor)
        if not live.any():
            return LevelSystem(state.drop(*ps), total, None if cold else len(kept), cold)
        state = preconditioned(state)
        last, size = size, products(state, rs, zs)
        if step:
            turn = np.where(live, size / np.where(last > 0, last, 1.0), 0.0)
        state = state.withColumns({n: F.col(z) + F.lit(float(t)) * F.col(n) for n, z, t in zip(ps, zs, turn)}).drop(*zs)
        across = add_levels(edges.drop(*zs), effects, state, ps, cold)
        image = level_sums(off_units(across, ps), effects, [F.sum(w * F.col(n)).alias(f"a{i}") for i, n in enumerate(ps)])
        state = cut_lineage(state.join(image, ["__e", "__l"], "left"))
        images = [f"a{i}" for i in sides]
        along = products(state, ps, images)
        length = np.where(live & (along > 0), size / np.where(along > 0, along, 1.0), 0.0)
        moves = {f"x{i}": F.col(f"x{i}") + F.lit(float(length[i])) * F.col(f"p{i}") for i in sides}
        moves |= {f"r{i}": F.col(f"r{i}") - F.lit(float(length[i])) * F.col(f"a{i}") for i in sides}
        state = state.withColumns(moves).drop(*images)
    raise RuntimeError(f"the levels of the effects have not converged in {max_steps} steps")


def _absorbed(cells, design, fe, k, cluster):
    """Slopes net of all effects from cell moments and the levels' solutions for regressors and outcome.

    The effects' rank is exact where all levels are held, and for one or two effects; otherwise each further effect
    counts its levels less one.
    """
    w, others, q = F.col("__w"), len(fe) - 1, k + 1
    zs = [f"z{i}" for i in range(q)]
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    units = cells.groupBy(fe[0]).agg(
        F.sum("__w").alias("w"), F.sum("__n").alias("n"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(q)],
        *[F.sum(second(i, j)).alias(second(i, j)) for i, j in pairs],
    )
    facts = units.agg(
        *[F.expr(f"sum({second(i, j)} - m{i} * m{j} / w)").alias(second(i, j)) for i, j in pairs],
        *[F.sum(second(i, i)).alias(f"raw{i}") for i in range(q)], F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"),
    ).first()
    edges = cells.select(
        F.col(fe[0]).alias("__u"), *[F.col(c).cast("string").alias(_at(i)) for i, c in enumerate(fe[1:])], "__w",
        *[(F.col(f"m{i}") / w).alias(z) for i, z in enumerate(zs)],
    )
    scale = np.array([facts[f"raw{i}"] or 0.0 for i in range(q)])
    net = np.zeros((q, q))
    for i, j in pairs:
        net[i, j] = net[j, i] = facts[second(i, j)] or 0.0
    absorbed = facts["units"]
    if others:
        levels = solve_levels(edges, others, q, TOLERANCE * scale)
        explained = levels.state.agg(*[F.expr(f"sum(b{i} * x{j} + x{i} * r{j})") for i, j in pairs]).first()
        for (i, j), part in zip(pairs, explained):
            net[i, j] = net[j, i] = net[i, j] - part
        rank = levels.rank
        if rank is None:
            rank = levels.total - max(others - 1, 0) - connected_blocks(cells, fe[0], fe[1])
        absorbed += rank
    tiny = np.diag(net)[:k] < 1e-10 * np.maximum(scale[:k], 1e-300)
    net[:k][tiny] = 0.0
    net[:, :k][:, tiny] = 0.0
    fit = _finish(design, k, net[:k, :k], net[:k, k], net[k, k], facts["n"], absorbed, {})
    if not cluster:
        return fit

    beta, moments, cs = np.nan_to_num(fit.coef), [f"m{i}" for i in range(q)], [f"x{i}" for i in range(q)]
    rows = cells.select(
        F.col(cluster).alias("__cluster"), F.col(fe[0]).alias("__u"), *[F.col(c).cast("string").alias(_at(i)) for i, c in enumerate(fe[1:])],
        "__w", *moments, *[second(i, j) for i, j in pairs],
    )
    rows = add_levels(rows, others, levels.state, cs, levels.cold) if others else rows.select("*", *[F.lit(0.0).alias(c) for c in cs])
    sides = rows.groupBy(F.col("__u").alias("__v")).agg(
        *[(F.sum(F.col(f"m{i}") - w * F.col(f"x{i}")) / F.sum(w)).alias(f"a{i}") for i in range(q)]
    )
    # x-tilde times residual of a cell, from its moments and the fitted effects f.
    joined = rows.join(sides, F.col("__u") == F.col("__v")).withColumns({f"f{i}": F.col(f"a{i}") + F.col(f"x{i}") for i in range(q)})
    joined = joined.withColumns({"fr": F.expr(combined([f"f{i}" for i in range(q)], beta)), "mr": F.expr(combined(moments, beta))})
    scores = joined.groupBy("__cluster").agg(
        *[
            F.expr(f"sum({combined([second(i, j) for j in range(q)], beta)} - fr * m{i} - f{i} * mr + f{i} * fr * __w)").alias(f"s{i}")
            for i in range(k)
        ]
    )
    return _clustered(fit, scores, k, min(nested_levels(cells, fe, cluster), absorbed))


def twoway_within(df: DataFrame, y: str, x: Sequence, unit: str, time: str, weight: str | None = None) -> FixedEffectsFit:
    """Two-way within estimator with model standard errors."""
    return fe_ols(df, y, x, [unit, time], weight)


def event_terms(df: DataFrame, rel: str, refs: Sequence[int] = (-1,), keep: Sequence[int] | None = None) -> list[factor]:
    """Relative-time dummies; never-treated rows (null) and the reference periods are the base."""
    found = [int(v) for v in find_levels(df, [rel])[rel] if int(v) not in refs]
    if keep is not None:
        found = [v for v in found if v in keep]
    return [factor("__rel", levels=("base", *found), ref="base")]


def with_relative_key(df: DataFrame, rel: str, refs: Sequence[int] = (-1,), keep: Sequence[int] | None = None) -> DataFrame:
    text = F.col(rel).cast("int").cast("string")
    base = F.col(rel).isNull() | F.col(rel).isin(list(refs))
    if keep is not None:
        base = base | ~F.col(rel).isin(list(keep))
    return df.withColumn("__rel", F.when(base, "base").otherwise(text))


def event_study_fe(
    df: DataFrame, y: str, rel: str, unit: str, time: str, refs: Sequence[int] = (-1,), weight: str | None = None,
    cluster: str | None = None,
) -> FixedEffectsFit:
    """Unit and time effects plus relative-time dummies."""
    keyed = with_relative_key(df, rel, refs)
    fit = fe_ols(keyed, y, event_terms(df, rel, refs), [unit, time], weight, cluster or unit)
    fit.names = [n.removeprefix("__") for n in fit.names]
    return fit
