"""Model terms as column expressions.

A term is a column name (numeric), ``factor``, ``interaction`` or ``poly``. ``build_design`` turns terms
into named expressions, with treatment coding against the first level. Levels are found by one distinct
scan over all factor columns together and their number is checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MAX_LEVELS = 3000


@dataclass(frozen=True)
class factor:
    column: str
    levels: tuple = ()
    ref: object = None


@dataclass(frozen=True)
class interaction:
    """Product of every combination of the members' columns (main effects are separate terms)."""

    members: tuple

    def __init__(self, *members):
        object.__setattr__(self, "members", tuple(members))


@dataclass(frozen=True)
class poly:
    column: str
    degree: int


def crossed(*members) -> list:
    """The ``a * b * ...`` expansion: every main effect and every interaction of the members."""
    from itertools import combinations

    out = list(members)
    for size in range(2, len(members) + 1):
        out += [interaction(*c) for c in combinations(members, size)]
    return out


@dataclass
class Design:
    names: list[str]
    columns: list[Column]
    sources: list[str]
    discrete: bool
    levels: dict = field(default_factory=dict)


def _members(terms):
    for t in terms:
        if isinstance(t, interaction):
            yield from _members(t.members)
        else:
            yield t


def find_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values of several columns in one pass."""
    if not columns:
        return {}
    pairs = [
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns
    ]
    found = (
        df.select(F.explode(F.array(*pairs)).alias("e"))
        .select("e.*").where("v IS NOT NULL").distinct()
        .limit(MAX_LEVELS * len(columns) + 1).collect()
    )
    out = {c: [] for c in columns}
    for row in found:
        out[row["c"]].append(row["v"])
    for c, values in out.items():
        if len(values) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels; absorb it as a fixed effect")
        numeric = isinstance(df.schema[c].dataType, NumericType)
        values.sort(key=(lambda v: float(v)) if numeric else None)
    return out


def orthogonal_poly(df: DataFrame, column: str, degree: int) -> list[Column]:
    """Orthonormal polynomial columns of a numeric column.

    One aggregate gives the power sums of the standardised column; a QR of their Hankel moment matrix
    gives coefficients, and the basis is again a set of plain expressions.
    """
    x = F.col(column).cast("double")
    centre, spread, n = df.agg(F.avg(x), F.stddev_pop(x), F.count(x)).first()
    z = (x - centre) / (spread or 1.0)
    sums = df.agg(*[F.sum(F.pow(z, F.lit(float(k)))) for k in range(1, 2 * degree + 1)]).first()
    power = np.array([float(n), *[float(s) for s in sums]])
    hankel = np.array([[power[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    basis = np.linalg.inv(np.linalg.cholesky(hankel))
    out = []
    for k in range(1, degree + 1):
        expr = F.lit(float(basis[k, 0]))
        zk = F.lit(1.0)
        for j in range(1, k + 1):
            zk = zk * z
            expr = expr + F.lit(float(basis[k, j])) * zk
        out.append(expr)
    return out


def _expand(term, df, levels) -> list[tuple[str, Column]]:
    if isinstance(term, factor):
        values = [str(v) for v in term.levels] or levels[term.column]
        ref = str(term.ref) if term.ref is not None else (values[0] if values else None)
        text = F.col(term.column).cast("string")
        return [
            (f"{term.column}_{v}", F.when(text == F.lit(v), 1.0).when(text.isNotNull(), 0.0))
            for v in values
            if v != ref
        ]
    if isinstance(term, poly):
        return [
            (f"{term.column}_poly{k + 1}", c)
            for k, c in enumerate(orthogonal_poly(df, term.column, term.degree))
        ]
    if isinstance(term, interaction):
        out = [("", F.lit(1.0))]
        for member in term.members:
            out = [
                (f"{a}:{b}" if a else b, x * y)
                for a, x in out
                for b, y in _expand(member, df, levels)
            ]
        return out
    return [(term, F.col(term).cast("double"))]


def build_design(df: DataFrame, terms: Sequence, intercept: bool = True) -> Design:
    members = list(_members(terms))
    wanted = list(dict.fromkeys(m.column for m in members if isinstance(m, factor) and not m.levels))
    levels = find_levels(df, wanted)
    pairs = [("(Intercept)", F.lit(1.0))] if intercept else []
    for t in terms:
        pairs += _expand(t, df, levels)
    sources = list(dict.fromkeys(m if isinstance(m, str) else m.column for m in members))
    discrete = all(isinstance(m, factor) for m in members)
    return Design([n for n, _ in pairs], [c for _, c in pairs], sources, discrete, levels)


def dummy_encode(
    df: DataFrame, columns: Sequence[str], drop_first: bool = True, order: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One 0/1 column per level (first level dropped), original columns removed.

    Levels are sorted unless ``order`` lists a column's levels; listed levels that do not occur are kept
    out.
    """
    levels = find_levels(df, columns)
    for c, wanted in (order or {}).items():
        if c in levels:
            levels[c] = [v for v in wanted if v in levels[c]] + [v for v in levels[c] if v not in wanted]
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        for v in levels[c][1 if drop_first else 0:]:
            text = F.col(c).cast("string")
            out.append(F.when(text == F.lit(v), 1).when(text.isNotNull(), 0).alias(f"{c}_{v}"))
    return df.select(*out)


def interact(df: DataFrame, *groups: Sequence[str]) -> DataFrame:
    """Add the products of all combinations with one column from each group."""
    out: list[tuple[str, Column]] = [("", F.lit(1))]
    for group in groups:
        out = [(f"{a}_x_{b}" if a else b, x * F.col(b)) for a, x in out for b in group]
    return df.select("*", *[c.alias(n) for n, c in out])
