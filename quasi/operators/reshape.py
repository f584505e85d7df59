"""Pivoting, scenario joins and row stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_scenarios(
    df: DataFrame, keys: Sequence[str], scenario: str, levels: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """One column set per scenario. The levels are given, so no extra pass looks for them."""
    aggregates = [F.first(v, ignorenulls=True).alias(v) for v in values]
    wide = df.groupBy(*keys).pivot(scenario, list(levels)).agg(*aggregates)
    if len(values) == 1:
        for level in levels:
            wide = wide.withColumnRenamed(level, f"{level}_{values[0]}")
    return wide


def pivot_longer(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    names_to: str = "name",
    values_to: str = "value",
    names_pattern: str | None = None,
    drop_null: bool = False,
) -> DataFrame:
    """Columns to rows; the pattern's first group replaces the name."""
    out = df.unpivot(list(ids), list(columns), names_to, values_to)
    if names_pattern is not None:
        out = out.withColumn(names_to, F.regexp_extract(names_to, names_pattern, 1))
    return out.where(F.col(values_to).isNotNull()) if drop_null else out


def pivot_longer_fields(
    df: DataFrame, ids: Sequence[str], metrics: Sequence[str], fields: Mapping[str, str],
    sep: str = "_", names_to: str = "metric",
) -> DataFrame:
    """Columns named <metric><sep><field> to one row per metric with one column per field."""
    entries = [
        F.struct(
            F.lit(m).alias(names_to), *[F.col(f"`{m}{sep}{f}`").alias(to) for f, to in fields.items()]
        )
        for m in metrics
    ]
    return df.select(*ids, F.explode(F.array(*entries)).alias("__e")).select(*ids, "__e.*")


def select_by_name(
    df: DataFrame, prefix: str | None = None, contains: str | None = None, regex: str | None = None,
    exclude: Sequence[str] = (),
) -> list[str]:
    """Column names by prefix, substring or regular expression, less the excluded ones."""
    import re

    return [
        c
        for c in df.columns
        if c not in exclude
        and (prefix is None or c.startswith(prefix))
        and (contains is None or contains in c)
        and (regex is None or re.search(regex, c))
    ]


def stack_rows(*parts: DataFrame) -> DataFrame:
    """Rows of different results under each other; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def per_outcome(
    df: DataFrame, ids: Sequence[str], outcomes: Sequence[str], by: Sequence[str], aggregates: Sequence[Column],
    names_to: str = "outcome", values_to: str = "score",
) -> DataFrame:
    """The same aggregates for every outcome and group: long form, then one grouped pass."""
    long = pivot_longer(df, ids, outcomes, names_to, values_to, drop_null=True)
    return long.groupBy(names_to, *by).agg(*aggregates)


def scenario_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Two runs of the same people side by side."""
    return left.join(right, on=list(keys), how=how)


def lookup_observed(
    df: DataFrame, long_probs: DataFrame, keys: Sequence[str], level: str, level_name: str, prob: str, to: str
) -> DataFrame:
    """Probability of the level actually observed, from a long (keys, level, probability) table."""
    side = long_probs.select(*keys, F.col(level_name).alias(level), F.col(prob).alias(to))
    return df.join(side, on=[*keys, level], how="left")


def cohort_pairs(df: DataFrame, cohort: str, pairs: Sequence[tuple[object, object]]) -> DataFrame:
    """Rows of every listed (a, b) cohort pair, one copy per pair a row belongs to.

    The pair list is written by the caller (cohorts squared), so it travels as a literal table.
    """
    spark = df.sparkSession
    rows = [(a, b, m) for a, b in pairs for m in {a, b}]
    kind = df.schema[cohort].dataType.simpleString()
    table = spark.createDataFrame(rows, f"a {kind}, b {kind}, __member {kind}")
    return df.join(F.broadcast(table), df[cohort] == table["__member"], "inner").drop("__member")


def grid_rows(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once per value of a literal grid, as an exploded array (no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
