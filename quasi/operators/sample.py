"""Repeatable splits and resamples.

Random order comes from md5(key|seed), so results do not depend on partitioning, and a lost task gives
the same rows when it runs again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.functions.columns import unit_hash
from quasi.operators.skew import below_cut, hash_rank, hash_top

CUT_DIGITS = 4


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], prop: float = 0.8, seed: object = 0) -> DataFrame:
    """Add ``split``: the first floor(prop * n) rows of each stratum in hash order are 'train'.

    Each row compares its own hash with its stratum's cut, so the rows are not shuffled.
    """
    marked = below_cut(df, key, prop, strata, seed, "__below")
    return marked.withColumn("split", F.when(F.col("__below"), "train").otherwise("test")).drop("__below")


def resample_flags(df: DataFrame, key: str, times: int = 25, prop: float = 0.75, seed: object = 0, to: str = "members") -> DataFrame:
    """Monte-Carlo resamples in compact form: ``to`` holds one flag per repeat, and each row stays one row.

    Every repeat has its own hash order, cut exactly at floor(prop * n). Hashes are counted by their first digits,
    map-side; the few that share their digits with a cut are ranked; then a row compares its hashes with ``times``
    cuts. Rows are never shuffled and only ``times`` hashes reach the driver.
    """
    ids = F.sequence(F.lit(1), F.lit(times))
    hashes = F.transform(ids, lambda i: unit_hash(F.concat_ws(":", i.cast("string"), F.col(key).cast("string")), seed))
    each = df.select(F.posexplode(hashes).alias("i", "h")).withColumn("b", F.substring("h", 1, CUT_DIGITS))
    counts = each.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("i").orderBy("b")
    upto = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    goal = F.floor(F.lit(float(prop)) * F.sum("n").over(Window.partitionBy("i")))
    place = counts.select("i", "b", (goal - (upto - F.col("n"))).alias("left"), "n").where("left > 0 AND left <= n").drop("n")
    # One bucket of hashes per repeat.
    inside = each.join(F.broadcast(place), ["i", "b"])
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("h")))
    cuts = {r["i"]: r["h"] for r in ranked.where("r = left").select("i", "h").collect()}
    # Without a cut no hash is at most the empty string.
    limits = F.array(*[F.lit(cuts.get(i, "")) for i in range(times)])
    return df.withColumn(to, F.zip_with(hashes, limits, lambda h, cut: h <= cut))


def mc_cv(df: DataFrame, key: str, times: int = 25, prop: float = 0.75, seed: object = 0) -> DataFrame:
    """Monte-Carlo resamples in long form: (resample_id, row, in_analysis); times * n rows by definition."""
    flags = resample_flags(df, key, times, prop, seed, "__members")
    long = flags.select(*df.columns, F.posexplode("__members").alias("__i", "__in"))
    return long.select(*df.columns, (F.col("__i") + 1).alias("resample_id"), F.col("__in").cast("int").alias("in_analysis"))


def vfold_cv(df: DataFrame, key: str, v: int = 10, seed: object = 0) -> DataFrame:
    """Add ``fold`` 0..v-1; fold sizes differ by at most one row."""
    ranked = hash_rank(df, key, [], seed, "__rank", "__n")
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(v)).cast("int")).drop("__rank", "__n")


def hash_fold(df: DataFrame, key: str, v: int = 10, seed: object = 0) -> DataFrame:
    """Add ``fold`` from the hash alone: no shuffle, folds of nearly equal size."""
    value = F.conv(F.substring(unit_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", F.pmod(value, F.lit(v)).cast("int"))


def sample_per_group(df: DataFrame, key: str, by: Sequence[str], n: int = 1, seed: object = 0) -> DataFrame:
    return hash_top(df, key, n, by, seed)


def sample_rows(df: DataFrame, key: str, n: int, seed: object = 0) -> DataFrame:
    return hash_top(df, key, n, (), seed)
