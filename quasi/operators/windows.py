"""Window operators on aggregated series.

A series has one row per period, so a window over it holds at most the number of observed periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PERIODS = 100_000


def lag_difference(series: DataFrame, by: Sequence[str], time: str, value: str, lag: int = 1, to: str = "diff") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time)
    return series.withColumn(to, F.col(value) - F.lag(value, lag).over(w))


def seasonal_difference(series: DataFrame, by: Sequence[str], time: str, value: str, season: int = 12, to: str = "sdiff") -> DataFrame:
    """First difference of the seasonal difference."""
    w = Window.partitionBy(*by).orderBy(time)
    seasonal = series.withColumn("__s", F.col(value) - F.lag(value, season).over(w))
    return seasonal.withColumn(to, F.col("__s") - F.lag("__s").over(w)).drop("__s")


def dense_period(df: DataFrame, period: str, to: str = "time") -> DataFrame:
    """Number the distinct observed periods 1, 2, ... and attach the number to every row.

    The ranking window sees distinct periods only; their table is joined back by its measured size.
    """
    ranked = df.select(F.col(period).alias("__p")).where("__p IS NOT NULL").distinct()
    ranked = ranked.withColumn(to, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__p")))
    if ranked.limit(MAX_PERIODS + 1).count() <= MAX_PERIODS:
        ranked = F.broadcast(ranked)  # periods are few and hot
    return df.join(ranked, df[period] == ranked["__p"], "left").drop("__p")
