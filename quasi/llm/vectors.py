"""Cleaning shared by the vector searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(rows: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """``vec_id`` and ``v`` (array of double) of the vectors that take part, each distinct row once.

    Left out: null ids; null or empty vectors; null or non-finite components; zero vectors unless allowed; vectors whose
    dimension is not the most frequent one (the smaller among equals).
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = v.isNotNull() & (F.size(v) > 0) & finite
    if not allow_zero:
        good &= F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
    sizes = kept.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    kept = kept.where(F.size("v") == (sizes.dim if sizes else 0))
    return kept.distinct()


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype, copy=False)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """Ranks (``query_id``, ``rank``, ``vec_id``, ``score``): largest score first, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
