"""Survey waves: union, weight harmonisation, labels, coverage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_waves(waves: Mapping[object, DataFrame], tag: str = "wave") -> DataFrame:
    """Stack waves under a tag column; columns a wave lacks are null."""
    tagged = [df.withColumn(tag, F.lit(key)) for key, df in waves.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def harmonise_weight(df: DataFrame, pattern: str = r"pwta\d{2}", to: str = "weight") -> DataFrame:
    """Rename the one column whose name matches the pattern."""
    hits = [c for c in df.columns if re.fullmatch(pattern, c)]
    if len(hits) != 1:
        raise ValueError(f"expected one column matching {pattern!r}, found {hits}")
    return df.withColumnRenamed(hits[0], to)


def pruned_scan(df: DataFrame, columns: Sequence[str], order: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """Named columns only, optionally the first n rows in an explicit order."""
    out = df.select(*columns)
    if n is not None:
        out = out.orderBy(*order).limit(n) if order else out.limit(n)
    return out


def decode_labels(
    df: DataFrame, labels: DataFrame, columns: Sequence[str], variable: str = "variable",
    code: str = "code", label: str = "label",
) -> DataFrame:
    """Replace codes by the labels of a (variable, code, label) table; unknown codes become null.

    The label side carries no broadcast hint: its measured size decides between a broadcast and a
    shuffle join.
    """
    out = df
    for c in columns:
        side = labels.where(F.col(variable) == c).select(
            F.col(code).alias(f"__code_{c}"), F.col(label).alias(f"__label_{c}")
        )
        out = (
            out.join(side, out[c] == side[f"__code_{c}"], "left")
            .withColumn(c, F.col(f"__label_{c}"))
            .drop(f"__code_{c}", f"__label_{c}")
        )
    return out


def column_coverage(waves: Mapping[object, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Wave by column: is the column present, and which share of its values is not null.

    Presence comes from the schema; only columns that exist are read, in one aggregate per wave.
    """
    parts = []
    for tag, df in waves.items():
        present = [c for c in columns if c in df.columns]
        shares = df.agg(
            F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"__c_{c}") for c in present]
        )
        entries = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(int(c in present)).cast("bigint").alias("present"),
                (
                    F.try_divide(F.col(f"__c_{c}").cast("double"), F.col("__n").cast("double"))
                    if c in present
                    else F.lit(None).cast("double")
                ).alias("non_null_share"),
            )
            for c in columns
        ]
        parts.append(
            shares.select(F.explode(F.array(*entries)).alias("e")).select(
                F.lit(tag).alias("wave"), "e.*"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def reference_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal table; its size is fixed by the program text."""
    return spark.createDataFrame(list(rows), schema)
