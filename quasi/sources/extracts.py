"""Delimited extracts keyed by their path, wave conversion and result stores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_keyed_extracts(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    key_pattern: str,
    keys: Mapping[str, str],
    sep: str = "\t",
    header: bool = True,
) -> DataFrame:
    """All delimited files below a path in one distributed read, keys parsed out of each file's path.

    ``key_pattern`` has one group per entry of ``keys`` (name to type), for example
    ``r"uk_(\\d{4})_(\\w+)\\.txt"`` with ``{"year": "int", "policy": "string"}``. The schema is declared:
    inferring it would read everything twice.
    """
    raw = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    source = F.col("_metadata.file_path")
    parsed = [
        F.regexp_extract(source, key_pattern, i + 1).try_cast(dtype).alias(name)
        for i, (name, dtype) in enumerate(keys.items())
    ]
    return raw.select(*parsed, *raw.columns)


def clean_name(name: str) -> str:
    """snake_case: camel humps split, other characters to underscores, leading digit prefixed."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9A-Za-z]+", "_", s.replace("%", "_percent_")).strip("_").lower()
    if not s:
        s = "x"
    return f"x{s}" if s[0].isdigit() else s


def clean_names(df: DataFrame) -> DataFrame:
    """Unique snake_case column names; repeats get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        base = clean_name(c)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)


def wave_name(first_year: int) -> str:
    """Name of the April to March wave starting in the given year, e.g. apr17_mar18."""
    return f"apr{first_year % 100:02d}_mar{(first_year + 1) % 100:02d}"


def convert_waves(waves: Mapping[int, DataFrame], destination: str) -> None:
    """Write each wave as a column store under one root, partitioned by the wave's name.

    A wave is converted as its own job, since columns differ by wave; reading the root back with
    ``mergeSchema`` gives the union with partition pruning on ``wave``.
    """
    for first_year, df in waves.items():
        clean_names(df).write.mode("overwrite").parquet(f"{destination}/wave={wave_name(first_year)}")


def read_waves(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", root).parquet(root)


COEFFICIENT_SCHEMA = (
    "term string, estimate double, std_error double, statistic double, p_value double, "
    "ci_lo double, ci_hi double"
)


def write_coefficients(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store a model as its term table (parquet or csv)."""
    writer = table.coalesce(1).write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)


def read_coefficients(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(COEFFICIENT_SCHEMA).option("header", True).csv(path)


def write_resamples(predictions: DataFrame, path: str, by: Sequence[str] = ("resample_id",)) -> None:
    """Store resample predictions or metrics, one folder per resample."""
    predictions.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_resamples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
