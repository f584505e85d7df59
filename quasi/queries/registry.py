"""Registration of queries and shared inputs built from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.functions.columns import ColumnLike, as_col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: ColumnLike, digits: int = 6) -> Column:
    """Rounded double without negative zero, so that two engines compare equal."""
    return F.round(as_col(c).cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, integers widened."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(r(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def orders_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's nation and segment; the join side is chosen by measured size."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


ORDERS_BY_CUSTOMER = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
