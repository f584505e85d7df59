"""Distribution fits of positive amounts, by group, from one pass of moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.functions.special import log_gamma_density, normal_cdf
from quasi.operators.agg import histogram


def gamma_moments(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Shape mean^2/var and scale var/mean."""
    m = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count(x).alias("n"))
    return m.select(*by, "n", (F.col("m") ** 2 / F.col("v")).alias("shape"), (F.col("v") / F.col("m")).alias("scale"))


def gamma_fit(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Shape and scale with scale = cov(x, ln x), for positive values."""
    m = df.where(F.col(x) > 0).groupBy(*by).agg(
        F.avg(x).alias("m"), F.covar_samp(x, F.log(x)).alias("b"), F.count(x).alias("n")
    )
    return m.select(*by, "n", (F.col("m") / F.col("b")).alias("shape"), F.col("b").alias("scale"))


def gamma_test(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Test of fit for the gamma distribution: V and its two-sided normal p value (sd sqrt 2)."""
    m = df.where(F.col(x) > 0).groupBy(*by).agg(
        F.avg(x).alias("m"), F.var_samp(x).alias("s2"), F.covar_samp(x, F.log(x)).alias("b"), F.count(x).alias("n")
    )
    v = F.sqrt(F.col("n") * F.col("m") / F.col("b")) * (F.col("s2") / (F.col("m") * F.col("b")) - 1.0)
    out = m.select(*by, "n", v.alias("v"))
    return out.withColumn("p_value", 2.0 * normal_cdf(-F.abs("v") / F.lit(math.sqrt(2.0))))


def exponential_test(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Cox and Oakes' score test of exponentiality, as a standard normal statistic.

    sum (1 - x/m) ln(x/m) expands into plain sums, so the mean needs no earlier pass.
    """
    m = df.where(F.col(x) > 0).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.sum(F.log(x)).alias("sl"), F.sum(F.col(x) * F.log(x)).alias("sxl")
    )
    n, lm = F.col("n"), F.log("m")
    score = n + (F.col("sl") - n * lm) - (F.col("sxl") - F.col("m") * n * lm) / F.col("m")
    out = m.select(*by, "n", (F.sqrt(6.0 / n) * score / math.pi).alias("z"))
    return out.withColumn("p_value", 2.0 * normal_cdf(-F.abs("z")))


def lognormal_test(df: DataFrame, x: str) -> DataFrame:
    """Kolmogorov-Smirnov test of ln x against a normal with its own mean and sd."""
    logs = df.where(F.col(x) > 0).select(F.log(x).alias("lx"))
    mean, sd = logs.agg(F.avg("lx"), F.stddev_samp("lx")).first()
    return KolmogorovSmirnovTest.test(logs, "lx", "norm", float(mean), float(sd)).select(
        F.col("statistic"), F.col("pValue").alias("p_value")
    )


def fitted_density(df: DataFrame, x: str, shape: float, scale: float, bins: int = 30) -> DataFrame:
    """Histogram density with the gamma density at each bin's middle."""
    h = histogram(df, x, bins, norm="density")
    mid = (F.col("x_lo") + F.col("x_hi")) / 2.0
    return h.select("bin", mid.alias("x"), "density", F.exp(log_gamma_density(mid, shape, F.lit(float(scale)))).alias("fitted"))
