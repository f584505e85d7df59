"""Normal and gamma densities and the normal distribution function as column expressions.

Spark SQL has no error function. The distribution function below is the rational approximation of
Hart (1968) in the arrangement of West (2005), good to about 1e-15.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quasi.functions.columns import ColumnLike, as_col

# Hart's coefficients, highest power first.
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_SWITCH = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def _polynomial(coefs, x):
    out = coefs[0]
    for c in coefs[1:]:
        out = out * x + c
    return out


def normal_cdf(x: ColumnLike) -> Column:
    x = as_col(x)
    a = F.abs(x)
    decay = F.exp(-a * a / 2.0)
    body = decay * _polynomial(HART_NUMERATOR, a) / _polynomial(HART_DENOMINATOR, a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + k / fraction
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < HART_SWITCH, body).otherwise(
        decay / fraction / SQRT_TWO_PI
    )
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def normal_cdf_sql(x: str) -> str:
    """The same expression as SQL text, for checks in another engine."""
    def poly(coefs):
        out = repr(coefs[0])
        for c in coefs[1:]:
            out = f"({out}*abs({x})+{c!r})"
        return out

    fraction = f"(abs({x})+0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = f"(abs({x})+{k}/{fraction})"
    decay = f"exp(-abs({x})*abs({x})/2.0)"
    upper = (
        f"(CASE WHEN abs({x})>37.0 THEN 0.0 WHEN abs({x})<{HART_SWITCH!r} "
        f"THEN {decay}*{poly(HART_NUMERATOR)}/{poly(HART_DENOMINATOR)} "
        f"ELSE {decay}/{fraction}/{SQRT_TWO_PI!r} END)"
    )
    return f"(CASE WHEN {x}>0 THEN 1.0-{upper} ELSE {upper} END)"


def log_normal_density(x: ColumnLike, mean: ColumnLike, sd: ColumnLike) -> Column:
    z = (as_col(x) - as_col(mean)) / as_col(sd)
    return -z * z / 2.0 - F.log(as_col(sd)) - 0.5 * math.log(2.0 * math.pi)


def log_gamma_density(x: ColumnLike, shape: float, scale: ColumnLike) -> Column:
    """log density of a gamma variable; the shape is one fitted number, so lgamma is a literal."""
    x, scale = as_col(x), as_col(scale)
    return (shape - 1.0) * F.log(x) - x / scale - shape * F.log(scale) - math.lgamma(shape)


def logistic(eta: ColumnLike) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(eta)))
