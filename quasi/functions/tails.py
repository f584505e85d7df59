"""Distribution tails for coefficient tables.

Coefficient tables have a handful of rows, so these run on the driver in plain Python: the regularised
incomplete beta and gamma functions by continued fraction, and inversions by bisection.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lentz(first: float, terms) -> float:
    """Modified Lentz evaluation of first/(1+) a1/(1+) a2/(1+) ... given (a, b) pairs."""
    tiny = 1e-300
    value = first or tiny
    c, d = value, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + a / (c if abs(c) > tiny else tiny)
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def terms():
        for m in range(0, 5000):
            if m > 0:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / (a * _lentz(1.0, terms()))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t; the normal tail for very large df."""
    if df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df > 1e7:
        return normal_two_sided(t)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5 by bisection on the tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1.0 - p, df)
    if df > 1e7:
        return normal_quantile(p)
    tail = 2.0 * (1.0 - p)
    lo, hi = 0.0, 2.0
    while t_two_sided(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, hi):
            break
    return (lo + hi) / 2.0


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front

    def terms():
        for i in range(1, 5000):
            yield -i * (i - a), x + 2 * i + 1.0 - a

    return front / _lentz(x + 1.0 - a, terms())


def chi2_upper(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2.0, x / 2.0)
