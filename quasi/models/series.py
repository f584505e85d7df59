"""Interrupted time series, autocorrelation, many-series forecasts and power."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.models.design import factor
from quasi.models.linear import Fit, ols
from quasi.operators.reshape import stack_rows


def interruption_columns(df: DataFrame, time: str, start: int) -> DataFrame:
    """Level indicator from ``start`` on and periods since the last one before it."""
    return df.withColumn("exp", (F.col(time) >= start).cast("int")).withColumn(
        "t_exp", F.greatest(F.lit(0), F.col(time) - F.lit(start - 1))
    )


def segmented_regression(df: DataFrame, y: str, time: str, start: int, month: str | None = None) -> Fit:
    """Level and slope change at ``start`` with optional month effects.

    All regressors depend on the period only, so rows are merged to periods before the fit.
    """
    rows = interruption_columns(df, time, start)
    terms = [time, "exp", "t_exp", *([factor(month)] if month else [])]
    return ols(rows, y, terms, merge=True)


def acf(series: DataFrame, time: str, value: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Autocorrelations at lags 1..k per series, from lagged products in one window pass."""
    by = list(by)
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    z = series.where(F.col(value).isNotNull()).withColumn("__z", F.col(value) - F.avg(value).over(part))
    along = part.orderBy(time)
    lagged = z.select(*by, "__z", *[F.lag("__z", k).over(along).alias(f"l{k}") for k in range(1, lags + 1)])
    wide = lagged.groupBy(*by).agg(
        *[F.try_divide(F.sum(F.col("__z") * F.col(f"l{k}")), F.sum(F.col("__z") * F.col("__z"))).alias(f"r{k}") for k in range(1, lags + 1)]
    )
    entries = [F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"r{k}").alias("acf")) for k in range(1, lags + 1)]
    return wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def pacf_from_acf(r: Sequence[float]) -> list[float]:
    """Durbin-Levinson recursion."""
    out, phi = [], np.zeros(0)
    for k in range(1, len(r) + 1):
        past = np.array(r[: k - 1])
        last = (r[k - 1] - phi @ past[::-1]) / (1.0 - phi @ past) if k > 1 else r[0]
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def acf_pacf(series: DataFrame, time: str, value: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Autocorrelations and partial autocorrelations per series: (by, lag, acf, pacf)."""
    by = list(by)
    table = acf(series, time, value, lags, by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*by).schema.fields)
    schema = ", ".join([*([kinds] if by else []), "lag long, acf double, pacf double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf.assign(pacf=pacf_from_acf(pdf.acf.tolist()))[[*by, "lag", "acf", "pacf"]]

    return table.groupBy(*(by or [F.lit(0)])).applyInPandas(one, schema)


# ---------------------------------------------------------------- forecasts


def _difference(x: np.ndarray, d: int, seasonal: int, season: int) -> np.ndarray:
    for _ in range(seasonal):
        x = x[season:] - x[:-season]
    for _ in range(d):
        x = np.diff(x)
    return x


def _fit_arma(w: np.ndarray, x: np.ndarray, ar: list[int], ma: list[int], constant: bool):
    """Conditional least squares in two regressions (Hannan and Rissanen): a long autoregression gives
    residuals, then the series is regressed on its lags, lagged residuals and the regressors."""
    n = len(w)
    e = np.zeros(n)
    if ma:
        m = min(max(ma) + 2, n // 4)
        lagged = np.column_stack([w[m - j - 1:n - j - 1] for j in range(m)])
        e[m:] = w[m:] - lagged @ np.linalg.lstsq(lagged, w[m:], rcond=None)[0]
    skip = max([0, *ar, *ma]) + (min(max(ma) + 2, n // 4) if ma else 0)
    rows = np.arange(skip, n)
    cols = [w[rows - j] for j in ar] + [e[rows - j] for j in ma] + [x[rows, i] for i in range(x.shape[1])]
    if constant:
        cols.append(np.ones(len(rows)))
    if len(rows) < len(cols) + 3:
        return None
    design = np.column_stack(cols) if cols else np.zeros((len(rows), 0))
    coef = np.linalg.lstsq(design, w[rows], rcond=None)[0] if cols else np.zeros(0)
    resid = w[rows] - design @ coef
    e[rows] = resid
    k = len(coef) + 1
    sigma2 = float(resid @ resid / len(rows))
    aicc = len(rows) * np.log(max(sigma2, 1e-300)) + 2 * k + 2 * k * (k + 1) / max(len(rows) - k - 1, 1)
    return {"coef": coef, "sigma2": sigma2, "score": aicc / len(rows), "e": e, "ar": ar, "ma": ma, "constant": constant}


def _integration(d: int, seasonal: int, season: int) -> np.ndarray:
    """Coefficients c of y_t = w_t + sum c_j y_{t-j} that undo the differencing."""
    p = np.array([1.0])
    for _ in range(d):
        p = np.convolve(p, [1.0, -1.0])
    for _ in range(seasonal):
        p = np.convolve(p, np.concatenate([[1.0], np.zeros(season - 1), [-1.0]]))
    return -p[1:]


def _forecast_one(y, x_past, x_future, h, season, level):
    """Best small seasonal model by corrected information criterion, then recursive forecasts."""
    best, choice = None, (0, 0)
    seasonal = 1 if len(y) >= 3 * season else 0
    for d in (0, 1):
        if len(y) < 12:
            continue
        w = _difference(y, d, seasonal, season)
        x = np.column_stack([_difference(c, d, seasonal, season) for c in x_past.T]) if x_past.shape[1] else np.zeros((len(w), 0))
        for p in (0, 1, 2):
            for q in (0, 1):
                for big_p in ((0, 1) if seasonal else (0,)):
                    ar = list(range(1, p + 1)) + ([season] if big_p else [])
                    fit = _fit_arma(w, x, ar, list(range(1, q + 1)), constant=d + seasonal == 0)
                    if fit and (best is None or fit["score"] < best["score"]):
                        best, choice = {**fit, "w": w}, (d, seasonal)
    z = NormalDist().inv_cdf((1 + level) / 2)
    if best is None:
        mean, sd = float(np.mean(y)), float(np.std(y, ddof=1)) if len(y) > 1 else 0.0
        return [(mean, mean - z * sd, mean + z * sd)] * h
    d, seasonal = choice
    undo = _integration(d, seasonal, season)
    coef, ar, ma = best["coef"], best["ar"], best["ma"]
    b = coef[len(ar) + len(ma):len(ar) + len(ma) + x_past.shape[1]]
    const = coef[-1] if best["constant"] else 0.0
    levels = list(y)
    w, e = list(best["w"]), list(best["e"])
    x_all = np.vstack([x_past, x_future]) if x_past.shape[1] else np.zeros((len(y) + h, 0))
    x_w = np.column_stack([_difference(c, d, seasonal, season) for c in x_all.T]) if x_past.shape[1] else np.zeros((len(w) + h, 0))
    # Weights of past shocks in the level, for the interval.
    full = np.zeros(h + 1)
    full[0] = 1.0
    psi = np.zeros(h + 1)
    for j in range(h + 1):
        own = (1.0 if j == 0 else 0.0) + sum(coef[len(ar) + i] for i, q in enumerate(ma) if q == j)
        own += sum(coef[i] * psi[j - a] for i, a in enumerate(ar) if j >= a)
        psi[j] = own
    for j in range(h + 1):
        full[j] = psi[j] + sum(c * full[j - i - 1] for i, c in enumerate(undo) if j >= i + 1)
    out = []
    for s in range(h):
        n = len(w)
        step = const + sum(coef[i] * w[n - a] for i, a in enumerate(ar)) + sum(coef[len(ar) + i] * e[n - q] for i, q in enumerate(ma))
        if len(b):
            step += float(x_w[n] @ b)
        w.append(step)
        e.append(0.0)
        level_now = step + sum(c * levels[len(levels) - i - 1] for i, c in enumerate(undo))
        levels.append(level_now)
        half = z * float(np.sqrt(best["sigma2"] * np.sum(full[: s + 1] ** 2)))
        out.append((float(level_now), float(level_now - half), float(level_now + half)))
    return out


def forecast_by_series(
    series: DataFrame, by: Sequence[str], time: str, value: str, h: int = 12, season: int = 12, level: float = 0.95,
    regressors: Sequence[str] = (), future: DataFrame | None = None,
) -> DataFrame:
    """Seasonal autoregressive forecasts of many series: (by, time, score, lower_ci, upper_ci).

    ``time`` is an integer period number and a series has one row per period, so a group is as short as
    the observed history. Each series picks among a small grid of orders by corrected information
    criterion, estimated by conditional least squares; this approximates a full likelihood search.
    ``future`` carries regressor values for the forecast periods.
    """
    by = list(by)
    names = list(regressors)
    history = series.select(*by, F.col(time).cast("long").alias("__t"), F.col(value).cast("double").alias("__y"), *names)
    if names:
        ahead = future.select(*by, F.col(time).cast("long").alias("__t"), F.lit(None).cast("double").alias("__y"), *names)
        history = history.unionByName(ahead)
    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, {time} long, score double, lower_ci double, upper_ci double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t")
        seen = pdf[pdf["__y"].notna()]
        x_past = seen[names].to_numpy(float)
        later = pdf[pdf["__y"].isna() & (pdf["__t"] > seen["__t"].max())]
        x_future = later[names].to_numpy(float)[:h] if names else np.zeros((h, 0))
        steps = len(x_future) if names else h
        out = _forecast_one(seen["__y"].to_numpy(float), x_past, x_future, steps, season, level)
        first = int(seen["__t"].max()) + 1
        frame = pd.DataFrame(out, columns=["score", "lower_ci", "upper_ci"])
        for c in by:
            frame[c] = pdf[c].iloc[0]
        frame[time] = np.arange(first, first + len(frame))
        return frame[[*by, time, "score", "lower_ci", "upper_ci"]]

    return history.groupBy(*by).applyInPandas(one, schema)


def observed_and_forecast(series: DataFrame, forecast: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Observed rows over forecast rows, marked by ``obs``."""
    observed = series.select(*by, F.col(time).cast("long").alias(time), F.col(value).alias("score"), F.lit("observed").alias("obs"))
    return stack_rows(observed, forecast.withColumn("obs", F.lit("pred")))


# ---------------------------------------------------------------- power


def power_by_group(
    df: DataFrame, by: Sequence[str], value: str, difference: float, alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Two-sample comparison per group, by normal approximation.

    Effect size difference/sd, power with the group's own n per arm, n per arm needed for the wanted
    power, and the smallest detectable difference at that power.
    """
    from quasi.functions.special import normal_cdf

    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    d = F.lit(float(difference)) / F.col("sd")
    shift = F.abs(d) * F.sqrt(F.col("n") / 2.0)
    return m.select(
        *by, "n", "mean", "sd", d.alias("d"),
        (normal_cdf(shift - F.lit(za)) + normal_cdf(-shift - F.lit(za))).alias("power"),
        F.ceil(2.0 * F.pow(F.lit(za + zb) / d, F.lit(2.0))).cast("long").alias("n_needed"),
        (F.lit(za + zb) * F.col("sd") * F.sqrt(2.0 / F.col("n"))).alias("detectable"),
    )
