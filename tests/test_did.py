"""Difference-in-differences, series and power on panels with known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quasi.models import did as T
from quasi.models import series as Z
from quasi.models.design import factor
from quasi.plans.reports import rollout_report


def panel(spark, noise, units=40, periods=10, timing=(0, 4, 6, 8), effect=1.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        g, base, f = timing[i % len(timing)], float(rng.normal(0, 3)), "ab"[(i // 4) % 2]
        for t in range(1, periods + 1):
            d = int(g != 0 and t >= g)
            rows.append((i, t, g, d, t - g if g else None, base + 0.5 * t + effect * d * (t - g + 1) + float(rng.normal(0, noise)) if noise else base + 0.5 * t + effect * d * (t - g + 1), f, i // 2))
    schema = "id int, t int, g int, d int, rel int, y double, f string, cl int"
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def exact(spark):
    return panel(spark, 0.0)


@pytest.fixture(scope="module")
def noisy(spark):
    return panel(spark, 0.5)


def test_decomposition_adds_up(exact, noisy):
    for _, df in (exact, noisy):
        parts = T.bacon(df, "y", "id", "t", "g").toPandas()
        assert parts.weight.sum() == pytest.approx(1.0, abs=1e-12)
        assert (parts.weight * parts.estimate).sum() == pytest.approx(T.twfe(df, "y", "d", "id", "t").coef[0], abs=1e-8)


def test_three_unit_panel(spark):
    """Constant effects of 4 and 2 from periods 8 and 5, one unit never treated."""
    rows = [
        (u, t, g, int(g != 0 and t >= g), float(k * (g != 0 and t >= g)))
        for u, g, k in ((1, 0, 0), (2, 8, 4), (3, 5, 2)) for t in range(1, 11)
    ]
    df = spark.createDataFrame(rows, "id int, t int, g int, d int, y double")
    parts = {(r["type"], r["treated"], r["control"]): r["estimate"] for r in T.bacon(df, "y", "id", "t", "g").collect()}
    assert parts == {
        ("Treated vs Untreated", 5, 0): 2.0, ("Treated vs Untreated", 8, 0): 4.0,
        ("Earlier vs Later Treated", 5, 8): 2.0, ("Later vs Earlier Treated", 8, 5): 4.0,
    }
    assert T.comparison_windows(df, "t", "g").where("comparison = '5v8'").count() == 14


@pytest.mark.parametrize("control", ["never", "notyet"])
def test_group_time_effects_recover_truth(spark, exact, control):
    _, df = exact
    gt = T.att_gt(df, "y", "t", "g", "id", control=control)
    want = np.where(gt.table.t >= gt.table.g, gt.table.t - gt.table.g + 1.0, 0.0)
    assert np.allclose(gt.table.att, want) and np.allclose(gt.vcov, 0, atol=1e-18)
    dynamic = {r["key"]: r["att"] for r in T.aggregated_frame(T.aggte(gt, "dynamic"), spark).collect()}
    assert dynamic["0"] == pytest.approx(1.0) and dynamic["6"] == pytest.approx(7.0) and dynamic["-2"] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("est", ["reg", "dr"])
def test_adjusted_effects_recover_truth(exact, est):
    _, df = exact
    gt = T.att_gt(df, "y", "t", "g", "id", covariates=[factor("f")], est=est)
    assert np.allclose(gt.table.att, np.where(gt.table.t >= gt.table.g, gt.table.t - gt.table.g + 1.0, 0.0), atol=1e-7)


def _regression_effect(pdf, g, t, b):
    """Effect adjusted for the factor f by regression on the never treated, from the rows themselves."""
    x = np.column_stack([np.ones(len(pdf)), pdf.f == "b"]).astype(float)
    y, cohort, time = pdf.y.to_numpy(), pdf.g.to_numpy(), pdf.t.to_numpy()
    beta = {s: np.linalg.lstsq(x[(cohort == 0) & (time == s)], y[(cohort == 0) & (time == s)], rcond=None)[0] for s in (t, b)}
    own = {s: (cohort == g) & (time == s) for s in (t, b)}
    return y[own[t]].mean() - y[own[b]].mean() - x[own[t] | own[b]].mean(axis=0) @ (beta[t] - beta[b])


def test_adjusted_variance_against_jackknife(spark):
    pdf, df = panel(spark, 0.5, units=120, periods=5, timing=(0, 3, 4))
    gt = T.att_gt(df, "y", "t", "g", "id", covariates=[factor("f")], draws=400)
    ids = pdf.id.unique()
    for g, t, b in ((3, 4, 2), (4, 2, 1)):
        i = int(np.flatnonzero((gt.table.g == g) & (gt.table.t == t))[0])
        assert gt.table.att[i] == pytest.approx(_regression_effect(pdf, g, t, b))
        left_out = np.array([_regression_effect(pdf[pdf.id != u], g, t, b) for u in ids])
        jackknife = (len(ids) - 1) / len(ids) * ((left_out - left_out.mean()) ** 2).sum()
        assert gt.vcov[i, i] == pytest.approx(jackknife, rel=0.1)
        assert gt.draws[:, i].std() == pytest.approx(np.sqrt(gt.vcov[i, i]), rel=0.15)
    found = T.pretrend_test(gt)
    assert found["df"] == 3 and 0.0 < found["p_value"] < 1.0
    rows = T.att_gt(df, "y", "t", "g", panel=False, covariates=[factor("f")], draws=400)
    i = int(np.flatnonzero((rows.table.g == 3) & (rows.table.t == 4))[0])
    left_out = np.array([_regression_effect(pdf.drop(index=r), 3, 4, 2) for r in pdf.index])
    jackknife = (len(pdf) - 1) / len(pdf) * ((left_out - left_out.mean()) ** 2).sum()
    assert rows.vcov[i, i] == pytest.approx(jackknife, rel=0.1)
    assert rows.draws[:, i].std() == pytest.approx(np.sqrt(rows.vcov[i, i]), rel=0.15)


def test_omitted_effects_are_named(exact):
    _, df = exact
    gt = T.att_gt(df.where("NOT (g = 6 AND t = 8)"), "y", "t", "g", panel=False)
    missing = [(g, t) for g, t, _ in gt.options["omitted"]]
    assert missing == [(6, 8)] and not ((gt.table.g == 6) & (gt.table.t == 8)).any()
    every = T.att_gt(df.where("g <> 0"), "y", "t", "g", "id", control="notyet")
    assert [(g, t) for g, t, _ in every.options["omitted"]] == [(8, None)]


def test_covariates_may_be_null(exact):
    _, df = exact
    holes = df.selectExpr("id", "t", "g", "y", "CASE WHEN id % 10 <> 9 THEN f END AS f")
    gt = T.att_gt(holes, "y", "t", "g", "id", covariates=[factor("f")])
    assert np.allclose(gt.table.att, np.where(gt.table.t >= gt.table.g, gt.table.t - gt.table.g + 1.0, 0.0), atol=1e-7)


def _robust_effect(pdf, g, t, b, columns):
    """Doubly robust effect against the never treated, propensity by Newton steps, from the rows themselves."""
    pdf = pdf[pdf.g.isin([0, g])]
    x = np.column_stack([np.ones(len(pdf)), *[pdf[c].astype(float) for c in columns]])
    y, treated, time = pdf.y.to_numpy(), (pdf.g == g).to_numpy(), pdf.t.to_numpy()
    fit, odds = time == b, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x[fit] @ odds))
        odds += np.linalg.solve((x[fit] * (p * (1 - p))[:, None]).T @ x[fit], x[fit].T @ (treated[fit] - p))
    out = 0.0
    for s, sign in ((t, 1.0), (b, -1.0)):
        own, other = treated & (time == s), ~treated & (time == s)
        rest = y - x @ np.linalg.lstsq(x[other], y[other], rcond=None)[0]
        out += sign * (rest[own].mean() - np.average(rest[other], weights=np.exp(x[other] @ odds)))
    return out


@pytest.mark.parametrize("covariates", [[factor("f")], ["x", factor("f")]])
def test_doubly_robust_variance_against_jackknife(spark, covariates):
    pdf, df = panel(spark, 0.5, units=150, periods=5, timing=(0, 3, 4))
    pdf["x"], pdf["fb"] = pdf.id * 7919 % 101 / 101.0, (pdf.f == "b").astype(float)
    pdf["y"] += 2 * pdf.x * pdf.t
    df = df.selectExpr("id", "t", "g", "f", "cl", "(id * 7919 % 101) / 101.0D AS x", "y + 2 * ((id * 7919 % 101) / 101.0D) * t AS y")
    gt = T.att_gt(df, "y", "t", "g", "id", covariates=covariates, est="dr", draws=400)
    columns = ["fb"] if len(covariates) == 1 else ["x", "fb"]
    ids = pdf.id.unique()
    for g, t, b in ((3, 4, 2), (4, 2, 1)):
        i = int(np.flatnonzero((gt.table.g == g) & (gt.table.t == t))[0])
        assert gt.table.att[i] == pytest.approx(_robust_effect(pdf, g, t, b, columns), abs=1e-6)
        left_out = np.array([_robust_effect(pdf[pdf.id != u], g, t, b, columns) for u in ids])
        jackknife = (len(ids) - 1) / len(ids) * ((left_out - left_out.mean()) ** 2).sum()
        assert gt.vcov[i, i] == pytest.approx(jackknife, rel=0.12)
        assert gt.draws[:, i].std() == pytest.approx(np.sqrt(gt.vcov[i, i]), rel=0.15)
    assert T.pretrend_test(gt)["df"] == 3
    band = T.aggregated_frame(T.aggte(gt, "dynamic"), spark, uniform=True).toPandas()
    assert band.se.gt(0).all()
    if len(covariates) == 1:
        i = int(np.flatnonzero((gt.table.g == 3) & (gt.table.t == 4))[0])
        rows = T.att_gt(df, "y", "t", "g", panel=False, covariates=covariates, est="dr", cluster="cl")
        assert rows.vcov[i, i] > 0 and rows.clusters == pdf.cl.nunique()


@pytest.mark.parametrize("kind", ["simple", "dynamic", "group"])
def test_share_uncertainty_against_jackknife(spark, kind):
    """Effects that differ much between cohorts, so that the shares matter."""
    pdf, df = panel(spark, 0.3, units=90, periods=6, timing=(0, 3, 5))
    df = df.selectExpr("id", "t", "g", "y + IF(g = 5 AND t >= 5, 6, 0) AS y")
    pdf["y"] += 6.0 * ((pdf.g == 5) & (pdf.t >= 5))
    agg = T.aggte(T.att_gt(df, "y", "t", "g", "id", draws=600), kind)

    def overall(p):
        wide, cohort = p.pivot(index="id", columns="t", values="y"), p.groupby("id").g.first()
        att = {}
        for g in (3, 5):
            for t in range(g, 7):
                change = wide[t] - wide[g - 1]
                att[g, t] = change[cohort == g].mean() - change[cohort == 0].mean()
        n = {g: (cohort == g).sum() for g in (3, 5)}
        if kind == "simple":
            return np.average(list(att.values()), weights=[n[g] for g, _ in att])
        if kind == "group":
            return np.average([np.mean([v for (h, _), v in att.items() if h == g]) for g in (3, 5)], weights=[n[3], n[5]])
        events = sorted({t - g for g, t in att})
        return np.mean([np.average([v for (g, t), v in att.items() if t - g == e], weights=[n[g] for g, t in att if t - g == e]) for e in events])

    ids = pdf.id.unique()
    assert agg.table.att.iloc[-1] == pytest.approx(overall(pdf))
    left_out = np.array([overall(pdf[pdf.id != u]) for u in ids])
    jackknife = (len(ids) - 1) / len(ids) * ((left_out - left_out.mean()) ** 2).sum()
    assert agg.vcov[-1, -1] == pytest.approx(jackknife, rel=0.06)
    assert agg.draws[:, -1].std() == pytest.approx(np.sqrt(agg.vcov[-1, -1]), rel=0.15)


def test_influence_variance_by_hand(noisy):
    pdf, df = noisy
    gt = T.att_gt(df, "y", "t", "g", "id")
    wide = pdf.pivot(index="id", columns="t", values="y")
    cohort = pdf.groupby("id").g.first()
    i = int(np.flatnonzero((gt.table.g == 6) & (gt.table.t == 7))[0])
    change = wide[7] - wide[5]
    parts = [change[cohort == g] for g in (6, 0)]
    n = len(cohort)
    want = sum(((p - p.mean()) ** 2).sum() / len(p) ** 2 for p in parts) * n / (n - 1)
    assert gt.vcov[i, i] == pytest.approx(want)


def test_bootstrap_is_close_and_repeatable(spark, noisy):
    _, df = noisy
    runs = [T.att_gt(df.repartition(p), "y", "t", "g", "id", draws=300, seed=4) for p in (1, 6)]
    assert np.allclose(runs[0].draws, runs[1].draws)
    spread = runs[0].draws.std(axis=0) / np.sqrt(np.diag(runs[0].vcov))
    assert 0.8 < spread.mean() < 1.2
    band = T.aggregated_frame(T.aggte(runs[0], "dynamic"), spark, uniform=True).toPandas()
    point = T.aggregated_frame(T.aggte(runs[0], "dynamic"), spark).toPandas()
    assert ((band.ci_hi - band.ci_lo) > (point.ci_hi - point.ci_lo)).all()


def test_pretrend(spark, noisy):
    _, df = noisy
    ok = T.pretrend_test(T.att_gt(df, "y", "t", "g", "id"))
    assert 0 <= ok["p_value"] <= 1 and ok["df"] > 3
    drift = df.selectExpr("*", "y + IF(g > 0, 0.4 * t, 0) AS z")
    assert T.pretrend_test(T.att_gt(drift, "z", "t", "g", "id"))["p_value"] < 0.01


@pytest.mark.parametrize("cluster", ["id", "cl"])
@pytest.mark.parametrize("event", [False, True])
def test_two_stage_matches_dense_algebra(noisy, cluster, event):
    pdf, df = noisy
    x1 = np.hstack([np.eye(40)[pdf.id], np.eye(10)[pdf.t - 1][:, 1:]])
    free = (pdf.d == 0).to_numpy()
    x10, y = x1 * free[:, None], pdf.y.to_numpy()
    resid = y - x1 @ np.linalg.lstsq(x10, y * free, rcond=None)[0]
    if event:
        levels = sorted(v for v in pdf.rel.dropna().unique() if v != -1)
        x2 = np.column_stack([(pdf.rel == v).to_numpy(float) for v in levels])
    else:
        x2 = pdf[["d"]].to_numpy(float)
    b = np.linalg.lstsq(x2, resid, rcond=None)[0]
    u2, u1 = resid - x2 @ b, resid * free
    inv = np.linalg.inv(x2.T @ x2)
    correction = x10 @ (np.linalg.pinv(x10.T @ x10) @ (x1.T @ x2))
    score = np.array([(x2[m] * u2[m][:, None]).sum(0) - (correction[m] * u1[m][:, None]).sum(0) for m in (pdf[cluster] == c for c in pdf[cluster].unique())])
    fit = T.did2s(df, "y", "id", "t", "d", cluster=cluster, rel="rel" if event else None)
    assert np.allclose(fit.coef, b) and np.allclose(fit.vcov, inv @ score.T @ score @ inv)


def test_units_without_untreated_rows_drop_out(spark, exact):
    pdf, df = exact
    always = spark.createDataFrame([(99, t, 1, 1, t - 1, 1000.0, "a", 99) for t in range(1, 11)], df.schema)
    with_always = T.did2s(df.unionByName(always), "y", "id", "t", "d")
    assert with_always.coef[0] == pytest.approx(T.did2s(df, "y", "id", "t", "d").coef[0])
    assert with_always.n == len(pdf)


def test_switchers(spark, exact):
    _, df = exact
    overall = T.did_m(df, "y", "id", "t", "d").where("kind = 'overall'").first()
    assert overall["effect"] == pytest.approx(1.0) and overall["switchers"] == 30


def test_estimators_agree_when_effects_are_constant(spark):
    rows = [(i, t, g, float(i) + t + 2.0 * (g != 0 and t >= g)) for i, g in enumerate([0, 3, 5] * 4) for t in range(1, 8)]
    df = spark.createDataFrame(rows, "id int, t int, g int, y double")
    for r in rollout_report(df, "y", "id", "t", "g").collect():
        assert r["estimate"] == pytest.approx(2.0, abs=1e-8)


def test_mixed_time_units_are_refused(spark):
    df = spark.createDataFrame([(1, t, 60, 1.0) for t in range(1, 5)] + [(2, t, 0, 1.0) for t in range(1, 5)], "id int, t int, g int, y double")
    with pytest.raises(ValueError):
        T.att_gt(df, "y", "t", "g", "id")


def test_segments(spark):
    rows = [(t, (t - 1) % 12 + 1, 5 + 0.1 * t + (2 + 0.3 * (t - 20) if t >= 21 else 0) + ((t - 1) % 12 == 3) * 1.5) for t in range(1, 61)]
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "time int, month int, y double")
    fit = Z.segmented_regression(df, "y", "time", 21, "month")
    got = dict(zip(fit.names, fit.coef))
    assert got["time"] == pytest.approx(0.1) and got["exp"] == pytest.approx(2.0) and got["t_exp"] == pytest.approx(0.3)
    assert got["month_4"] == pytest.approx(1.5)


def test_partial_autocorrelations():
    assert Z.pacf_from_acf([0.6, 0.36, 0.216]) == pytest.approx([0.6, 0.0, 0.0], abs=1e-12)


def test_forecast_continues_a_clean_season(spark):
    rows = [("s", t, 10 + 0.2 * t + 3 * np.sin(2 * np.pi * t / 12)) for t in range(1, 85)] + [("c", t, 4.0) for t in range(1, 40)]
    df = spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "k string, time long, v double")
    got = Z.forecast_by_series(df, ["k"], "time", "v", 12).toPandas()
    s = got[got.k == "s"].sort_values("time")
    assert s.time.tolist() == list(range(85, 97))
    assert np.allclose(s.score, 10 + 0.2 * s.time + 3 * np.sin(2 * np.pi * s.time / 12), atol=1e-6)
    assert np.allclose(got[got.k == "c"].score, 4.0) and (got.lower_ci <= got.upper_ci).all()


def test_power_of_the_textbook_case(spark):
    df = spark.createDataFrame([("a", float(v)) for v in np.random.default_rng(0).normal(0, 1, 400)], "g string, x double")
    row = Z.power_by_group(df, ["g"], "x", 0.2).first()
    assert row["n_needed"] == pytest.approx(392 * row["sd"] ** 2, rel=0.02)
