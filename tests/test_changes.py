"""Group-time effects from changes within units, against row-wise algebra on panels with gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quasi.models import did as T
from quasi.models.changes import att_gt_changes
from quasi.models.design import factor

SCHEMA = "id int, t int, g int, y double, f string, x double, w double, cl int"


def gappy(spark, units=150, periods=5, timing=(0, 3, 4), seed=5):
    """A panel in which about a sixth of the rows is missing and the covariates change over time."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        g, base = timing[i % len(timing)], float(rng.normal(0, 3))
        for t in range(1, periods + 1):
            f, x = "ab"[int(rng.integers(2))], float(rng.uniform())
            y = base + 0.5 * t + (g != 0 and t >= g) * (t - g + 1.0) + 0.4 * t * (f == "b") + x * t + float(rng.normal(0, 0.5))
            if rng.uniform() > 1 / 6:
                rows.append((i, t, g, y, f, x, float(1 + (i + t) % 3), i // 2))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]), spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def gaps(spark):
    pdf, df = gappy(spark)
    return pdf, df.cache()


def effect(pdf, g, t, b, columns=(), est="reg", weight=None, pool=(0,)):
    """The effect from units seen in t and b, covariates and weights of b, from the rows themselves."""
    both = pdf[pdf.t == t].merge(pdf[pdf.t == b], on="id", suffixes=("_t", ""))
    both = both[both.g.isin([g, *pool])]
    d, dy = (both.g == g).to_numpy(), (both.y_t - both.y).to_numpy()
    w = both[weight].to_numpy() if weight else np.ones(len(both))
    x = np.column_stack([np.ones(len(both)), *[both[c].astype(float) for c in columns]])
    root = np.sqrt(w[~d])
    beta = np.linalg.lstsq(x[~d] * root[:, None], dy[~d] * root, rcond=None)[0]
    rest = dy - x @ beta
    out = np.average(rest[d], weights=w[d])
    if est == "reg":
        return out
    odds = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ odds))
        odds += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (d - p)))
    return out - np.average(rest[~d], weights=w[~d] * np.exp(x[~d] @ odds))


def at(gt, g, t):
    return int(np.flatnonzero((gt.table.g == g) & (gt.table.t == t))[0])


@pytest.mark.parametrize(("control", "weight"), [("never", None), ("notyet", "w")])
def test_units_seen_in_both_periods(gaps, control, weight):
    pdf, df = gaps
    gt = att_gt_changes(df, "y", "t", "g", "id", control=control, weight=weight)
    assert len(gt.table) == 8 and not gt.options["omitted"]
    for row in gt.table.itertuples():
        b = row.g - 1 if row.t >= row.g else row.t - 1
        pool = [0] if control == "never" else [h for h in (0, 3, 4) if h != row.g and (h == 0 or h > max(row.t, b))]
        assert row.att == pytest.approx(effect(pdf, row.g, row.t, b, weight=weight, pool=pool))


def test_balanced_panels_agree_with_the_cell_form(spark):
    pdf, df = gappy(spark)
    full = df.groupBy("id").count().where("count = 5").select("id")
    df = df.join(full, "id").withColumn("f", (df.id % 2).cast("string")).cache()
    for options in ({"control": "notyet"}, {"covariates": [factor("f")], "cluster": "cl"}, {"covariates": [factor("f")], "est": "dr"}):
        a, b = T.att_gt(df, "y", "t", "g", "id", **options), att_gt_changes(df, "y", "t", "g", "id", **options)
        assert np.allclose(a.table.att, b.table.att, atol=1e-7) and a.clusters == b.clusters
        assert np.allclose(a.joint_vcov, b.joint_vcov, atol=1e-8)
        for kind in ("simple", "dynamic", "group"):
            assert np.allclose(T.aggte(a, kind).vcov, T.aggte(b, kind).vcov, atol=1e-8)


def test_pooled_controls_against_jackknife(spark):
    """Controls not yet treated are a mix of cohorts, which is estimated too (repeated cross-sections, no clusters)."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"t": rng.integers(1, 6, 400), "g": rng.choice([0, 3, 5], 400)})
    pdf["y"] = 3.0 * pdf.g + pdf.t + rng.normal(0, 0.5, 400)
    gt = T.att_gt(spark.createDataFrame(pdf), "y", "t", "g", control="notyet", panel=False)

    def change(p):
        m = {(k, s): p.y[p.g.isin(k) & (p.t == s)].mean() for k in ((3,), (0, 5)) for s in (2, 4)}
        return m[(3,), 4] - m[(3,), 2] - m[(0, 5), 4] + m[(0, 5), 2]

    i = at(gt, 3, 4)
    assert gt.table.att[i] == pytest.approx(change(pdf))
    left_out = np.array([change(pdf.drop(index=r)) for r in pdf.index])
    jackknife = (len(pdf) - 1) / len(pdf) * ((left_out - left_out.mean()) ** 2).sum()
    assert gt.vcov[i, i] == pytest.approx(jackknife, rel=0.08)


@pytest.mark.parametrize(("est", "weight"), [("reg", None), ("dr", "w")])
def test_base_covariates_and_errors_against_jackknife(spark, gaps, est, weight):
    pdf, df = gaps
    pdf = pdf.assign(fb=(pdf.f == "b").astype(float))
    gt = att_gt_changes(df, "y", "t", "g", "id", covariates=["x", factor("f")], est=est, weight=weight, draws=400)
    ids = pdf.id.unique()
    assert gt.clusters == len(ids)
    for g, t, b in ((3, 4, 2), (4, 2, 1)):
        i = at(gt, g, t)
        assert gt.table.att[i] == pytest.approx(effect(pdf, g, t, b, ["x", "fb"], est, weight), abs=1e-7)
        left_out = np.array([effect(pdf[pdf.id != u], g, t, b, ["x", "fb"], est, weight) for u in ids])
        jackknife = (len(ids) - 1) / len(ids) * ((left_out - left_out.mean()) ** 2).sum()
        assert gt.vcov[i, i] == pytest.approx(jackknife, rel=0.2)
        assert gt.draws[:, i].std() == pytest.approx(np.sqrt(gt.vcov[i, i]), rel=0.15)
    assert T.pretrend_test(gt)["df"] == 3
    assert T.aggregated_frame(T.aggte(gt, "dynamic"), spark, uniform=True).toPandas().se.gt(0).all()


def test_repeated_rows_nulls_and_clashing_names(spark, gaps):
    _, df = gaps
    want = att_gt_changes(df, "y", "t", "g", "id")
    odd = spark.createDataFrame(
        [(None, 2, 3, 9.0, "a", 0.0, 1.0, 1), (1, None, 3, 9.0, "a", 0.0, 1.0, 1), (2, 3, 4, None, "a", 0.0, 1.0, 1)], SCHEMA
    )
    never = df.selectExpr("id", "t", "CASE WHEN g > 0 THEN g END AS g", "y", "f", "x", "w", "cl")
    more = never.unionByName(never.where("id % 3 = 0")).unionByName(odd).selectExpr("*", "1 AS u", "2 AS c", "3 AS seen", "4 AS pairs", "5 AS x0", "6 AS `last`")
    got = att_gt_changes(more, "y", "t", "g", "id")
    assert np.allclose(want.table.att, got.table.att) and np.allclose(want.joint_vcov, got.joint_vcov)
    with pytest.raises(ValueError, match="no rows"):
        att_gt_changes(df.where("false"), "y", "t", "g", "id")
    with pytest.raises(ValueError, match="more than one cohort"):
        att_gt_changes(df.selectExpr("id", "t", "IF(id = 6 AND t > 2, 3, g) AS g", "y"), "y", "t", "g", "id")


def test_missing_comparisons_and_separation_are_named(gaps):
    _, df = gaps
    gt = att_gt_changes(df.where("NOT (g = 3 AND t = 2 AND id % 2 = 0) AND NOT (g = 3 AND t = 5 AND id % 2 = 1)"), "y", "t", "g", "id")
    assert [(g, t) for g, t, _ in gt.options["omitted"]] == [(3, 5)] and not ((gt.table.g == 3) & (gt.table.t == 5)).any()
    with pytest.raises(ValueError, match=r"separate"):
        att_gt_changes(df.selectExpr("id", "t", "g", "y", "IF(g = 3, 1.0D, 0.0D) + x * 0.1 AS z"), "y", "t", "g", "id", covariates=["z"], est="dr")
