"""Estimators against numpy."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quasi.models import fe as E
from quasi.models import weighting as X
from quasi.models.design import crossed, factor, poly
from quasi.models.fe import fe_ols
from quasi.models.glm import Separated, gamma_glm, logit, multinomial
from quasi.models.knn import knn_predict, nearest, smote
from quasi.models.linear import aliased_terms, ols, survey_glm
from quasi.models.mixed import random_intercept_logit
from quasi.operators.agg import crosstab
from quasi.models.scoring import coefficient_map, score_expr, score_long


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 1500
    pdf = pd.DataFrame({
        "id": np.arange(n), "u": rng.integers(0, 30, n), "t": rng.integers(0, 6, n), "f": rng.choice(list("abc"), n),
        "x": rng.normal(size=n), "w": rng.uniform(0.5, 2, n),
    })
    pdf["y"] = 1 + 2 * pdf.x + (pdf.f == "b") * 0.5 + pdf.u * 0.1 + pdf.t * 0.3 + rng.normal(size=n)
    pdf["d"] = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 0.8 * pdf.x - 0.5 * (pdf.f == "c"))))).astype(int)
    pdf["k"] = [("lo", "mid", "hi")[v] for v in rng.integers(0, 3, n)]
    pdf["pos"] = rng.gamma(2.0, np.exp(0.2 + 0.3 * (pdf.f == "b")) / 2.0)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def design(pdf):
    return np.column_stack([np.ones(len(pdf)), pdf.x, pdf.f == "b", pdf.f == "c"]).astype(float)


@pytest.mark.parametrize("weight", [None, "w"])
def test_least_squares(data, weight):
    pdf, df = data
    a, w = design(pdf), (pdf.w if weight else pd.Series(np.ones(len(pdf)))).to_numpy()
    inv = np.linalg.inv(a.T @ (a * w[:, None]))
    b = inv @ (a.T @ (w * pdf.y))
    e = pdf.y - a @ b
    fit = ols(df, "y", ["x", factor("f")], weight)
    assert np.allclose(fit.coef, b) and fit.names == ["(Intercept)", "x", "f_b", "f_c"]
    assert np.allclose(fit.se, np.sqrt(np.diag(inv) * (w * e * e).sum() / (len(pdf) - 4)))


def test_merged_cells_change_nothing(data):
    _, df = data
    terms = crossed(factor("f"), factor("t"))
    a, b = ols(df, "y", terms, "w"), ols(df, "y", terms, "w", merge=False)
    assert np.allclose(a.coef, b.coef) and np.allclose(a.se, b.se) and a.stats["r_squared"] == pytest.approx(b.stats["r_squared"])


def test_clustered_variance(data):
    pdf, df = data
    a, w = design(pdf), pdf.w.to_numpy()
    inv = np.linalg.inv(a.T @ (a * w[:, None]))
    e = pdf.y - a @ (inv @ (a.T @ (w * pdf.y)))
    s = np.array([((w * e).to_numpy()[:, None] * a)[pdf.u == u].sum(0) for u in range(30)])
    want = inv @ (s.T @ s * 30 / 29) @ inv
    assert np.allclose(survey_glm(df, "y", ["x", factor("f")], "w", "u").vcov, want)


def test_aliased_and_polynomial(data):
    pdf, df = data
    flags = {r["term"]: r["aliased"] for r in aliased_terms(df.withColumn("x2", 3 * F.col("x") - 1), ["x", "x2", factor("f")]).collect()}
    assert flags == {"(Intercept)": 0, "x": 0, "x2": 1, "f_b": 0, "f_c": 0}
    fit = ols(df, "y", ["x", "x2"] if False else [poly("x", 3)])
    q = np.linalg.lstsq(np.vander(pdf.x, 4), pdf.y, rcond=None)[0]
    assert fit.stats["rss"] == pytest.approx(((pdf.y - np.vander(pdf.x, 4) @ q) ** 2).sum())


def irls(a, y):
    b = np.zeros(a.shape[1])
    for _ in range(30):
        m = 1 / (1 + np.exp(-a @ b))
        h = a.T @ (a * (m * (1 - m))[:, None])
        b = b + np.linalg.solve(h, a.T @ (y - m))
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logit_and_scoring(spark, data):
    pdf, df = data
    b, se = irls(design(pdf), pdf.d.to_numpy())
    fit = logit(df, "d", ["x", factor("f")])
    assert np.allclose(fit.coef, b, atol=1e-7) and np.allclose(fit.se, se, atol=1e-6)
    assert np.allclose(logit(df, "d", ["x", factor("f")], positive=0).coef, -b, atol=1e-7)
    # Long scoring, expression scoring and the model agree.
    dummies = dict(zip(fit.names, fit.design.columns))
    wide = df.select("id", *[dummies[n].alias(n) for n in fit.names if n != "(Intercept)"])
    table = fit.table(spark)
    long = {r["id"]: r["prob"] for r in score_long(wide, "id", [c for c in wide.columns if c != "id"], table).collect()}
    by_expr = df.select("id", (1 / (1 + F.exp(-score_expr(coefficient_map(table), dummies)))).alias("p"), fit.mean().alias("m"))
    for r in by_expr.collect():
        assert r["p"] == pytest.approx(r["m"]) and long[r["id"]] == pytest.approx(r["m"])


@pytest.mark.parametrize("link", ["inverse", "log"])
def test_gamma(data, link):
    pdf, df = data
    fit = gamma_glm(df, "pos", [factor("f")], link)
    means = pdf.groupby("f").pos.mean()
    want = 1 / means if link == "inverse" else np.log(means)
    assert np.allclose(fit.coef, [want["a"], want["b"] - want["a"], want["c"] - want["a"]], rtol=1e-6)
    mu = pdf.f.map(means)
    assert fit.stats["dispersion"] == pytest.approx((((pdf.pos - mu) / mu) ** 2).sum() / (len(pdf) - 3), rel=1e-6)
    # Intercept-only dispersion gives the moment shape.
    only = gamma_glm(df, "pos", [], link)
    assert only.stats["shape"] == pytest.approx(pdf.pos.mean() ** 2 / pdf.pos.var(), rel=1e-6)


def test_gamma_inverse_with_numeric_term(data):
    pdf, df = data
    fit = gamma_glm(df, "pos", ["x"], "inverse")
    mu = 1 / (fit.coef[0] + fit.coef[1] * pdf.x)
    assert (mu > 0).all()
    score = [(pdf.pos - mu).sum(), ((pdf.pos - mu) * pdf.x).sum()]
    assert np.allclose(score, 0, atol=1e-5)


def test_multinomial(data):
    pdf, df = data
    model = multinomial(df, "k", [factor("f")])
    want = pd.crosstab(pdf.f, pdf.k, normalize="index")
    for r in model.add_probabilities(df.select("f").distinct()).collect():
        assert all(r[f"p_{k}"] == pytest.approx(want.loc[r["f"], k], abs=1e-7) for k in ("lo", "mid", "hi"))
    seen = model.add_observed(df, "k", "p").select("f", "k", "p").distinct().collect()
    assert all(r["p"] == pytest.approx(want.loc[r["f"], r["k"]], abs=1e-7) for r in seen)


@pytest.mark.parametrize("cluster", ["u", "t", "id"])
def test_fixed_effects(data, cluster, monkeypatch):
    pdf, df = data
    dummies = np.column_stack([np.eye(30)[pdf.u], np.eye(6)[pdf.t][:, 1:]])
    a = np.column_stack([pdf.x, dummies])
    b = np.linalg.lstsq(a, pdf.y, rcond=None)[0]
    e = (pdf.y - a @ b).to_numpy()
    xt = pdf.x.to_numpy() - dummies @ np.linalg.lstsq(dummies, pdf.x, rcond=None)[0]
    fit = fe_ols(df, "y", ["x"], ["u", "t"], cluster=cluster)
    assert fit.coef[0] == pytest.approx(b[0])
    s = pd.Series(xt * e).groupby(pdf[cluster].to_numpy()).sum().to_numpy()
    n, g = len(pdf), len(s)
    nested = {"u": 30, "t": 6, "id": 0}[cluster]
    want = np.sqrt((s @ s) * g / (g - 1) * (n - 1) / (n - (1 + 35 - nested))) / (xt @ xt)
    assert fit.se[0] == pytest.approx(want)
    for held in (0, 3):
        monkeypatch.setattr(E, "HELD", held)
        other = fe_ols(df, "y", ["x"], ["u", "t"], cluster=cluster)
        assert other.coef[0] == pytest.approx(fit.coef[0], rel=1e-8) and other.se[0] == pytest.approx(fit.se[0], rel=1e-8)


def _dense_random_intercept(x, y, of, groups, steps=60):
    """Penalised weighted least squares on the whole design; the variance repeats its update until it stays."""
    beta, b, variance = np.zeros(x.shape[1]), np.zeros(groups), 0.25
    beta[0] = np.log(y.mean() / (1 - y.mean()))
    z = np.eye(groups)[of]
    both, p = np.hstack([x, z]), x.shape[1]
    for _ in range(steps):
        eta = x @ beta + b[of]
        mu = 1 / (1 + np.exp(-eta))
        curve = mu * (1 - mu)
        work, last = eta + (y - mu) / curve, 0.0
        gram, right = (both * curve[:, None]).T @ both, both.T @ (curve * work)
        while abs(variance - last) > 1e-11:
            last, full = variance, gram.copy()
            full[p:, p:] += np.eye(groups) / variance
            found = np.linalg.solve(full, right)
            variance = float(np.mean(found[p:] ** 2 + 1 / (z.T @ curve + 1 / variance)))
        beta, b = found[:p], found[p:]
    return beta, b, variance, np.sqrt(np.diag(np.linalg.inv(full))[:p])


@pytest.mark.parametrize("numeric", [False, True])
def test_random_intercept_against_dense_algebra(spark, numeric):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        shift = rng.normal(0, 0.8)
        for i in range(50):
            v = float(rng.uniform()) if numeric else float(i % 2)
            rows.append((g, "ab"[i % 2], v, int(rng.uniform() < 1 / (1 + np.exp(-(-0.3 + 0.7 * v + shift))))))
    df = spark.createDataFrame(rows, "g int, f string, v double, y int")
    found = random_intercept_logit(df, "y", ["v" if numeric else factor("f")], "g")
    x = np.array([(1.0, r[2]) for r in rows])
    beta, b, variance, se = _dense_random_intercept(x, np.array([float(r[3]) for r in rows]), np.array([r[0] for r in rows]), 40)
    assert found.fit.coef == pytest.approx(beta, abs=1e-5) and found.variance == pytest.approx(variance, rel=1e-4)
    assert found.fit.se == pytest.approx(se, rel=1e-4)
    effects = {int(r[0]): r[1] for r in found.effects.collect()}
    assert [effects[g] for g in range(40)] == pytest.approx(list(b), abs=1e-4)
    with pytest.raises(RuntimeError, match="not converged"):
        random_intercept_logit(df, "y", ["v"], "g", max_iter=1)


def test_random_intercept_of_many_groups_is_that_of_few(spark):
    """Every group a thousand times: fixed effects, variance and intercepts stay, errors shrink by the root."""
    rng = np.random.default_rng(6)
    cells = spark.createDataFrame(
        [(g, f, int(rng.uniform() < 0.3 + 0.4 * (g % 2) + 0.1 * (f == "b"))) for g in range(50) for f in "ab" for _ in range(10)], "g int, f string, y int"
    )
    few = random_intercept_logit(cells, "y", [factor("f")], "g")
    copies = cells.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(999)))).withColumn("g", F.concat_ws("-", "g", "copy"))
    many = random_intercept_logit(copies, "y", [factor("f")], "g")
    assert many.effects.count() == 50_000
    assert many.fit.coef == pytest.approx(few.fit.coef, abs=1e-6) and many.variance == pytest.approx(few.variance, rel=1e-5)
    assert many.fit.se * np.sqrt(1000) == pytest.approx(few.fit.se, rel=1e-5)


def test_effects_of_unconnected_blocks_and_nested_clusters(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for u in range(20):
        for t in range(6):
            x = rng.normal() + u % 3
            rows.append((u, t + 10 * (u // 10), u // 2, float(x), float(1.5 * x + u + 0.3 * t + rng.normal())))
    df = spark.createDataFrame(rows, "u int, t int, g int, x double, y double")
    dense = fe_ols(df, "y", ["x"], ["u", "t"], cluster="g")
    plain = fe_ols(df, "y", ["x"], ["u", "t"])
    monkeypatch.setattr(E, "HELD", 5)
    other = fe_ols(df, "y", ["x"], ["u", "t"], cluster="g")
    assert dense.stats["absorbed"] == other.stats["absorbed"] == 20 + 12 - 2
    assert other.coef[0] == pytest.approx(dense.coef[0], rel=1e-8) and other.se[0] == pytest.approx(dense.se[0], rel=1e-8)
    assert plain.se[0] == pytest.approx(fe_ols(df, "y", ["x"], ["u", "t"]).se[0], rel=1e-8)
    monkeypatch.undo()

    # Against dummy variables: 20 unit effects lie inside the clusters and are not counted.
    pdf = df.toPandas()
    d = np.column_stack([pdf.u.to_numpy()[:, None] == np.arange(20), pdf.t.to_numpy()[:, None] == np.unique(pdf.t)]).astype(float)
    q, s, _ = np.linalg.svd(d, full_matrices=False)
    q = q[:, s > 1e-9]
    x, y = (v - q @ (q.T @ v) for v in (pdf.x.to_numpy(), pdf.y.to_numpy()))
    e = y - x * (x @ y) / (x @ x)
    scores = np.array([(x * e)[pdf.g == g].sum() for g in range(10)])
    used = 1 + 30 - 20
    se = np.sqrt((scores ** 2).sum()) / (x @ x) * np.sqrt(10 / 9 * 119 / (120 - used))
    assert dense.se[0] == pytest.approx(se, rel=1e-6)
    with pytest.raises(RuntimeError, match="not converged"):
        monkeypatch.setattr(E, "HELD", 0)
        monkeypatch.setattr(E, "solve_levels", functools.partial(E.solve_levels, max_steps=1))
        fe_ols(df, "y", ["x"], ["u", "t"])


def test_split_samples_share_cells_and_held_levels_need_no_step(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for u in range(150):
        for t in range(5):
            for s in ("p", "q", None):
                x = float(rng.normal() + t + u % 7)
                rows.append((u, f"t{t}", u // 3, s, "ab"[(u + t) % 2] if s != "q" else "a", x, float(1.5 * x + u * 0.1 + t + rng.normal())))
    df = spark.createDataFrame([r for r in rows if rng.random() < 0.9], "u int, t string, g int, s string, f string, x double, y double").cache()
    calls = {"moment_cells": 0, "off_units": 0}

    def counted(name, plain):
        def call(*args):
            calls[name] += 1
            return plain(*args)

        monkeypatch.setattr(E, name, call)

    for name in calls:
        counted(name, getattr(E, name))
    fits = E.fe_ols_split(df, "s", ["p", "q"], y="y", x=["x"], fe=["u", "t"], cluster="g")
    assert calls == {"moment_cells": 1, "off_units": 3}
    # A factor that has one level in a sample has no regressor there.
    other = E.fe_ols_split(df, "s", ["q"], y="y", x=["x", factor("f")], fe=["u", "t"])
    assert len(other["all"].names) == 2 and other["q"].names == ["x"]
    monkeypatch.undo()
    for sample, part in (("all", df), ("p", df.where("s = 'p'")), ("q", df.where("s = 'q'"))):
        alone = fe_ols(part, "y", ["x"], ["u", "t"], cluster="g")
        pdf = part.toPandas()
        d = np.column_stack([pdf.u.to_numpy()[:, None] == np.unique(pdf.u), pdf.t.to_numpy()[:, None] == np.unique(pdf.t)]).astype(float)
        x, y = (v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (pdf.x.to_numpy(), pdf.y.to_numpy()))
        assert fits[sample].n == len(pdf) and fits[sample].coef[0] == pytest.approx(x @ y / (x @ x), rel=1e-9)
        assert fits[sample].se[0] == pytest.approx(alone.se[0], rel=1e-9) and fits[sample].stats["absorbed"] == alone.stats["absorbed"]


def test_gram_leaves_out_null_rows_at_any_width(spark, monkeypatch):
    import quasi.models.linear as L

    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (4.0, None), (5.0, 6.0)], "a double, b double")
    narrow = L.gram(df, [F.col("a"), F.col("b"), F.lit(1.0)])
    monkeypatch.setattr(L, "JVM_SUMS", 0)
    assert (L.gram(df, [F.col("a"), F.col("b"), F.lit(1.0)]) == narrow).all() and narrow[2, 2] == 2
    assert (L.gram(df.where("false"), [F.col("a"), F.col("b")]) == 0).all()


def test_grid_metrics(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import DecisionTreeRegressor

    from quasi.models.learners import tune_grid

    rows = [(float(i % 3), float(i % 7), float((i % 3) + (i % 7 > 3)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "c double, x double, z double, fold int")
    grid = [{"maxDepth": 1}, {"maxDepth": 4}]
    for metric, learner, label in (("rmse", DecisionTreeRegressor(labelCol="x"), "x"), ("accuracy", DecisionTreeClassifier(labelCol="c"), "c")):
        out = tune_grid(df, label, ["z"], learner, grid, "fold", 2, metric=metric).collect()
        values = [r[metric] for r in out]
        assert values == sorted(values, reverse=metric == "accuracy") and len(values) == 2


def test_crosstab_margins(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y")], "f string, k string")
    assert {(r.f, r.k): r.column_share for r in crosstab(df, "f", "k", margin="column").collect()} == {("a", "x"): 1.0, ("a", "y"): 2 / 3, ("b", "y"): 1 / 3}
    assert {(r.f, r.k): r.total_share for r in crosstab(df, "f", "k", margin="total").collect()} == {("a", "x"): 0.25, ("a", "y"): 0.5, ("b", "y"): 0.25}


def brute(a, b, k, skip_self):
    d = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(-1))
    if skip_self:
        np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_nearest_with_many_copies(spark, monkeypatch):
    import quasi.models.knn as K

    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 3))
    v[:200] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in row], int(i % 4)) for i, row in enumerate(v)], "id int, vec array<double>, label int")
    got = nearest(df, df, 4, exclude_self=True).toPandas().sort_values(["query_id", "rank"])
    d = np.sqrt(((v[:, None, :] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got.groupby("query_id").size().eq(4).all()
    assert np.allclose(got.dist.to_numpy().reshape(600, 4), np.sort(d, axis=1)[:, :4], atol=1e-9)
    assert (got.train_id.to_numpy().reshape(600, 4)[250:] == brute(v, v, 4, True)[250:]).all()
    votes = knn_predict(df, df, 1, "label").toPandas()
    assert len(votes) == 600


def test_separated_levels_are_named_and_can_be_dropped(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 5}", int(i % 5 == 1 or (i % 5 not in (1, 3) and rng.random() < 0.3 + 0.1 * (i % 5))), "uv"[i % 2], float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, y int, f string, x double")
    for terms in ([factor("s"), factor("f")], [factor("s"), "x"]):
        with pytest.raises(Separated, match="s_s1, s_s3"):
            logit(df, "y", terms)
        fit, rest = logit(df, "y", terms, separated="drop"), logit(df.where("s NOT IN ('s1', 's3')"), "y", terms)
        assert fit.stats["separated"] == ["s_s1", "s_s3"] and fit.n == 240
        want = dict(zip(rest.names, rest.coef))
        for name, b in zip(fit.names, fit.coef):
            assert np.isnan(b) if name in ("s_s1", "s_s3") else b == pytest.approx(want[name], abs=1e-6)
        p = {(r.s, r.p) for r in df.select("s", fit.mean().alias("p")).where("s IN ('s1', 's3')").collect()}
        assert p == {("s1", 1.0), ("s3", 0.0)}


def test_separating_combinations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x if abs(a + b) > 0.4], "a double, b double, y int")
    with pytest.raises(Separated, match="a \\+ b"):
        logit(df, "y", ["a", "b"])
    with pytest.raises(Separated, match="every row"):
        logit(df, "y", ["a", "b"], separated="drop")
    # Only rows with u = 1 are certain; the others are fitted.
    mixed = [(int(u), float(a), int(rng.random() < 0.5 + 0.2 * np.tanh(a)) if not u else int(a > 0)) for u, a in zip(rng.random(400) < 0.2, rng.normal(size=400))]
    df = spark.createDataFrame(mixed, "u int, a double, y int").selectExpr("u", "y", "a * (1 - u) AS a", "u * IF(a > 0, 1, -1) AS v")
    fit = logit(df, "y", ["a", "v"], separated="drop")
    rest = logit(df.where("u = 0"), "y", ["a"])
    assert fit.coef[:2] == pytest.approx(rest.coef, abs=1e-6) and fit.n == df.where("u = 0").count()


def test_train_rows_go_only_to_routed_blocks(spark, monkeypatch):
    import quasi.models.knn as K

    monkeypatch.setattr(K, "BLOCK_ROWS", 32)
    monkeypatch.setattr(K, "PIVOT_SPARSITY", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 2)) * 100
    v = np.concatenate([c + rng.normal(size=(80, 2)) for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, vec array<double>")
    sides = []
    plain = K._routed_blocks

    def watched(*args):
        sides.extend(plain(*args))
        return tuple(sides)

    monkeypatch.setattr(K, "_routed_blocks", watched)
    got = nearest(df, df, 3).toPandas().sort_values(["query_id", "rank"])
    assert (got.train_id.to_numpy().reshape(-1, 3) == brute(v, v, 3, False)).all()
    left, right = (x.select(*K.BLOCK_KEYS).toPandas() for x in sides)
    assert {tuple(k) for k in left.to_numpy()} <= {tuple(k) for k in right.to_numpy()}
    # With every train row in every query block there would be 960 rows in at least 30 blocks.
    assert len(left) < 960 * 30 / 4


def test_neighbour_search_holds_one_block_at_a_time(spark, monkeypatch):
    import quasi.models.knn as K

    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 4))
    v[100:200] = 1e3 + v[:100]
    v[200:300] = v[100:200]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, vec array<double>")
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    monkeypatch.setattr(K, "TILE_QUERIES", 16)
    monkeypatch.setattr(K, "TILE_ROWS", 32)
    monkeypatch.setattr(K, "WAITING_PAIRS", 100)
    sides = []
    plain = K._routed_blocks
    monkeypatch.setattr(K, "_routed_blocks", lambda *args: sides.extend(plain(*args)) or sides)
    got = nearest(df, df, 4).toPandas().sort_values(["query_id", "rank"])
    # Exact copies tie at zero, also far from the origin where matrix products cancel.
    d = np.sqrt(((v[:, None, :] - v[None]) ** 2).sum(-1))
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got.train_id.to_numpy().reshape(900, 4) == want).all()
    # A query is one row with its vector, whatever the number of cells it is routed to.
    assert sides[1].count() == 900
    assert sides[1].groupBy(*K.BLOCK_KEYS).count().agg(F.max("count")).first()[0] < 3 * 64


def test_neighbours_pass_over_all_rows_of_their_own_id(spark):
    rows = [(i % 30, [float(i % 30), float((i % 30) ** 2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    got = nearest(df, df, 4, exclude_self=True).toPandas()
    assert got.groupby("query_id").size().eq(4).all() and (got.query_id != got.train_id).all()
    for q, part in got.groupby("query_id"):
        gaps = [(np.hypot(q - t, q * q - t * t), t) for t in range(30) if t != q]
        assert set(part.train_id) == {min(gaps)[1]}


def test_oversampling(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i < 100 else ("small" if i < 120 else "tiny"), [float(x) for x in rng.normal(size=2)]) for i in range(127)]
    df = spark.createDataFrame(rows, "id int, label string, vec array<double>")
    made = smote(df, "id", "label", "vec", 0.75).toPandas()
    assert made.groupby("label").size().to_dict() == {"big": 100, "small": 75, "tiny": 75}
    source = {i: np.array(v) for i, _, v in rows}
    for label, ids in (("small", range(100, 120)), ("tiny", range(120, 127))):
        members = np.array([source[i] for i in ids])
        near = brute(members, members, 5, True)
        for _, r in made[(made.label == label) & (made.synthetic == 1)].iterrows():
            # A copy is its source, moved by one share of the way to one of the five nearest of its class.
            gap = np.array(r.vec) - source[r.id]
            ways = members[near[r.id - ids[0]]] - source[r.id]
            share = (ways @ gap) / (ways * ways).sum(axis=1)
            fits = np.linalg.norm(ways * share[:, None] - gap, axis=1) < 1e-9
            assert (fits & (share > -1e-12) & (share < 1 + 1e-12)).any()


def test_weighting_improves_balance(data):
    _, df = data
    weighted = X.iptw_binary(df, "d", [], ["x", factor("f")])
    before = {r["variable"]: r["smd"] for r in X.smd(df, "d", ["x"], ["f"]).collect()}
    after = {r["variable"]: r["smd"] for r in X.smd(weighted, "d", ["x"], ["f"], "weight").collect()}
    assert before["x"] > 0.5 and after["x"] < 0.1 and after["f"] < before["f"]


def test_weight_trim(spark):
    df = spark.createDataFrame([(0.0,), (float("inf"),), (None,), (float("nan"),), (2.0,), (50.0,)], "w double")
    assert {r["status"]: r["n"] for r in X.weight_diagnostics(df, "w").collect()} == {"Zero": 1, "Infinite": 1, "Missing": 2, "Positive weight": 2}
    assert X.trim_weights(df, "w").count() == 3 and X.trim_weights(df, "w", upper=10.0).count() == 2


def test_balance_of_all_covariates_is_that_of_single_models(spark):
    rng = np.random.default_rng(3)
    rows = [
        (float(rng.normal() + (i % 3)), float(rng.normal()) if i % 7 else None, "abc"[i % 3] if i % 11 else None,
         float(rng.uniform(0.5, 2)) if i % 13 else None, i % 20 if i % 17 else None, float("nan") if i % 19 == 0 else float(i % 5))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "e double, x double, f string, w double, c int, z double")
    covariates = ["x", factor("f"), "z"]
    found = {(r["variable"], r["term"], r["design"]): r["t_val"] for r in X.balance_tstats(df, "e", covariates, "w", "c").collect()}
    want = {}
    for c in covariates:
        for design, w in (("unweighted", None), ("weighted", "w")):
            fit = survey_glm(df, "e", [c], w, "c")
            want |= {(c if isinstance(c, str) else c.column, r[0], design): r[3] for r in fit.rows()[1:]}
    assert found.keys() == want.keys() and len(found) == 8
    assert all(found[k] == pytest.approx(want[k], rel=1e-8) for k in want)
