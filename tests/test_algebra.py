"""The sweep written as SQL against numpy."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from quasi.queries.algebra import clustered_within_sql, ols_sql, products_sql, swept_sql, two_stage_sql


def test_weighted_regression_and_aliased_terms():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"a": rng.normal(size=60), "b": rng.uniform(size=60), "w": rng.uniform(0.5, 2, 60)})
    rows["y"] = 1 + 2 * rows.a - rows.b + rng.normal(size=60)
    con = duckdb.connect()
    con.register("rows", rows)
    got = {t: (b, se) for t, b, se in con.execute(ols_sql("rows", {"one": "1", "a": "a", "b": "b"}, "y", "w", 8)).fetchall()}
    x, w = np.column_stack([np.ones(60), rows.a, rows.b]), rows.w.to_numpy()
    inverse = np.linalg.inv((x * w[:, None]).T @ x)
    b = inverse @ (x * w[:, None]).T @ rows.y
    sigma = (w * (rows.y - x @ b) ** 2).sum() / 57
    assert [got[t][0] for t in ("one", "a", "b")] == pytest.approx(list(b), abs=1e-7)
    assert [got[t][1] for t in ("one", "a", "b")] == pytest.approx(list(np.sqrt(sigma * np.diag(inverse))), abs=1e-7)
    twice = products_sql("(SELECT 0 AS key, 1.0 AS w, [1.0, a, 2 * a, y] AS v FROM rows)", 4)
    ((matrix,),) = con.execute(f"SELECT m FROM {swept_sql(twice, 3, 4, 'key')}").fetchall()
    assert matrix[2] == [0.0] * 4 and all(r[2] == 0.0 for r in matrix)


def test_absorbed_and_two_stage_effects():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(u, t) for u in range(8) for t in range(1, 6) if (u + t) % 7], columns=["unit", "t"])
    rows["d"] = ((rows.unit > 3) & (rows.t > 3)).astype(int)
    rows["y"] = rows.unit + 0.5 * rows.t + 2 * rows.d + rng.normal(size=len(rows))
    con = duckdb.connect()
    con.register("rows", rows)
    dummies = np.column_stack([np.eye(8)[rows.unit], np.eye(5)[rows.t - 1]])
    both = np.column_stack([rows.d, dummies])
    source = "SELECT 0 AS key, unit AS u, 1.0 AS w, y, d::DOUBLE AS d, t::INT AS level FROM rows"
    ((_, term, b, se),) = con.execute(clustered_within_sql(source, ["d"], ("level", 5), 8)).fetchall()
    full = np.linalg.lstsq(both, rows.y, rcond=None)[0]
    x = rows.d - dummies @ np.linalg.lstsq(dummies, rows.d, rcond=None)[0]
    scores = (x * (rows.y - both @ full)).groupby(rows.unit).sum()
    n = len(rows)
    want = np.sqrt((scores**2).sum() * 8 / 7 * (n - 1) / (n - 5)) / (x @ x)
    assert term == "d" and b == pytest.approx(full[0], abs=1e-7) and se == pytest.approx(want, abs=1e-7)
    ((term, b, _),) = con.execute(two_stage_sql("rows", "CASE WHEN d = 1 THEN 'D' END", 8, (1, 5), digits=8)).fetchall()
    plain = rows.d == 0
    gap = rows.y - dummies @ np.linalg.lstsq(dummies[plain], rows.y[plain], rcond=None)[0]
    assert b == pytest.approx(gap[rows.d == 1].mean(), abs=1e-7)
    rows["w"] = rng.uniform(0.5, 2, len(rows))
    con.register("weighted", rows)
    ((_, b, _),) = con.execute(two_stage_sql("weighted", "CASE WHEN d = 1 THEN 'D' END", 8, (1, 5), "w", 8)).fetchall()
    root = np.sqrt(rows.w[plain]).to_numpy()
    gap = rows.y - dummies @ np.linalg.lstsq(dummies[plain] * root[:, None], rows.y[plain] * root, rcond=None)[0]
    assert b == pytest.approx(np.average(gap[rows.d == 1], weights=rows.w[rows.d == 1]), abs=1e-7)
