"""SQL of least squares for the oracles: cross-products as rows, swept in a recursive query with one matrix per row."""

from __future__ import annotations

from collections.abc import Sequence


def swept_sql(entries: str, pivots: int, size: int, key: str = "0") -> str:
    """Text of (key, m): the matrices of ``entries`` (key, i, j, v; from 1, absent is 0) after sweeping the first ``pivots`` rows.

    A pivot that is nothing beside its diagonal is passed over, its row and column set to zero. With X'X swept, the
    block of the pivots holds its inverse and the other columns their coefficients.
    """
    return f"""(WITH RECURSIVE e AS (SELECT * FROM ({entries})),
        g AS (SELECT {key} AS key, i, j FROM (SELECT DISTINCT {key} FROM e), range(1, {size + 1}) a(i), range(1, {size + 1}) b(j)),
        rws AS (SELECT g.key, g.i, list(coalesce(v, 0.0)::DOUBLE ORDER BY g.j) AS r FROM g LEFT JOIN e ON e.{key} = g.key AND e.i = g.i AND e.j = g.j GROUP BY 1, 2),
        m0 AS (SELECT key, list(r ORDER BY i) AS m FROM rws GROUP BY 1),
        s AS (SELECT key, 0 AS k, m, list_transform(range(1, {size + 1}), lambda i: m[i][i]) AS d FROM m0
              UNION ALL
              SELECT key, k + 1, CASE WHEN m[k+1][k+1] > 1e-9 * d[k+1] THEN
                  list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j:
                      CASE WHEN i = k+1 AND j = k+1 THEN 1 / m[k+1][k+1] WHEN i = k+1 THEN m[i][j] / m[k+1][k+1]
                           WHEN j = k+1 THEN -m[i][j] / m[k+1][k+1] ELSE m[i][j] - m[i][k+1] * m[k+1][j] / m[k+1][k+1] END))
                  ELSE list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: CASE WHEN i = k+1 OR j = k+1 THEN 0.0 ELSE m[i][j] END)) END, d
              FROM s WHERE k < {pivots})
        SELECT key, m FROM s WHERE k = {pivots})"""


def products_sql(rows: str, size: int) -> str:
    """Text of (key, i, j, v): weighted cross-products of the list ``v`` in ``rows`` (key, w, v)."""
    return f"SELECT key, i, j, sum(w * v[i] * v[j]) AS v FROM {rows}, range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) GROUP BY 1, 2, 3"


def ols_sql(source: str, terms: dict[str, str], y: str, weight: str = "1.0", digits: int = 4) -> str:
    """Terms, estimates and standard errors of a weighted regression, as SQL on ``source``."""
    p = len(terms)
    values = ", ".join(f"({x})::DOUBLE" for x in [*terms.values(), y])
    names = ", ".join(f"'{n}'" for n in terms)
    return f"""WITH z AS MATERIALIZED (SELECT 0 AS key, ({weight})::DOUBLE AS w, [{values}] AS v FROM {source}),
        f AS MATERIALIZED (SELECT m FROM {swept_sql(products_sql("z", p + 1), p, p + 1, "key")}), n AS (SELECT count(*) AS n FROM z)
        SELECT [{names}][i] AS term, round(m[i][{p + 1}], {digits}) + 0.0 AS estimate,
               round(sqrt(m[{p + 1}][{p + 1}] / (n - {p}) * m[i][i]), {digits}) + 0.0 AS std_error
        FROM f, n, range(1, {p + 1}) r(i)"""


def clustered_within_sql(rows: str, x: Sequence[str], effect: tuple[str, int], digits: int) -> str:
    """Slopes with two absorbed effects and clustered errors, as SQL; (key, term, estimate, std_error).

    ``rows`` has key (the sample), u (first effect, also the cluster), w, y and the regressors ``x``; ``effect`` is the
    column of the second effect, whose levels are numbers from 1, and their number.
    """
    level, size = effect
    q, names = len(x) + 1, [*x, "y"]
    moment = ", ".join(f'sum(w * "{c}") AS m{i}' for i, c in enumerate(names))
    per_unit = ", ".join(f"sum(m{i}) AS u{i}" for i in range(q))
    block = " UNION ALL ".join(
        f"SELECT c.key, {level} AS i, {size + 1 + n} AS j, sum(m{n}) - sum(c.w * u{n} / u.w) AS v FROM c JOIN u USING (key, u) GROUP BY 1, 2" for n in range(q)
    )
    net = ", ".join(f'r."{c}" - m[r.{level}][{size + 1 + n}] AS "{c}"' for n, c in enumerate(names))
    centred = ", ".join(f'"{c}" - sum(w * "{c}") OVER k / sum(w) OVER k' for c in names)
    terms = ", ".join(f"'{c}'" for c in x)
    p = len(x)
    coef = [f"m[{i + 1}][{q}]" for i in range(p)]
    resid = f"(v[{q}] - " + " - ".join(f"{b} * v[{i + 1}]" for i, b in enumerate(coef)) + ")"
    return f"""WITH r AS MATERIALIZED ({rows}),
        c AS MATERIALIZED (SELECT key, u, {level}, sum(w) AS w, {moment} FROM r GROUP BY ALL), u AS MATERIALIZED (SELECT key, u, sum(w) AS w, {per_unit} FROM c GROUP BY ALL),
        e AS MATERIALIZED (SELECT key, i, j, sum(v) AS v FROM (
            SELECT key, {level} AS i, {level} AS j, w AS v FROM c
            UNION ALL SELECT a.key, a.{level}, b.{level}, -a.w * b.w / u.w FROM c a JOIN c b ON a.key = b.key AND a.u = b.u JOIN u ON u.key = a.key AND u.u = a.u
            UNION ALL {block}) GROUP BY 1, 2, 3),
        s AS MATERIALIZED (SELECT * FROM {swept_sql("SELECT * FROM e", size, size + q, "key")}),
        n AS (SELECT r.key, r.u, r.w, {net} FROM r JOIN s USING (key)),
        z AS MATERIALIZED (SELECT key, u, w, [{centred}] AS v FROM n WINDOW k AS (PARTITION BY key, u)),
        f AS MATERIALIZED (SELECT * FROM {swept_sql(products_sql("z", q), p, q, "key")}),
        g AS (SELECT z.key, z.u, {", ".join(f"sum(w * v[{i + 1}] * {resid}) AS s{i + 1}" for i in range(p))} FROM z JOIN f USING (key) GROUP BY 1, 2),
        k AS (SELECT key, count(*) AS n, count(DISTINCT u) AS units, (SELECT count(DISTINCT {level}) FROM r r2 WHERE r2.key = z.key) AS levels FROM z GROUP BY 1),
        a AS (SELECT g.key, i, sum(power({" + ".join(f"m[i][{j + 1}] * s{j + 1}" for j in range(p))}, 2)) AS v FROM g JOIN f USING (key), range(1, {p + 1}) r(i) GROUP BY 1, 2)
        SELECT key, [{terms}][i] AS term, round(m[i][{q}], {digits}) + 0.0 AS estimate,
               round(sqrt(a.v * units / (units - 1.0) * (n - 1.0) / (n - ({p} + levels - 1))), {digits}) + 0.0 AS std_error
        FROM a JOIN f USING (key) JOIN k USING (key)"""


def two_stage_sql(panel: str, label: str, units: int, periods: tuple[int, int], weight: str = "1.0", digits: int = 4) -> str:
    """Two-stage effects by ``label`` (null: none) on rows (unit from 0, t, d, y), errors clustered by unit, as SQL.

    Unit and period dummies are fitted on untreated rows; a unit's score is the residuals of its label less what its
    untreated residuals move the dummies.
    """
    first, last = periods
    size = units + last - first + 1
    dummies = f"list_concat(list_transform(range(0, {units}), lambda i: (unit = i)::INT::DOUBLE), list_transform(range({first}, {last + 1}), lambda i: (t = i)::INT::DOUBLE))"
    return f"""WITH p AS MATERIALIZED (SELECT unit, d, y::DOUBLE AS y, ({weight})::DOUBLE AS w, {label} AS term, {dummies} AS x FROM {panel}),
        z AS MATERIALIZED (SELECT 0 AS key, sum(w) AS w, list_append(x, sum(w * y) / sum(w)) AS v FROM p WHERE d = 0 GROUP BY x),
        f AS MATERIALIZED (SELECT m FROM {swept_sql(products_sql("z", size + 1), size, size + 1, "key")}),
        e AS MATERIALIZED (SELECT p.*, y - list_dot_product(x, list_transform(range(1, {size + 1}), lambda i: m[i][{size + 1}])) AS e FROM p, f),
        k AS MATERIALIZED (SELECT term, sum(w * e) / sum(w) AS b, sum(w) AS n FROM e WHERE term IS NOT NULL GROUP BY 1),
        c AS (SELECT term, i, sum(w * x[i]) AS s FROM e, range(1, {size + 1}) r(i) WHERE term IS NOT NULL GROUP BY 1, 2),
        v AS (SELECT term, list(s ORDER BY i) AS v FROM c GROUP BY 1),
        h AS MATERIALIZED (SELECT term, list_transform(range(1, {size + 1}), lambda j: list_dot_product(v, list_transform(range(1, {size + 1}), lambda i: m[i][j]))) AS h FROM v, f),
        s AS (SELECT term, unit, sum(s) AS s FROM (
            SELECT term, unit, w * (e - b) AS s FROM e JOIN k USING (term)
            UNION ALL SELECT h.term, unit, -list_dot_product(h, x) * w * e FROM e, h WHERE d = 0) GROUP BY 1, 2)
        SELECT term, round(any_value(b), {digits}) + 0.0 AS estimate, round(sqrt(sum(s * s)) / any_value(n), {digits}) + 0.0 AS std_error
        FROM s JOIN k USING (term) GROUP BY 1"""
