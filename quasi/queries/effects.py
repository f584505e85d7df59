"""T, Z and Q: difference-in-differences, time series and power."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from quasi.functions.special import normal_cdf_sql
from quasi.models import did as T
from quasi.models import series as Z
from quasi.models.changes import att_gt_changes
from quasi.models.design import factor
from quasi.models.fe import event_study_fe
from quasi.operators.windows import dense_period
from quasi.queries.algebra import clustered_within_sql, ols_sql, two_stage_sql
from quasi.queries.columns import TIMING, timing
from quasi.queries.modelling import PANEL, TWOWAY_SQL, nation_year_panel
from quasi.queries.registry import ORDERS_BY_CUSTOMER, orders_by_customer, query, r, rounded, table


def order_cohorts(spark, sf):
    """Repeated cross-sections: single orders with rollout year and a survey-style weight."""
    return orders_by_customer(spark, sf).select(
        "o_orderkey", F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("t"), timing().alias("g"),
        F.col("o_totalprice").alias("y"), (1.0 + F.col("o_orderkey") % 5).alias("w"), "c_mktsegment", "o_orderpriority",
    )


ROWS = f"""(SELECT o_orderkey, c_nationkey AS unit, year(o_orderdate) AS t, {TIMING} AS g, o_totalprice AS y, 1.0 + o_orderkey % 5 AS w, c_mktsegment, o_orderpriority
      FROM {ORDERS_BY_CUSTOMER})"""


@query(
    "t1_did_2x2",
    f"""WITH c AS (SELECT (g > 0)::INT AS a, (t >= 1998)::INT AS p, sum(w * y) / sum(w) AS m FROM {ROWS} GROUP BY 1, 2)
        SELECT 'treat_1:post_1' AS term, round(sum(CASE WHEN a = p THEN m ELSE -m END), 3) + 0.0 AS estimate FROM c""",
)
def t1(spark, sf):
    rows = order_cohorts(spark, sf).withColumn("treat", (F.col("g") > 0).cast("int")).withColumn("post", (F.col("t") >= 1998).cast("int"))
    fit = T.did_2x2(rows, "y", "treat", "post", "w")
    return rounded(fit.table(spark).where("term = 'treat_1:post_1'").select("term", "estimate"), 3)


@query(
    "t1_did_2x2_inference",
    f"""WITH x AS (SELECT (g > 0)::INT AS a, (t >= 1998)::INT AS p, y FROM {ROWS}), c AS (SELECT a, p, avg(y) AS m, count(*)::DOUBLE AS n, var_pop(y) * count(*) AS ss FROM x GROUP BY 1, 2),
             s AS (SELECT sum(ss) / (sum(n) - 4) AS s2 FROM c),
             w AS (SELECT any_value(s2) AS s2, max(m) FILTER (a=0 AND p=0) AS m00, max(m) FILTER (a=1 AND p=0) AS m10, max(m) FILTER (a=0 AND p=1) AS m01, max(m) FILTER (a=1 AND p=1) AS m11,
                          max(1/n) FILTER (a=0 AND p=0) AS v00, max(1/n) FILTER (a=1 AND p=0) AS v10, max(1/n) FILTER (a=0 AND p=1) AS v01, max(1/n) FILTER (a=1 AND p=1) AS v11 FROM c, s)
        SELECT '(Intercept)' AS term, round(m00, 3) + 0.0 AS estimate, round(sqrt(s2 * v00), 3) + 0.0 AS std_error FROM w
        UNION ALL SELECT 'treat_1', round(m10 - m00, 3) + 0.0, round(sqrt(s2 * (v00 + v10)), 3) + 0.0 FROM w
        UNION ALL SELECT 'post_1', round(m01 - m00, 3) + 0.0, round(sqrt(s2 * (v00 + v01)), 3) + 0.0 FROM w
        UNION ALL SELECT 'treat_1:post_1', round(m11 - m10 - m01 + m00, 3) + 0.0, round(sqrt(s2 * (v00 + v10 + v01 + v11)), 3) + 0.0 FROM w""",
)
def t1_inference(spark, sf):
    rows = order_cohorts(spark, sf).withColumn("treat", (F.col("g") > 0).cast("int")).withColumn("post", (F.col("t") >= 1998).cast("int"))
    return rounded(T.did_2x2(rows, "y", "treat", "post").table(spark).select("term", "estimate", "std_error"), 3)


@query(
    "t2_twfe",
    TWOWAY_SQL + """, b AS (SELECT sum(x*y) / sum(x*x) AS b, sum(x*x) AS sxx, count(*) AS n, count(DISTINCT unit) AS g FROM z),
       u AS (SELECT unit, sum(x * (y - b*x)) AS u FROM z, b GROUP BY 1)
       SELECT 'd' AS term, round(any_value(b), 4) + 0.0 AS estimate,
              round(sqrt(sum(u*u) * any_value(g) / (any_value(g) - 1.0) * (any_value(n) - 1.0) / (any_value(n) - 1.0 - (SELECT count(DISTINCT t) - 1 FROM p))) / any_value(sxx), 4) + 0.0 AS std_error FROM u, b""",
)
def t2(spark, sf):
    fit = T.twfe(nation_year_panel(spark, sf), "y", "d", "unit", "t")
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 4)


BACON_SQL = f"""WITH p AS (SELECT * FROM {PANEL}), c AS (SELECT g, t, avg(y) AS m, avg(d) AS d, count(*) AS n FROM p GROUP BY 1, 2),
    s AS (SELECT g, any_value(n)::DOUBLE / (SELECT count(DISTINCT unit) FROM p) AS sh, avg(d) AS ex FROM c GROUP BY 1),
    v AS (SELECT avg(q * q) AS v FROM (SELECT d - avg(d) OVER (PARTITION BY unit) - avg(d) OVER (PARTITION BY t) + avg(d) OVER () AS q FROM p)),
    k AS (SELECT a.g AS ga, b.g AS gb, a.sh + b.sh AS n, a.sh / (a.sh + b.sh) AS x, a.ex AS da, b.ex AS db FROM s a JOIN s b ON a.g <> b.g WHERE a.g > 0 AND (b.g = 0 OR a.g < b.g)),
    w AS (SELECT 'Treated vs Untreated' AS type, ga AS treated, gb AS control, n*n*x*(1-x)*da*(1-da)/v AS weight, ga AS cut, -1 AS lo, 9999 AS hi FROM k, v WHERE gb = 0
          UNION ALL SELECT 'Earlier vs Later Treated', ga, gb, (n*(1-db))**2*x*(1-x)*((da-db)/(1-db))*((1-da)/(1-db))/v, ga, -1, gb FROM k, v WHERE gb > 0
          UNION ALL SELECT 'Later vs Earlier Treated', gb, ga, (n*da)**2*x*(1-x)*(db/da)*((da-db)/da)/v, gb, ga, 9999 FROM k, v WHERE gb > 0),
    e AS (SELECT type, treated, control, any_value(weight) AS weight,
                 avg(a.m) FILTER (a.t >= cut) - avg(a.m) FILTER (a.t < cut) - avg(b.m) FILTER (b.t >= cut) + avg(b.m) FILTER (b.t < cut) AS estimate
          FROM w JOIN c a ON a.g = treated AND a.t >= lo AND a.t < hi JOIN c b ON b.g = control AND b.t = a.t GROUP BY 1, 2, 3)"""


@query(
    "t3_bacon",
    BACON_SQL + " SELECT type, treated::BIGINT AS treated, control::BIGINT AS control, round(estimate, 3) + 0.0 AS estimate, round(weight, 6) + 0.0 AS weight FROM e",
)
def t3(spark, sf):
    return rounded(T.bacon(nation_year_panel(spark, sf), "y", "unit", "t", "g"), 3, weight=6)


@query(
    "t3_bacon_identity",
    TWOWAY_SQL + " SELECT round(sum(x*y) / sum(x*x), 3) + 0.0 AS coefficient, 1.0::DOUBLE AS total_weight FROM z",
)
def t3_identity(spark, sf):
    """The weighted comparisons add up to the two-way fixed effects coefficient."""
    parts = T.bacon(nation_year_panel(spark, sf), "y", "unit", "t", "g")
    return parts.agg(
        r(F.sum(F.col("estimate") * F.col("weight")), 3).alias("coefficient"), r(F.sum("weight"), 6).alias("total_weight")
    )


@query(
    "t4_comparison_windows",
    f"""WITH c AS (SELECT DISTINCT g FROM {ROWS})
        SELECT a.g::VARCHAR || 'v' || b.g::VARCHAR AS comparison, count(*) AS n, round(avg(y), 4) + 0.0 AS mean FROM c a JOIN c b ON a.g <> b.g AND a.g <> 0
        JOIN {ROWS} x ON x.g IN (a.g, b.g) WHERE b.g = 0 OR (b.g > a.g AND t < b.g) OR (b.g < a.g AND t >= b.g) GROUP BY 1""",
)
def t4(spark, sf):
    windows = T.comparison_windows(order_cohorts(spark, sf), "t", "g")
    return rounded(windows.groupBy("comparison").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")), 4)


_ATT = """WITH m AS (SELECT g, t, {mean} AS y, {n} AS n FROM {source} GROUP BY 1, 2), gs AS (SELECT DISTINCT g FROM m WHERE g > 1995 AND g <= 2000), ts AS (SELECT DISTINCT t FROM m WHERE t > 1995),
    k AS (SELECT gs.g, ts.t, CASE WHEN ts.t >= gs.g THEN gs.g - 1 ELSE ts.t - 1 END AS b FROM gs, ts),
    c AS (SELECT k.g, k.t, {pool}(h.g) AS x, sum(h.n * h.y) / sum(h.n) AS yt, sum(h2.n * h2.y) / sum(h2.n) AS yb
          FROM k JOIN m h ON h.t = k.t JOIN m h2 ON h2.t = k.b AND h2.g = h.g WHERE {control} GROUP BY 1, 2),
    att AS (SELECT k.g, k.t, (a.y - b.y) - (c.yt - c.yb) AS att FROM k JOIN m a ON a.g = k.g AND a.t = k.t JOIN m b ON b.g = k.g AND b.t = k.b JOIN c ON c.g = k.g AND c.t = k.t)"""
ATT_NEVER = _ATT.format(mean="avg(y)", n="count(*)", source=PANEL, pool="count", control="h.g = 0")
ATT_NOTYET = _ATT.format(mean="avg(y)", n="count(*)", source=PANEL, pool="count", control="h.g <> k.g AND (h.g = 0 OR h.g > greatest(k.t, k.b))")
ATT_CROSS = _ATT.format(mean="sum(w * y) / sum(w)", n="sum(w)", source=ROWS, pool="count", control="h.g <> k.g AND (h.g = 0 OR h.g > greatest(k.t, k.b))")
_PICK = " SELECT g::BIGINT AS g, t::BIGINT AS t, round(att, 3) + 0.0 AS att FROM att"


def _effects(gt, spark):
    return rounded(gt.frame(spark).select("g", "t", "att"), 3)


@query("t5_att_gt_never", ATT_NEVER + _PICK)
def t5(spark, sf):
    return _effects(T.att_gt(nation_year_panel(spark, sf), "y", "t", "g", "unit"), spark)


@query("t5_att_gt_notyet", ATT_NOTYET + _PICK)
def t5_notyet(spark, sf):
    return _effects(T.att_gt(nation_year_panel(spark, sf), "y", "t", "g", "unit", control="notyet"), spark)


@query("t5_att_gt_cross_section", ATT_CROSS + _PICK)
def t5_cross(spark, sf):
    gt = T.att_gt(order_cohorts(spark, sf), "y", "t", "g", control="notyet", panel=False, weight="w", cluster="unit")
    return _effects(gt, spark)


_ADJUSTED = """WITH r AS ({rows}), c AS (SELECT g, t, s, avg(y) AS m, count(*) AS n FROM r GROUP BY 1, 2, 3), o AS (SELECT g, t, avg(y) AS m FROM r GROUP BY 1, 2),
    k AS (SELECT a.g, b.t, CASE WHEN b.t >= a.g THEN a.g - 1 ELSE b.t - 1 END AS b FROM (SELECT DISTINCT g FROM r WHERE g > 1995 AND g <= 2000) a, (SELECT DISTINCT t FROM r WHERE t > 1995) b),
    m AS (SELECT k.g, k.t, k.b, c.s, sum(c.n) AS n FROM k JOIN c ON c.g = k.g AND c.t IN (k.t, k.b) GROUP BY 1, 2, 3, 4),
    j AS (SELECT m.g, m.t, any_value(m.b) AS b, sum(m.n * (x.m - z.m)) / sum(m.n) AS adj FROM m JOIN c x ON x.g = 0 AND x.t = m.t AND x.s = m.s JOIN c z ON z.g = 0 AND z.t = m.b AND z.s = m.s GROUP BY 1, 2)
    SELECT j.g::BIGINT AS g, j.t::BIGINT AS t, round(x.m - z.m - adj, 3) + 0.0 AS att FROM j JOIN o x ON x.g = j.g AND x.t = j.t JOIN o z ON z.g = j.g AND z.t = j.b"""


@query("t5_att_gt_regression", _ADJUSTED.format(rows=f"SELECT g, t, c_mktsegment AS s, y FROM {ROWS}"))
def t5_reg(spark, sf):
    """Outcome regression on market segment, repeated cross-sections."""
    gt = T.att_gt(order_cohorts(spark, sf), "y", "t", "g", control="never", panel=False, covariates=[factor("c_mktsegment")], est="reg")
    return _effects(gt, spark)


_SEGMENT_PANEL = f"""SELECT g, t, s, avg(y) AS y FROM (SELECT unit, c_mktsegment AS s, t, g, y FROM {ROWS}) GROUP BY unit, s, t, g
    QUALIFY count(*) OVER (PARTITION BY unit, s) = 7"""


@query("t5_att_gt_doubly_robust", _ADJUSTED.format(rows=_SEGMENT_PANEL))
def t5_dr(spark, sf):
    """Nation-by-segment panel, doubly robust in the segment.

    Segments are fixed within units, so the propensity is fitted once per cohort; with a saturated
    covariate the estimate equals segment-standardised differences, which is what the SQL computes.
    """
    panel = order_cohorts(spark, sf).groupBy("unit", "c_mktsegment", "t", "g").agg(F.avg("y").alias("y"))
    panel = panel.withColumn("id", F.concat_ws("-", F.col("unit").cast("string"), "c_mktsegment"))
    return _effects(T.att_gt(panel, "y", "t", "g", "id", covariates=[factor("c_mktsegment")], est="dr"), spark)


@query(
    "t5_att_gt_dr_errors",
    f"""WITH p AS (SELECT unit::VARCHAR || '-' || s AS id, g, t, s, y FROM (SELECT unit, {_SEGMENT_PANEL.removeprefix("SELECT ")})),
        k AS (SELECT a.g, b.t, CASE WHEN b.t >= a.g THEN a.g - 1 ELSE b.t - 1 END AS b FROM (SELECT DISTINCT g FROM p WHERE g > 1995 AND g <= 2000) a, (SELECT DISTINCT t FROM p WHERE t > 1995) b),
        d AS (SELECT k.g, k.t, x.g <> 0 AS own, x.s, x.y - z.y AS dy FROM k JOIN p x ON x.t = k.t AND x.g IN (0, k.g) JOIN p z ON z.id = x.id AND z.t = k.b),
        c AS (SELECT g, t, s, avg(dy) FILTER (NOT own) AS dc, count(*) FILTER (NOT own) AS nc, count(*) FILTER (own) AS nt FROM d GROUP BY 1, 2, 3),
        a AS (SELECT g, t, avg(dy - dc) AS att, count(*)::DOUBLE AS n FROM d JOIN c USING (g, t, s) WHERE own GROUP BY 1, 2),
        v AS (SELECT g, t, any_value(att) AS att, sum((CASE WHEN own THEN (dy - dc - att) / n ELSE nt / n * (dy - dc) / nc END) ** 2) AS v FROM d JOIN c USING (g, t, s) JOIN a USING (g, t) GROUP BY 1, 2),
        u AS (SELECT count(DISTINCT id)::DOUBLE AS u FROM p)
        SELECT g::BIGINT AS g, t::BIGINT AS t, round(att, 3) + 0.0 AS att, round(sqrt(v * u / (u - 1)), 3) + 0.0 AS se FROM v, u""",
)
def t5_dr_errors(spark, sf):
    """Errors of the doubly robust effects; with a saturated covariate they have the closed form of the SQL."""
    panel = order_cohorts(spark, sf).groupBy("unit", "c_mktsegment", "t", "g").agg(F.avg("y").alias("y"))
    panel = panel.withColumn("id", F.concat_ws("-", F.col("unit").cast("string"), "c_mktsegment"))
    gt = T.att_gt(panel, "y", "t", "g", "id", covariates=[factor("c_mktsegment")], est="dr")
    return rounded(gt.frame(spark).select("g", "t", "att", "se"), 3)


_CUSTOMER_YEARS = f"""SELECT o_custkey AS id, year(o_orderdate) AS t, any_value({TIMING}) AS g, avg(o_totalprice) AS y, max((o_orderpriority = '1-URGENT')::INT) AS s
        FROM {ORDERS_BY_CUSTOMER} GROUP BY 1, 2"""
_CHANGES = """WITH p AS ({rows}), k AS (SELECT a.g, b.t, CASE WHEN b.t >= a.g THEN a.g - 1 ELSE b.t - 1 END AS b FROM (SELECT DISTINCT g FROM p WHERE g > 1995 AND g <= 2000) a, (SELECT DISTINCT t FROM p WHERE t > 1995) b),
        d AS (SELECT k.g, k.t, x.g = k.g AS own, z.s, x.y - z.y AS dy FROM k JOIN p x ON x.t = k.t AND (x.g IN (0, k.g) OR {control}) JOIN p z ON z.id = x.id AND z.t = k.b),
        u AS (SELECT count(DISTINCT id)::DOUBLE AS u FROM p)"""


def customer_years(spark, sf):
    """Customers by year, a panel with gaps: mean price and whether any order was urgent, which changes from year to year."""
    return (
        orders_by_customer(spark, sf)
        .groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("t"), timing().alias("g"))
        .agg(F.avg("o_totalprice").alias("y"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    )


@query(
    "t5_att_gt_unbalanced",
    _CHANGES.format(rows=_CUSTOMER_YEARS, control="x.g > greatest(k.t, k.b)") + """,
        m AS (SELECT g, t, own, avg(dy) AS m, var_pop(dy) / count(*) AS v FROM d GROUP BY 1, 2, 3)
        SELECT g::BIGINT AS g, t::BIGINT AS t, round(sum(CASE WHEN own THEN m ELSE -m END), 3) + 0.0 AS att, round(sqrt(sum(v) * any_value(u) / (any_value(u) - 1)), 3) + 0.0 AS se FROM m, u GROUP BY 1, 2""",
)
def t5_unbalanced(spark, sf):
    """Customers that do not order every year, against those not yet treated: each comparison uses whom it can."""
    gt = att_gt_changes(customer_years(spark, sf), "y", "t", "g", "id", control="notyet")
    return rounded(gt.frame(spark).select("g", "t", "att", "se"), 3)


_BY_BASE = _CHANGES.format(rows=_CUSTOMER_YEARS, control="false") + """,
        c AS (SELECT g, t, s, avg(dy) FILTER (NOT own) AS dc, count(*) FILTER (NOT own) AS nc, count(*) FILTER (own) AS nt FROM d GROUP BY 1, 2, 3),
        a AS (SELECT g, t, avg(dy - dc) AS att, count(*)::DOUBLE AS n FROM d JOIN c USING (g, t, s) WHERE own GROUP BY 1, 2),
        v AS (SELECT g, t, any_value(att) AS att, sum((CASE WHEN own THEN (dy - dc - att) / n ELSE nt / n * (dy - dc) / nc END) ** 2) AS v FROM d JOIN c USING (g, t, s) JOIN a USING (g, t) GROUP BY 1, 2)
        SELECT g::BIGINT AS g, t::BIGINT AS t, round(att, 3) + 0.0 AS att, round(sqrt(v * u / (u - 1)), 3) + 0.0 AS se FROM v, u"""


@query("t5_att_gt_base_covariates", _BY_BASE)
def t5_base(spark, sf):
    """Adjusted by regression for the covariate of the base year, in a panel with gaps."""
    gt = att_gt_changes(customer_years(spark, sf), "y", "t", "g", "id", covariates=[factor("urgent")])
    return rounded(gt.frame(spark).select("g", "t", "att", "se"), 3)


@query("t5_att_gt_base_covariates_dr", _BY_BASE)
def t5_base_dr(spark, sf):
    """Doubly robust in the covariate of the base year; as it is saturated, effects and errors equal the regression's."""
    gt = att_gt_changes(customer_years(spark, sf), "y", "t", "g", "id", covariates=[factor("urgent")], est="dr")
    return rounded(gt.frame(spark).select("g", "t", "att", "se"), 3)


_SHARES = ", s AS (SELECT g, sum(n)::DOUBLE AS p FROM m GROUP BY 1)"


def _aggregate(spark, sf, kind):
    gt = T.att_gt(nation_year_panel(spark, sf), "y", "t", "g", "unit")
    return rounded(T.aggregated_frame(T.aggte(gt, kind), spark).select("key", "att"), 3)


@query("t6_aggte_simple", ATT_NEVER + _SHARES + " SELECT 'overall' AS key, round(sum(att * p) / sum(p), 3) + 0.0 AS att FROM att JOIN s USING (g) WHERE t >= g")
def t6_simple(spark, sf):
    return _aggregate(spark, sf, "simple")


@query(
    "t6_aggte_dynamic",
    ATT_NEVER + _SHARES + """, e AS (SELECT t - g AS e, sum(att * p) / sum(p) AS att FROM att JOIN s USING (g) GROUP BY 1)
    SELECT e::VARCHAR AS key, round(att, 3) + 0.0 AS att FROM e UNION ALL SELECT 'overall', round(avg(att), 3) + 0.0 FROM e WHERE e >= 0""",
)
def t6_dynamic(spark, sf):
    return _aggregate(spark, sf, "dynamic")


@query(
    "t6_aggte_group",
    ATT_NEVER + _SHARES + """, e AS (SELECT g, avg(att) AS att, any_value(p) AS p FROM att JOIN s USING (g) WHERE t >= g GROUP BY 1)
    SELECT g::VARCHAR AS key, round(att, 3) + 0.0 AS att FROM e UNION ALL SELECT 'overall', round(sum(att * p) / sum(p), 3) + 0.0 FROM e""",
)
def t6_group(spark, sf):
    return _aggregate(spark, sf, "group")


@query(
    "t6_aggte_errors",
    f"""WITH p AS (SELECT * FROM {PANEL}), n AS (SELECT count(DISTINCT unit)::DOUBLE AS n FROM p), sh AS (SELECT g, count(DISTINCT unit) / any_value(n) AS p FROM p, n GROUP BY 1),
        d AS (SELECT k.g, x.t, x.unit, x.g AS own, x.y - z.y AS dy FROM (SELECT DISTINCT g FROM p WHERE g > 1995 AND g <= 2000) k JOIN p x ON x.t >= k.g AND x.g IN (0, k.g) JOIN p z ON z.unit = x.unit AND z.t = k.g - 1),
        m AS (SELECT g, t, own, avg(dy) AS m, count(*) AS k FROM d GROUP BY 1, 2, 3), att AS (SELECT g, t, sum(CASE WHEN own = 0 THEN -m ELSE m END) AS att FROM m GROUP BY 1, 2),
        w AS (SELECT g, t, att, p / sum(p) OVER () AS w, sum(p) OVER () AS total FROM att JOIN sh USING (g)), a AS (SELECT sum(w * att) AS theta FROM w),
        turn AS (SELECT sh.g, any_value(p) AS p, coalesce(sum((att - theta) / total), 0) AS turn FROM sh CROSS JOIN a LEFT JOIN w ON w.g = sh.g GROUP BY 1),
        one AS (SELECT unit, sum(w * CASE WHEN d.own = 0 THEN -(dy - m) / k ELSE (dy - m) / k END) AS e FROM d JOIN m ON m.g = d.g AND m.t = d.t AND m.own = d.own JOIN w ON w.g = d.g AND w.t = d.t GROUP BY 1),
        two AS (SELECT unit, (turn - (SELECT sum(turn * p) FROM turn)) / n AS e FROM (SELECT DISTINCT unit, g FROM p) JOIN turn USING (g), n)
        SELECT 'overall' AS key, round(any_value(theta), 3) + 0.0 AS att, round(sqrt(sum((coalesce(one.e, 0) + two.e) ** 2) * any_value(n) / (any_value(n) - 1)), 3) + 0.0 AS se FROM two LEFT JOIN one USING (unit), a, n""",
)
def t6_errors(spark, sf):
    """Error of the overall effect with the cohort shares estimated."""
    gt = T.att_gt(nation_year_panel(spark, sf), "y", "t", "g", "unit")
    return rounded(T.aggregated_frame(T.aggte(gt, "simple"), spark).select("key", "att", "se"), 3)


@query("t7_bootstrap_bands")
def t7(spark, sf):
    """Clustered multiplier bootstrap with uniform bands on event-time effects."""
    gt = T.att_gt(order_cohorts(spark, sf), "y", "t", "g", control="notyet", panel=False, weight="w", cluster="unit", draws=499)
    return rounded(T.aggregated_frame(T.aggte(gt, "dynamic"), spark, uniform=True), 3)


@query(
    "t7_analytic_errors",
    f"""WITH p AS (SELECT * FROM {PANEL}), k AS (SELECT a.g, b.t, CASE WHEN b.t >= a.g THEN a.g - 1 ELSE b.t - 1 END AS b FROM (SELECT DISTINCT g FROM p WHERE g > 1995 AND g <= 2000) a, (SELECT DISTINCT t FROM p WHERE t > 1995) b),
             d AS (SELECT k.g, k.t, x.g AS own, x.y - z.y AS dy FROM k JOIN p x ON x.t = k.t AND x.g IN (0, k.g) JOIN p z ON z.unit = x.unit AND z.t = k.b),
             m AS (SELECT g, t, own, avg(dy) AS m, var_pop(dy) / count(*) AS v FROM d GROUP BY 1, 2, 3), n AS (SELECT count(DISTINCT unit)::DOUBLE AS n FROM p),
             e AS (SELECT g, t, sum(CASE WHEN own = 0 THEN -m ELSE m END) AS att, sqrt(sum(v) * any_value(n) / (any_value(n) - 1)) AS se FROM m, n GROUP BY 1, 2)
        SELECT g::BIGINT AS g, t::BIGINT AS t, round(att, 3) + 0.0 AS att, round(se, 3) + 0.0 AS se, round(att - {NormalDist().inv_cdf(0.975)!r} * se, 3) + 0.0 AS ci_lo, round(att + {NormalDist().inv_cdf(0.975)!r} * se, 3) + 0.0 AS ci_hi FROM e""",
)
def t7_analytic(spark, sf):
    gt = T.att_gt(nation_year_panel(spark, sf), "y", "t", "g", "unit")
    return rounded(gt.frame(spark), 3)


@query("t8_pretrend_test")
def t8(spark, sf):
    gt = T.att_gt(order_cohorts(spark, sf), "y", "t", "g", panel=False)
    test = T.pretrend_test(gt)
    return rounded(spark.createDataFrame([(test["statistic"], test["df"], test["p_value"])], "statistic double, df long, p_value double"), 5)


@query("t9_did2s_static", two_stage_sql(PANEL, "CASE WHEN d = 1 THEN 'D' END", 25, (1995, 2001)))
def t9(spark, sf):
    fit = T.did2s(nation_year_panel(spark, sf), "y", "unit", "t", "d")
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 4)


@query(
    "t9_did2s_rows",
    two_stage_sql(f"(SELECT *, CASE WHEN g <> 0 AND t >= g THEN 1 ELSE 0 END AS d FROM {ROWS})", "CASE WHEN d = 1 THEN 'D' END", 25, (1995, 2001), "w"),
)
def t9_rows(spark, sf):
    """Two-stage estimate on single orders, clustered by nation."""
    rows = order_cohorts(spark, sf).withColumn("d", F.when((F.col("g") != 0) & (F.col("t") >= F.col("g")), 1).otherwise(0))
    return rounded(T.did2s(rows, "y", "unit", "t", "d", weight="w").table(spark).select("term", "estimate", "std_error"), 4)


@query("t10_did2s_event_study", two_stage_sql(PANEL, "CASE WHEN g <> 0 AND t - g <> -1 THEN 'rel_' || (t - g)::INT END", 25, (1995, 2001)))
def t10(spark, sf):
    fit = T.did2s(nation_year_panel(spark, sf), "y", "unit", "t", "d", rel="rel", keep=range(-10, 11))
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 4)


EVENTS = [v for v in range(-5, 5) if v != -1]
T11_ROWS = f"""SELECT 0 AS key, unit AS u, 1.0::DOUBLE AS w, y::DOUBLE AS y, (t - 1994)::INT AS period,
    {", ".join(f'(g <> 0 AND t - g = {v})::INT::DOUBLE AS "rel_{v}"' for v in EVENTS)} FROM {PANEL}"""


@query(
    "t11_event_study_fe",
    f"""SELECT term, estimate, std_error FROM ({clustered_within_sql(T11_ROWS, [f"rel_{v}" for v in EVENTS], ("period", 7), 4)})""",
)
def t11(spark, sf):
    fit = event_study_fe(nation_year_panel(spark, sf), "y", "rel", "unit", "t")
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 4)


@query(
    "t12_triple_difference",
    f"""WITH c AS (SELECT (g > 0)::INT AS a, (t >= 1998)::INT AS p, (c_mktsegment = 'BUILDING')::INT AS s, avg(y) AS m FROM {ROWS} GROUP BY 1, 2, 3)
        SELECT 'treat_1:post_1:sub_1' AS term, round(sum(m * (2*a-1) * (2*p-1) * (2*s-1)), 3) + 0.0 AS estimate FROM c""",
)
def t12(spark, sf):
    rows = order_cohorts(spark, sf).select(
        "y", (F.col("g") > 0).cast("int").alias("treat"), (F.col("t") >= 1998).cast("int").alias("post"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("sub"),
    )
    t = T.triple_difference(rows, "y", "treat", "post", "sub").table(spark)
    return rounded(t.where("term = 'treat_1:post_1:sub_1'").select("term", "estimate"), 3)


@query(
    "t13_switchers",
    f"""WITH p AS (SELECT *, y - lag(y) OVER w AS dy, lag(d) OVER w AS d0 FROM {PANEL} WINDOW w AS (PARTITION BY unit ORDER BY t)),
             k AS (SELECT t, avg(dy) FILTER (d <> d0) - avg(dy) FILTER (d = d0) AS e, count(*) FILTER (d <> d0) AS n FROM p WHERE dy IS NOT NULL AND d0 = 0 GROUP BY 1 HAVING count(*) FILTER (d <> d0) > 0 AND count(*) FILTER (d = d0) > 0)
        SELECT 'in' AS kind, t::BIGINT AS time, round(e, 3) + 0.0 AS effect, n AS switchers FROM k
        UNION ALL SELECT 'overall', NULL, round(sum(e * n) / sum(n), 3) + 0.0, sum(n)::BIGINT FROM k""",
)
def t13(spark, sf):
    return rounded(T.did_m(nation_year_panel(spark, sf), "y", "unit", "t", "d"), 3)


# ---------------------------------------------------------------- series


def monthly_orders(spark, sf):
    """Orders with a dense month number and calendar month."""
    rows = table(spark, sf, "orders").select(
        F.trunc("o_orderdate", "MM").alias("date"), F.month("o_orderdate").alias("month"), "o_totalprice", "o_orderstatus"
    )
    return dense_period(rows, "date", "time")


@query(
    "z1_segmented_level",
    """WITH d AS (SELECT date_trunc('month', o_orderdate) AS m, o_totalprice AS y FROM orders), k AS (SELECT m, dense_rank() OVER (ORDER BY m) AS t FROM (SELECT DISTINCT m FROM d)),
            x AS (SELECT t, y, (t >= 40)::INT AS e FROM d JOIN k USING (m)), s AS (SELECT e, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM x GROUP BY 1)
       SELECT '(Intercept)' AS term, round(a, 3) + 0.0 AS estimate FROM s WHERE e = 0
       UNION ALL SELECT 'time', round(b, 3) + 0.0 FROM s WHERE e = 0
       UNION ALL SELECT 't_exp', round(sum(CASE WHEN e = 1 THEN b ELSE -b END), 3) + 0.0 FROM s
       UNION ALL SELECT 'exp', round(sum(CASE WHEN e = 1 THEN a + 39 * b ELSE -(a + 39 * b) END), 3) + 0.0 FROM s""",
)
def z1(spark, sf):
    """Without month effects the segments are two separate lines."""
    fit = Z.segmented_regression(monthly_orders(spark, sf), "o_totalprice", "time", 40)
    return rounded(fit.table(spark).select("term", "estimate"), 3)


Z1_ROWS = """(SELECT o_totalprice, month(o_orderdate) AS mo, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) AS t FROM orders)"""
Z1_TERMS = {"(Intercept)": "1", "time": "t", "exp": "(t >= 40)::INT", "t_exp": "greatest(0, t - 39)", **{f"month_{m}": f"(mo = {m})::INT" for m in range(2, 13)}}


@query("z1_segmented_regression", ols_sql(Z1_ROWS, Z1_TERMS, "o_totalprice", digits=3))
def z1_months(spark, sf):
    fit = Z.segmented_regression(monthly_orders(spark, sf), "o_totalprice", "time", 40, "month")
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 3)


def _series(spark, sf):
    rows = monthly_orders(spark, sf)
    return rows.groupBy("o_orderstatus", "time").agg(F.avg("o_totalprice").alias("score"))


SERIES = """(SELECT o_orderstatus, time, avg(o_totalprice) AS score FROM orders JOIN (SELECT m, dense_rank() OVER (ORDER BY m) AS time FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)) ON m = date_trunc('month', o_orderdate) GROUP BY 1, 2)"""


@query(
    "z2_acf",
    f"""WITH z AS (SELECT o_orderstatus, time, score - avg(score) OVER (PARTITION BY o_orderstatus) AS z FROM {SERIES}),
             l AS (SELECT o_orderstatus, z, """ + ", ".join(f"lag(z, {k}) OVER w AS l{k}" for k in range(1, 7)) + """ FROM z WINDOW w AS (PARTITION BY o_orderstatus ORDER BY time))
       """ + " UNION ALL ".join(f"SELECT o_orderstatus, {k}::BIGINT AS lag, round(sum(z * l{k}) / sum(z * z), 6) + 0.0 AS acf FROM l GROUP BY 1" for k in range(1, 7)),
)
def z2(spark, sf):
    return rounded(Z.acf(_series(spark, sf), "time", "score", 6, ["o_orderstatus"]))


@query("z2_acf_pacf")
def z2_pacf(spark, sf):
    from quasi.operators.windows import seasonal_difference

    diffed = seasonal_difference(_series(spark, sf), ["o_orderstatus"], "time", "score")
    return rounded(Z.acf_pacf(diffed, "time", "sdiff", 12, ["o_orderstatus"]))


@query("z3_forecast_by_series")
def z3(spark, sf):
    return rounded(Z.forecast_by_series(_series(spark, sf), ["o_orderstatus"], "time", "score", 12), 3)


@query("z3_forecast_with_regressor")
def z3_regressor(spark, sf):
    series = Z.interruption_columns(_series(spark, sf), "time", 40)
    last = series.groupBy("o_orderstatus").agg(F.max("time").alias("last"))
    future = last.select("o_orderstatus", F.explode(F.sequence(F.col("last") + 1, F.col("last") + 12)).alias("time"))
    future = Z.interruption_columns(future, "time", 40)
    return rounded(Z.forecast_by_series(series, ["o_orderstatus"], "time", "score", 12, regressors=["t_exp"], future=future), 3)


@query("z4_observed_and_forecast")
def z4(spark, sf):
    series = _series(spark, sf)
    ahead = Z.forecast_by_series(series, ["o_orderstatus"], "time", "score", 12)
    return rounded(Z.observed_and_forecast(series, ahead, ["o_orderstatus"], "time", "score"), 3)


_ZA, _ZB = NormalDist().inv_cdf(0.995), NormalDist().inv_cdf(0.8)


@query(
    "q1_power_by_group",
    f"""WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, count(*) AS n FROM customer GROUP BY 1),
             k AS (SELECT *, 250.0::DOUBLE / sd AS d, 250.0::DOUBLE / sd * sqrt(n / 2.0) - {_ZA!r} AS u, -250.0::DOUBLE / sd * sqrt(n / 2.0) - {_ZA!r} AS l FROM m)
        SELECT c_mktsegment, n, round(mean, 4) + 0.0 AS mean, round(sd, 4) + 0.0 AS sd, round(d, 6) + 0.0 AS d, round({normal_cdf_sql('u')} + {normal_cdf_sql('l')}, 6) + 0.0 AS power,
               ceil(2 * (({_ZA!r} + {_ZB!r}) / d) ** 2)::BIGINT AS n_needed, round(({_ZA!r} + {_ZB!r}) * sd * sqrt(2.0 / n), 4) + 0.0 AS detectable FROM k""",
)
def q1(spark, sf):
    return rounded(Z.power_by_group(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", 250.0, alpha=0.01), 4, d=6, power=6)
