"""X and D: inverse-probability weights, balance, distribution fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.functions.special import normal_cdf_sql
from quasi.models import dist as D
from quasi.models import weighting as X
from quasi.models.design import crossed, factor
from quasi.queries.modelling import cluster_slope_sql
from quasi.queries.registry import ORDERS_BY_CUSTOMER, orders_by_customer, query, rounded, table


def _exposure(spark, sf):
    """Orders with a binary exposure and a survey-style base weight."""
    return orders_by_customer(spark, sf).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_mktsegment", "c_acctbal",
        (F.col("o_orderstatus") == "F").cast("int").alias("d"), (1.0 + F.col("o_orderkey") % 5).alias("w"),
    )


EXPOSURE = f"(SELECT *, (o_orderstatus = 'F')::INT AS d, 1.0 + o_orderkey % 5 AS w FROM {ORDERS_BY_CUSTOMER})"
SEGMENT, BOTH = [factor("c_mktsegment")], crossed(factor("c_mktsegment"), factor("o_orderpriority"))

_CELLS = f"""WITH e AS (SELECT *, avg(d) OVER (PARTITION BY c_mktsegment) AS p0, avg(d) OVER (PARTITION BY c_mktsegment, o_orderpriority) AS p1 FROM {EXPOSURE}),
     k AS (SELECT *, {{w}} AS weight FROM e) SELECT d::BIGINT AS d, c_mktsegment, count(*) AS n, round(sum(weight), 3) + 0.0 AS total, round(max(weight), 5) + 0.0 AS top FROM k GROUP BY 1, 2"""


def _by_exposure(df):
    return rounded(
        df.groupBy("d", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("top")), 3, top=5
    )


@query("x1_iptw_binary", _CELLS.format(w="CASE WHEN d = 1 THEN p0 / p1 ELSE (1 - p0) / (1 - p1) END"))
def x1(spark, sf):
    return _by_exposure(X.iptw_binary(_exposure(spark, sf), "d", SEGMENT, BOTH))


@query("x2_ipw_binary", _CELLS.format(w="CASE WHEN d = 1 THEN 1 / p1 ELSE 1 / (1 - p1) END"))
def x2(spark, sf):
    return _by_exposure(X.ipw_binary(_exposure(spark, sf), "d", BOTH))


@query(
    "x3_iptw_multinomial",
    """WITH s AS (SELECT o_orderstatus, count(*)::DOUBLE / sum(count(*)) OVER () AS p0 FROM orders GROUP BY 1),
            c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p1 FROM orders GROUP BY 1, 2)
       SELECT o_orderstatus, o_orderpriority, n, round(p0 / p1, 3) + 0.0 AS weight FROM c JOIN s USING (o_orderstatus)""",
)
def x3(spark, sf):
    w = X.iptw_multinomial(table(spark, sf, "orders"), "o_orderstatus", [], [factor("o_orderpriority")])
    return rounded(w.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")), 3)


def _by_type(df):
    return rounded(
        df.groupBy("event_type").agg(F.count("weight").alias("n"), F.avg("weight").alias("mean"), F.min("weight").alias("low")), 4
    )


_TYPE = [factor("event_type")]


@query(
    "x4_iptw_gamma",
    """WITH y AS (SELECT event_type, value + 1 AS y FROM events), m AS (SELECT *, avg(y) OVER () AS m0, avg(y) OVER (PARTITION BY event_type) AS m1, count(*) OVER () AS n FROM y),
            g AS (SELECT count(DISTINCT event_type) AS k FROM events),
            a AS (SELECT (any_value(n) - 1) / sum((y - m0) * (y - m0) / (m0 * m0)) AS a0, (any_value(n) - any_value(k)) / sum((y - m1) * (y - m1) / (m1 * m1)) AS a1 FROM m, g),
            w AS (SELECT event_type, exp(((a0 - 1) * ln(y) - y * a0 / m0 - a0 * ln(m0 / a0) - lgamma(a0)) - ((a1 - 1) * ln(y) - y * a1 / m1 - a1 * ln(m1 / a1) - lgamma(a1))) AS weight FROM m, a)
       SELECT event_type, count(weight) AS n, round(avg(weight), 4) + 0.0 AS mean, round(min(weight), 4) + 0.0 AS low FROM w GROUP BY 1""",
)
def x4(spark, sf):
    return _by_type(X.iptw_gamma(table(spark, sf, "events"), "value", [], _TYPE))


@query(
    "x5_iptw_normal",
    """WITH m AS (SELECT event_type, value AS y, avg(value) OVER () AS m0, avg(value) OVER (PARTITION BY event_type) AS m1, stddev_samp(value) OVER () AS sd FROM events),
            w AS (SELECT event_type, exp(((y - m1) * (y - m1) - (y - m0) * (y - m0)) / (2 * sd * sd)) AS weight FROM m)
       SELECT event_type, count(weight) AS n, round(avg(weight), 4) + 0.0 AS mean, round(min(weight), 4) + 0.0 AS low FROM w GROUP BY 1""",
)
def x5(spark, sf):
    return _by_type(X.iptw_normal(table(spark, sf, "events"), "value", [], _TYPE))


@query(
    "x6_iptw_heteroscedastic",
    """WITH m AS (SELECT event_type, value AS y, avg(value) OVER () AS m0, avg(value) OVER (PARTITION BY event_type) AS m1 FROM events),
            s AS (SELECT *, exp(avg(CASE WHEN y <> m0 THEN ln(abs(y - m0)) END) OVER ()) AS s0, exp(avg(CASE WHEN y <> m1 THEN ln(abs(y - m1)) END) OVER (PARTITION BY event_type)) AS s1 FROM m),
            w AS (SELECT event_type, (-(y - m0) * (y - m0) / (2 * s0 * s0) - ln(s0)) - (-(y - m1) * (y - m1) / (2 * s1 * s1) - ln(s1)) AS lw FROM s)
       SELECT event_type, count(lw) AS n, round(avg(lw), 4) + 0.0 AS mean, round(min(lw), 4) + 0.0 AS low FROM w GROUP BY 1""",
)
def x6(spark, sf):
    """Reported as log weights: the densities of large values are tiny under this scale."""
    w = X.iptw_heteroscedastic(table(spark, sf, "events"), "value", [], _TYPE)
    return _by_type(w.withColumn("weight", F.log("weight")))


@query(
    "x7_iptw_binned",
    f"""WITH o AS (SELECT o_orderpriority AS p, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS a FROM orders),
             q AS (SELECT list_prepend(0.0::DOUBLE, [{", ".join(f"quantile_cont(a, {i}.0/15.0)" for i in range(16))}]) AS cuts FROM o WHERE a <> 0),
             b AS (SELECT p, greatest(len(list_filter(cuts, lambda x: x < a)) - 1, 0) AS bin FROM o, q),
             c AS (SELECT bin, p, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY p) AS p1, sum(count(*)) OVER (PARTITION BY bin) / sum(count(*)) OVER () AS p0 FROM b GROUP BY 1, 2)
        SELECT bin::BIGINT AS bin, sum(n)::BIGINT AS n, round(sum(n * p0 / p1) / sum(n), 3) + 0.0 AS mean FROM c GROUP BY 1""",
)
def x7(spark, sf):
    """Zero bin and 15 quantile bins of order value, by order priority."""
    o = table(spark, sf, "orders").withColumn("amount", F.when(F.col("o_orderkey") % 6 == 0, 0.0).otherwise(F.col("o_totalprice")))
    w = X.iptw_binned(o, "amount", [], [factor("o_orderpriority")])
    return rounded(
        w.groupBy(F.substring("amount_bin", 1, 2).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean")), 3
    )


_RAW_WEIGHT = "CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE WHEN l_tax > 0.07 THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_discount / l_tax END"


def _raw_weights(spark, sf):
    tax, disc = F.col("l_tax"), F.col("l_discount")
    w = F.when(tax == 0, F.lit(float("inf"))).when(tax > 0.07, F.lit(None).cast("double")).when(disc == 0, 0.0).otherwise(F.try_divide(disc, tax))
    return table(spark, sf, "lineitem").withColumn("weight", w)


@query(
    "x8_weight_diagnostics",
    f"""WITH w AS (SELECT {_RAW_WEIGHT} AS weight FROM lineitem)
        SELECT CASE WHEN weight IS NULL THEN 'Missing' WHEN isinf(weight) THEN 'Infinite' WHEN weight = 0 THEN 'Zero' ELSE 'Positive weight' END AS status, count(*) AS n,
               round(avg(CASE WHEN NOT isinf(weight) THEN weight END), 5) + 0.0 AS mean, round(max(CASE WHEN NOT isinf(weight) THEN weight END), 5) + 0.0 AS max FROM w GROUP BY 1""",
)
def x8(spark, sf):
    return rounded(X.weight_diagnostics(_raw_weights(spark, sf), "weight"), 5)


@query(
    "x8_trim_weights",
    f"WITH w AS (SELECT {_RAW_WEIGHT} AS weight FROM lineitem) SELECT count(*) AS n, round(sum(weight), 3) + 0.0 AS total FROM w WHERE weight IS NOT NULL AND NOT isinf(weight) AND weight BETWEEN 0.3 AND 4.1",
)
def x8_trim(spark, sf):
    kept = X.trim_weights(_raw_weights(spark, sf), "weight", 0.3, 4.1)
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")), 3)


_STATS = f"""WITH s AS (SELECT d::VARCHAR AS stratum, v.variable, count(v.x) AS n, sum(w * v.x) / sum(w) AS mean, sum(w * v.x * v.x) / sum(w) AS m2
      FROM {EXPOSURE}, LATERAL (VALUES ('o_totalprice', o_totalprice), ('c_acctbal', c_acctbal)) v(variable, x) GROUP BY 1, 2),
     t AS (SELECT *, (m2 - mean * mean) * n / (n - 1.0) AS var FROM s)"""


@query(
    "x9_table_one",
    _STATS + f""", c AS (SELECT d::VARCHAR AS stratum, c_mktsegment AS level, count(*) AS n, sum(w) / sum(sum(w)) OVER (PARTITION BY d) AS mean FROM {EXPOSURE} GROUP BY d, c_mktsegment)
       SELECT variable, NULL::VARCHAR AS level, stratum, n, round(mean, 3) + 0.0 AS mean, round(sqrt(var), 3) + 0.0 AS sd FROM t
       UNION ALL SELECT 'c_mktsegment', level, stratum, n, round(mean, 3) + 0.0, NULL FROM c""",
)
def x9(spark, sf):
    return rounded(X.table_one(_exposure(spark, sf), "d", ["o_totalprice", "c_acctbal"], ["c_mktsegment"], "w"), 3)


@query(
    "x10_smd",
    _STATS + f""", b AS (SELECT d, sum(w * (c_mktsegment = 'BUILDING')::INT) / sum(w) AS p FROM {EXPOSURE} GROUP BY 1)
       SELECT a.variable, round(abs(a.mean - z.mean) / sqrt((a.var + z.var) / 2), 6) + 0.0 AS smd FROM t a JOIN t z ON a.variable = z.variable AND a.stratum < z.stratum
       UNION ALL SELECT 'building', round(abs(x.p - y.p) / sqrt((x.p * (1 - x.p) + y.p * (1 - y.p)) / 2), 6) + 0.0 FROM b x JOIN b y ON x.d < y.d""",
)
def x10(spark, sf):
    e = _exposure(spark, sf).withColumn("building", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return rounded(X.smd(e, "d", ["o_totalprice", "c_acctbal"], ["building"], "w"))


@query(
    "x10_smd_pairs",
    """WITH s AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
       SELECT 'o_totalprice' AS variable, round(avg(abs(a.m - b.m) / sqrt((a.v + b.v) / 2)), 6) + 0.0 AS smd FROM s a JOIN s b ON a.g < b.g""",
)
def x10_pairs(spark, sf):
    """Three strata: the mean over pairs."""
    return rounded(X.smd(table(spark, sf, "orders"), "o_orderstatus", ["o_totalprice"]))


def _t_sql(x, design, w):
    return f"SELECT '{x}' AS variable, '{x}' AS term, '{design}' AS design, round(t, 5) + 0.0 AS t_val FROM {cluster_slope_sql(EXPOSURE, 'o_totalprice', x, w, 'o_custkey')}"


@query(
    "x11_balance_tstats",
    " UNION ALL ".join(_t_sql(x, d, w) for x in ("d", "c_acctbal") for d, w in (("unweighted", "1.0"), ("weighted", "w"))),
)
def x11(spark, sf):
    return rounded(X.balance_tstats(_exposure(spark, sf), "o_totalprice", ["d", "c_acctbal"], "w", "o_custkey"), 5)


# ---------------------------------------------------------------- distributions


@query(
    "d1_gamma_moments",
    "SELECT event_type, count(*) AS n, round(avg(value) ** 2 / var_samp(value), 6) + 0.0 AS shape, round(var_samp(value) / avg(value), 6) + 0.0 AS scale FROM events GROUP BY 1",
)
def d1(spark, sf):
    return rounded(D.gamma_moments(table(spark, sf, "events"), "value", ["event_type"]))


_FIT = "WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS s2, covar_samp(value, ln(value)) AS b FROM events WHERE value > 0 GROUP BY 1)"


@query("d2_gamma_fit", _FIT + " SELECT event_type, n, round(m / b, 6) + 0.0 AS shape, round(b, 6) + 0.0 AS scale FROM g")
def d2(spark, sf):
    return rounded(D.gamma_fit(table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "d3_gamma_test",
    _FIT + f", v AS (SELECT event_type, n, sqrt(n * m / b) * (s2 / (m * b) - 1) AS v FROM g), z AS (SELECT *, -abs(v) / sqrt(2.0::DOUBLE) AS z FROM v) SELECT event_type, n, round(v, 6) + 0.0 AS v, round(2 * {normal_cdf_sql('z')}, 6) + 0.0 AS p_value FROM z",
)
def d3(spark, sf):
    return rounded(D.gamma_test(table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "d4_exponential_test",
    f"""WITH x AS (SELECT event_type, value / avg(value) OVER (PARTITION BY event_type) AS u FROM events WHERE value > 0),
             s AS (SELECT event_type, count(*) AS n, count(*) + sum((1 - u) * ln(u)) AS co FROM x GROUP BY 1), z AS (SELECT event_type, n, sqrt(6.0::DOUBLE / n) * co / pi() AS z FROM s),
             k AS (SELECT *, -abs(z) AS q FROM z)
        SELECT event_type, n, round(z, 6) + 0.0 AS z, round(2 * {normal_cdf_sql('q')}, 6) + 0.0 AS p_value FROM k""",
)
def d4(spark, sf):
    return rounded(D.exponential_test(table(spark, sf, "events"), "value", ["event_type"]))


@query(
    "d5_lognormal_test",
    f"""WITH l AS (SELECT ln(value) AS x FROM events WHERE value > 0), s AS (SELECT x, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z, row_number() OVER (ORDER BY x) AS i, count(*) OVER ()::DOUBLE AS n FROM l),
             c AS (SELECT {normal_cdf_sql('z')} AS f, i, n FROM s)
        SELECT round(max(greatest(f - (i - 1) / n, i / n - f)), 6) + 0.0 AS statistic FROM c""",
)
def d5(spark, sf):
    return rounded(D.lognormal_test(table(spark, sf, "events"), "value").select("statistic"))


@query(
    "d6_fitted_density",
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w, count(*)::DOUBLE AS n FROM events),
            c AS (SELECT least(floor((value - lo) / w), 29)::BIGINT AS bin, count(*) AS k FROM events, b GROUP BY 1),
            x AS (SELECT bin, lo + (bin + 0.5) * w AS x, k / n / w AS density FROM c, b), f AS (SELECT avg(value) / covar_samp(value, ln(value)) AS a, covar_samp(value, ln(value)) AS s FROM events WHERE value > 0)
       SELECT bin, round(x, 5) + 0.0 AS x, round(density, 6) + 0.0 AS density, round(exp((a - 1) * ln(x) - x / s - a * ln(s) - lgamma(a)), 6) + 0.0 AS fitted FROM x, f""",
)
def d6(spark, sf):
    ev = table(spark, sf, "events")
    shape, scale = D.gamma_fit(ev, "value").select("shape", "scale").first()
    return rounded(D.fitted_density(ev, "value", shape, scale), x=5)
