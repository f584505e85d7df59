"""A: grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.operators import agg as A
from quasi.queries.columns import CODED_CUSTOMERS, _coded_customers
from quasi.queries.registry import query, r, rounded, table


@query(
    "a1_household_totals",
    """WITH h AS (SELECT *, sum(o_totalprice) OVER w AS lba_income, max(o_totalprice) OVER w AS uc_income FROM orders WINDOW w AS (PARTITION BY year(o_orderdate), o_custkey))
       SELECT o_orderpriority, count(*) AS n, round(avg(lba_income), 4) + 0.0 AS lba_income, round(avg(uc_income), 4) + 0.0 AS uc_income FROM h GROUP BY 1""",
)
def a1(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    h = A.household_totals(o, ["year", "o_custkey"], {"lba_income": "o_totalprice"}, {"uc_income": "o_totalprice"})
    return rounded(
        h.groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.avg("lba_income").alias("lba_income"), F.avg("uc_income").alias("uc_income")
        ),
        4,
    )


@query(
    "a2_household_counts",
    """WITH h AS (SELECT *, count(*) FILTER (o_orderstatus = 'F') OVER w AS n_f, count(*) FILTER (o_totalprice < 50000) OVER w AS n_small FROM orders WINDOW w AS (PARTITION BY year(o_orderdate), o_custkey))
       SELECT n_f, n_small, count(*) AS n FROM h GROUP BY 1, 2""",
)
def a2(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    h = A.household_totals(
        o, ["year", "o_custkey"],
        counts={"n_f": F.col("o_orderstatus") == "F", "n_small": F.col("o_totalprice") < 50000},
    )
    return h.groupBy("n_f", "n_small").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_weighted_rate",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(sum((l_returnflag = 'R')::INT * l_quantity) / sum(l_quantity), 6) + 0.0 AS rate FROM lineitem GROUP BY 1""",
)
def a3(spark, sf):
    return rounded(
        A.weighted_rate(table(spark, sf, "lineitem"), [F.trunc("l_shipdate", "MM").alias("month")], F.col("l_returnflag") == "R", "l_quantity")
    )


@query(
    "a4_weighted_share",
    """WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus, sum(o_totalprice) AS w FROM orders GROUP BY 1, 2)
       SELECT month, o_orderstatus, round(w, 2) + 0.0 AS weight, round(w / sum(w) OVER (PARTITION BY month), 6) + 0.0 AS share FROM c""",
)
def a4(spark, sf):
    o = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("month"), "o_orderstatus", "o_totalprice")
    return rounded(A.weighted_share(o, ["month"], "o_orderstatus", "o_totalprice"), weight=2)


@query(
    "a5_group_means",
    """SELECT year(l_shipdate)::BIGINT AS year, round(avg(l_quantity), 6) + 0.0 AS l_quantity_mean, round(avg(l_discount), 6) + 0.0 AS l_discount_mean,
              round(stddev_samp(l_quantity), 6) + 0.0 AS l_quantity_sd, round(stddev_samp(l_discount), 6) + 0.0 AS l_discount_sd FROM lineitem GROUP BY 1""",
)
def a5(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return rounded(A.group_means(li, ["year"], ["l_quantity", "l_discount"], sd=True))


@query(
    "a6_mean_se",
    """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY 1)
       SELECT event_type, n, round(mean, 6) + 0.0 AS mean, round(se, 6) + 0.0 AS se, round(mean - se, 6) + 0.0 AS lo, round(mean + se, 6) + 0.0 AS hi FROM g""",
)
def a6(spark, sf):
    return rounded(A.mean_se(table(spark, sf, "events"), ["event_type"], "value"))


@query("a6_mean_cl_normal")
def a6_t(spark, sf):
    return rounded(A.mean_cl_normal(table(spark, sf, "events"), ["event_type"], "value"))


@query(
    "a7_missing_rate",
    f"""SELECT 'bal' AS "column", round(avg((bal IS NULL OR bal IN (-9, -8))::INT), 6) + 0.0 AS missing FROM {CODED_CUSTOMERS}
        UNION ALL SELECT 'c_nationkey', round(avg((c_nationkey IS NULL OR c_nationkey IN (-9, -8))::INT), 6) + 0.0 FROM customer""",
)
def a7(spark, sf):
    df = _coded_customers(spark, sf).withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    return rounded(A.missing_rate(df, ["bal", "c_nationkey"]))


@query(
    "a8_quantiles",
    """SELECT event_type, prob, round(quantile_cont(value, prob), 6) + 0.0 AS value FROM events, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE)) v(prob) GROUP BY event_type, prob"""
    .replace("quantile_cont(value, prob)", "CASE prob WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.99 THEN quantile_cont(value, 0.99) ELSE quantile_cont(value, 0.999) END"),
)
def a8(spark, sf):
    return rounded(A.quantiles(table(spark, sf, "events"), "value", [0.25, 0.5, 0.99, 0.999], ["event_type"]))


@query(
    "a8_trim_above_quantile",
    """SELECT count(*) AS n, round(max(value), 2) + 0.0 AS top, round(sum(value), 2) + 0.0 AS total FROM events WHERE value < (SELECT quantile_cont(value, 0.99) FROM events)""",
)
def a8_trim(spark, sf):
    kept = A.trim_above_quantile(table(spark, sf, "events"), "value", 0.99)
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.sum("value").alias("total")), 2)


@query("a8_approximate_quantiles")
def a8_approx(spark, sf):
    return A.approximate_quantiles(table(spark, sf, "events"), "value", [0.5, 0.99], ["event_type"])


_HISTOGRAM = """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
     c AS (SELECT event_type, least(floor((value - lo) / w), 29)::BIGINT AS bin, sum(1 + event_id % 3)::DOUBLE AS n FROM events, b GROUP BY 1, 2)"""


@query(
    "a9_histogram",
    _HISTOGRAM + """ SELECT event_type, bin, round(n, 2) + 0.0 AS "count", round(lo + bin * w, 6) + 0.0 AS x_lo, round(lo + (bin + 1) * w, 6) + 0.0 AS x_hi,
        round(n / sum(n) OVER (), 6) + 0.0 AS proportion FROM c, b""",
)
def a9(spark, sf):
    ev = table(spark, sf, "events")
    return rounded(A.histogram(ev, "value", 30, 1 + F.col("event_id") % 3, "proportion", ["event_type"]))


@query(
    "a9_histogram_density",
    _HISTOGRAM + """ SELECT event_type, bin, round(n, 2) + 0.0 AS "count", round(lo + bin * w, 6) + 0.0 AS x_lo, round(lo + (bin + 1) * w, 6) + 0.0 AS x_hi,
        round(n / sum(n) OVER (PARTITION BY event_type) / w, 6) + 0.0 AS density FROM c, b""",
)
def a9_density(spark, sf):
    ev = table(spark, sf, "events")
    return rounded(A.histogram(ev, "value", 30, 1 + F.col("event_id") % 3, "density", ["event_type"]))


@query(
    "a10_crosstab",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) + 0.0 AS row_share FROM orders GROUP BY 1, 2""",
)
def a10(spark, sf):
    return rounded(A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"))


@query(
    "a11_rows_at_max",
    "SELECT l_orderkey, l_partkey, l_suppkey, round(l_tax, 2) + 0.0 AS l_tax FROM lineitem WHERE l_quantity + 100 * l_tax = (SELECT max(l_quantity + 100 * l_tax) FROM lineitem)",
)
def a11(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity") + 100 * F.col("l_tax"))
    return rounded(A.rows_at_max(li, "x").select("l_orderkey", "l_partkey", "l_suppkey", "l_tax"), 2)


@query(
    "a12_first_per_group",
    """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def a12(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rounded(A.first_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate"), 2)


@query(
    "a13_moments",
    """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean_x, round(avg(l_quantity), 6) + 0.0 AS mean_y, round(var_samp(l_extendedprice), 0) + 0.0 AS var_x,
              round(var_samp(l_quantity), 4) + 0.0 AS var_y, round(covar_samp(l_extendedprice, l_quantity), 2) + 0.0 AS cov_xy FROM lineitem GROUP BY 1""",
)
def a13(spark, sf):
    m = A.moments(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(m, 4, mean_y=6, var_x=0, cov_xy=2)


@query(
    "a13_summary_numbers",
    """SELECT event_type, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(median(value), 6) + 0.0 AS median,
              round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(max(value), 6) + 0.0 AS max FROM events GROUP BY 1""",
)
def a13_summary(spark, sf):
    return rounded(A.summary_numbers(table(spark, sf, "events"), "value", ["event_type"]))


@query("a14_category_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def a14(spark, sf):
    return A.category_count(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
