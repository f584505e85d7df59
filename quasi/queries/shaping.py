"""R, J, W, P: reshaping, joins, windows, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.functions.columns import benefit_change_class
from quasi.operators import reshape as R
from quasi.operators import sample as P
from quasi.operators import windows as W
from quasi.operators.agg import drop_last, weighted_rate
from quasi.queries.columns import TIMING, timing
from quasi.queries.registry import ORDERS_BY_CUSTOMER, orders_by_customer, query, r, rounded, table


def scenarios(spark, sf):
    """Two policy runs per order: revenue before and after the discount."""
    li = table(spark, sf, "lineitem")
    gross, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_orderkey").agg(F.sum(gross).alias("lba"), F.sum(net).alias("uc"))


@query(
    "r1_pivot_scenarios",
    """SELECT l_suppkey, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 4) + 0.0 AS a_price,
              count(*) FILTER (l_returnflag = 'A') AS a_n,
              round(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 4) + 0.0 AS n_price,
              count(*) FILTER (l_returnflag = 'N') AS n_n,
              round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) + 0.0 AS r_price,
              count(*) FILTER (l_returnflag = 'R') AS r_n
       FROM lineitem GROUP BY 1""",
)
def r1(spark, sf):
    long = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.lower("l_returnflag").alias("policy"))
        .agg(F.avg("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))
    )
    wide = R.pivot_scenarios(long, ["l_suppkey"], "policy", ["a", "n", "r"], ["price", "n"])
    return rounded(wide.fillna(0, ["a_n", "n_n", "r_n"]), 4)


@query(
    "r2_pivot_longer",
    """SELECT 'discount' AS metric, count(*) AS n, round(avg(l_discount), 6) + 0.0 AS mean FROM lineitem
       UNION ALL SELECT 'extendedprice', count(*), round(avg(l_extendedprice), 6) + 0.0 FROM lineitem
       UNION ALL SELECT 'tax', count(*), round(avg(l_tax), 6) + 0.0 FROM lineitem""",
)
def r2(spark, sf):
    long = R.pivot_longer(
        table(spark, sf, "lineitem"), [], ["l_discount", "l_extendedprice", "l_tax"], "metric", "value", r"l_(.*)", True
    )
    return rounded(long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query(
    "r3_pivot_longer_fields",
    """WITH g AS (SELECT l_suppkey, avg(l_quantity) q, min(l_quantity) ql, avg(l_tax) t, min(l_tax) tl FROM lineitem GROUP BY 1)
       SELECT l_suppkey, 'quantity' AS metric, round(q, 6) + 0.0 AS estimate, round(ql, 6) + 0.0 AS low FROM g
       UNION ALL SELECT l_suppkey, 'tax', round(t, 6) + 0.0, round(tl, 6) + 0.0 FROM g""",
)
def r3(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("quantity_estimate"), F.min("l_quantity").alias("quantity_95% CI"),
        F.avg("l_tax").alias("tax_estimate"), F.min("l_tax").alias("tax_95% CI"),
    )
    return rounded(
        R.pivot_longer_fields(wide, ["l_suppkey"], ["quantity", "tax"], {"estimate": "estimate", "95% CI": "low"})
    )


@query(
    "r4_per_outcome",
    """SELECT 'l_quantity' AS outcome, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_samp(l_quantity), 6) + 0.0 AS sd FROM lineitem GROUP BY 2
       UNION ALL SELECT 'l_tax', l_returnflag, count(*), round(avg(l_tax), 6) + 0.0, round(stddev_samp(l_tax), 6) + 0.0 FROM lineitem GROUP BY 2""",
)
def r4(spark, sf):
    return rounded(
        R.per_outcome(
            table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], ["l_returnflag"],
            [F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd")],
        )
    )


@query(
    "r5_stack_rows",
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS v, stddev_samp(o_totalprice) / sqrt(count(*)) AS se FROM orders GROUP BY 1)
       SELECT date, 'observed' AS obs, round(v, 4) + 0.0 AS score, NULL::DOUBLE AS lower_ci FROM m
       UNION ALL SELECT date, 'pred', round(v + se, 4) + 0.0, round(v - se, 4) + 0.0 FROM m""",
)
def r5(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(
        F.avg("o_totalprice").alias("v"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    observed = m.select("date", F.lit("observed").alias("obs"), F.col("v").alias("score"))
    predicted = m.select(
        "date", F.lit("pred").alias("obs"), (F.col("v") + F.col("se")).alias("score"), (F.col("v") - F.col("se")).alias("lower_ci")
    )
    return rounded(R.stack_rows(observed, predicted), 4)


@query(
    "j1_scenario_join",
    """WITH a AS (SELECT l_orderkey, sum(l_extendedprice) AS lba FROM lineitem GROUP BY 1),
            b AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS uc FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
       SELECT count(*) AS n, count(uc) AS n_matched, round(sum(lba), 2) + 0.0 AS lba, round(sum(uc), 2) + 0.0 AS uc FROM a LEFT JOIN b USING (l_orderkey)""",
)
def j1(spark, sf):
    li = table(spark, sf, "lineitem")
    legacy = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("lba"))
    new = li.where(F.col("l_returnflag") != "A").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("uc")
    )
    return R.scenario_join(legacy, new, ["l_orderkey"]).agg(
        F.count(F.lit(1)).alias("n"), F.count("uc").alias("n_matched"), r(F.sum("lba"), 2).alias("lba"), r(F.sum("uc"), 2).alias("uc")
    )


@query(
    "j2_lookup_observed",
    """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
            p AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS prob FROM c)
       SELECT o_orderstatus, count(*) AS n, round(avg(prob), 6) + 0.0 AS mean_prob FROM orders LEFT JOIN p USING (o_orderpriority, o_orderstatus) GROUP BY 1""",
)
def j2(spark, sf):
    """Each row's probability of its own level from a long class-probability table."""
    from quasi.operators.agg import weighted_share

    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    probs = weighted_share(o, ["o_orderpriority"], "o_orderstatus").withColumnRenamed("o_orderstatus", "level")
    joined = R.lookup_observed(o, probs, ["o_orderpriority"], "o_orderstatus", "level", "share", "prob")
    return rounded(joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob")))


@query(
    "j3_reported_vs_observed",
    """WITH rep AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum((l_returnflag = 'N')::INT * l_quantity) / sum(l_quantity) AS prop_rep FROM lineitem GROUP BY 1),
            obs AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS prop_obs FROM orders GROUP BY 1)
       SELECT date, round(prop_rep, 6) + 0.0 AS prop_rep, round(prop_obs, 6) + 0.0 AS prop_obs FROM rep JOIN obs USING (date)""",
)
def j3(spark, sf):
    rep = weighted_rate(
        table(spark, sf, "lineitem"), [F.trunc("l_shipdate", "MM").alias("date")], F.col("l_returnflag") == "N", "l_quantity", "prop_rep"
    )
    obs = weighted_rate(
        table(spark, sf, "orders"), [F.trunc("o_orderdate", "MM").alias("date")], F.col("o_orderstatus") == "F", F.lit(1.0), "prop_obs"
    )
    return rounded(rep.join(obs, "date", "inner"))


@query(
    "j4_dimension_joins",
    f"""WITH b AS (SELECT c_nationkey, avg(o_totalprice) AS base FROM {ORDERS_BY_CUSTOMER} WHERE year(o_orderdate) = 1995 GROUP BY 1)
        SELECT r_name, {TIMING}::BIGINT AS timing, count(*) AS n, round(avg(o_totalprice - base), 4) + 0.0 AS change
        FROM {ORDERS_BY_CUSTOMER} o LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
             LEFT JOIN b USING (c_nationkey) GROUP BY 1, 2""",
)
def j4(spark, sf):
    """Rows joined to region, rollout and baseline tables; Spark picks the join by measured size."""
    rows = orders_by_customer(spark, sf)
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    base = rows.where(F.year("o_orderdate") == 1995).groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("base"))
    joined = (
        rows.join(nation, rows.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .join(base, "c_nationkey", "left")
    )
    return rounded(
        joined.groupBy("r_name", timing().alias("timing")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("o_totalprice") - F.col("base")).alias("change")
        ),
        4,
    )


@query(
    "j5_threshold_grid",
    """SELECT thr, count(*) AS n, count(*) FILTER (l_discount > thr) AS above FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE)) v(thr) GROUP BY 1""",
)
def j5(spark, sf):
    long = R.grid_rows(table(spark, sf, "lineitem").select("l_discount"), "thr", [0.02, 0.05, 0.08])
    return long.groupBy("thr").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_discount") > F.col("thr"), 1)).alias("above")
    )


@query(
    "j6_key_bind",
    """WITH s AS (SELECT l_orderkey, sum(l_quantity) * 3000 AS pred FROM lineitem GROUP BY 1)
       SELECT o_orderstatus, count(*) AS n, count(pred) AS n_pred, round(avg(o_totalprice - pred), 4) + 0.0 AS gap
       FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY 1""",
)
def j6(spark, sf):
    """Predictions next to rows by key; never by position."""
    preds = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        (F.sum("l_quantity") * 3000).alias("pred")
    )
    joined = table(spark, sf, "orders").join(preds, "o_orderkey", "left")
    return rounded(
        joined.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_pred"), F.avg(F.col("o_totalprice") - F.col("pred")).alias("gap")
        ),
        4,
    )


# ---------------------------------------------------------------- windows


def monthly_status(spark, sf):
    """Monthly mean order value by status: one row per (status, month)."""
    return table(spark, sf, "orders").groupBy(
        "o_orderstatus", F.trunc("o_orderdate", "MM").alias("month")
    ).agg(F.avg("o_totalprice").alias("score"))


MONTHLY_STATUS = """(SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2)"""


@query(
    "w1_lag_difference",
    f"SELECT o_orderstatus, month, round(score - lag(score) OVER (PARTITION BY o_orderstatus ORDER BY month), 4) + 0.0 AS diff FROM {MONTHLY_STATUS}",
)
def w1(spark, sf):
    return rounded(W.lag_difference(monthly_status(spark, sf), ["o_orderstatus"], "month", "score").drop("score"), 4)


@query(
    "w2_seasonal_difference",
    f"""WITH s AS (SELECT o_orderstatus, month, score - lag(score, 12) OVER (PARTITION BY o_orderstatus ORDER BY month) AS sd FROM {MONTHLY_STATUS})
        SELECT o_orderstatus, month, round(sd - lag(sd) OVER (PARTITION BY o_orderstatus ORDER BY month), 4) + 0.0 AS sdiff FROM s""",
)
def w2(spark, sf):
    return rounded(W.seasonal_difference(monthly_status(spark, sf), ["o_orderstatus"], "month", "score").drop("score"), 4)


@query(
    "w3_dense_period",
    """WITH p AS (SELECT date_trunc('month', o_orderdate) AS m, o_totalprice FROM orders), d AS (SELECT m, dense_rank() OVER (ORDER BY m) AS time FROM (SELECT DISTINCT m FROM p))
       SELECT time::BIGINT AS time, count(*) AS n, round(avg(o_totalprice), 4) + 0.0 AS mean FROM p JOIN d USING (m) GROUP BY 1""",
)
def w3(spark, sf):
    rows = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("m"), "o_totalprice")
    return rounded(W.dense_period(rows, "m").groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@query(
    "w4_row_before_last",
    """WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
       SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM k WHERE rn < n GROUP BY 1""",
)
def w4(spark, sf):
    kept = drop_last(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("w5_sort", "SELECT o_custkey, year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 2, 1")
def w5(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy("year", "o_custkey")


@query("w6_head", "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def w6(spark, sf):
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return rounded(top.select("o_orderkey", "o_totalprice"), 2)


# ---------------------------------------------------------------- sampling


@query(
    "p1_stratified_split",
    """WITH k AS (SELECT o_orderkey, year(o_orderdate) AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5(o_orderkey::VARCHAR || '|11'), o_orderkey) AS rn, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders)
       SELECT y::BIGINT AS year, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM k GROUP BY 1, 2""",
)
def p1(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    split = P.stratified_split(rows, "o_orderkey", ["year"], 0.8, seed=11)
    return rounded(split.groupBy("year", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")))


@query(
    "p2_mc_cv",
    """WITH l AS (SELECT o_orderkey, i AS resample_id, md5(i::VARCHAR || ':' || o_orderkey::VARCHAR || '|3') AS h FROM orders, range(1, 26) t(i)),
            k AS (SELECT *, row_number() OVER (PARTITION BY resample_id ORDER BY h, resample_id::VARCHAR || ':' || o_orderkey::VARCHAR) AS rn, count(*) OVER (PARTITION BY resample_id) AS n FROM l)
       SELECT resample_id::BIGINT AS resample_id, (rn <= floor(0.75 * n))::BIGINT AS in_analysis, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM k GROUP BY 1, 2""",
)
def p2(spark, sf):
    long = P.mc_cv(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 25, 0.75, seed=3)
    return rounded(long.groupBy("resample_id", "in_analysis").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")))


@query(
    "p3_vfold_cv",
    """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|5'), o_orderkey) AS rn FROM orders)
       SELECT ((rn - 1) % 10)::BIGINT AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM k GROUP BY 1""",
)
def p3(spark, sf):
    folds = P.vfold_cv(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, seed=5)
    return rounded(folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")))


@query(
    "p4_sample_per_group",
    """WITH k AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || '|1'), c_custkey) AS rn FROM customer)
       SELECT c_nationkey::BIGINT AS c_nationkey, c_custkey FROM k WHERE rn <= 2""",
)
def p4(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return rounded(P.sample_per_group(rows, "c_custkey", ["c_nationkey"], 2, seed=1))


@query(
    "p4_sample_rows",
    "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|400'), o_orderkey LIMIT 400",
)
def p4_rows(spark, sf):
    return rounded(P.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 400, seed=400), 2)


@query(
    "r_benefit_change_class",
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS lba, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 1.1 ELSE l_extendedprice * (1 - l_discount) END) AS uc FROM lineitem GROUP BY 1)
       SELECT CASE WHEN uc = 0 AND lba = 0 THEN 'No change' WHEN lba = 0 AND uc > 0 THEN 'Increase' WHEN (uc - lba) / nullif(lba, 0) >= 0.02 THEN 'Increase'
                   WHEN abs((uc - lba) / nullif(lba, 0)) < 0.02 THEN 'No change' ELSE 'Decrease' END AS change, count(*) AS n FROM s GROUP BY 1""",
)
def r_change(spark, sf):
    """Three-way benefit change between two scenarios."""
    price = F.col("l_extendedprice")
    new = F.when(F.col("l_returnflag") == "R", price * 1.1).otherwise(price * (1 - F.col("l_discount")))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(price).alias("lba"), F.sum(new).alias("uc"))
    return s.groupBy(benefit_change_class("uc", "lba").alias("change")).agg(F.count(F.lit(1)).alias("n"))
