"""C: projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.functions import columns as C
from quasi.functions.special import normal_cdf_sql
from quasi.models.design import build_design, dummy_encode, interact, poly
from quasi.operators.reshape import select_by_name
from quasi.queries.registry import ORDERS_BY_CUSTOMER, orders_by_customer, query, r, rounded, table


def _coded_customers(spark, sf):
    """Customers whose balance carries the two missing codes."""
    bal = F.col("c_acctbal")
    return table(spark, sf, "customer").withColumn(
        "bal", F.when(bal < -500, -9.0).when(bal < 0, -8.0).otherwise(bal)
    )


CODED_CUSTOMERS = """(SELECT *, CASE WHEN c_acctbal < -500 THEN -9.0 WHEN c_acctbal < 0 THEN -8.0 ELSE c_acctbal END AS bal FROM customer)"""


@query(
    "c1_sentinel_to_null",
    f"""SELECT c_mktsegment, count(*) AS n, count(CASE WHEN bal NOT IN (-9, -8) THEN bal END) AS n_valid,
               round(avg(CASE WHEN bal NOT IN (-9, -8) THEN bal END), 4) + 0.0 AS mean_bal
        FROM {CODED_CUSTOMERS} GROUP BY 1""",
)
def c1(spark, sf):
    df = _coded_customers(spark, sf).withColumn("bal", C.sentinel_to_null("bal"))
    return df.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count("bal").alias("n_valid"), r(F.avg("bal"), 4).alias("mean_bal")
    )


@query(
    "c2_floor_and_zero",
    """SELECT c_nationkey::BIGINT AS c_nationkey, round(sum(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END), 2) + 0.0 AS floored,
              round(avg(coalesce(CASE WHEN c_acctbal >= 1000 THEN c_acctbal END, 0)), 6) + 0.0 AS zeroed
       FROM customer GROUP BY 1""",
)
def c2(spark, sf):
    bal = F.col("c_acctbal")
    return rounded(
        table(spark, sf, "customer").groupBy("c_nationkey").agg(
            r(F.sum(C.clip_floor(bal)), 2).alias("floored"),
            r(F.avg(C.null_to_zero(F.when(bal >= 1000, bal))), 6).alias("zeroed"),
        )
    )


@query(
    "c3_topcode",
    """SELECT l_returnflag, round(sum(least(l_extendedprice, 50000)), 2) + 0.0 AS income,
              round(sum(CASE WHEN l_extendedprice = 0 THEN 1.0 ELSE 0 END)::DOUBLE, 0) + 0.0 AS i_0,
              round(sum(CASE WHEN l_extendedprice >= 50000 THEN 1.0 ELSE 0 END)::DOUBLE, 0) + 0.0 AS i_m,
              round(sum(CASE WHEN l_extendedprice >= 50000 THEN 0 ELSE l_extendedprice END), 2) + 0.0 AS i_l
       FROM lineitem GROUP BY 1""",
)
def c3(spark, sf):
    parts = C.topcode("l_extendedprice", 50000.0)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        *[r(F.sum(c), 2).alias(name) for name, c in parts.items()]
    )


CUT_BREAKS = [0.0, 10.0, 20.0, 30.0, 50.0]


@query(
    "c4_cut",
    """WITH b AS (SELECT l_quantity q FROM lineitem)
       SELECT CASE WHEN q >= 0 AND q < 10 THEN '[0,10)' WHEN q >= 10 AND q < 20 THEN '[10,20)'
                   WHEN q >= 20 AND q < 30 THEN '[20,30)' WHEN q >= 30 AND q <= 50 THEN '[30,50]' END AS left_closed,
              CASE WHEN q > 0 AND q <= 10 THEN 'low' WHEN q > 10 AND q <= 20 THEN 'mid' WHEN q > 20 AND q <= 40 THEN 'high' END AS right_closed,
              count(*) AS n FROM b GROUP BY 1, 2""",
)
def c4(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            C.cut("l_quantity", CUT_BREAKS, right=False, include_lowest=True).alias("left_closed"),
            C.cut("l_quantity", [0, 10, 20, 40], labels=["low", "mid", "high"]).alias("right_closed"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "c5_recode_first_match",
    """WITH k AS (SELECT l_partkey % 35 AS code FROM lineitem)
       SELECT CASE WHEN code BETWEEN 1 AND 4 THEN 'Employed' WHEN code = 5 THEN 'Unemployed'
                   WHEN code BETWEEN 12 AND 33 THEN 'Inactive' WHEN code IN (20, 31) THEN 'Retired'
                   WHEN code IN (15, 16, 26, 27) THEN 'Sick or disabled' ELSE 'Other' END AS employment,
              count(*) AS n, sum(code)::BIGINT AS code_sum FROM k GROUP BY 1""",
)
def c5(spark, sf):
    """First match wins: codes 15, 16, 20, 26, 27 and 31 all fall to the earlier, wider rule."""
    code = F.col("code")
    rules = [
        (code.between(1, 4), "Employed"),
        (code == 5, "Unemployed"),
        (code.between(12, 33), "Inactive"),
        (code.isin(20, 31), "Retired"),
        (code.isin(15, 16, 26, 27), "Sick or disabled"),
    ]
    df = table(spark, sf, "lineitem").select((F.col("l_partkey") % 35).alias("code"))
    return df.groupBy(C.recode(rules, "Other").alias("employment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("code").alias("code_sum")
    )


@query(
    "c5_rule_usage",
    """WITH k AS (SELECT l_partkey % 35 AS code FROM lineitem)
       SELECT 1::BIGINT AS rule, 'Inactive' AS label, count(*) FILTER (code BETWEEN 12 AND 33) AS matches, count(*) FILTER (code BETWEEN 12 AND 33) AS first_matches FROM k
       UNION ALL SELECT 2, 'Retired', count(*) FILTER (code IN (20, 31)), 0 FROM k
       UNION ALL SELECT 3, 'Employed', count(*) FILTER (code BETWEEN 1 AND 4), count(*) FILTER (code BETWEEN 1 AND 4) FROM k""",
)
def c5_usage(spark, sf):
    """Which rules can never fire because earlier ones take all their rows."""
    code = F.col("code")
    rules = [(code.between(12, 33), "Inactive"), (code.isin(20, 31), "Retired"), (code.between(1, 4), "Employed")]
    df = table(spark, sf, "lineitem").select((F.col("l_partkey") % 35).alias("code"))
    return C.rule_usage(df, rules)


def _answers(spark, sf):
    """Repeated-answer columns: four codes 0..6 per line."""
    k = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(
        "l_shipdate", "l_quantity",
        *[((k + i * F.col("l_suppkey")) % 7).cast("int").alias(f"tpbn130{i}") for i in range(1, 5)],
    )


ANSWERS = "(SELECT l_shipdate, l_quantity, " + ", ".join(
    f"(l_partkey + {i} * l_suppkey) % 7 AS tpbn130{i}" for i in range(1, 5)
) + " FROM lineitem)"
ANSWER_COLUMNS = [f"tpbn130{i}" for i in range(1, 5)]


def _count_sql(code):
    return "(" + " + ".join(f"(CASE WHEN tpbn130{i} = {code} THEN 1 ELSE 0 END)" for i in range(1, 5)) + ")"


@query(
    "c6_any_match",
    f"SELECT count(*) AS n, count(*) FILTER (tpbn1301 = 1 OR tpbn1302 = 1 OR tpbn1303 = 1 OR tpbn1304 = 1) AS n_match FROM {ANSWERS}",
)
def c6(spark, sf):
    df = _answers(spark, sf)
    hit = C.any_match(select_by_name(df, regex=r"^tpbn13\d\d$"), 1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("n_match"))


@query(
    "c7_factor_levels",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'Finished' WHEN o_orderstatus = 'O' THEN 'Open' END AS label,
              CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '3+' END AS lumped,
              CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'top' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS collapsed,
              CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 0 END::BIGINT AS position,
              count(*) AS n
       FROM orders GROUP BY 1, 2, 3, 4""",
)
def c7(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(
            C.label_levels("o_orderstatus", {"F": "Finished", "O": "Open"}).alias("label"),
            C.lump_other("o_orderpriority", ["1-URGENT", "2-HIGH"], "3+").alias("lumped"),
            C.collapse_levels("o_orderpriority", {"top": ["1-URGENT", "2-HIGH"], "low": ["5-LOW"]}).alias("collapsed"),
            C.level_order("o_orderstatus", ["O", "P", "F"]).cast("bigint").alias("position"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "c8_parse_survey_date",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_day
       FROM orders GROUP BY 1""",
)
def c8(spark, sf):
    """Dates carried as undelimited numbers that have lost their leading zero."""
    text = F.date_format("o_orderdate", "ddMMyyyy").cast("int").cast("string")
    parsed = table(spark, sf, "orders").select(C.parse_survey_date(text).alias("d"))
    return parsed.groupBy(C.month_start("d").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("last_day")
    )


@query(
    "c9_period_index",
    """SELECT (month(o_orderdate) + (year(o_orderdate) - 1995) * 12)::BIGINT AS month_index,
              (quarter(o_orderdate) + (year(o_orderdate) - 1995) * 4)::BIGINT AS quarter_index, count(*) AS n
       FROM orders GROUP BY 1, 2""",
)
def c9(spark, sf):
    return rounded(
        table(spark, sf, "orders")
        .groupBy(
            C.period_index("o_orderdate", 1995, "month").alias("month_index"),
            C.period_index("o_orderdate", 1995, "quarter").alias("quarter_index"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Answer codes of the benefits question.
BENEFIT_CODES = {"uc": 1, "housing": 2, "tax_cr": 3, "income_s": 4, "jsa": 5, "disab": 6}


@query(
    "c10_count_codes",
    f"""SELECT {_count_sql(1)}::BIGINT AS uc, ({_count_sql(1)} > 0)::BIGINT AS uc_flag, {_count_sql(6)}::BIGINT AS disab,
               count(*) AS n FROM {ANSWERS} GROUP BY 1, 2, 3""",
)
def c10(spark, sf):
    counted = C.count_codes(ANSWER_COLUMNS, BENEFIT_CODES)
    df = _answers(spark, sf).select(*[c.alias(n) for n, c in counted.items()])
    return rounded(df.groupBy("uc", "uc_flag", "disab").agg(F.count(F.lit(1)).alias("n")))


@query(
    "c11_claim_type",
    f"""WITH k AS (SELECT {_count_sql(1)} AS uc, {_count_sql(2)} + {_count_sql(3)} + {_count_sql(4)} + {_count_sql(5)} AS other, l_quantity FROM {ANSWERS})
        SELECT CASE WHEN uc > 0 AND other > 0 THEN 'Combination' WHEN uc > 0 THEN 'New' WHEN other > 0 THEN 'Legacy' END AS claim,
               count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS weight FROM k GROUP BY 1""",
)
def c11(spark, sf):
    counted = C.count_codes(ANSWER_COLUMNS, BENEFIT_CODES)
    legacy = counted["tax_cr"] + counted["housing"] + counted["income_s"] + counted["jsa"]
    df = _answers(spark, sf).select("l_quantity", C.claim_type(counted["uc"], legacy).alias("claim"))
    return df.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("weight"))


def _sentences(spark, sf):
    """Effect sentences written from per-supplier discount statistics."""
    stats = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("m"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi")
    )
    return stats.select(
        "l_suppkey",
        F.format_string("-%.4f point drop in score (-%.2f to %.2f)", "m", "lo", "hi").alias("text"),
        "m", "lo", "hi",
    )


@query(
    "c12_extract_numbers",
    """SELECT l_suppkey, round(-round(avg(l_discount), 4), 4) + 0.0 AS estimate, round(-min(l_discount), 2) + 0.0 AS cl, round(max(l_discount), 2) + 0.0 AS cu
       FROM lineitem GROUP BY 1""",
)
def c12(spark, sf):
    parsed = C.extract_numbers("text")
    return rounded(_sentences(spark, sf).select("l_suppkey", *[c.alias(n) for n, c in parsed.items()]), 4)


@query(
    "c13_split_column",
    """SELECT substr(o_orderpriority, 1, 1)::BIGINT AS level, substr(o_orderpriority, 3) AS name, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def c13(spark, sf):
    parts = C.split_column("o_orderpriority", "-", {"level": "bigint", "name": "string"})
    return table(spark, sf, "orders").groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c14_format_effect",
    """SELECT l_suppkey, printf('%.2f (%.2f, %.2f)', avg(l_extendedprice), min(l_discount), max(l_tax)) AS label,
              printf('%.1f%%', avg(l_discount) * 100.0) AS pct FROM lineitem GROUP BY 1""",
)
def c14(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("e"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"),
        F.avg("l_discount").alias("share"),
    )
    return g.select("l_suppkey", C.format_effect("e", "lo", "hi").alias("label"), C.format_percent("share").alias("pct"))


@query(
    "c15_composite_income",
    """WITH x AS (SELECT l_orderkey, sum(l_extendedprice + l_quantity - l_extendedprice * l_discount) AS income FROM lineitem GROUP BY 1)
       SELECT (income > 100000)::BIGINT AS receipt, count(*) AS n, round(sum(income), 2) + 0.0 AS income FROM x GROUP BY 1""",
)
def c15(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("reduction", F.col("l_extendedprice") * F.col("l_discount"))
    income = C.composite(["l_extendedprice", "l_quantity"], ["reduction"])
    per_order = li.groupBy("l_orderkey").agg(F.sum(income).alias("income"))
    return per_order.groupBy((F.col("income") > 100000).cast("bigint").alias("receipt")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("income"), 2).alias("income")
    )


@query(
    "c16_filters",
    """SELECT count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders
       WHERE o_totalprice BETWEEN 18000 AND 250000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL
         AND (o_orderdate < TIMESTAMP '1997-01-01' OR o_orderdate >= TIMESTAMP '1999-01-01')""",
)
def c16(spark, sf):
    d = F.col("o_orderdate")
    kept = table(spark, sf, "orders").where(
        F.col("o_totalprice").between(18000, 250000)
        & F.col("o_orderstatus").isin("F", "O")
        & F.col("o_orderpriority").isNotNull()
        & ((d < F.lit("1997-01-01").cast("timestamp")) | (d >= F.lit("1999-01-01").cast("timestamp")))
    )
    return kept.agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "c17_select_helpers",
    """SELECT round(sum(l_discount), 2) + 0.0 AS l_discount, round(sum(l_extendedprice), 2) + 0.0 AS l_extendedprice,
              round(sum(l_tax), 2) + 0.0 AS l_tax FROM lineitem""",
)
def c17(spark, sf):
    li = table(spark, sf, "lineitem")
    names = sorted(
        set(select_by_name(li, prefix="l_ext")) | set(select_by_name(li, contains="disc")) | set(select_by_name(li, regex=r"_tax$"))
    )
    return li.agg(*[r(F.sum(n), 2).alias(n) for n in names])


@query(
    "c18_dummy_encode",
    """SELECT c_nationkey::BIGINT AS c_nationkey, sum((o_orderstatus = 'O')::INT)::BIGINT AS o_orderstatus_O, sum((o_orderstatus = 'P')::INT)::BIGINT AS o_orderstatus_P,
              sum((c_mktsegment = 'BUILDING')::INT)::BIGINT AS c_mktsegment_BUILDING
       FROM (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
)
def c18(spark, sf):
    wide = dummy_encode(
        orders_by_customer(spark, sf).select("c_nationkey", "o_orderstatus", "c_mktsegment"),
        ["o_orderstatus", "c_mktsegment"],
    )
    return rounded(
        wide.groupBy("c_nationkey").agg(
            *[F.sum(c).alias(c) for c in ("o_orderstatus_O", "o_orderstatus_P", "c_mktsegment_BUILDING")]
        )
    )


@query(
    "c19_interact",
    """SELECT l_linestatus, sum(((l_returnflag = 'N') AND l_quantity > 25)::INT)::BIGINT AS n_x_big,
              sum(((l_returnflag = 'N') AND l_discount > 0.05)::INT)::BIGINT AS n_x_cheap,
              sum(((l_returnflag = 'R') AND l_quantity > 25)::INT)::BIGINT AS r_x_big,
              sum(((l_returnflag = 'R') AND l_discount > 0.05)::INT)::BIGINT AS r_x_cheap
       FROM lineitem GROUP BY 1""",
)
def c19(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_linestatus",
        *[(F.col("l_returnflag") == v.upper()).cast("int").alias(v) for v in ("n", "r")],
        (F.col("l_quantity") > 25).cast("int").alias("big"), (F.col("l_discount") > 0.05).cast("int").alias("cheap"),
    )
    wide = interact(li, ["n", "r"], ["big", "cheap"])
    return rounded(
        wide.groupBy("l_linestatus").agg(*[F.sum(c).alias(c) for c in ("n_x_big", "n_x_cheap", "r_x_big", "r_x_cheap")])
    )


@query(
    "c20_orthogonal_poly",
    """WITH z AS (SELECT l_quantity - avg(l_quantity) OVER () AS x FROM lineitem),
            m AS (SELECT count(*)::DOUBLE AS n, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4 FROM z),
            p AS (SELECT x / sqrt(s2) AS p1, (x*x - x*s3/s2 - s2/n) / sqrt(s4 - s3*s3/s2 - s2*s2/n) AS p2 FROM z, m)
       SELECT round(min(p1), 6) + 0.0 AS min_1, round(max(p1), 6) + 0.0 AS max_1, round(min(p2), 6) + 0.0 AS min_2, round(max(p2), 6) + 0.0 AS max_2,
              round(sum(p1*p2), 6) + 0.0 AS cross, round(sum(p2*p2), 6) + 0.0 AS norm FROM p""",
)
def c20(spark, sf):
    li = table(spark, sf, "lineitem")
    d = build_design(li, [poly("l_quantity", 2)], intercept=False)
    p = li.select(*[c.alias(f"p{i + 1}") for i, c in enumerate(d.columns)])
    return p.agg(
        r(F.min("p1")).alias("min_1"), r(F.max("p1")).alias("max_1"), r(F.min("p2")).alias("min_2"),
        r(F.max("p2")).alias("max_2"), r(F.sum(F.col("p1") * F.col("p2"))).alias("cross"),
        r(F.sum(F.col("p2") * F.col("p2"))).alias("norm"),
    )


@query(
    "c21_effect_from_ci",
    f"""WITH g AS (SELECT l_suppkey, avg(l_discount) - 0.05 AS e, min(l_discount) - 0.05 AS lo, max(l_discount) - 0.04 AS hi FROM lineitem GROUP BY 1),
             s AS (SELECT *, (hi - lo) / (2 * 1.96) AS se FROM g), z AS (SELECT *, -abs(e) / se AS z FROM s)
        SELECT l_suppkey, round(se, 6) + 0.0 AS se, round(2 * {normal_cdf_sql("z")}, 6) + 0.0 AS p,
               (2 * {normal_cdf_sql("z")} < 0.05)::BIGINT AS signif FROM z""",
)
def c21(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_discount") - 0.05).alias("e"), (F.min("l_discount") - 0.05).alias("lo"), (F.max("l_discount") - 0.04).alias("hi")
    )
    return rounded(g.select("l_suppkey", *[c.alias(n) for n, c in C.effect_from_ci("e", "lo", "hi").items()]))


TIMING = "CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 1996 + c_nationkey % 5 END"


def timing():
    """Rollout year by nation; 0 is never treated."""
    k = F.col("c_nationkey") % 5
    return F.when(k == 0, 0).otherwise(1996 + k)


@query(
    "c22_assign_treatment",
    f"""WITH p AS (SELECT year(o_orderdate) AS t, {TIMING} AS timing FROM {ORDERS_BY_CUSTOMER})
        SELECT (CASE WHEN timing <> 0 AND t >= timing THEN 1 ELSE 0 END)::BIGINT AS d,
               (CASE WHEN timing <> 0 THEN t - timing END)::BIGINT AS rel, count(*) AS n FROM p GROUP BY 1, 2""",
)
def c22(spark, sf):
    df = orders_by_customer(spark, sf).select(F.year("o_orderdate").alias("t"), timing().alias("timing"))
    return rounded(
        df.groupBy(C.treated("t", "timing").alias("d"), C.relative_time("t", "timing").alias("rel")).agg(
            F.count(F.lit(1)).alias("n")
        )
    )


@query(
    "c23_scale_effect",
    """WITH g AS (SELECT l_suppkey, avg(l_discount) AS e, avg((l_quantity > 45)::INT) AS share, avg(l_tax) AS other FROM lineitem GROUP BY 1)
       SELECT l_suppkey, round(e / nullif(share, 0), 6) + 0.0 AS scaled, round(e / nullif(other, 0), 6) + 0.0 AS mult FROM g""",
)
def c23(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("e"), F.avg((F.col("l_quantity") > 45).cast("double")).alias("share"), F.avg("l_tax").alias("other")
    )
    return rounded(g.select("l_suppkey", C.scale_effect("e", "share").alias("scaled"), C.scale_effect("e", "other").alias("mult")))


@query(
    "c24_inject_effect",
    f"""WITH p AS (SELECT c_nationkey, year(o_orderdate) AS t, {TIMING} AS timing, o_totalprice AS y FROM {ORDERS_BY_CUSTOMER})
        SELECT t::BIGINT AS t, timing::BIGINT AS timing, round(avg(CASE WHEN timing <> 0 AND t >= timing THEN y + (t - timing) * 1000 ELSE y END), 4) + 0.0 AS y
        FROM p GROUP BY 1, 2""",
)
def c24(spark, sf):
    df = orders_by_customer(spark, sf).select(F.year("o_orderdate").alias("t"), timing().alias("timing"), "o_totalprice")
    y = C.inject_effect("o_totalprice", "t", "timing", F.lit(1000))
    return rounded(df.groupBy("t", "timing").agg(F.avg(y).alias("y")), 4)
