"""S: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.models.linear import ols
from quasi.operators.agg import weighted_rate
from quasi.operators.metrics import regression_metrics, summarise_resamples
from quasi.operators.sample import hash_fold
from quasi.queries.registry import query, r, rounded, table
from quasi.session import scratch_path
from quasi.sources import extracts, waves

EXTRACT_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double"


@query(
    "s1_read_keyed_extracts",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
              CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'reform' END AS policy,
              count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total
       FROM orders GROUP BY 1, 2""",
)
def s1(spark, sf):
    """Delimited extracts written to the shared folder, read back with keys from their paths."""
    path = scratch_path(spark, "extracts")
    policy = F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("reform")
    (
        table(spark, sf, "orders")
        .select(F.year("o_orderdate").alias("year"), policy.alias("policy"), "o_orderkey", "o_custkey", "o_totalprice")
        .write.partitionBy("year", "policy").option("sep", "\t").option("header", True).csv(path)
    )
    read = extracts.read_keyed_extracts(
        spark, path, EXTRACT_SCHEMA, r"year=(\d{4})/policy=(\w+)", {"year": "bigint", "policy": "string"}
    )
    return read.groupBy("year", "policy").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "s2_union_waves",
    """SELECT 'early' AS wave, count(*) AS n, count(o_orderpriority) AS n_priority, round(avg(o_totalprice), 4) + 0.0 AS mean_price
       FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
       UNION ALL
       SELECT 'late', count(*), CAST(0 AS BIGINT), round(avg(o_totalprice), 4) + 0.0
       FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def s2(spark, sf):
    o = table(spark, sf, "orders")
    split = F.lit("1998-01-01").cast("timestamp")
    stacked = waves.union_waves(
        {
            "early": o.where(F.col("o_orderdate") < split),
            "late": o.where(F.col("o_orderdate") >= split).drop("o_orderpriority"),
        }
    )
    return stacked.groupBy("wave").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("n_priority"),
        r(F.avg("o_totalprice"), 4).alias("mean_price"),
    )


@query(
    "s3_pruned_scan",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
       ORDER BY l_orderkey, l_partkey, l_quantity LIMIT 100""",
)
def s3(spark, sf):
    cols = ["l_orderkey", "l_partkey", "l_quantity"]
    return waves.pruned_scan(table(spark, sf, "lineitem"), cols, order=cols, n=100)


@query(
    "s4_harmonise_weight",
    """SELECT CASE WHEN year(l_shipdate) < 1999 THEN '18' ELSE '20' END AS wave,
              l_returnflag, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS weight
       FROM lineitem GROUP BY 1, 2""",
)
def s4(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = {
        "18": li.where(F.year("l_shipdate") < 1999).select("l_returnflag", F.col("l_quantity").alias("pwta18")),
        "20": li.where(F.year("l_shipdate") >= 1999).select("l_returnflag", F.col("l_quantity").alias("pwta20")),
    }
    stacked = waves.union_waves({k: waves.harmonise_weight(df) for k, df in parts.items()})
    return stacked.groupBy("wave", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("weight"), 2).alias("weight")
    )


@query(
    "s5_convert_waves",
    """WITH w AS (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS fy FROM orders)
       SELECT format('apr{:02d}_mar{:02d}', CAST(fy % 100 AS INTEGER), CAST((fy + 1) % 100 AS INTEGER)) AS wave,
              count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total
       FROM w GROUP BY 1""",
)
def s5(spark, sf):
    """Each fiscal-year wave converted to a column store under one root, then read with pruning."""
    root = scratch_path(spark, "waves")
    o = table(spark, sf, "orders")
    start = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 4, 1).otherwise(0)
    tagged = o.withColumn("fy", start)
    years = sorted(x["fy"] for x in tagged.select("fy").distinct().collect())
    renamed = tagged.withColumnsRenamed({"o_orderkey": "Order Key", "o_totalprice": "totalPrice"})
    extracts.convert_waves({y: renamed.where(F.col("fy") == y).drop("fy") for y in years}, root)
    return extracts.read_waves(spark, root).groupBy("wave").agg(
        F.count("order_key").alias("n"), r(F.sum("total_price"), 2).alias("total")
    )


@query(
    "s6_clean_names",
    """SELECT o_orderstatus AS order_status, count(*) AS x1st_count, round(sum(o_totalprice), 2) + 0.0 AS total_price,
              round(max(o_totalprice), 2) + 0.0 AS total_price_2 FROM orders GROUP BY 1""",
)
def s6(spark, sf):
    o = table(spark, sf, "orders")
    messy = o.groupBy(F.col("o_orderstatus").alias("Order Status")).agg(
        F.count(F.lit(1)).alias("1st count"), r(F.sum("o_totalprice"), 2).alias("totalPrice"),
        r(F.max("o_totalprice"), 2).alias("Total.Price"),
    )
    return extracts.clean_names(messy)


@query(
    "s7_decode_labels",
    """SELECT n_name AS c_nationkey, r_name AS region, count(*) AS n
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1, 2""",
)
def s7(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    labels = nation.select(
        F.lit("c_nationkey").alias("variable"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label")
    ).unionByName(
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.lit("region").alias("variable"), F.col("n_nationkey").alias("code"), F.col("r_name").alias("label")
        )
    )
    customers = table(spark, sf, "customer").select("c_nationkey", F.col("c_nationkey").alias("region"))
    return waves.decode_labels(customers, labels, ["c_nationkey", "region"]).groupBy("c_nationkey", "region").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "s8_column_coverage",
    """WITH a AS (SELECT 'A' AS wave, CASE WHEN l_discount > 0 THEN l_discount END AS d, l_tax AS t FROM lineitem WHERE l_returnflag = 'A'),
            n AS (SELECT 'N' AS wave, CASE WHEN l_discount > 0 THEN l_discount END AS d FROM lineitem WHERE l_returnflag = 'N'),
            r AS (SELECT CASE WHEN l_discount > 0 THEN l_discount END AS d, l_tax AS t FROM lineitem WHERE l_returnflag = 'R')
       SELECT 'A' AS wave, 'disc' AS "column", CAST(1 AS BIGINT) AS present, round(count(d)::DOUBLE / count(*), 6) + 0.0 AS non_null_share FROM a
       UNION ALL SELECT 'A', 'tax', 1, round(count(t)::DOUBLE / count(*), 6) + 0.0 FROM a
       UNION ALL SELECT 'N', 'disc', 1, round(count(d)::DOUBLE / count(*), 6) + 0.0 FROM n
       UNION ALL SELECT 'N', 'tax', 0, NULL
       UNION ALL SELECT 'R', 'disc', 1, round(count(d)::DOUBLE / count(*), 6) + 0.0 FROM r
       UNION ALL SELECT 'R', 'tax', 1, round(count(t)::DOUBLE / count(*), 6) + 0.0 FROM r""",
)
def s8(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("disc", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    full = li.select("l_returnflag", "disc", F.col("l_tax").alias("tax"))
    parts = {
        "A": full.where(F.col("l_returnflag") == "A"),
        "N": full.where(F.col("l_returnflag") == "N").drop("tax"),
        "R": full.where(F.col("l_returnflag") == "R"),
    }
    return rounded(waves.column_coverage(parts, ["disc", "tax"]))


@query(
    "s9_coefficient_store",
    """SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS estimate FROM lineitem
       UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 FROM lineitem""",
)
def s9(spark, sf):
    path = scratch_path(spark, "coefficients")
    extracts.write_coefficients(ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]).table(spark), path)
    return extracts.read_coefficients(spark, path).select("term", r("estimate", 4).alias("estimate"))


@query(
    "s10_resample_store",
    """WITH f AS (SELECT CAST(('0x' || substr(md5(o_orderkey::VARCHAR || '|7'), 1, 8))::BIGINT % 4 AS BIGINT) AS resample_id,
                         o_totalprice AS truth, 1000.0 * (o_orderkey % 500) AS pred FROM orders),
            m AS (SELECT resample_id, sqrt(avg((truth - pred) * (truth - pred))) AS rmse FROM f GROUP BY 1)
       SELECT count(*) AS n, round(avg(rmse), 4) + 0.0 AS mean, round(stddev_samp(rmse) / sqrt(count(*)), 4) + 0.0 AS std_err FROM m""",
)
def s10(spark, sf):
    path = scratch_path(spark, "resamples")
    preds = hash_fold(table(spark, sf, "orders"), "o_orderkey", 4, seed=7).select(
        F.col("fold").alias("resample_id"), F.col("o_totalprice").alias("truth"),
        (1000.0 * (F.col("o_orderkey") % 500)).alias("pred"),
    )
    extracts.write_resamples(preds, path)
    metrics = regression_metrics(extracts.read_resamples(spark, path), "truth", "pred", ["resample_id"])
    return rounded(summarise_resamples(metrics, [], "rmse"), 4)


@query(
    "s11_reference_table",
    """SELECT o_orderpriority, rank, round(avg(o_totalprice), 4) + 0.0 AS mean_price FROM orders
       JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) v(p, rank)
         ON o_orderpriority = p GROUP BY 1, 2""",
)
def s11(spark, sf):
    rows = [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 4), ("5-LOW", 5)]
    ranks = waves.reference_table(spark, rows, "o_orderpriority string, rank int")
    joined = table(spark, sf, "orders").join(F.broadcast(ranks), "o_orderpriority")
    return joined.groupBy("o_orderpriority", "rank").agg(r(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(
    "s12_population_table",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
              round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) + 0.0 AS prop_obs
       FROM orders GROUP BY 1""",
)
def s12(spark, sf):
    """An administrative (date, n, population) table kept as Parquet, read back and turned into rates."""
    path = scratch_path(spark, "population")
    table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("date")).agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_uc"), F.count(F.lit(1)).alias("pop")
    ).write.parquet(path)
    return rounded(weighted_rate(spark.read.parquet(path), ["date"], F.col("n_uc") / F.col("pop"), "pop", "prop_obs"))
