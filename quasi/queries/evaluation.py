"""E: metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quasi.operators import metrics as M
from quasi.operators.reshape import pivot_longer
from quasi.queries.registry import query, rounded, table

CLASSES = ["F", "O", "P"]


def _binary(spark, sf):
    """Truth and score per order: finished or not, against a price-based score with ties."""
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("truth"),
        (F.floor(F.col("o_totalprice") / 100) * 100 / 600000.0).alias("score"),
        (F.year("o_orderdate")).alias("resample_id"),
    ).withColumn("pred", F.when(F.col("score") > 0.5, "Yes").otherwise("No"))


BINARY = """(SELECT o_orderkey, year(o_orderdate) AS resample_id, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS truth, floor(o_totalprice / 100) * 100 / 600000.0 AS score,
            CASE WHEN floor(o_totalprice / 100) * 100 / 600000.0 > 0.5 THEN 'Yes' ELSE 'No' END AS pred FROM orders)"""


def _auc_sql(source, by=""):
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    pick = f"{by}, " if by else ""
    return f"""(WITH c AS (SELECT {pick}score, count(*) FILTER (truth = 'Yes') AS pos, count(*) FILTER (truth = 'No') AS neg FROM {source} GROUP BY {pick}score),
        k AS (SELECT *, sum(neg) OVER ({part}ORDER BY score) - neg AS below FROM c)
        SELECT {pick}sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM k {group})"""


@query("e1_roc_auc", f"SELECT round(auc, 6) + 0.0 AS roc_auc FROM {_auc_sql(BINARY)}")
def e1(spark, sf):
    return rounded(M.roc_auc(_binary(spark, sf), "truth", "score", "Yes"))


@query(
    "e2_roc_curve",
    f"""WITH c AS (SELECT score, count(*) FILTER (truth = 'Yes') AS pos, count(*) FILTER (truth = 'No') AS neg FROM {BINARY} GROUP BY 1),
             k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score) - neg AS tn, sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM c)
        SELECT round(score, 6) + 0.0 AS threshold, round(tp::DOUBLE / p, 6) + 0.0 AS sensitivity, round(tn::DOUBLE / q, 6) + 0.0 AS specificity FROM k""",
)
def e2(spark, sf):
    return rounded(M.roc_curve(_binary(spark, sf), "truth", "score", "Yes"))


@query("e3_confusion_matrix", f"SELECT truth, pred, count(*) AS n FROM {BINARY} GROUP BY 1, 2")
def e3(spark, sf):
    return M.confusion_matrix(_binary(spark, sf), "truth", "pred")


_RATES = """round(count(*) FILTER (truth = 'Yes' AND {p}) / nullif(count(*) FILTER (truth = 'Yes'), 0)::DOUBLE, 6) + 0.0 AS sens,
    round(count(*) FILTER (truth = 'No' AND NOT ({p})) / nullif(count(*) FILTER (truth = 'No'), 0)::DOUBLE, 6) + 0.0 AS spec,
    round(count(*) FILTER (truth = 'Yes' AND {p}) / nullif(count(*) FILTER ({p}), 0)::DOUBLE, 6) + 0.0 AS ppv,
    round(count(*) FILTER (truth = 'No' AND NOT ({p})) / nullif(count(*) FILTER (NOT ({p})), 0)::DOUBLE, 6) + 0.0 AS npv"""

_CALLED = _RATES.format(p="pred = 'Yes'")


@query("e4_class_metrics", f"SELECT resample_id::BIGINT AS resample_id, {_CALLED} FROM {BINARY} GROUP BY 1")
def e4(spark, sf):
    return rounded(M.class_metrics(_binary(spark, sf), "truth", "pred", "Yes", ["resample_id"]))


@query("e5_threshold_sweep", f"SELECT round((k * 0.05)::DOUBLE, 2) + 0.0 AS threshold, {_RATES.format(p='score > round(k * 0.05, 2)')} FROM {BINARY}, range(1, 20) t(k) GROUP BY k")
def e5(spark, sf):
    grid = [round(0.05 * k, 2) for k in range(1, 20)]
    return rounded(M.threshold_sweep(_binary(spark, sf), "truth", "score", "Yes", grid))


@query(
    "e6_regression_metrics",
    """WITH p AS (SELECT o_orderstatus, o_totalprice AS y, 50000 + 1000.0 * (o_orderkey % 300) + o_totalprice * 0.3 AS f FROM orders)
       SELECT o_orderstatus, round(sqrt(avg((y - f) * (y - f))), 4) + 0.0 AS rmse, round(corr(y, f) ** 2, 6) + 0.0 AS rsq FROM p GROUP BY 1""",
)
def e6(spark, sf):
    p = table(spark, sf, "orders").withColumn("f", 50000 + 1000.0 * (F.col("o_orderkey") % 300) + F.col("o_totalprice") * 0.3)
    return rounded(M.regression_metrics(p, "o_totalprice", "f", ["o_orderstatus"]), 4, rsq=6)


@query("e7_accuracy", f"SELECT round(avg((truth = pred)::INT), 6) + 0.0 AS accuracy FROM {BINARY}")
def e7(spark, sf):
    return rounded(M.accuracy(_binary(spark, sf), "truth", "pred"))


def _three_class(spark, sf):
    """Three class scores per order that sum to one."""
    k = F.col("o_orderkey")
    raw = [
        1 + (k % 7) + F.when(F.col("o_orderstatus") == "F", 2).otherwise(0),
        1 + (k % 5) + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0),
        1 + (k % 3),
    ]
    total = raw[0] + raw[1] + raw[2]
    out = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("truth"), *[(x / total).alias(f"p_{c}") for x, c in zip(raw, CLASSES)]
    )
    best = F.greatest("p_F", "p_O", "p_P")
    return out.withColumn("pred", F.when(F.col("p_F") == best, "F").when(F.col("p_O") == best, "O").otherwise("P"))


THREE_CLASS = """(SELECT *, CASE WHEN p_F >= p_O AND p_F >= p_P THEN 'F' WHEN p_O >= p_P THEN 'O' ELSE 'P' END AS pred FROM
    (SELECT truth, a / (a + b + c)::DOUBLE AS p_F, b / (a + b + c)::DOUBLE AS p_O, c / (a + b + c)::DOUBLE AS p_P FROM
     (SELECT o_orderstatus AS truth, 1 + o_orderkey % 7 + (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) AS a,
             1 + o_orderkey % 5 + (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b, 1 + o_orderkey % 3 AS c FROM orders)))"""


def _pair_sql(a, b):
    src = f"(SELECT CASE WHEN truth = '{a}' THEN 'Yes' ELSE 'No' END AS truth, p_{a} AS score FROM {THREE_CLASS} WHERE truth IN ('{a}', '{b}'))"
    return f"(SELECT auc FROM {_auc_sql(src)})"


@query(
    "e8_multiclass_auc",
    "SELECT round((" + " + ".join(_pair_sql(a, b) for a in CLASSES for b in CLASSES if a != b) + ") / 6, 6) + 0.0 AS roc_auc",
)
def e8(spark, sf):
    return rounded(M.multiclass_auc(_three_class(spark, sf), "truth", {c: f"p_{c}" for c in CLASSES}))


@query("e9_sensitivity_by_class", f"SELECT truth AS class, round(avg((truth = pred)::INT), 6) + 0.0 AS sensitivity FROM {THREE_CLASS} GROUP BY 1")
def e9(spark, sf):
    return rounded(M.sensitivity_by_class(_three_class(spark, sf), "truth", "pred"))


@query(
    "e10_resample_summary",
    f"""WITH m AS (SELECT resample_id, {_CALLED.replace(', 6) + 0.0', ', 15) + 0.0')} FROM {BINARY} GROUP BY 1),
             l AS (SELECT 'sens' AS metric, sens AS v FROM m UNION ALL SELECT 'spec', spec FROM m UNION ALL SELECT 'roc_auc', auc FROM {_auc_sql(BINARY, 'resample_id')})
        SELECT metric, round(avg(v), 6) + 0.0 AS mean, count(v) AS n, round(stddev_samp(v) / sqrt(count(v)), 6) + 0.0 AS std_err FROM l GROUP BY 1""",
)
def e10(spark, sf):
    df = _binary(spark, sf)
    rates = pivot_longer(M.class_metrics(df, "truth", "pred", "Yes", ["resample_id"]), ["resample_id"], ["sens", "spec"], "metric", "value")
    areas = M.roc_auc(df, "truth", "score", "Yes", ["resample_id"]).select("resample_id", F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return rounded(M.summarise_resamples(rates.unionByName(areas), ["metric"], "value"))
