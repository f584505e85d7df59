"""M: models and scoring."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from quasi.functions.columns import null_to_zero
from quasi.models import learners as L
from quasi.models.design import crossed, factor
from quasi.models.fe import fe_ols, fe_ols_split, twoway_within
from quasi.models.glm import gamma_glm, logit, multinomial
from quasi.models.knn import knn_predict, nearest, smote
from quasi.models.linear import aliased_terms, ols, survey_glm
from quasi.models.mixed import random_intercept_logit
from quasi.models.scoring import apply_eligibility_score, predict_class, predict_clip, score_expr, score_long
from quasi.operators.metrics import roc_auc
from quasi.operators.sample import hash_fold
from quasi.queries.algebra import clustered_within_sql, ols_sql
from quasi.queries.columns import timing
from quasi.queries.registry import ORDERS_BY_CUSTOMER, orders_by_customer, query, rounded, table

# ---------------------------------------------------------------- shared inputs


def nation_year_panel(spark, sf):
    """Nation by year mean order value over the years 1995 to 2001, with rollout and treatment."""
    rows = orders_by_customer(spark, sf)
    panel = rows.groupBy(F.col("c_nationkey").alias("unit"), F.year("o_orderdate").alias("t"), timing().alias("g")).agg(
        F.avg("o_totalprice").alias("y")
    )
    return panel.withColumn("d", F.when((F.col("g") != 0) & (F.col("t") >= F.col("g")), 1).otherwise(0)).withColumn(
        "rel", F.when(F.col("g") != 0, F.col("t") - F.col("g"))
    )


PANEL = f"""(SELECT unit, t, g, y, CASE WHEN g <> 0 AND t >= g THEN 1 ELSE 0 END AS d FROM (
    SELECT c_nationkey AS unit, year(o_orderdate) AS t, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 1996 + c_nationkey % 5 END AS g, avg(o_totalprice) AS y
    FROM {ORDERS_BY_CUSTOMER} GROUP BY 1, 2, 3))"""


def labelled_documents(spark, sf):
    """Documents with their quality label and numeric features."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "inner").select(
        "doc_id", "quality", "toxic", "lang", "source", (F.col("n_chars") / 1000.0).alias("k_chars"),
        F.log1p("n_chars").alias("log_chars"), *[(F.col("lang") == v).cast("double").alias(f"lang_{v}") for v in ("de", "en", "es", "fr")],
    )


DOC_FEATURES = ["k_chars", "log_chars", "lang_de", "lang_en", "lang_es", "lang_fr"]


def cluster_slope_sql(source: str, y: str, x: str, w: str, cluster: str) -> str:
    """One-regressor weighted slope with its linearised cluster variance, as a subquery (b, se, t)."""
    return f"""(WITH s AS (SELECT {y} AS y, {x} AS x, {w} AS w, {cluster} AS c FROM {source}),
        m AS (SELECT sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM s),
        k AS (SELECT sum(w*(x-mx)*(y-my)) / sum(w*(x-mx)*(x-mx)) AS b, sum(w*(x-mx)*(x-mx)) AS sxx FROM s, m),
        u AS (SELECT c, sum(w*(x-mx)*((y-my) - b*(x-mx))) AS u FROM s, m, k GROUP BY c)
        SELECT any_value(b) AS b, sqrt(sum(u*u) * count(*) / (count(*) - 1.0)) / any_value(sxx) AS se,
               any_value(b) / (sqrt(sum(u*u) * count(*) / (count(*) - 1.0)) / any_value(sxx)) AS t FROM u, k)"""


# ---------------------------------------------------------------- linear models


@query(
    "m1_ols",
    """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx,
                         regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, count(*)::DOUBLE AS n, avg(l_quantity) AS mx FROM lineitem),
            v AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM s)
       SELECT '(Intercept)' AS term, round(a, 4) + 0.0 AS estimate, round(sqrt(s2 * (1 / n + mx * mx / sxx)), 4) + 0.0 AS std_error FROM v
       UNION ALL SELECT 'l_quantity', round(b, 4) + 0.0, round(sqrt(s2 / sxx), 4) + 0.0 FROM v""",
)
def m1(spark, sf):
    t = ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]).table(spark)
    return rounded(t.select("term", "estimate", "std_error"), 4)


@query(
    "m1_ols_saturated",
    """SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 3) + 0.0 AS fitted, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def m1_saturated(spark, sf):
    o = table(spark, sf, "orders")
    fit = ols(o, "o_totalprice", crossed(factor("o_orderstatus"), factor("o_orderpriority")))
    scored = o.select("o_orderstatus", "o_orderpriority", fit.mean().alias("fitted"))
    return rounded(scored.groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("fitted").alias("fitted"), F.count(F.lit(1)).alias("n")), 3)


M1_TERMS = {
    "(Intercept)": "1", "l_quantity": "l_quantity", "l_discount": "l_discount", "l_returnflag_N": "l_returnflag = 'N'", "l_returnflag_R": "l_returnflag = 'R'",
    "l_linestatus_O": "l_linestatus = 'O'", "l_returnflag_N:l_quantity": "(l_returnflag = 'N')::INT * l_quantity",
    "l_returnflag_R:l_quantity": "(l_returnflag = 'R')::INT * l_quantity",
}


@query("m1_ols_interactions", ols_sql("lineitem", {n: f"({x})::DOUBLE" for n, x in M1_TERMS.items()}, "l_extendedprice", "l_quantity", 3))
def m1_general(spark, sf):
    """Weighted regression with factors, an interaction and numeric terms."""
    li = table(spark, sf, "lineitem")
    terms = ["l_quantity", "l_discount", factor("l_returnflag"), factor("l_linestatus")] + crossed(factor("l_returnflag"), "l_quantity")[2:]
    return rounded(ols(li, "l_extendedprice", terms, weight="l_quantity").table(spark).select("term", "estimate", "std_error"), 3)


@query(
    "m2_logit_saturated",
    f"""SELECT o_orderpriority, c_mktsegment, round(avg((o_orderstatus = 'F')::INT), 6) + 0.0 AS p, count(*) AS n FROM {ORDERS_BY_CUSTOMER} GROUP BY 1, 2""",
)
def m2(spark, sf):
    rows = orders_by_customer(spark, sf).select("o_orderpriority", "c_mktsegment", "o_orderstatus")
    fit = logit(rows, "o_orderstatus", crossed(factor("o_orderpriority"), factor("c_mktsegment")), positive="F")
    cells = rows.groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return rounded(cells.select("o_orderpriority", "c_mktsegment", fit.mean().alias("p"), "n"))


_LABELLED = "(SELECT quality, ln(n_chars + 1) AS x, (lang = 'en')::INT AS e FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL AND lang IS NOT NULL)"
_INFORMATION = "sum(v) AS a, sum(v*x) AS b, sum(v*e) AS c, sum(v*x*x) AS d, sum(v*x*e) AS f, sum(v*e*e) AS h"
_COFACTORS = "d*h - f*f AS k00, c*f - b*h AS k01, b*f - c*d AS k02, a*h - c*c AS k11, b*c - a*f AS k12, a*d - b*b AS k22, a*(d*h - f*f) - b*(b*h - c*f) + c*(b*f - c*d) AS det"


@query(
    "m2_logit",
    f"""WITH RECURSIVE r AS (SELECT quality, x, e FROM {_LABELLED}),
        it(i, b0, b1, b2) AS (
          SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
          SELECT i + 1, b0 + (k00*s0 + k01*s1 + k02*s2) / det, b1 + (k01*s0 + k11*s1 + k12*s2) / det, b2 + (k02*s0 + k12*s1 + k22*s2) / det FROM (
            SELECT *, {_COFACTORS} FROM (
              SELECT i, b0, b1, b2, {_INFORMATION}, sum(quality - p) AS s0, sum((quality - p)*x) AS s1, sum((quality - p)*e) AS s2 FROM (
                SELECT *, p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1*x + b2*e))) AS p FROM it, r WHERE i < 25)) GROUP BY i, b0, b1, b2))),
        last AS (SELECT * FROM it WHERE i = 25),
        v AS (SELECT *, {_COFACTORS} FROM (SELECT b0, b1, b2, {_INFORMATION} FROM (
                SELECT *, p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1*x + b2*e))) AS p FROM last, r)) GROUP BY b0, b1, b2))
        SELECT unnest(['(Intercept)', 'log_chars', 'english']) AS term, unnest([round(b0, 4) + 0.0, round(b1, 4) + 0.0, round(b2, 4) + 0.0]) AS estimate,
               unnest([round(sqrt(k00/det), 4) + 0.0, round(sqrt(k11/det), 4) + 0.0, round(sqrt(k22/det), 4) + 0.0]) AS std_error FROM v""",
)
def m2_general(spark, sf):
    """Quality by length and language; both levels of either outcome occur at every scale, so there is a finite optimum."""
    rows = labelled_documents(spark, sf).withColumn("english", (F.col("lang") == "en").cast("int"))
    return rounded(logit(rows, "quality", ["log_chars", "english"]).table(spark).select("term", "estimate", "std_error"), 4)


@query(
    "m2_logit_separated",
    """WITH s AS (SELECT source, avg(quality) AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND source IS NOT NULL GROUP BY 1)
       SELECT source, round(p, 5) + 0.0 AS p, p IN (0, 1) AS separated FROM s""",
)
def m2_separated(spark, sf):
    """Quality by source, where some sources hold one outcome only: their probabilities are certain, the others are fitted."""
    rows = labelled_documents(spark, sf).where("source is not null")
    fit = logit(rows, "quality", [factor("source")], separated="drop")
    named = F.concat(F.lit("source_"), F.col("source")).isin(fit.stats.get("separated", []))
    return rounded(rows.select("source", fit.mean().alias("p"), named.alias("separated")).distinct(), 5).distinct()


GAMMA_SQL = """WITH g AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1),
    p AS (SELECT sum((value - m) * (value - m) / (m * m)) / (count(*) - (SELECT count(*) FROM g)) AS disp FROM events JOIN g USING (event_type))
    SELECT event_type, round(m, 5) + 0.0 AS mean, round(disp, 6) + 0.0 AS dispersion, round(1 / disp, 5) + 0.0 AS shape FROM g, p"""


def _gamma(spark, sf, link):
    ev = table(spark, sf, "events").select("event_type", "value")
    fit = gamma_glm(ev, "value", [factor("event_type")], link)
    types = ev.select("event_type").distinct()
    return rounded(
        types.select("event_type", fit.mean().alias("mean"), F.lit(fit.stats["dispersion"]).alias("dispersion"), F.lit(fit.stats["shape"]).alias("shape")), 5, dispersion=6
    )


@query("m3_gamma_inverse", GAMMA_SQL)
def m3(spark, sf):
    return _gamma(spark, sf, "inverse")


@query("m3_gamma_log", GAMMA_SQL)
def m3_log(spark, sf):
    return _gamma(spark, sf, "log")


@query("m3_gamma_continuous")
def m3_general(spark, sf):
    """Inverse-link gamma model with a numeric regressor, needing iterations over rows."""
    ev = table(spark, sf, "events").withColumn("hour", F.hour("ts") / 24.0)
    return rounded(gamma_glm(ev, "value", ["hour", factor("event_type")], "inverse").table(spark), 5)


@query(
    "m4_multinomial_saturated",
    """SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 4) + 0.0 AS "F", round(avg((o_orderstatus = 'O')::INT), 4) + 0.0 AS "O", round(avg((o_orderstatus = 'P')::INT), 4) + 0.0 AS "P" FROM orders GROUP BY 1""",
)
def m4(spark, sf):
    o = table(spark, sf, "orders")
    model = multinomial(o, "o_orderstatus", [factor("o_orderpriority")])
    cells = o.select("o_orderpriority").distinct()
    return rounded(model.add_probabilities(cells, prefix=""), 4)


@query(
    "m5_survey_glm",
    f"SELECT round(b, 3) + 0.0 AS estimate, round(se, 3) + 0.0 AS std_error, round(t, 5) + 0.0 AS statistic FROM {cluster_slope_sql('lineitem', 'l_extendedprice', 'l_discount', 'l_quantity', 'l_suppkey')}",
)
def m5(spark, sf):
    fit = survey_glm(table(spark, sf, "lineitem"), "l_extendedprice", ["l_discount"], "l_quantity", "l_suppkey")
    t = fit.table(spark).where("term = 'l_discount'").select("estimate", "std_error", "statistic")
    return rounded(t, 3, statistic=5)


@query(
    "m6_fe_ols",
    """WITH s AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1),
            k AS (SELECT sum((x-mx)*(y-my)) / sum((x-mx)*(x-mx)) AS b, sum((x-mx)*(x-mx)) AS sxx, count(*)::DOUBLE AS n FROM s JOIN m USING (g)),
            u AS (SELECT g, sum((x-mx)*((y-my) - b*(x-mx))) AS u FROM s JOIN m USING (g), k GROUP BY 1)
       SELECT 'l_quantity' AS term, round(any_value(b), 4) + 0.0 AS estimate,
              round(sqrt(sum(u*u) * count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 1)) / any_value(sxx), 4) + 0.0 AS std_error FROM u, k""",
)
def m6(spark, sf):
    fit = fe_ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], cluster="l_suppkey")
    return rounded(fit.table(spark).select("term", "estimate", "std_error"), 4)


M6_ROWS = """SELECT k.key, l_suppkey AS u, l_quantity::DOUBLE AS w, l_extendedprice::DOUBLE AS y, l_discount::DOUBLE AS l_discount, l_quantity::DOUBLE AS l_quantity,
    ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::INT AS month FROM lineitem, (VALUES ('all'), ('F'), ('O')) k(key) WHERE k.key = 'all' OR k.key = l_linestatus"""


@query(
    "m6_fe_ols_two_effects",
    f"""SELECT key AS sample, term, estimate, std_error FROM ({clustered_within_sql(M6_ROWS, ["l_discount", "l_quantity"], ("month", 120), 5)})""",
)
def m6_two(spark, sf):
    """Unbalanced supplier and month effects, on the whole sample and by line status."""
    li = table(spark, sf, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    fits = fe_ols_split(
        li, "l_linestatus", ["F", "O"], y="l_extendedprice", x=["l_discount", "l_quantity"], fe=["l_suppkey", "month"],
        weight="l_quantity", cluster="l_suppkey",
    )
    rows = [(sample, *row[:3]) for sample, fit in fits.items() for row in fit.rows()]
    return rounded(spark.createDataFrame(rows, "sample string, term string, estimate double, std_error double"), 5)


TWOWAY_SQL = f"""WITH p AS (SELECT unit, t, d::DOUBLE AS x, y FROM {PANEL}),
    z AS (SELECT x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x,
                 y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, unit FROM p)"""


@query(
    "m7_twoway_within",
    TWOWAY_SQL + """, b AS (SELECT sum(x*y) / sum(x*x) AS b, sum(x*x) AS sxx, count(*) - (SELECT count(DISTINCT unit) + count(DISTINCT t) - 1 FROM p) - 1 AS df FROM z)
       SELECT 'd' AS term, round(any_value(b), 4) + 0.0 AS estimate, round(sqrt(sum((y - b*x)*(y - b*x)) / any_value(df) / any_value(sxx)), 4) + 0.0 AS std_error FROM z, b""",
)
def m7(spark, sf):
    return rounded(twoway_within(nation_year_panel(spark, sf), "y", ["d"], "unit", "t").table(spark).select("term", "estimate", "std_error"), 4)


# ---------------------------------------------------------------- learners


@query("m8_boosted_classifier")
def m8(spark, sf):
    df = labelled_documents(spark, sf).persist()
    model = L.boosted_classifier(df, "quality", DOC_FEATURES, maxDepth=4, maxIter=10)
    scored = L.predict_probability(model, df)
    return rounded(roc_auc(scored, "quality", "prob", 1), 4)


@query("m8_boosted_regressor")
def m8_regressor(spark, sf):
    df = labelled_documents(spark, sf).persist()
    model = L.boosted_regressor(df, "k_chars", ["lang_de", "lang_en", "lang_es", "lang_fr", "quality"], maxDepth=3, maxIter=5)
    return rounded(L.predict_value(model, df).groupBy("lang").agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n")), 4)


@query("m9_random_forest")
def m9(spark, sf):
    df = labelled_documents(spark, sf).persist()
    model = L.forest_regressor(df, "k_chars", ["lang_de", "lang_en", "lang_es", "lang_fr", "quality"], trees=20)
    return rounded(L.predict_value(model, df).groupBy("lang").agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n")), 4)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"), F.col("label").cast("bigint").alias("label")
    )


NEIGHBOURS = """n AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON {on})"""


@query(
    "m10_nearest",
    f"WITH {NEIGHBOURS.format(on='a.vec_id <> b.vec_id')} SELECT query_id, train_id, rank::BIGINT AS rank, round(dist, 6) + 0.0 AS dist FROM n WHERE rank <= 10",
)
def m10(spark, sf):
    v = vectors(spark, sf)
    return rounded(nearest(v, v, 10, exclude_self=True).select("query_id", "train_id", "rank", "dist"))


@query(
    "m10_knn_classify",
    f"""WITH {NEIGHBOURS.format(on='true')}, v AS (SELECT query_id, label, count(*)::DOUBLE AS c FROM n WHERE rank <= 10 GROUP BY 1, 2)
        SELECT query_id, first(label ORDER BY c DESC, label)::BIGINT AS pred, round(max(c) / 10, 6) + 0.0 AS share FROM v GROUP BY 1""",
)
def m10_classify(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn_predict(v, v, 10, "label"))


@query(
    "m10_knn_regress",
    f"WITH {NEIGHBOURS.format(on='true')} SELECT query_id, round(avg(label), 6) + 0.0 AS pred FROM n WHERE rank <= 5 GROUP BY 1",
)
def m10_regress(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn_predict(v, v, 5, "label", mode="regression"))


@query(
    "p5_smote",
    """WITH c AS (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1)
       SELECT label, 0::BIGINT AS synthetic, n FROM c
       UNION ALL SELECT label, 1, (floor(0.95 * (SELECT max(n) FROM c)) - n)::BIGINT FROM c WHERE floor(0.95 * (SELECT max(n) FROM c)) > n""",
)
def p5(spark, sf):
    made = smote(vectors(spark, sf), "id", "label", "vec", over_ratio=0.95)
    return rounded(made.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n")))


@query("m11_mlp")
def m11(spark, sf):
    df = labelled_documents(spark, sf).persist()
    scored = L.predict_probability(L.mlp_classifier(df, "quality", DOC_FEATURES), df)
    return rounded(roc_auc(scored, "quality", "prob", 1), 4)


@query("m12_random_intercept_logit")
def m12(spark, sf):
    rows = orders_by_customer(spark, sf).select("o_orderstatus", "o_orderpriority", "c_nationkey")
    model = random_intercept_logit(rows, "o_orderstatus", [factor("o_orderpriority")], "c_nationkey", positive="F")
    return rounded(model.fit.table(spark).select("term", "estimate", "std_error").withColumn("variance", F.lit(model.variance)), 3)


@query("m13_tune_grid")
def m13(spark, sf):
    df = hash_fold(labelled_documents(spark, sf), "doc_id", 3, seed=1).persist()
    grid = L.boost_grid({"maxDepth": [2, 4], "stepSize": [0.05, 0.1]})
    return rounded(L.tune_grid(df, "quality", DOC_FEATURES, GBTClassifier(labelCol="quality", maxIter=4, seed=1), grid, "fold", 3), 4)


# ---------------------------------------------------------------- scoring

# A small coefficient table with an aliased (null) term.
COEFS = [("(Intercept)", -1.25), ("price", 0.004), ("urgent", 0.6), ("finished", -0.35), ("unused", None)]


def _scoring_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1000.0).alias("price"),
        (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), (F.col("o_orderstatus") == "F").cast("double").alias("finished"),
    )


ETA_SQL = "(-1.25 + 0.004 * o_totalprice / 1000.0 + 0.6 * (o_orderpriority = '1-URGENT')::INT - 0.35 * (o_orderstatus = 'F')::INT)"


@query("m14_score_long", f"SELECT o_orderkey, round({ETA_SQL}, 6) + 0.0 AS eta, round(1 / (1 + exp(-{ETA_SQL})), 6) + 0.0 AS prob FROM orders")
def m14(spark, sf):
    coefs = spark.createDataFrame(COEFS, "term string, estimate double")
    return rounded(score_long(_scoring_rows(spark, sf), "o_orderkey", ["price", "urgent", "finished"], coefs))


@query("m15_score_expr", f"SELECT o_orderkey, round({ETA_SQL}, 6) + 0.0 AS eta FROM orders")
def m15(spark, sf):
    coefs = {k: v for k, v in COEFS if v is not None}
    return rounded(_scoring_rows(spark, sf).select("o_orderkey", score_expr({k: v for k, v in coefs.items()}).alias("eta")))


@query(
    "m16_aliased_terms",
    """SELECT '(Intercept)' AS term, 0::BIGINT AS aliased UNION ALL SELECT 'l_quantity', (var_samp(l_quantity) < 1e-12)::BIGINT FROM lineitem
       UNION ALL SELECT 'l_discount', (1 - corr(l_quantity, l_discount) ** 2 < 1e-9)::BIGINT FROM lineitem
       UNION ALL SELECT 'mix', (max(abs(2 * l_quantity + 30 * l_discount - (2 * l_quantity + 30 * l_discount))) < 1e-9)::BIGINT FROM lineitem""",
)
def m16(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("mix", 2 * F.col("l_quantity") + 30 * F.col("l_discount"))
    return aliased_terms(li, ["l_quantity", "l_discount", "mix"])


@query(
    "m17_predict_clip",
    f"""SELECT CASE WHEN 1 / (1 + exp(-{ETA_SQL})) > 0.3 THEN 'Yes' ELSE 'No' END AS pred, count(*) AS n, round(sum(greatest({ETA_SQL}, 0)), 4) + 0.0 AS clipped FROM orders GROUP BY 1""",
)
def m17(spark, sf):
    eta = score_expr({k: v for k, v in COEFS if v is not None})
    scored = _scoring_rows(spark, sf).select(eta.alias("eta"))
    return rounded(
        scored.groupBy(predict_class(1.0 / (1.0 + F.exp(-F.col("eta"))), 0.3).alias("pred")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(predict_clip("eta")).alias("clipped")
        ),
        4,
    )


@query(
    "m18_eligibility_score",
    f"""WITH p AS (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)
        SELECT c_mktsegment, count(*) AS n, round(avg(p), 6) + 0.0 AS p_receipt, round(sum(p * (1 + o_orderkey % 5)), 3) + 0.0 AS eligibility_weight
        FROM {ORDERS_BY_CUSTOMER} JOIN p USING (o_orderpriority) GROUP BY 1""",
)
def m18(spark, sf):
    """A model trained on one table scores another through its coefficient table."""
    o = table(spark, sf, "orders")
    fit = logit(o, "o_orderstatus", [factor("o_orderpriority")], positive="F")
    coefs = {row[0]: row[1] for row in fit.rows()}
    survey = orders_by_customer(spark, sf).withColumn("base_weight", 1 + F.col("o_orderkey") % 5)
    scored = apply_eligibility_score(survey, coefs, dict(zip(fit.names, fit.design.columns)), "base_weight")
    return rounded(
        scored.groupBy("c_mktsegment").agg(
            F.count(F.lit(1)).alias("n"), F.avg("p_receipt").alias("p_receipt"), F.sum(null_to_zero("eligibility_weight")).alias("eligibility_weight")
        ),
        6, eligibility_weight=3,
    )
