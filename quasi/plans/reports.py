"""Claimant rates over time, exposure weighting reports and rollout evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.functions import columns as C
from quasi.models import did
from quasi.models import weighting as X
from quasi.operators.agg import category_count, weighted_rate, weighted_share
from quasi.operators.reshape import select_by_name
from quasi.sources.waves import harmonise_weight, union_waves

# Answer codes of the repeated benefits question.
BENEFIT_CODES = {"uc": 1, "housing": 2, "tax_cr": 3, "income_s": 4, "jsa": 5, "disab": 6}
LEGACY_BENEFITS = ["tax_cr", "housing", "income_s", "jsa"]


def claimants(
    waves: Mapping[object, DataFrame], date: str = "refdte", age: str = "age", ages: tuple[int, int] = (16, 64),
    answers: str = r"^tpbn13\d\d$",
) -> DataFrame:
    """All waves with month, code counts, the legacy flag and the claim type, for one age range."""
    stacked = union_waves({tag: harmonise_weight(df) for tag, df in waves.items()})
    columns = select_by_name(stacked, regex=answers)
    rows = stacked.where(F.col(age).between(*ages)).withColumn("month", C.month_start(C.parse_survey_date(date)))
    rows = rows.withColumns(C.count_codes(columns, BENEFIT_CODES))
    legacy = sum((F.col(c) for c in LEGACY_BENEFITS[1:]), F.col(LEGACY_BENEFITS[0]))
    return rows.withColumns({"other": (legacy > 0).cast("int"), "claim": C.claim_type("uc", legacy)})


def claimant_series(rows: DataFrame, weight: str = "weight") -> dict[str, DataFrame]:
    """Monthly weighted rates of new and legacy claims, shares by claim type, and counts."""
    return {
        "new": weighted_rate(rows, ["month"], F.col("uc_flag"), weight, "prop_uc"),
        "legacy": weighted_rate(rows, ["month"], F.col("other"), weight, "prop_other"),
        "types": weighted_share(rows, ["month"], "claim", weight),
        "counts": category_count(rows.where(F.col("claim").isNotNull()), ["month", "claim"]),
    }


def compare_with_register(rates: DataFrame, register: DataFrame) -> DataFrame:
    """Reported rate next to the rate of an external (date, n_uc, pop) table, months in both."""
    observed = register.select(F.col("date").alias("month"), F.try_divide(F.col("n_uc").cast("double"), F.col("pop").cast("double")).alias("prop_obs"))
    return rates.join(observed, "month", "inner")


def weighting_report(
    df: DataFrame, exposure: str, num: Sequence, den: Sequence, continuous: Sequence[str], categorical: Sequence[str] = (),
    positive: object = 1,
) -> DataFrame:
    """Balance before and after stabilised weighting: (variable, unweighted, weighted)."""
    weighted = X.trim_weights(X.iptw_binary(df, exposure, num, den, positive), "weight")
    before = X.smd(df, exposure, continuous, categorical).withColumnRenamed("smd", "unweighted")
    after = X.smd(weighted, exposure, continuous, categorical, "weight").withColumnRenamed("smd", "weighted")
    return before.join(after, "variable")


def rollout_report(df: DataFrame, y: str, unit: str, time: str, cohort: str) -> DataFrame:
    """Estimates of the average effect from several estimators on one balanced panel."""
    spark = df.sparkSession
    rows = df.withColumn("__d", C.treated(time, cohort))
    gt = did.att_gt(rows, y, time, cohort, unit, control="notyet")
    overall = did.aggte(gt, "simple")
    found = [
        ("two-way fixed effects", *_first(did.twfe(rows, y, "__d", unit, time))),
        ("two-stage", *_first(did.did2s(rows, y, unit, time, "__d"))),
        ("group-time", float(overall.table.att.iloc[-1]), float(overall.vcov[-1, -1] ** 0.5)),
    ]
    return spark.createDataFrame(found, "estimator string, estimate double, std_error double")


def _first(fit) -> tuple[float, float]:
    return float(fit.coef[0]), float(fit.se[0])
