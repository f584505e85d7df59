"""Eligibility prediction: simulated households to features, model matrix, model, survey scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.functions import columns as C
from quasi.models.design import dummy_encode, factor, interaction
from quasi.models.glm import logit
from quasi.models.linear import Fit
from quasi.operators.agg import household_totals
from quasi.operators.sample import stratified_split
from quasi.operators.skew import attach_totals
from quasi.sources.extracts import read_keyed_extracts

# Income components of the two policy runs.
SHARED = ["bho_s", "bmu_s", "boamt_s", "boamtmm_s", "boamtxp_s"]
NEW_PLUS, NEW_MINUS = ["bsauc_s"], ["brduc_s"]
LEGACY_PLUS, LEGACY_MINUS = ["bfamt_s", "bsadi_s", "bsa_s", "bwkmt_s"], ["brd_s"]
AMOUNTS = [*SHARED, *NEW_PLUS, *NEW_MINUS, *LEGACY_PLUS, *LEGACY_MINUS, "yem", "lhw", "liwwh", "dwt"]
CODES = ["dag", "dcz", "ddi", "les", "deh", "dgn", "dms", "drgn1", "lowas", "amrtn", "dhr", "lcr01"]
EXTRACT_SCHEMA = ", ".join(
    ["idhh bigint", "idperson bigint", *[f"{c} double" for c in AMOUNTS], *[f"{c} int" for c in CODES]]
)
EXTRACT_NAME = r"uk_(\d{4})_(\w+)\.txt"
LEGACY_RUN, NEW_RUN = "LBAon", "UCAon"

# Code labels of the simulation output.
SIM_STATUS = {1: "Employed", 2: "Employed", 3: "Employed", 4: "Retired", 5: "Unemployed", 6: "Inactive", 7: "Inactive", 8: "Sick or disabled"}
SIM_EDUCATION = {2: "Lower Secondary", 3: "Secondary", 4: "Degree or College", 5: "Tertiary"}
MARITAL = {1: "Single", 2: "Married", 3: "Separated", 4: "Divorced", 5: "Widowed"}
SIM_TENURE = {"Mortgaged": ["1"], "Outright": ["2"], "Rented": ["3", "4", "5"], "Free": ["6"], "Other": ["7"]}
SEX = {0: "Female", 1: "Male"}
YES_NO = {0: "No", 1: "Yes"}
DISABLED = {0: "Not disabled", 1: "Disabled"}

# Earnings cap, earnings bands and job tenure bands (months).
EARNINGS_CAP = 3415.0
BAND_BREAKS = [0, 1, 500, 1000, 2000, 3000, 3500]
HOUSEHOLD_BAND_BREAKS = [0, 1, 500, 1000, 2000, 3000, 20000]
BAND_LABELS = ["0", "1-499", "500-999", "1000-1999", "2000-2999", "3000+"]
TENURE_MONTHS = {
    12: "Less than 12 months", 24: "Between 1 and 2 years", 60: "Between 2 and 5 years",
    120: "Between 5 and 10 years", 240: "Between 10 and 20 years",
}
LONGEST_TENURE = "20 years or more"

# Survey codes.
SURVEY_UK = 926
SURVEY_MARITAL = {"Single": [1], "Married": [2, 6], "Separated": [3, 7], "Divorced": [4, 8], "Widowed": [5, 9]}
SURVEY_TENURE = {"Mortgaged": ["2"], "Outright": ["1"], "Rented": ["3", "4"], "Free": ["5"], "Other": ["6", "-9", "-8"]}
QUALIFICATIONS = [
    (r"^QUAL_[1-9]$", "Degree or College"),
    (r"^QUAL_(1[0-7]|23|29|30)$", "Secondary"),
    (r"^QUAL_(18|19|2[0-4])$", "Secondary"),
    (r"^QUAL_(2[5-9]|3[0-5])$", "Tertiary"),
]


def read_simulation(spark: SparkSession, path: str) -> DataFrame:
    """Every (year, policy) extract below a path."""
    return read_keyed_extracts(spark, path, EXTRACT_SCHEMA, EXTRACT_NAME, {"year": "string", "policy": "string"})


def join_scenarios(extracts: DataFrame) -> DataFrame:
    """One row per person and year: legacy-run columns with both runs' incomes and the receipt flag."""
    legacy = extracts.where(F.col("policy") == LEGACY_RUN).withColumn(
        "lba_income", C.composite([*SHARED, *LEGACY_PLUS], LEGACY_MINUS)
    ).drop("policy")
    award = C.composite(NEW_PLUS, NEW_MINUS)
    new = extracts.where(F.col("policy") == NEW_RUN).select(
        "year", "idperson", C.composite([*SHARED, *NEW_PLUS], NEW_MINUS).alias("uc_income"), (award > 0).cast("double").alias("uc_receipt")
    )
    return legacy.join(new, ["year", "idperson"], "left")


def job_tenure(status: Sequence[tuple[Column, str]], months: Column) -> Column:
    """Out-of-work status first, then bands of months in work."""
    bands = [(months < limit, label) for limit, label in TENURE_MONTHS.items()]
    return C.recode([*status, *bands, (months >= max(TENURE_MONTHS), LONGEST_TENURE)])


def earnings_columns(income: Column) -> dict[str, Column]:
    parts = C.topcode(income, EARNINGS_CAP)
    return {**parts, "i_c": C.cut(parts["income"], BAND_BREAKS, right=False, include_lowest=True, labels=BAND_LABELS)}


def tidy_simulation(people: DataFrame) -> DataFrame:
    """Model features of simulated people. Children are counted within (year, household)."""
    les = F.col("les")
    rows = attach_totals(people, ["year", "idhh"], [F.count(F.when(F.col("dag") < 16, 1)).alias("n_children")])
    not_working = [(les == code, label) for code, label in SIM_STATUS.items() if label != "Employed"]
    return rows.select(
        "year", "idhh", "idperson", "uc_income", "lba_income", "uc_receipt",
        F.col("dag").alias("age"),
        F.when(F.col("dcz") == 1, "UK").when(F.col("dcz").isNotNull(), "Other").alias("cit"),
        C.label_levels("ddi", DISABLED).alias("disab"),
        C.recode([(les == code, label) for code, label in SIM_STATUS.items()], "Other").alias("employment"),
        C.recode([(F.col("deh") == code, label) for code, label in SIM_EDUCATION.items()], "None").alias("educ"),
        C.label_levels("dgn", SEX).alias("gender"),
        C.label_levels(F.when(F.col("dms") == 0, 1).otherwise(F.col("dms")), MARITAL).alias("marsta"),
        C.letter_region("drgn1").alias("region"),
        job_tenure(not_working, F.col("liwwh")).alias("emp_len"),
        C.label_levels("lowas", YES_NO).alias("seeking"),
        F.when(les == 6, 1).when(les.isNotNull(), 0).alias("student"),
        C.lump_other(F.col("n_children"), ["0", "1"], "2+").alias("children"),
        *[c.alias(n) for n, c in earnings_columns(F.col("yem")).items()],
        F.col("lhw").alias("hours_worked_wk"),
        C.collapse_levels("amrtn", SIM_TENURE).alias("house_ten"),
        C.label_levels("dhr", YES_NO).alias("house_resp"),
        F.when(F.col("lcr01") == 0, "No").when(F.col("lcr01").isNotNull(), "Yes").alias("caring"),
    )


def survey_status_rules(code: Column) -> list[tuple[Column, str]]:
    """Ordered activity rules. The wide inactive range comes first, so retired and sick codes inside it
    are labelled inactive; ``rule_usage`` reports the two unreachable rules."""
    return [
        (code.between(1, 4), "Employed"), (code == 5, "Unemployed"), (code.between(12, 33), "Inactive"),
        (code.isin(20, 31), "Retired"), (code.isin(15, 16, 26, 27), "Sick or disabled"),
    ]


def tidy_survey(people: DataFrame) -> DataFrame:
    """The same features from survey codes."""
    import re

    code = F.col("INECAC05")
    rules = survey_status_rules(code)
    weekly = C.clip_floor("GRSSWK") + C.clip_floor("GRSSWK2")
    education = [
        (C.any_match([c for c in people.columns if re.match(pattern, c)], 1), label)
        for pattern, label in QUALIFICATIONS
        if any(re.match(pattern, c) for c in people.columns)
    ]
    return people.select(
        F.col("AGE").alias("age"),
        F.when(F.col("NTNLTY12") == SURVEY_UK, "UK").when(F.col("NTNLTY12").isNotNull(), "Other").alias("cit"),
        F.when(F.col("DISEA") == 1, "Disabled").when(F.col("DISEA").isNotNull(), "Not disabled").alias("disab"),
        C.recode(rules, "Other").alias("employment"),
        F.when(F.col("STUCUR") == 1, 1).when(F.col("STUCUR").isNotNull(), 0).alias("student"),
        C.recode(education, "None").alias("educ"),
        C.label_levels("SEX", {1: "Male", 2: "Female"}).alias("gender"),
        C.recode([(F.col("MARSTA").isin(codes), label) for label, codes in SURVEY_MARITAL.items()], "Single").alias("marsta"),
        job_tenure(rules[1:], F.col("EMPMON")).alias("emp_len"),
        F.when(F.col("ILODEFR") == 2, "Yes").when(F.col("ILODEFR").isNotNull(), "No").alias("seeking"),
        *[c.alias(n) for n, c in earnings_columns(C.null_to_zero(52.0 * weekly / 12.0)).items()],
        F.when(F.col("lhw").isin(-9, -8), 0).otherwise(F.col("lhw")).alias("hours_worked_wk"),
        C.collapse_levels("TEN1", SURVEY_TENURE).alias("house_ten"),
        F.when(F.col("HRPID") == 1, "Yes").otherwise("No").alias("house_resp"),
    )


def model_rows(tidy: DataFrame, low: int = 18, high: int = 65) -> DataFrame:
    """Household totals on every member, then the age range. Totals are taken before the filter."""
    counts = {
        f"n_hh_{short}": F.col("employment") == label
        for short, label in (("emp", "Employed"), ("unemp", "Unemployed"), ("inact", "Inactive"))
    }
    members = tidy.withColumnsRenamed({c: f"own_{c}" for c in ("lba_income", "uc_income", "uc_receipt")})
    rows = household_totals(
        members, ["year", "idhh"], {"lba_income": "own_lba_income", "hh_income": "income"},
        {"uc_income": "own_uc_income", "uc_receipt": "own_uc_receipt"}, counts,
    )
    rows = rows.where(F.col("age").between(low, high)).drop("own_lba_income", "own_uc_income", "own_uc_receipt")
    lumped = {n: C.lump_other(n, ["0", "1"], "2+") for n in counts}
    band = C.cut("hh_income", HOUSEHOLD_BAND_BREAKS, right=False, include_lowest=True, labels=BAND_LABELS)
    return rows.withColumns(
        {**lumped, "hh_i_c": band, "benefit_change": C.benefit_change_class("uc_income", "lba_income"),
         "uc_receipt": F.when(F.col("uc_receipt") > 0, "Yes").otherwise("No")}
    )


FEATURES = [
    "cit", "disab", "educ", "gender", "marsta", "region", "emp_len", "seeking", "children", "i_c", "house_ten", "house_resp", "caring",
]


# Level order of labelled features; the first level is the base.
LEVEL_ORDER = {
    "disab": list(DISABLED.values()), "gender": list(SEX.values()), "marsta": list(MARITAL.values()),
    "seeking": list(YES_NO.values()), "children": ["0", "1", "2+"], "i_c": BAND_LABELS, "house_ten": list(SIM_TENURE),
    "house_resp": list(YES_NO.values()), "caring": list(YES_NO.values()),
}


def model_matrix(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Numeric dummies of the features, first level dropped."""
    keep = ["year", "idhh", "idperson", "uc_receipt", "age", "student", "hours_worked_wk"]
    return dummy_encode(rows.select(*keep, *features), list(features), order=LEVEL_ORDER)


def eligibility_terms() -> list:
    """Main effects and the interactions of gender, children, job tenure, caring and marital status."""
    def base(c: str) -> factor:
        return factor(c, ref=LEVEL_ORDER[c][0]) if c in LEVEL_ORDER else factor(c)

    gender, children, tenure, marital, caring = (base(c) for c in ("gender", "children", "emp_len", "marsta", "caring"))
    mains = ["age", "hours_worked_wk", "student", *[base(c) for c in FEATURES]]
    return mains + [
        interaction(gender, children), interaction(gender, children, tenure), interaction(children, tenure),
        interaction("student", children), interaction("student", caring), interaction(marital, gender),
        interaction(marital, children), interaction(marital, gender, children),
    ]


def fit_eligibility(rows: DataFrame, terms: Sequence | None = None, seed: int = 1) -> tuple[Fit, DataFrame]:
    """80/20 split by year, fit on the training part, probabilities for the held-out part."""
    split = stratified_split(rows, "idperson", ["year"], 0.8, seed)
    fit = logit(split.where(F.col("split") == "train"), "uc_receipt", terms or eligibility_terms(), positive="Yes")
    return fit, split.where(F.col("split") == "test").withColumn("pred_yes", fit.mean())
