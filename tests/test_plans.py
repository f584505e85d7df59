"""Feature building on edge rows, claimant series, and every registered query at the smallest scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quasi.models.design import factor
from quasi.plans import eligibility as E
from quasi.plans import reports as R


def person(idperson, idhh, policy, **kw):
    base = {c: 0.0 for c in E.AMOUNTS} | {c: 1 for c in E.CODES} | {"dag": 30, "liwwh": 130.0}
    return {"year": "2019", "policy": policy, "idhh": idhh, "idperson": idperson} | base | kw


def frame(spark, people):
    names = list(people[0])
    kinds = {"year": "string", "policy": "string", "idhh": "bigint", "idperson": "bigint"} | {c: "double" for c in E.AMOUNTS} | {c: "int" for c in E.CODES}
    return spark.createDataFrame([tuple(p[n] for n in names) for p in people], ", ".join(f"{n} {kinds[n]}" for n in names))


@pytest.fixture(scope="module")
def tidy(spark):
    people = []
    for policy in ("LBAon", "UCAon"):
        people += [
            person(1, 1, policy, bho_s=10.0, bfamt_s=5.0, brd_s=1.0, bsauc_s=7.0, brduc_s=2.0, yem=9000.0),
            person(2, 1, policy, dag=15, les=6, yem=0.5),
            person(3, 1, policy, dag=16, dms=0, yem=3415.0, drgn1=3),
            person(4, 2, policy, dag=66, les=4, yem=500.0, amrtn=4),
        ]
    people.append(person(5, 2, "LBAon", dag=65, les=8))
    return {r["idperson"]: r for r in E.tidy_simulation(E.join_scenarios(frame(spark, people))).collect()}


def test_incomes_and_children(tidy):
    assert tidy[1]["lba_income"] == 14.0 and tidy[1]["uc_income"] == 15.0 and tidy[1]["uc_receipt"] == 1.0
    assert tidy[1]["children"] == "1" and tidy[4]["children"] == "0"
    assert tidy[5]["uc_income"] is None


def test_topcoded_earnings(tidy):
    assert (tidy[1]["income"], tidy[1]["i_m"], tidy[1]["i_l"], tidy[1]["i_c"]) == (3415.0, 1.0, 0.0, "3000+")
    assert tidy[2]["i_c"] == "0" and tidy[4]["i_c"] == "500-999" and tidy[3]["i_m"] == 1.0


def test_labels(tidy):
    assert tidy[2]["employment"] == "Inactive" and tidy[2]["student"] == 1 and tidy[2]["emp_len"] == "Inactive"
    assert tidy[1]["employment"] == "Employed" and tidy[1]["emp_len"] == "Between 10 and 20 years"
    assert tidy[3]["marsta"] == "Single" and tidy[3]["region"] == "D" and tidy[4]["house_ten"] == "Rented"


def test_household_totals_before_age_filter(spark):
    people = [person(i, 1, p, dag=a, bho_s=10.0, bsauc_s=float(i)) for p in ("LBAon", "UCAon") for i, a in ((1, 17), (2, 18), (3, 65), (4, 66))]
    rows = E.model_rows(E.tidy_simulation(E.join_scenarios(frame(spark, people)))).collect()
    assert {r["idperson"] for r in rows} == {2, 3}
    assert {(r["lba_income"], r["uc_income"], r["n_hh_emp"]) for r in rows} == {(40.0, 14.0, "2+")}


def test_eligibility_model(spark):
    people = [
        person(i, i, p, dag=20 + i % 40, dgn=i % 2, dms=1 + i % 3, bsauc_s=float((i * 7 + i // 3) % 5 > 2 - i % 2))
        for p in ("LBAon", "UCAon") for i in range(1, 401)
    ]
    rows = E.model_rows(E.tidy_simulation(E.join_scenarios(frame(spark, people)))).cache()
    matrix = E.model_matrix(rows, ["gender", "marsta"])
    assert {"gender_Male", "marsta_Married", "marsta_Separated"} <= set(matrix.columns) and "gender" not in matrix.columns
    fit, scored = E.fit_eligibility(rows, ["age", factor("gender"), factor("marsta")])
    assert scored.count() == 80 and fit.n == 320
    assert scored.where("pred_yes > 0 AND pred_yes < 1").count() == 80


def test_survey_features(spark):
    cols = {"AGE": 40, "NTNLTY12": 926, "DISEA": 1, "INECAC05": 20, "STUCUR": 2, "QUAL_1": 0, "QUAL_10": 0, "QUAL_24": 1, "SEX": 1,
            "MARSTA": 6, "EMPMON": 12, "ILODEFR": 2, "GRSSWK": -9.0, "GRSSWK2": 100.0, "lhw": -8, "TEN1": -9, "HRPID": 2}
    row = E.tidy_survey(spark.createDataFrame([tuple(cols.values())], list(cols))).first()
    assert row["employment"] == "Inactive" and row["educ"] == "Secondary" and row["marsta"] == "Married"
    assert row["income"] == pytest.approx(52 * 100 / 12) if 52 * 100 / 12 < 3415 else row["income"] == 3415
    assert row["hours_worked_wk"] == 0 and row["house_ten"] == "Other" and row["house_resp"] == "No" and row["seeking"] == "Yes"


def test_claimant_series(spark):
    schema = "refdte string, age int, tpbn1301 int, tpbn1302 int, {} double"
    waves = {
        "a": spark.createDataFrame([("1042014", 30, 1, 1, 2.0), ("15042014", 64, 3, -9, 1.0), ("16042014", 65, 1, -9, 9.0)], schema.format("pwta18")),
        "b": spark.createDataFrame([("01052014", 16, 1, 2, 4.0), ("02052014", 40, 6, -9, 4.0)], schema.format("pwta20")),
    }
    rows = R.claimants(waves)
    series = R.claimant_series(rows)
    new = [r["prop_uc"] for r in series["new"].orderBy("month").collect()]
    assert new == pytest.approx([2 / 3, 0.5])
    counts = {(str(r["month"]), r["claim"]): r["n"] for r in series["counts"].collect()}
    assert counts == {("2014-04-01", "New"): 1, ("2014-04-01", "Legacy"): 1, ("2014-05-01", "Combination"): 1}
    register = spark.createDataFrame([("2014-04-01", 10, 40)], "d string, n_uc long, pop long").select(F.to_date("d").alias("date"), "n_uc", "pop")
    assert [r["prop_obs"] for r in R.compare_with_register(series["new"], register).collect()] == [0.25]


def test_weighting_report(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    d = (rng.uniform(size=1000) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(d, x)], "d int, x double")
    row = R.weighting_report(df, "d", [], ["x"], ["x"]).first()
    assert row["unweighted"] > 0.5 and row["weighted"] < 0.15


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


# Cheap queries of every family against DuckDB; tests/oracle_check.py compares all of them.
SAMPLE = ["s7_decode_labels", "c4_cut", "c5_rule_usage", "c10_count_codes", "a1_household_totals", "a9_histogram", "r1_pivot_scenarios",
          "j2_lookup_observed", "w2_seasonal_difference", "p4_sample_per_group", "e3_confusion_matrix", "m15_score_expr", "d2_gamma_fit", "x8_weight_diagnostics"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    from oracle_check import check, connect

    from quasi.queries import ORACLES, QUERIES

    result, n, _ = check(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert result == "" and n > 0
