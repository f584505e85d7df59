"""Scalar expressions on their edge rows."""

from __future__ import annotations

import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quasi.functions import columns as C
from quasi.functions import tails
from quasi.functions.special import log_gamma_density, normal_cdf
from quasi.sources.extracts import clean_name, clean_names, wave_name


def values(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def test_cut_closures_and_outside(spark):
    xs = [(x,) for x in (-1.0, 0.0, 0.5, 1.0, 3500.0, 3501.0, None)]
    got = values(
        spark, xs, "x double",
        left=C.cut("x", [0, 1, 500, 3500], right=False, include_lowest=True),
        right=C.cut("x", [0, 1, 500, 3500]),
    )
    assert [g[0] for g in got] == [None, "[0,1)", "[0,1)", "[1,500)", "[500,3500]", None, None]
    assert [g[1] for g in got] == [None, None, "(0,1]", "(0,1]", "(500,3500]", None, None]


def test_recode_first_match_and_unreachable(spark):
    code = F.col("c")
    rules = [(code.between(12, 33), "Inactive"), (code.isin(20, 31), "Retired"), (code == 4, "Employed")]
    df = spark.createDataFrame([(20,), (31,), (12,), (4,), (99,), (None,)], "c int")
    got = [r[0] for r in df.select(C.recode(rules, "Other")).collect()]
    assert got == ["Inactive", "Inactive", "Inactive", "Employed", "Other", "Other"]
    usage = {r["label"]: (r["matches"], r["first_matches"]) for r in C.rule_usage(df, rules).collect()}
    assert usage == {"Inactive": (3, 3), "Retired": (2, 0), "Employed": (1, 1)}


def test_survey_dates(spark):
    got = values(spark, [("1042011",), (" 15062014 ",), ("99999999",), ("-9",), (None,)], "s string", d=C.parse_survey_date("s"))
    assert [g[0] for g in got] == [dt.date(2011, 4, 1), dt.date(2014, 6, 15), None, None, None]


def test_period_index(spark):
    got = values(spark, [(dt.date(2014, 1, 5),), (dt.date(2015, 12, 31),)], "d date", m=C.period_index("d", 2014), q=C.period_index("d", 2014, "quarter"))
    assert got == [(1, 1), (24, 8)]


def test_code_counts_and_claim_type(spark):
    df = spark.createDataFrame([(1, 1, -9), (1, 3, -9), (6, -8, -9), (2, None, 5)], "a int, b int, c int")
    counted = C.count_codes(["a", "b", "c"], {"uc": 1, "tax": 3, "housing": 2, "jsa": 5})
    rows = df.select(*[c.alias(n) for n, c in counted.items()])
    rows = rows.withColumn("claim", C.claim_type("uc", F.col("tax") + F.col("housing") + F.col("jsa"))).collect()
    assert [r["uc"] for r in rows] == [2, 1, 0, 0]
    assert [r["uc_flag"] for r in rows] == [1, 1, 0, 0]
    assert [r["claim"] for r in rows] == ["New", "Combination", None, "Legacy"]


def test_numbers_from_prose(spark):
    text = "-0.066 point drop in life satisfaction (-0.087 to -0.044)"
    got = values(spark, [(text,), ("nothing here",)], "t string", **C.extract_numbers("t"))
    assert got[0] == (-0.066, -0.087, -0.044) and got[1] == (None, None, None)


def test_split_and_format(spark):
    got = values(spark, [("0.1 to 0.25",), ("x",)], "t string", **C.split_column("t", " to ", {"ll": "double", "ul": "double"}))
    assert got == [(0.1, 0.25), (None, None)]
    assert values(spark, [(0.123, -1.0, 2.0)], "e double, l double, u double", s=C.format_effect("e", "l", "u"), p=C.format_percent("e")) == [
        ("0.12 (-1.00, 2.00)", "12.3%")
    ]


@pytest.mark.parametrize(
    "new,old,want",
    [(0.0, 0.0, "No change"), (5.0, 0.0, "Increase"), (101.0, 100.0, "No change"), (102.0, 100.0, "Increase"), (97.0, 100.0, "Decrease"), (0.0, 10.0, "Decrease")],
)
def test_benefit_change(spark, new, old, want):
    assert values(spark, [(new, old)], "n double, o double", c=C.benefit_change_class("n", "o")) == [(want,)]


def test_region_letters_share_d(spark):
    got = values(spark, [(1,), (2,), (3,), (4,)], "r int", x=C.letter_region("r"))
    assert [g[0] for g in got] == ["C", "D", "D", "E"]


def test_treatment_and_injection(spark):
    got = values(
        spark, [(5, 5, 1.0), (4, 5, 1.0), (9, 0, 1.0), (7, 5, 1.0)], "t int, g int, y double",
        d=C.treated("t", "g"), rel=C.relative_time("t", "g"), y=C.inject_effect("y", "t", "g", F.lit(10.0)),
    )
    assert got == [(1, 0, 1.0), (0, -1, 1.0), (0, None, 1.0), (1, 2, 21.0)]


def test_normal_distribution_function(spark):
    zs = [-40.0, -8.5, -7.2, -3.0, -0.5, 0.0, 0.5, 1.96, 6.0, 9.0]
    got = values(spark, [(z,) for z in zs], "z double", p=normal_cdf("z"))
    for z, (p,) in zip(zs, got):
        assert p == pytest.approx(NormalDist().cdf(z), rel=1e-9, abs=1e-15)


def test_tails_match_closed_forms():
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert tails.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138851986, abs=1e-9)
    assert tails.t_quantile(0.975, 1e8) == pytest.approx(1.959963985, abs=1e-6)
    assert tails.chi2_upper(5.0, 2) == pytest.approx(math.exp(-2.5), abs=1e-13)
    assert tails.chi2_upper(30.0, 4) == pytest.approx(math.exp(-15) * 16, rel=1e-10)


def test_gamma_density(spark):
    (got,) = values(spark, [(2.0, 3.0)], "x double, s double", d=F.exp(log_gamma_density("x", 1.0, "s")))
    assert got[0] == pytest.approx(math.exp(-2 / 3) / 3)


def test_names(spark):
    assert clean_name("95% CI") == "x95_percent_ci"
    assert clean_name("effectSize") == "effect_size"
    assert wave_name(2017) == "apr17_mar18" and wave_name(2099) == "apr99_mar00"
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a_b", "a.b"])
    assert clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]
