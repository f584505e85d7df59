"""Grouped, ranked and sampled operators against brute force, with one group holding most rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quasi.operators import agg as A
from quasi.operators import metrics as M
from quasi.operators import sample as P
from quasi.operators import skew as S
from quasi.sources import extracts, waves


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; group 0 holds two thirds, group None some, the rest is spread thinly."""
    rng = np.random.default_rng(3)
    g = [0 if i % 3 else (None if i % 30 == 0 else int(rng.integers(1, 200))) for i in range(3000)]
    pdf = pd.DataFrame({"id": range(3000), "g": pd.array(g, dtype="Int64"), "x": rng.integers(0, 400, 3000) / 4.0, "y": rng.integers(0, 2, 3000)})
    rows = [(int(i), None if pd.isna(a) else int(a), float(x), int(y)) for i, a, x, y in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "id int, g int, x double, y int").repartition(7, "id").cache()


def test_attach_totals_keeps_every_row(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(S, "HOT_GROUPS", 3)
    got = S.attach_totals(df, ["g"], [F.sum("x").alias("sx"), F.max("id").alias("mid")]).toPandas().sort_values("id")
    want = pdf.groupby("g", dropna=False)
    assert len(got) == len(pdf)
    assert np.allclose(got.sx.to_numpy(), want.x.transform("sum").to_numpy())
    assert (got.mid.to_numpy() == want.id.transform("max").to_numpy()).all()


def test_exact_quantiles(skewed):
    pdf, df = skewed
    got = {r["g"]: r for r in S.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        row = got[None if pd.isna(g) else g]
        assert np.allclose([row[f"q{i}"] for i in range(5)], np.quantile(part.x, [0, 0.1, 0.5, 0.99, 1.0]))


def test_running_totals(skewed):
    pdf, df = skewed
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = S.running_totals(counts, "x", ["n"]).toPandas().sort_values("x")
    assert (got.n_cum.to_numpy() == pdf.groupby("x").size().cumsum().to_numpy()).all()
    assert set(got.n_total) == {3000}


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))


def test_hash_rank_and_cut_agree_with_sorting(skewed):
    pdf, df = skewed
    ranked = S.hash_rank(df, "id", ["g"], 5).toPandas()
    split = P.stratified_split(df, "id", ["g"], 0.8, 5).toPandas()
    for g, part in pdf.groupby("g", dropna=False):
        order = md5_order(part.id.tolist(), 5)
        same = ranked[ranked.g.isna()] if pd.isna(g) else ranked[ranked.g == g]
        assert same.sort_values("rank").id.tolist() == order
        train = split[(split.g.isna() if pd.isna(g) else split.g == g) & (split.split == "train")]
        assert set(train.id) == set(order[: int(0.8 * len(order))])
    assert len(split) == len(pdf)


def test_splits_do_not_depend_on_partitioning(spark, skewed):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(set(map(tuple, P.vfold_cv(df.repartition(int(n)), "id", 10, 2).select("id", "fold").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    sizes = pd.Series([f for _, f in seen[0]]).value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_monte_carlo_sizes(skewed):
    _, df = skewed
    got = P.mc_cv(df.select("id"), "id", 4, 0.75).groupBy("resample_id").agg(F.sum("in_analysis").alias("n"), F.count(F.lit(1)).alias("all"))
    assert {(r["n"], r["all"]) for r in got.collect()} == {(2250, 3000)}


def test_first_last_and_max(skewed):
    pdf, df = skewed
    first = {r["g"]: r["id"] for r in A.first_per_group(df, ["g"], ["x", "id"]).collect()}
    ordered = pdf.sort_values(["x", "id"])
    for g, part in ordered.groupby("g", dropna=False):
        assert first[None if pd.isna(g) else g] == part.id.iloc[0]
    assert A.drop_last(df, ["g"], ["x", "id"]).count() == 3000 - pdf.g.nunique(dropna=False)
    assert A.rows_at_max(df, "x").count() == int((pdf.x == pdf.x.max()).sum())


def test_metrics_against_pairs(skewed):
    pdf, df = skewed
    pos, neg = pdf[pdf.y == 1].x.to_numpy(), pdf[pdf.y == 0].x.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "x", 1).first()[0] == pytest.approx(want)
    assert M.roc_auc(df, "y", "x", 0).first()[0] == pytest.approx(1 - want)
    sweep = {r["threshold"]: r for r in M.threshold_sweep(df, "y", "x", 1, [-1.0, 20.0, 500.0]).collect()}
    assert sweep[-1.0]["sens"] == 1.0 and sweep[500.0]["sens"] == 0.0
    assert sweep[20.0]["sens"] == pytest.approx((pos > 20).mean()) and sweep[20.0]["spec"] == pytest.approx((neg <= 20).mean())


def test_one_class_only_gives_null_area(spark):
    df = spark.createDataFrame([("Yes", 0.2), ("Yes", 0.7)], "truth string, p double")
    assert M.roc_auc(df, "truth", "p", "Yes").first()[0] is None


def test_weighted_rate_skips_null_flags(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0), ("a", None, 9.0), ("b", None, 1.0)], "m string, f int, w double")
    got = {r["m"]: r["rate"] for r in A.weighted_rate(df, ["m"], "f", "w").collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] is None


def test_keyed_extracts_and_waves(spark, tmp_path):
    for name, v in (("uk_2019_LBAon.txt", 1.5), ("uk_2020_UCAon.txt", 2.5)):
        (tmp_path / name).write_text(f"id\tv\n1\t{v}\n2\t\n")
    got = extracts.read_keyed_extracts(
        spark, str(tmp_path), "id int, v double", r"uk_(\d{4})_(\w+)\.txt", {"year": "int", "policy": "string"}
    ).orderBy("year", "id").collect()
    assert [tuple(r) for r in got] == [(2019, "LBAon", 1, 1.5), (2019, "LBAon", 2, None), (2020, "UCAon", 1, 2.5), (2020, "UCAon", 2, None)]
    a, b = (spark.createDataFrame([(1.0,)], f"pwta{y} double") for y in (18, 20))
    stacked = waves.union_waves({"x": waves.harmonise_weight(a), "y": waves.harmonise_weight(b)})
    assert stacked.columns == ["weight", "wave"]
    with pytest.raises(ValueError):
        waves.harmonise_weight(stacked.drop("weight"))


def test_coefficient_table_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.0, None, None, None, None, None)], extracts.COEFFICIENT_SCHEMA)
    for fmt in ("parquet", "csv"):
        extracts.write_coefficients(t, str(tmp_path / fmt), fmt)
        assert [tuple(r) for r in extracts.read_coefficients(spark, str(tmp_path / fmt), fmt).collect()] == [tuple(t.first())]


def test_cuts_of_many_groups_are_those_of_few(spark):
    rows = [(i, "hot" if i % 2 else None if i % 4 else f"s{i % 100}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, s string")
    for prop in (0.7, 0.0003):
        few, many = ({tuple(r) for r in S.below_cut(df, "id", prop, ["s"], few=f).collect()} for f in (True, False))
        assert few == many and len(many) == 4000
        taken = {}
        for _, s, below in many:
            taken[s] = taken.get(s, 0) + below
        sizes = {s: sum(1 for r in rows if r[1] == s) for s in taken}
        assert taken == {s: int(prop * n) for s, n in sizes.items()}


def test_only_the_largest_groups_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_GROUPS", 1)
    rows = [(i, "hot" if i % 2 else f"s{i % 100}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, s string")
    few, many = ({tuple(r) for r in S.below_cut(df, "id", 0.5, ["s"], few=f).collect()} for f in (True, False))
    assert few == many
    totals = S.attach_totals(df, ["s"], [F.count(F.lit(1)).alias("n")]).select("s", "n").distinct().collect()
    assert {r["s"]: r["n"] for r in totals} == {s: sum(1 for x in rows if x[1] == s) for _, s in rows}
