"""Classification and regression metrics from aggregates.

Ranking metrics work on counts per distinct score with bucketed running totals; threshold metrics count
scores between neighbouring thresholds once and cumulate over the grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.operators.skew import null_safe, running_totals


def _score_counts(df: DataFrame, truth: str, score: str, positive: object, by: Sequence[str] = ()) -> DataFrame:
    hit = F.col(truth) == F.lit(positive)
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg")
    )


def roc_auc(df: DataFrame, truth: str, score: str, positive: object, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores count one half."""
    cum = running_totals(_score_counts(df, truth, score, positive, by), "score", ["pos", "neg"], by)
    wins = F.col("pos") * ((F.col("neg_cum") - F.col("neg")) + F.col("neg") / 2.0)
    return cum.groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.max(F.col("pos_total").cast("double") * F.col("neg_total"))).alias("roc_auc")
    )


def roc_curve(df: DataFrame, truth: str, score: str, positive: object, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity and specificity when every score at or above the threshold is called positive."""
    cum = running_totals(_score_counts(df, truth, score, positive, by), "score", ["pos", "neg"], by)
    return cum.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(
            (F.col("pos_total") - F.col("pos_cum") + F.col("pos")).cast("double"), F.col("pos_total").cast("double")
        ).alias("sensitivity"),
        F.try_divide(
            (F.col("neg_cum") - F.col("neg")).cast("double"), F.col("neg_total").cast("double")
        ).alias("specificity"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    def ratio(a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))

    return [
        ratio(tp, tp + fn).alias("sens"), ratio(tn, tn + fp).alias("spec"),
        ratio(tp, tp + fp).alias("ppv"), ratio(tn, tn + fn).alias("npv"),
    ]


def class_metrics(df: DataFrame, truth: str, predicted: str, positive: object, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity, specificity, positive and negative predictive value."""
    t, p = F.col(truth) == F.lit(positive), F.col(predicted) == F.lit(positive)
    counts = df.groupBy(*by).agg(
        F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"),
        F.count(F.when(t & ~p, 1)).alias("fn"), F.count(F.when(~t & ~p, 1)).alias("tn"),
    )
    return counts.select(*by, *_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def threshold_sweep(
    df: DataFrame, truth: str, score: str, positive: object, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rates at each threshold (score strictly above it is a positive call).

    The rows are read once: each row adds to the slot between two thresholds, and the few slot counts
    are summed over the grid. Nothing is multiplied by the number of thresholds before aggregation.
    """
    grid = sorted(thresholds)
    slot = reduce(lambda acc, t: acc + (F.col(score) > t).cast("int"), grid, F.lit(0))
    hit = F.col(truth) == F.lit(positive)
    slots = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*by, slot.alias("slot")).agg(
        F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg")
    )
    totals = slots.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # A slot counts towards every threshold below it.
    above = slots.where("slot > 0").select(*by, "pos", "neg", F.explode(F.sequence(F.lit(0), F.col("slot") - 1)).alias("i"))
    above = above.groupBy(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("i").alias("__i")).agg(
        F.sum("pos").alias("tp"), F.sum("neg").alias("fp")
    )
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)])
    wide = totals.select(*by, "pos", "neg", F.explode(points).alias("e")).select(*by, "pos", "neg", "e.*")
    joined = wide.join(above, null_safe(wide, above, [*[(c, f"__o_{c}") for c in by], ("i", "__i")]), "left")
    tp, fp = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp"))
    return joined.select(*by, "threshold", *_rates(tp, fp, F.col("pos") - tp, F.col("neg") - fp))


def regression_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error and squared correlation."""
    gap = F.col(truth) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.pow(F.corr(truth, predicted), 2).alias("rsq")
    )


def accuracy(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def sensitivity_by_class(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest sensitivity of every observed class."""
    return df.groupBy(*by, F.col(truth).alias("class")).agg(
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("sensitivity")
    )


def multiclass_auc(df: DataFrame, truth: str, probabilities: Mapping[str, str]) -> DataFrame:
    """Hand and Till's mean of pairwise areas; ``probabilities`` maps a class to its score column.

    Every ordered pair (i, j) is the area of class i's score among rows of classes i and j. Counts per
    (score kind, class, score) are taken in one pass over the rows; all pairs come from those counts.
    """
    classes = list(probabilities)
    entries = [
        F.struct(F.lit(c).alias("kind"), F.col(probabilities[c]).cast("double").alias("score")) for c in classes
    ]
    counts = (
        df.where(F.col(truth).isin(classes))
        .select(truth, F.explode(F.array(*entries)).alias("e"))
        .groupBy(F.col("e.kind").alias("kind"), F.col("e.score").alias("score"))
        .agg(*[F.count(F.when(F.col(truth) == c, 1)).alias(f"n{i}") for i, c in enumerate(classes)])
    )
    names = [f"n{i}" for i in range(len(classes))]
    cum = running_totals(counts, "score", names, ["kind"])
    own = {c: i for i, c in enumerate(classes)}
    areas = []
    for a in classes:
        for b in classes:
            if a == b:
                continue
            i, j = own[a], own[b]
            win = F.col(f"n{i}") * ((F.col(f"n{j}_cum") - F.col(f"n{j}")) + F.col(f"n{j}") / 2.0)
            here = F.col("kind") == a
            areas.append(
                F.try_divide(
                    F.sum(F.when(here, win)),
                    F.max(F.when(here, F.col(f"n{i}_total").cast("double") * F.col(f"n{j}_total"))),
                )
            )
    total = reduce(lambda x, y: x + y, areas)
    return cum.agg((total / len(areas)).alias("roc_auc"))


def summarise_resamples(metrics: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, count and standard error of a metric over resamples."""
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("std_err"),
    )
