"""Building blocks that stay balanced when one group holds a large share of the rows.

Three patterns cover every operator that would otherwise put a whole group into one task:

* ``attach_totals``: group totals back on the rows. The most frequent groups (an exact, fixed number of
  them) are attached by a broadcast join, all others by a shuffle join.
* ``running_totals``: cumulative sums inside groups, by value buckets with carried offsets.
* ``hash_rank``: an exact random rank inside groups, by buckets of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quasi.functions.columns import unit_hash

HOT_GROUPS = 1000
FEW_GROUPS = 100_000
MIN_BUCKETS, MAX_BUCKETS = 64, 2048


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def attach_totals(df: DataFrame, keys: Sequence[str], totals: Sequence[Column]) -> DataFrame:
    """Add per-group aggregates to every row of the group (null keys form a group).

    A window over the keys would sort a whole group in one task. Instead the totals are pre-aggregated
    on the map side. The HOT_GROUPS largest groups are joined by broadcast (at most that many rows), so
    any group left for the shuffle join has fewer than 1/HOT_GROUPS of the rows. Hot rows pass through
    the shuffle join under a salt taken from their partition number and match nothing there.
    """
    keys = list(keys)
    side_keys = [f"__k{i}" for i in range(len(keys))]
    grouped = df.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, side_keys)]).agg(
        F.count(F.lit(1)).alias("__rows"), *totals
    )
    names = [c for c in grouped.columns if c not in side_keys and c != "__rows"]
    hot = grouped.orderBy(F.desc("__rows"), *side_keys).limit(HOT_GROUPS)
    # The always-true filter keeps both sides on the same aggregate, so its shuffle is reused.
    return attach_groups(df, keys, side_keys, hot, grouped.where(F.col("__rows") > 0), names)


def attach_groups(df: DataFrame, keys: Sequence[str], side_keys: Sequence[str], hot: DataFrame, cold: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``names`` of its group to every row: ``hot``, the largest groups, by broadcast and ``cold`` by shuffle.

    Every group of ``hot`` (HOT_GROUPS at most) is found there, with whatever values; its rows pass the shuffle join under
    a salt. Groups may be absent from ``cold``: their rows get nulls.
    """
    hot = hot.select(*[F.col(s).alias(f"__h{s}") for s in side_keys], F.struct(*names).alias("__hot"))
    first = df.join(F.broadcast(hot), null_safe(df, hot, [(k, f"__h{s}") for k, s in zip(keys, side_keys)]), "left")
    first = first.drop(*[f"__h{s}" for s in side_keys]).withColumn(
        "__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.spark_partition_id())
    )
    rest = cold.select(*side_keys, F.lit(0).alias("__cold_salt"), F.struct(*names).alias("__cold"))
    joined = first.join(
        rest, null_safe(first, rest, list(zip(keys, side_keys))) & (first["__salt"] == rest["__cold_salt"]), "left"
    )
    picked = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(c) for c in df.columns], *[picked[n].alias(n) for n in names])


def value_buckets(df: DataFrame, column: str) -> DataFrame:
    """Number rows by approximate quantile ranges of a numeric column (``__bucket``).

    Any set of boundaries gives exact results later; balanced ones give even work. There are as many
    buckets as shuffle partitions, within bounds.
    """
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    probabilities = [i / buckets for i in range(1, buckets)]
    typed = df.withColumn("__value", F.col(column).cast("double"))
    inner = sorted(set(typed.approxQuantile("__value", probabilities, 0.25 / buckets)))
    splits = [-float("inf"), *inner, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="__value", outputCol="__bucket", handleInvalid="keep")
        .transform(typed)
        .drop("__value")
    )


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), suffix: str = "_cum"
) -> DataFrame:
    """Cumulative sums of columns along a numeric column, exact, without a single-task window.

    ``order`` must be unique within a group (aggregate first). Adds ``<name><suffix>`` inclusive running
    sums and ``<name>_total`` group totals. Two levels: bucket totals are cumulated over at most
    MAX_BUCKETS rows per group, and rows are cumulated inside (group, bucket).
    """
    by = list(by)
    bucketed = value_buckets(df, order)
    offsets = bucketed.groupBy(*by, "__bucket").agg(*[F.sum(s).alias(f"__s_{s}") for s in sums])
    along = Window.partitionBy(*by).orderBy("__bucket") if by else Window.partitionBy(F.lit(0)).orderBy("__bucket")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = offsets.select(
        *[F.col(c).alias(f"__o_{c}") for c in [*by, "__bucket"]],
        *[
            (F.sum(f"__s_{s}").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"__s_{s}")).alias(f"__b_{s}")
            for s in sums
        ],
        *[F.sum(f"__s_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    pairs = [(c, f"__o_{c}") for c in [*by, "__bucket"]]
    if not by:
        offsets = F.broadcast(offsets)
    joined = bucketed.join(offsets, null_safe(bucketed, offsets, pairs), "left")
    inside = (
        Window.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__b_{s}") + F.sum(s).over(inside)).alias(f"{s}{suffix}") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def hash_rank(
    df: DataFrame, key: str, by: Sequence[str] = (), seed: object = 0, rank: str = "rank", size: str = "n"
) -> DataFrame:
    """Exact rank of every row by md5(key|seed) inside its group, with the group's size.

    The first three hex digits split each group into 4096 even buckets; the rank is the count of
    earlier buckets plus the position inside the bucket, so a large group is spread over many tasks and
    the rows are shuffled once. ``key`` must be unique.
    """
    by = list(by)
    hashed = df.withColumn("__h", unit_hash(key, seed)).withColumn(
        "__bucket", F.substring("__h", 1, 3)
    )
    along = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = hashed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.select(
        *[F.col(c).alias(f"__o_{c}") for c in [*by, "__bucket"]],
        (
            F.sum("__c").over(along.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__c")
        ).alias("__before"),
        F.sum("__c").over(along).alias(size),
    )
    joined = hashed.join(
        counts, null_safe(hashed, counts, [(c, f"__o_{c}") for c in [*by, "__bucket"]]), "inner"
    )
    inside = Window.partitionBy(*by, "__bucket").orderBy("__h", key)
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("__before") + F.row_number().over(inside)).alias(rank),
        F.col(size),
    )


def few_groups(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether the grouping columns have at most FEW_GROUPS combinations (reads those columns only)."""
    return not by or df.select(*by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def sized(side: DataFrame, few: bool) -> DataFrame:
    """Broadcast a table with one row per group when the number of groups was found small."""
    return F.broadcast(side) if few else side


def hash_cut(
    df: DataFrame, key: str, prop: float, by: Sequence[str] = (), seed: object = 0, few: bool | None = None
) -> DataFrame:
    """Per group, the hash below or at which exactly floor(prop * n) rows lie: (by, cut_hash, cut_key).

    Rows are only counted; with few groups (checked unless the caller knows) they are never shuffled.
    Counts by the first three hex digits find the bucket that
    holds the cut, counts by the next three narrow it to one in 16 million of the group, and the few rows
    left are ranked. Groups with no row below the cut are absent.
    """
    by = list(by)
    few = few_groups(df, by) if few is None else few
    hashed = df.select(*by, F.col(key).alias("__key"), unit_hash(key, seed).alias("__h"))
    along = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))

    def locate(rows: DataFrame, first: int, target: Column | None) -> DataFrame:
        """The bucket in which the running count passes the target, and what is left of the target."""
        counts = rows.groupBy(*by, *([] if target is None else ["__left"]), F.substring("__h", first, 3).alias("__b")).agg(
            F.count(F.lit(1)).alias("__c")
        )
        upto = F.sum("__c").over(along.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
        goal = F.floor(F.lit(prop) * F.sum("__c").over(along)) if target is None else target
        found = counts.select(*by, "__b", goal.alias("__goal"), upto.alias("__upto"), "__c")
        hit = found.where((F.col("__upto") >= F.col("__goal")) & (F.col("__upto") - F.col("__c") < F.col("__goal")))
        return hit.select(
            *[F.col(c).alias(f"__o_{c}") for c in by], F.col("__b").alias("__bucket"),
            (F.col("__goal") - (F.col("__upto") - F.col("__c"))).alias("__left"),
        )

    def inside(rows: DataFrame, first: int, where: DataFrame) -> DataFrame:
        kept = rows.withColumn("__b", F.substring("__h", first, 3))
        pairs = [*[(c, f"__o_{c}") for c in by], ("__b", "__bucket")]
        return kept.join(sized(where, few), null_safe(kept, where, pairs), "inner").select(*by, "__key", "__h", "__left")

    narrow = inside(hashed, 1, locate(hashed, 1, None))
    narrower = inside(narrow.drop("__left"), 4, locate(narrow, 4, F.col("__left")))
    ranked = narrower.withColumn("__r", F.row_number().over(along.orderBy("__h", "__key")))
    return ranked.where(F.col("__r") == F.col("__left")).select(
        *by, F.col("__h").alias("cut_hash"), F.col("__key").alias("cut_key")
    )


def below_cut(
    df: DataFrame, key: str, prop: float, by: Sequence[str] = (), seed: object = 0, to: str = "below", few: bool | None = None
) -> DataFrame:
    """Mark the first floor(prop * n) rows of each group in hash order (ties by key).

    With few groups only the table of cuts moves; with many, rows of the HOT_GROUPS largest ones find their cut by
    broadcast, so no task of the join holds a hot group.
    """
    by = list(by)
    few = few_groups(df, by) if few is None else few
    cuts = hash_cut(df, key, prop, by, seed, few)
    owners, names = [f"__o_{c}" for c in by], ["cut_hash", "cut_key"]
    side = cuts.select(*[F.col(c).alias(o) for c, o in zip(by, owners)], *names)
    hashed = df.withColumn("__h", unit_hash(key, seed))
    if not by:
        joined = hashed.join(F.broadcast(side), F.lit(True), "left")
    elif few:
        joined = hashed.join(F.broadcast(side), null_safe(hashed, side, list(zip(by, owners))), "left")
    else:
        sizes = df.groupBy(*[F.col(c).alias(f"__g_{c}") for c in by]).agg(F.count(F.lit(1)).alias("__rows"))
        large = sizes.orderBy(F.desc("__rows"), *[f"__g_{c}" for c in by]).limit(HOT_GROUPS)
        hot = large.join(side, null_safe(large, side, [(f"__g_{c}", o) for c, o in zip(by, owners)]), "left")
        hot = hot.select(*[F.col(f"__g_{c}").alias(o) for c, o in zip(by, owners)], *names)
        joined = attach_groups(hashed, by, owners, hot, side, names)
    h, k = F.col("__h"), F.col(key)
    flag = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (k <= F.col("cut_key")))
    return joined.select(*df.columns, F.coalesce(flag, F.lit(False)).alias(to))


def hash_top(df: DataFrame, key: str, n: int, by: Sequence[str] = (), seed: object = 0) -> DataFrame:
    """The n rows of every group that come first by hash; map-side limits keep hot groups small."""
    hashed = df.withColumn("__h", unit_hash(key, seed))
    if not by:
        return hashed.orderBy("__h", key).limit(n).drop("__h")
    w = Window.partitionBy(*by).orderBy("__h", key)
    return (
        hashed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__h", "__r")
    )


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles (type 7) per group as columns q0, q1, ... with the group's count.

    Equal values are merged first, running counts locate the two order statistics around each
    position, and no group is ever held in one task.
    """
    by = list(by)
    values = (
        df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = running_totals(values, "__v", ["__n"], by)
    low_rank = F.col("__n_cum") - F.col("__n")
    picks, out = [], []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("__n_total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((low_rank <= lo) & (lo < F.col("__n_cum")), F.col("__v"))).alias(f"__lo{i}"),
            F.max(F.when((low_rank <= hi) & (hi < F.col("__n_cum")), F.col("__v"))).alias(f"__hi{i}"),
        ]
    grouped = ranked.groupBy(*by).agg(F.max("__n_total").alias("n"), *picks)
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        share = at - F.floor(at)
        out.append((F.col(f"__lo{i}") + share * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}"))
    return grouped.select(*by, "n", *out)
