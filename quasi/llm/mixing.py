"""Mixing sources to target weights: temperature on token shares, realised as budgeted block permutations.

A source with share p gets the weight p^a / sum(p^a). The exponent a is bisected, three halvings per pass over the source
table, which stays in Spark. Budgets are whole numbers of tokens. A source first gives as many whole passes as its budget
holds; the rest is filled from a pseudo-random permutation of its blocks (runs of neighbouring ids, so that a reader
moves in large strides): whole blocks in permuted order, the last one document by document, never past the budget.

DataFrame functions only. Running totals go over buckets of the permutation, blocks in a bucket and documents in a block,
so no window holds a whole source. A null source is a source of its own; null ids are dealt to NULL_BLOCKS negative blocks by
their number of tokens; null texts have no tokens and are taken with what precedes them. Rows equal in id, source and text are one unit: each gets its copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quasi.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_IDS = 256
NULL_BLOCKS = 1024
BUCKET_DIGITS = 3
LEVELS = 3
HALVINGS = 42


def tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Distinct documents: id, source, text hash, multiplicity, tokens, and block with its place in the permutation."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text_col).alias("digest"), tokens(F.col(text_col)).alias("n_tokens"),
    )
    rows = rows.groupBy("id", "source", "digest").agg(F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("n_tokens"))
    # Below all blocks of ids, which may be negative, too.
    unnamed = F.lit(-(2**62)) - F.col("n_tokens") % NULL_BLOCKS
    block = F.coalesce(F.floor(F.col("id") / BLOCK_IDS), unnamed).cast("long")
    rows = rows.withColumn("block", block)
    place = F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"), F.col("block").cast("string")))
    return rows.withColumn("place", place)


def exponent(shares: DataFrame, factor: float, repeat: float | None, entropy: float | None) -> float:
    """Bisect the exponent over a table with ``share`` (positive, summing to one).

    With ``repeat``: the smallest exponent in [0, 1] at which no source is read more than ``repeat`` times for a budget of
    ``factor`` times the corpus (1 if none). With ``entropy`` (nats): the largest in [0, 8] that keeps at least it (0 if
    none). Both measures are monotone in the exponent.
    """
    lo, hi = (0.0, 1.0) if entropy is None else (0.0, 8.0)
    log = F.log("share")
    done = 0
    while done < HALVINGS:
        mids: list[float] = []
        spans = [(lo, hi)]
        for _ in range(LEVELS):
            spans = [half for a, b in spans for half in ((a, (a + b) / 2), ((a + b) / 2, b))]
            mids = sorted({*mids, *(a for a, _ in spans[1:])})
        cells = [F.min(log).alias("low")]
        for i, a in enumerate(mids):
            power = F.exp(log * F.lit(a))
            cells += [F.sum(power).alias(f"z{i}"), F.sum(power * log).alias(f"g{i}")]
        row = shares.agg(*cells).first()
        if row.low is None:
            return 1.0

        def goes_down(i: int) -> bool:
            a, z = mids[i], row[f"z{i}"]
            if entropy is None:
                return factor * math.exp((a - 1) * row.low) / z <= repeat
            return math.log(z) - a * row[f"g{i}"] / z < entropy

        for _ in range(LEVELS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if goes_down(mids.index(mid)) else (mid, hi)
            done += 1
    return hi if entropy is None else lo


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.0,
    repeat: float | None = 2.0, entropy: float | None = None,
) -> DataFrame:
    """Units (see ``units``) with ``exponent``, ``weight``, ``budget`` of their source and ``copies``.

    The corpus budget is ``factor`` times its tokens. Sources without tokens get weight, budget and copies zero. A
    limit that no exponent meets (``factor`` above ``repeat``, ``entropy`` above that of equal shares) is refused.
    """
    if (repeat is None) == (entropy is None):
        raise ValueError("give either repeat or entropy")
    if repeat is not None and factor > repeat:
        raise ValueError(f"a budget of {factor} times the corpus must read some source more than {repeat} times")
    all_units = stash(units(docs, id_col, text_col, source_col), "units")
    amount = F.sum(F.col("n_tokens") * F.col("rows"))
    blocks = stash(all_units.groupBy("source", "block", "place").agg(amount.alias("tokens")), "blocks")
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    buckets = blocks.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    sources = stash(buckets.groupBy("source").agg(F.sum("tokens").alias("source_tokens")), "sources")
    total = sources.agg(F.sum("source_tokens")).first()[0] or 0
    shares = stash(
        sources.where("source_tokens > 0").withColumn("share", F.col("source_tokens") / F.lit(float(max(total, 1)))), "shares"
    )
    if entropy is not None and (n := shares.count()) and entropy > math.log(n) + 1e-9:
        raise ValueError(f"{n} sources have an entropy of at most {math.log(n):.6f}")
    a = exponent(shares, factor, repeat, entropy)
    whole = shares.agg(F.sum(F.exp(F.log("share") * a))).first()[0] or 1.0
    weights = shares.withColumn("weight", F.exp(F.log("share") * a) / whole)
    weights = weights.withColumn("budget", F.floor(F.col("weight") * math.floor(total * factor)).cast("long"))
    weights = weights.withColumn("passes", F.floor(F.col("budget") / F.col("source_tokens")).cast("long"))
    weights = weights.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_tokens"))
    weights = weights.select(F.col("source").alias("wsource"), "weight", "budget", "passes", "rest")

    def before(*by: str, order: tuple[str, ...], of: str) -> Column:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(of).over(frame), F.lit(0))

    buckets = buckets.join(weights, F.col("source").eqNullSafe(F.col("wsource")), "left").drop("wsource")
    buckets = buckets.withColumn("start", before("source", order=("bucket",), of="tokens")).drop("tokens")
    buckets = stash(buckets.select(F.col("source").alias("bsource"), "bucket", "start", "weight", "budget", "passes", "rest"), "buckets")
    blocks = blocks.withColumn("bucket_of", bucket)
    blocks = blocks.withColumn("inner", before("source", "bucket_of", order=("place", "block"), of="tokens"))
    blocks = blocks.join(buckets, F.col("source").eqNullSafe(F.col("bsource")) & (F.col("bucket_of") == F.col("bucket")))
    blocks = blocks.select(
        F.col("source").alias("bsource"), F.col("block").alias("bblock"), (F.col("start") + F.col("inner")).alias("start"),
        "weight", "budget", "passes", "rest",
    )
    rows = all_units.withColumn("size", F.col("n_tokens") * F.col("rows"))
    rows = rows.withColumn("inner", before("source", "block", order=("id", "digest"), of="size"))
    rows = rows.join(blocks, F.col("source").eqNullSafe(F.col("bsource")) & (F.col("block") == F.col("bblock")))
    end = F.col("start") + F.col("inner") + F.col("size")
    copies = F.coalesce(F.col("passes") + F.when(end <= F.col("rest"), 1).otherwise(0), F.lit(0)).cast("long")
    return rows.select(
        "id", "source", "digest", "rows", "n_tokens", "block", F.lit(a).alias("exponent"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("budget", F.lit(0)).alias("budget"), copies.alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its plan says."""
    wanted = plan(docs, id_col, text_col, source_col, **options).where("copies > 0")
    wanted = wanted.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"), F.col("copies").alias("__copies"))
    wanted = stash(wanted, "mix")
    rows = docs.withColumn("__key", F.col(id_col).cast("long"))
    same = (
        F.col("__key").eqNullSafe(F.col("__id"))
        & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
        & (F.xxhash64(text_col) == F.col("__digest"))
    )
    rows = rows.join(wanted.hint("shuffle_hash"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return rows.select(*docs.columns)
