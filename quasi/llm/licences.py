"""Licence scans by canonical digest.

A text is brought to canonical form (lower case; lines that state a copyright dropped; every run of other characters than
letters and digits one space; equivalent spellings replaced) and its SHA-256 looked up among those of known licences by
hash join. Whole texts are looked up, and every line of a text as a text of its own, which finds notices in documents.

DataFrame functions only. Null and empty texts match nothing. Up to BROADCAST_TEXTS known texts are broadcast, more are
joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import stash
from quasi.llm.licence_texts import EQUIVALENTS, LICENCES

#: A line that states a copyright: the word with a sign, a year or ``by``, the sign alone, or the reservation of rights.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
BROADCAST_TEXTS = 100_000


def canonical(text: Column) -> Column:
    """Canonical form of a text; words are kept apart by two spaces while spellings are replaced."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER, "  "), F.lit(" "))
    for a, b in EQUIVALENTS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_texts(spark, licences: Sequence[tuple[str, str]] = LICENCES) -> DataFrame:
    return spark.createDataFrame(list(licences), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text", carry: Sequence[Column] = ()) -> DataFrame:
    """Columns ``carry`` with ``digest`` (of the canonical whole text, null if empty), ``licence`` (the whole text's, else
    null), ``notices`` (distinct licences of its lines, sorted, joined by commas; null if none) and ``n_notices`` (lines
    that are known texts).

    A text known under several licences gets the first by name.
    """
    forms = known.where("licence is not null").select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
    forms = forms.groupBy("form").agg(F.min("licence").alias("licence"))
    forms = stash(forms.select(F.sha2("form", 256).alias("known"), F.length("form").alias("size"), "licence"), "licences")
    few = forms.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    sizes = forms.agg(F.min("size").alias("low"), F.max("size").alias("high")).first()
    low, high = sizes.low or 0, sizes.high or -1

    text, whole = F.col(text_col), canonical(F.col(text_col))
    # Only forms as long as some known one can match; the whole text and its lines are told apart by a flag.
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical), lambda x: F.length(x).between(low, high))
    entries = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("found"))),
        F.transform(F.col("lines"), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("found"))),
    )
    rows = docs.select(F.struct(F.lit(0).alias("__"), *carry).alias("doc"), whole.alias("form"), lines.alias("lines"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", F.when(F.col("form") != "", F.sha2("form", 256))).drop("form")
    rows = rows.withColumn("entry", F.explode(entries)).select("row", "doc", "digest", "entry.*")
    met = rows.join(F.broadcast(forms) if few else forms, F.col("found") == F.col("known"), "left")
    notice = F.when(~F.col("whole"), F.col("licence"))
    out = met.groupBy("row").agg(
        F.first("doc").alias("doc"), F.first("digest").alias("digest"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(notice)), ",").alias("notices"), F.count(notice).alias("n_notices"),
    )
    names = docs.select(*carry).columns
    return out.select(
        *[F.col("doc")[n].alias(n) for n in names], "digest", "licence",
        F.when(F.col("n_notices") > 0, F.col("notices")).alias("notices"), "n_notices",
    )
