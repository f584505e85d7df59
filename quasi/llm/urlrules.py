"""URL filters by hashed host-suffix and path-prefix expressions.

A url is expanded into every suffix of its host joined to every prefix of its path that has a length some rule uses, so
any rule path is honoured, not only those ending at a slash. Expressions meet rules by the first HEX_PREFIX hex digits of
their SHA-256; the full digest then confirms. The longest rule wins, and among equal rules ``allow`` before ``block``.

DataFrame functions only. A null url, or one without ``://``, has an empty host and path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import stash

HEX_PREFIX = 8
BROADCAST_RULES = 200_000
MOST_LENGTHS = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's. Rules with a null or unknown verdict or a
    null host are ignored; a null path is empty. Up to BROADCAST_RULES rules are broadcast, more are joined by shuffle.
    """
    spark = pages.sparkSession
    known = rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
    known = known.select(
        "verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).distinct()
    known = known.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("size"),
        F.length(F.concat("host", "path")).alias("weight"),
    )
    digest = F.sha2("rule", 256)
    known = stash(known.withColumn("rule_digest", digest).withColumn("short", F.substring(digest, 1, HEX_PREFIX)), "rules")
    sizes = [r["size"] for r in known.select("size").distinct().limit(MOST_LENGTHS + 1).collect()]
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct(*keep).alias("page"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # With too many distinct rule lengths to list, every prefix is tried.
    lengths = F.array(*map(F.lit, sorted(sizes))) if 0 < len(sizes) <= MOST_LENGTHS else F.sequence(F.lit(0), F.length("path"))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    rows = rows.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
    hashed = F.sha2(F.concat("suffix", F.coalesce("prefix", F.lit(""))), 256)
    rows = rows.withColumn("digest", hashed).drop("suffix", "prefix").withColumn("url_short", F.substring("digest", 1, HEX_PREFIX))
    known = F.broadcast(known) if few else known
    met = rows.join(known, (F.col("url_short") == F.col("short")) & (F.col("digest") == F.col("rule_digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("weight", (F.col("verdict") == "allow").alias("allows"), "rule", "verdict")))
    out = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page", "host", "path")], best.alias("best"))
    return out.select(
        "page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
