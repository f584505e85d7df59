"""A corpus from raw documents to piece ids, in five stages; each is written and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All stages but the last return the columns of
documents. SQL cannot express them (a trained classifier, sampled blocks, piece merges), so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.llm import langid, mixing, pieces, simhash, suffix
from quasi.llm.common import keyed, stash

ORACLE_SQL = None
SIMHASH_WORDS, SIMHASH_RADIUS = 4, 4
MIX_FACTOR, MIX_REPEAT = 1.0, 2.0
REPEAT_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; learns from the documents that have a ``lang``."""
    model = langid.train(docs, "doc_id", "text", "lang")
    found = langid.identify(docs, model, "text", carry=[F.struct(*docs.columns).alias("__doc")])
    return found.where(~F.col("rejected")).select("__doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row by id (nulls last) of each group of documents whose fingerprints are SIMHASH_RADIUS bits apart at most."""
    others = F.struct(F.lit(0).alias("__"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    rows = keyed(docs.select("doc_id", "text", others.alias("__others")), "doc_id", "text", ["__others"])
    groups = simhash.near_duplicates(rows, "key", words=SIMHASH_WORDS, radius=SIMHASH_RADIUS)
    gone = stash(groups.where("component_id <> key").select("key"), "gone")
    out = rows.join(gone, "key", "left_anti").select(
        F.col("id").alias("doc_id"), F.when(~F.col("carry.was_null"), F.col("text").cast("string")).alias("text"), "carry.__others.*"
    )
    return out.select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of REPEAT_BYTES-byte passages (a cut character goes whole); emptied documents go."""
    others = F.struct(F.lit(0).alias("__"), *[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    rows = docs.select("doc_id", "text", others.alias("__others"))
    out = suffix.remove_repeats(rows, length=REPEAT_BYTES, keep_first=True, whole_chars=True, carry=["__others"])
    out = out.where((F.col("n_bytes") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    out = out.withColumn("text", F.when(~F.col("was_null"), F.col("kept").cast("string")))
    out = out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "__others.*")
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources asks."""
    return mixing.mix(docs, factor=MIX_FACTOR, repeat=MIX_REPEAT)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document."""
    out = pieces.encode(docs, carry=[F.col("doc_id"), F.col("lang"), F.col("source")])
    return out.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "_"))
    return docs
