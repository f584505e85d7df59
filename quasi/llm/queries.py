"""One registered query per corpus operator, with its SQL where SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quasi.llm import (
    ann, langid, licences, mixing, negatives, phrases, pieces, resample, setjoin, simhash, suffix, topk, urlrules,
)
from quasi.llm import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
MIX_FACTOR, MIX_REPEAT = 1.0, 2.0


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 64 bits, radius 4."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


@query()
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector, by inner product."""
    out = ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query()
def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing later copies of 20-word windows."""
    out = phrases.remove_phrases(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, carry=[F.col("doc_id"), F.xxhash64("text").alias("text_hash")])
    coded = pieces.decode(coded, carry=[F.col("doc_id"), F.col("text_hash"), F.col("ids")])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.xxhash64("decoded") == F.col("text_hash")).alias("same_text")
    )


@query(S.url_rules(URL_RULES))
def op5_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    out = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlrules.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from labelled documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held), "doc_id", "text", "lang")
    out = langid.identify(docs, model, "text", carry=[F.col("doc_id"), held.alias("held_out")])
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for every 20th vector, exact."""
    out = topk.search(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query(S.mixing(MIX_FACTOR, MIX_REPEAT))
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mixture as flat as two readings of each source allow."""
    out = mixing.plan(table(spark, sf_dir, "documents"), factor=MIX_FACTOR, repeat=MIX_REPEAT)
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select(
        F.col("id").alias("doc_id"), "source", "n_tokens", F.round("exponent", 6).alias("exponent"),
        F.round("weight", 6).alias("weight"), "budget", "copies",
    )


@query()
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after removing every 400-byte string that occurs more than once."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(S.licences())
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that documents are, or hold as lines."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.known_texts(spark), carry=[F.col("doc_id")])


@query()
def op11_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return setjoin.link(table(spark, sf_dir, "documents"), words=3, percent=90)


@query()
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five best positives of every 50th vector."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), every=50, positives=5, negatives=3, lower=50, upper=95, scale=256)


@query(S.resample(buckets=10_000, percent=10, min_words=20, seed="2024"))
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark in words."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target, longest=1, buckets=10_000, percent=10, min_words=20, seed="2024")
