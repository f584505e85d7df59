"""Importance resampling towards a target distribution of hashed n-grams.

Features are runs of words; a feature's bucket is the CRC of its bytes modulo the number of buckets. Each text is normalised
(A-Z lower-cased, words joined by one space) and read once: the CRC runs on from word to word, and its value at every word's
end is kept. As crc(AB) = shift(crc(A), |B|) ^ crc(B), with ``shift`` linear over GF(2), the CRC of any run of words follows
from the two prefixes around it, however many runs overlap.

Corpus and target become one count per bucket, so what reaches the driver is bounded by ``buckets``. A document's weight is
the floored mean of its features' gains, and its score adds Gumbel noise drawn from a hash of its id: the highest scores are
a draw without replacement. The cut comes from the count of each integer score, and only rows at or above it are sorted.

Null and empty texts have no features, weight 0, and are drawn only if ``min_words`` is 0. A null id is hashed as an empty
one and comes after equal scores; repeated rows are rows of their own, with the same score. Equal scores and ids go on by
the number of features and a hash of the text. An empty table gives no rows; an empty target counts nothing. Long texts
are split into words slice by slice.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.llm.common import stash

SLICE = 1 << 20
WORDS_AT_ONCE = 1 << 17
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in LETTERS else 32 for c in range(256))
SPACE = np.uint32(zlib.crc32(b" "))
POLYNOMIAL = 0xEDB88320


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & 255]
    for lane in (1, 2, 3):
        out = out ^ tables[lane][(x >> np.uint32(8 * lane)) & 255]
    return out


def _shift_tables() -> list[np.ndarray]:
    """By k: what 2**k zero bytes make of each byte of a CRC."""
    byte = np.arange(256, dtype=np.uint32)
    once = byte
    for _ in range(8):
        once = np.where(once & 1, once >> np.uint32(1) ^ np.uint32(POLYNOMIAL), once >> np.uint32(1))
    tables = [np.stack([once, *(byte << np.uint32(8 * lane - 8) for lane in (1, 2, 3))])]
    while len(tables) < 32:
        tables.append(np.stack([_apply(tables[-1], row) for row in tables[-1]]))
    return tables


SHIFTS = _shift_tables()


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRCs moved past ``n_bytes`` further bytes each."""
    out = crc.copy()
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        at = np.flatnonzero(n_bytes >> k & 1)
        out[at] = _apply(SHIFTS[k], out[at])
    return out


def running(text: bytes) -> tuple[list[int], list[int]]:
    """Of each word of a normalised text: the CRC of all up to its end, and its length."""
    text, at, crcs, sizes = text.translate(NORMAL), 0, [], []
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        sizes += map(len, words)
        spaced = [b" " + w for w in words]
        if spaced and not crcs:
            spaced[0] = words[0]
        crcs += itertools.islice(itertools.accumulate(spaced, lambda c, w: zlib.crc32(w, c), initial=crcs[-1] if crcs else 0), 1, None)
        at = end
    return crcs, sizes


def feature_crcs(ends: np.ndarray, sizes: np.ndarray, doc: np.ndarray, longest: int):
    """For n = 1 to ``longest``: the first words and the CRCs of all runs of n words inside one document."""
    if not len(ends):
        return
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    # Before a word: the CRC up to the word before, moved past one space.
    begins = np.roll(_apply(SHIFTS[0], ends) ^ SPACE, 1)
    begins[first] = 0
    upto = np.cumsum(sizes + 1) - 1
    since = upto - sizes
    for n in range(1, longest + 1):
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        last = at + n - 1
        yield at, ends[last] ^ shift(begins[at], upto[last] - since[at])


def _batches(batches, place: int):
    """Bounded runs of documents: batch, first row, rows, and the words' CRCs, sizes and rows in the run."""
    for batch in batches:
        ends, sizes, counts, begin = [], [], [], 0
        for i in range(batch.num_rows):
            crcs, lengths = running(batch.column(place)[i].as_py() or b"")
            ends += crcs
            sizes += lengths
            counts.append(len(crcs))
            if len(ends) >= WORDS_AT_ONCE or i == batch.num_rows - 1:
                rows = np.repeat(np.arange(len(counts)), counts)
                yield batch, begin, np.array(counts, np.int64), np.array(ends, np.uint32), np.array(sizes, np.int64), rows
                ends, sizes, counts, begin = [], [], [], i + 1


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> dict[int, int]:
    """Features of all texts by bucket."""

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, ends, sizes, rows in _batches(batches, 0):
            for _, crc in feature_crcs(ends, sizes, rows, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    each = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(task, "bucket long, n long")
    return {r.bucket: r.n for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandfold log ratio of the smoothed shares of target and corpus by bucket, floored."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = ((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, text_col: str, gain: np.ndarray, longest: int, carry: Sequence) -> DataFrame:
    """``carry`` and ``n_words``, ``n_features``, ``weight`` of every document."""
    buckets = np.uint32(len(gain))

    def task(batches):
        for batch, begin, counts, ends, sizes, rows in _batches(batches, 1):
            total, n = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for at, crc in feature_crcs(ends, sizes, rows, longest):
                own = np.bincount(rows[at], minlength=len(counts))
                upto = np.concatenate([[0], np.cumsum(gain[crc % buckets])])
                stop = np.cumsum(own)
                total += upto[stop] - upto[stop - own]
                n += own
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, len(counts)), pa.array(counts), pa.array(n), pa.array(weight)],
                ["carry", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.struct(*carry).alias("carry"), F.col(text_col).cast("binary").alias("text"))
    schema = rows.select("carry").schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(task, schema).select("carry.*", "n_words", "n_features", "weight")


def _ranked(rows: DataFrame, order: Sequence) -> DataFrame:
    """``rank`` from 1 in ``order``: a range sort, then each sorted part's offset from the parts' sizes."""
    rows = stash(rows.sort(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    # One row per task of the sort.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("rank", rank.cast("long")).drop("__part", "__at", "__before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """Per document: id, ``n_features``, ``weight``, ``score``, and ``rank`` (from 1) if it is drawn, else null.

    Features are runs of 1 to ``longest`` words. Of the documents with at least ``min_words`` words, ``percent`` % (floored)
    are drawn by score, ties by id.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    ident, text = F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie")
    rows = weigh(docs, text_col, gain, longest, [ident, text])
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = stash(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = F.col("n_words") >= min_words
    # An integer score has few values: the log of a ratio of counts, and the noise of a 32-bit hash, are bounded.
    levels = stash(rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "levels")
    wanted = (levels.agg(F.sum("n")).first()[0] or 0) * percent // 100
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    cut = levels.select("score", upto.alias("upto")).where(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    above = able & (F.col("score") >= (cut if cut is not None else 0)) & F.lit(wanted > 0)
    ranked = _ranked(rows.where(above), [F.desc("score"), F.col("id").asc_nulls_last(), "n_features", "tie"])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    out = ranked.unionByName(rows.where(~above).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
