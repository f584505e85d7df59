"""Hard negatives by exact integer scores from residue matrices.

Scores of anchors against all rows are products of integer matrices. Each matrix is reduced modulo several primes below 1024
to residues around zero; products of 64 components of such residues stay below 2**24, so float32 multiplication gives them
exactly. Chinese remaindering joins the residues of a score to the score itself, with as many primes as the norms of
the two blocks ask for.

Anchors travel in blocks, rows in at most GROUPS groups per block; a task streams one group past one block, batch by batch,
and keeps the best few of each anchor, so its memory follows the block, not the group, and what it sends on does not
follow the rows. Two passes: the best rows of the anchor's label are its positives; then the best rows of other
labels whose scores lie in the window below each positive.

Rows with a null id, label or vector, an empty vector, or null or non-finite components take no part, nor do vectors
whose dimension is not the most frequent one (the smaller among equals). Of several rows of one id the least by label
and vector takes part, so repeated rows count once. Components beyond the range of a long count as its ends, and so do
scores. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.llm.common import release, stash
from quasi.llm.vectors import matrix

BLOCK = 4096
SLAB = 512
ROWS = 2048
GROUPS = 64
COMPONENTS = 64
PRIMES = [p for p in range(1023, 2, -1) if all(p % q for q in range(2, 32) if q < p)]
LOW, HIGH = -(2**63), 2**63 - 1
NONE = LOW  # the score of a place that is not filled


def residues(x: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(x, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)).max()) if len(x) else 0.0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; beyond a long, its ends."""
    need = 2 * int(_longest(a) * _longest(b) * 1.000001 + 1) + 1
    total, modulus = np.zeros((len(a), len(b)), np.int64), 1
    for p in PRIMES:
        if modulus >= need:
            break
        ra, rb = residues(a, p), residues(b, p)
        part = np.zeros(total.shape, np.int32)
        for at in range(0, a.shape[1], COMPONENTS):
            part += (ra[:, at : at + COMPONENTS] @ rb[:, at : at + COMPONENTS].T).astype(np.int32) % p
        if modulus * p >= 2**62 and total.dtype != object:
            total = total.astype(object)
        step = (part - (total % p).astype(np.int32)) * pow(modulus, -1, p) % p
        total += step.astype(total.dtype) * modulus
        modulus *= p
    total = np.where(total > modulus // 2, total - modulus, total)
    return np.clip(total, LOW + 1, HIGH).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest wanted scores and their ids, ties to the smaller id; NONE where there are fewer.

    Columns are in the order of their ids.
    """
    k, n = min(k, len(ids)), len(ids)
    masked = np.where(wanted, score, NONE)
    top = max(abs(int(score.max())), abs(int(score.min())))
    if top * (n + 1) < 2**61:
        # Score and place in one number, all different.
        ranked = np.where(wanted, score * n - np.arange(n), NONE)
        at = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
    else:
        place = np.broadcast_to(np.arange(n), masked.shape)
        at = np.lexsort((place, -np.maximum(masked, LOW + 1), masked == NONE), axis=1)[:, :k]
    return np.take_along_axis(masked, at, axis=1), ids[at]


class Best:
    """The best k (score, id) of each of n places, over all batches seen."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE, np.int64), np.full((n, k), HIGH, np.int64)

    def add(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[rows], score], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, -np.maximum(score, LOW + 1), score == NONE), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def window(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """Least and largest long s with lower * positive <= 100 * s <= upper * positive."""
    return max(-(-lower * positive // 100), LOW + 1), min(upper * positive // 100, HIGH)


def streamed(anchors: DataFrame, rows: DataFrame, every: int, handle, schema: str) -> DataFrame:
    """``handle(block of anchors, iterator of row batches)`` for each group of rows and block of anchors.

    ``anchors`` has columns of ``rows`` and ``limits`` (array<long>), rows come sorted by id within a batch.
    """
    n = rows.count()
    blocks, groups = max(1, -(-n // (every * BLOCK))), max(1, min(GROUPS, -(-n // ROWS)))

    def to(column, n, salt):
        return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = anchors.withColumn("block", to("id", blocks, 1)).withColumn("group", all_of(groups)).withColumn("kind", F.lit(0))
    r = rows.withColumn("limits", F.array().cast("array<long>")).withColumn("group", to("id", groups, 2))
    r = r.withColumn("block", all_of(blocks)).withColumn("kind", F.lit(1))
    fields = ["block", "group", "kind", "id", "label", "v", "limits"]
    both = a.select(*fields).union(r.select(*fields)).repartition(blocks * groups, "block", "group")
    both = both.sortWithinPartitions("block", "group", "kind", "id")

    def runs(batches):
        for pdf in batches:
            at = pdf[["block", "group", "kind"]].to_numpy()
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
            for x, y in zip(edges, edges[1:]):
                for z in range(x, y, ROWS):
                    yield tuple(at[z]), pdf.iloc[z : min(y, z + ROWS)]

    def task(batches):
        current, block, state = None, [], None
        for (b, g, kind), pdf in runs(batches):
            if (b, g) != current:
                if state is not None:
                    yield state.frame()
                current, block, state = (b, g), [], None
            if kind == 0:
                block.append(pdf)
            elif block:
                state = state or handle(pd.concat(block))
                state.see(pdf)
        if state is not None:
            yield state.frame()
        release()

    return both.mapInPandas(task, schema)


class _Positives:
    def __init__(self, anchors: pd.DataFrame, k: int):
        self.ids, self.labels, self.v = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["v"], np.int64)
        self.best = Best(len(anchors), k)

    def see(self, rows: pd.DataFrame) -> None:
        ids, labels, v = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], np.int64)
        for at in range(0, len(self.ids), SLAB):
            part = slice(at, at + SLAB)
            wanted = (self.labels[part, None] == labels) & (self.ids[part, None] != ids)
            self.best.add(part, *best(products(self.v[part], v), ids, wanted, self.best.k))

    def frame(self) -> pd.DataFrame:
        i, j = np.nonzero(self.best.score > NONE)
        return pd.DataFrame({"anchor_id": self.ids[i], "positive_id": self.best.id[i, j], "positive_score": self.best.score[i, j]})


class _Negatives:
    """``limits`` of an anchor holds (positive id, its score) one after the other."""

    def __init__(self, anchors: pd.DataFrame, k: int, lower: int, upper: int):
        self.ids, self.labels, self.v = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["v"], np.int64)
        limits = [np.asarray(x, np.int64).reshape(-1, 2) for x in anchors["limits"]]
        most = max(map(len, limits))
        self.pairs = np.zeros((len(limits), most, 2), np.int64)
        self.low, self.high = np.full((len(limits), most), HIGH), np.full((len(limits), most), LOW)
        for i, x in enumerate(limits):
            self.pairs[i, : len(x)] = x
            for j, (_, score) in enumerate(x.tolist()):
                self.low[i, j], self.high[i, j] = window(score, lower, upper)
        self.best = [Best(len(limits), k) for _ in range(most)]

    def see(self, rows: pd.DataFrame) -> None:
        ids, labels, v = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], np.int64)
        for at in range(0, len(self.ids), SLAB):
            part = slice(at, at + SLAB)
            score, other = products(self.v[part], v), self.labels[part, None] != labels
            for slot, found in enumerate(self.best):
                # What does not reach the last of those found so far cannot enter.
                low = np.maximum(self.low[part, slot], found.score[part, -1])
                wanted = other & (score >= low[:, None]) & (score <= self.high[part, slot][:, None])
                if wanted.any():
                    found.add(part, *best(score, ids, wanted, found.k))

    def frame(self) -> pd.DataFrame:
        out = []
        for slot, found in enumerate(self.best):
            i, j = np.nonzero(found.score > NONE)
            out.append(
                pd.DataFrame(
                    {"anchor_id": self.ids[i], "positive_id": self.pairs[i, slot, 0], "negative_id": found.id[i, j],
                     "positive_score": self.pairs[i, slot, 1], "negative_score": found.score[i, j]}
                )
            )
        return pd.concat(out)


def integers(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v`` (array of long) of the rows that take part."""
    ends = F.lit(float(LOW)), F.lit(float(np.nextafter(2.0**63, 0)))
    x = F.col(vector_col).cast("array<double>").alias("x")
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & finite)
    within = F.transform("x", lambda c: F.least(F.greatest(c * F.lit(float(scale)), ends[0]), ends[1]))
    kept = kept.select("id", "label", F.transform(within, lambda c: F.floor(c).cast("long")).alias("v"))
    sizes = kept.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    kept = kept.where(F.size("v") == (sizes.dim if sizes else 0))
    return kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50,
    positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors have an id divisible by ``every``; a score is the inner product of components floor(``scale`` * x). An anchor's
    positives are the ``positives`` best other rows of its label; the negatives of a positive are the ``negatives`` best
    rows of other labels from ``lower`` to ``upper`` percent of the positive's score. Ties go to the smaller id.
    """
    base = stash(integers(rows, id_col, vector_col, label_col, scale), "integers")
    asked = base.where(F.col("id") % every == 0).withColumn("limits", F.array().cast("array<long>"))
    found = streamed(
        asked, base, every, lambda block: _Positives(block, positives), "anchor_id long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = F.flatten(F.collect_list(F.array("positive_id", "positive_score")))
    limits = stash(found.groupBy(F.col("anchor_id").alias("id")).agg(pairs.alias("limits")), "positives")
    asked = asked.drop("limits").join(limits, "id")
    found = streamed(
        asked, base, every, lambda block: _Negatives(block, negatives, lower, upper),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
