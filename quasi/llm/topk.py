"""Exact top-k by inner product of integer vectors with the three-phase uniform threshold.

Vectors are cut into SEGMENTS runs of components; every (segment, row block, query block) is a task that knows partial
scores only.

1. Each task gives each query its k best partial scores. The k best of each segment are resolved to full scores, and the
   k-th of these is a safe cutoff t: the result cannot end below it.
2. A score of at least t has a partial score of at least t / SEGMENTS in some segment (or all would sum to less), so each
   task sends exactly those entries.
3. The entries visit the other segments, which add their partial scores; what reaches t is ranked.

Queries travel with their cutoffs in blocks; nothing that grows with the data is broadcast or collected.

Components beyond the range of a long count as its ends, and so do scores. Where norms leave room for such scores there is
one segment only, whose tasks know the exact scores and need no sums of parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.llm.common import stash
from quasi.llm.vectors import clean, matrix, nearest

SEGMENTS = 2
ROWS = 4096
QUERIES = 1024
EXACT = 2.0**52
ROOM = 2.0**62

VECTOR, QUERY, ENTRY = 0, 1, 2
COLUMNS = "kind int, seg int, rb int, qb int, id long, other long, part array<long>, amount double"


def integers(rows: DataFrame, scale: int = 64) -> DataFrame:
    """floor(scale * x) of every component, or the nearest long."""
    low, high = F.lit(-(2.0**63)), F.lit(float(np.nextafter(2.0**63, 0)))
    within = F.transform("v", lambda x: F.least(F.greatest(x * F.lit(float(scale)), low), high))
    return rows.withColumn("v", F.transform(within, lambda x: F.floor(x).cast("long")))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products, or the nearest long: by floating point, by longs, or by Python integers."""
    if not len(q) or not len(v):
        return np.zeros((len(q), len(v)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(v.astype(np.float64)).max()) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most < ROOM:
        return q @ v.T
    return np.clip(q.astype(object) @ v.T.astype(object), -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _sides(pdf: pd.DataFrame):
    v, q = pdf[pdf["kind"] == VECTOR], pdf[pdf["kind"] == QUERY]
    if not len(v) or not len(q):
        return None
    same = q["other"].to_numpy()[:, None] == v["other"].to_numpy()[None, :]
    return v["id"].to_numpy(), matrix(v["part"], np.int64), q["id"].to_numpy(), matrix(q["part"], np.int64), q["amount"].to_numpy(), same


def _frame(query_id, vec_id, score) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def _local_lists(k: int):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(pdf)
        if sides is None:
            return _frame([], [], [])
        ids, v, queries, q, _, same = sides
        scores = _products(q, v)
        scores[same] = np.iinfo(np.int64).min
        take = min(k, len(ids))
        at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
        picked = np.take_along_axis(scores, at, axis=1).ravel()
        real = picked > np.iinfo(np.int64).min
        return _frame(np.repeat(queries, take)[real], ids[at.ravel()][real], picked[real]).assign(seg=pdf["seg"].iloc[0])

    return task


def _entries(segments: int):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(pdf)
        if sides is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "seg": [], "score": []})
        ids, v, queries, q, cutoff, same = sides
        scores = _products(q, v)
        # A double may round a cutoff up: its neighbour below is safe.
        hit = (scores * float(segments) >= np.nextafter(cutoff, -np.inf)[:, None]) & ~same
        i, j = np.nonzero(hit)
        out = _frame(queries[i], ids[j], scores[i, j])
        return out.assign(seg=pdf["seg"].iloc[0])

    return task


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries (id: query, other: vector, amount: sum so far) with this segment's partial score added."""
    sides, e = _sides(pdf), pdf[pdf["kind"] == ENTRY]
    if sides is None or not len(e):
        return _frame([], [], [])
    ids, v, queries, q, _, _ = sides
    by_v, by_q = np.argsort(ids), np.argsort(queries)
    j = by_v[np.searchsorted(ids, e["other"].to_numpy(), sorter=by_v)]
    i = by_q[np.searchsorted(queries, e["id"].to_numpy(), sorter=by_q)]
    sums = matrix(e["part"], np.int64)[:, 0]
    return _frame(e["id"].to_numpy(), e["other"].to_numpy(), sums + np.einsum("ij,ij->i", q[i], v[j]))


def search(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64,
    segments: int = SEGMENTS,
) -> DataFrame:
    """For each query (id divisible by ``every``) its k highest scores among all other rows (all, if fewer).

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (long); ties to the smaller id. Vectors left out: see
    ``vectors.clean`` (zero vectors take part). Repeated rows count once; an id with several vectors competes with each of
    them, asks with the least of them, and never finds itself. An empty table gives no rows.
    """
    base = stash(integers(clean(rows, id_col, vector_col, True), scale).distinct(), "integers")
    n = base.count()
    size = base.select(F.size("v").alias("d")).first()
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # A score is at most the product of two norms.
    roomy = (base.agg(F.max(squares)).first()[0] or 0.0) < ROOM
    segments = max(1, min(segments, size.d if size else 1)) if roomy else 1
    width = -(-(size.d if size else 1) // segments)
    segments = -(-(size.d if size else 1) // width)
    queries = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rb, n_qb = max(1, -(-n // ROWS)), max(1, -(-n // (every * QUERIES)))
    row_block, query_block = F.pmod(F.xxhash64("id"), F.lit(n_rb)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_qb))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.struct(s.alias("seg"), F.slice("v", s * width + 1, F.lit(width)).alias("part"))))

    # Ids with several vectors are told apart by a hash of the vector until the end.
    own = stash(base.select("vec_id", F.xxhash64("vec_id", "v").alias("id"), "v"), "vectors")
    asked = stash(queries.select("vec_id", F.xxhash64("vec_id", "v").alias("id"), "v"), "asked")

    def blocks(seen: DataFrame, cutoffs: DataFrame | None) -> DataFrame:
        v = seen.select("vec_id", "id", cut.alias("f")).withColumn("rb", row_block.cast("int"))
        v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1))))
        v = v.select(F.lit(VECTOR).alias("kind"), "f.seg", "rb", "qb", "id", F.col("vec_id").alias("other"), "f.part", F.lit(0.0).alias("amount"))
        q = asked if cutoffs is None else asked.join(cutoffs, "id")
        q = q.withColumn("amount", F.lit(0.0) if cutoffs is None else F.col("cutoff"))
        q = q.select("vec_id", "id", "amount", cut.alias("f")).withColumn("qb", query_block.cast("int"))
        q = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rb - 1))))
        return v.union(q.select(F.lit(QUERY).alias("kind"), "f.seg", "rb", "qb", "id", F.col("vec_id").alias("other"), "f.part", "amount"))

    keys = ["seg", "rb", "qb"]
    local = blocks(own, None).groupBy(*keys).applyInPandas(_local_lists(k), "query_id long, vec_id long, score long, seg int")
    best = Window.partitionBy("query_id", "seg").orderBy(F.desc("score"), "vec_id")
    local = local.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    scored = local.select("query_id", "vec_id", "score")
    local = local.select("query_id", "vec_id").distinct()
    a, b = asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), own.select(F.col("id").alias("vec_id"), F.col("v").alias("vv"))
    full = F.aggregate(F.zip_with("qv", "vv", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    # Scores of one segment are whole already.
    local = stash(local, "local").join(a, "query_id").join(b, "vec_id").select("query_id", "vec_id", full.alias("score")) if segments > 1 else scored
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = local.withColumn("place", F.row_number().over(order)).groupBy(F.col("query_id").alias("id")).agg(
        F.min(F.when(F.col("place") == k, F.col("score"))).alias("cutoff")
    )
    cutoffs = asked.select("id").join(cutoffs, "id", "left")
    cutoffs = cutoffs.select("id", F.coalesce(F.col("cutoff").cast("double"), F.lit(float("-inf"))).alias("cutoff"))
    cutoffs = stash(cutoffs, "cutoffs")

    both = stash(blocks(own, cutoffs), "blocks")
    found = both.groupBy(*keys).applyInPandas(
        _entries(segments), "query_id long, vec_id long, score long, seg int"
    )
    sums = found.select("query_id", "vec_id", "score", "seg")
    for step in range(1, segments):
        visiting = sums.select(
            F.lit(ENTRY).alias("kind"), F.pmod(F.col("seg") + 1, F.lit(segments)).cast("int").alias("seg"),
            F.pmod(F.xxhash64("vec_id"), F.lit(n_rb)).cast("int").alias("rb"),
            F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_qb)).cast("int").alias("qb"),
            F.col("query_id").alias("id"), F.col("vec_id").alias("other"), F.array("score").alias("part"), F.lit(0.0).alias("amount"),
        )

        def visit(pdf: pd.DataFrame) -> pd.DataFrame:
            out = _add(pdf).assign(seg=pdf["seg"].iloc[0])
            if step == segments - 1 and len(out):
                q = pdf[pdf["kind"] == QUERY]
                limit = dict(zip(q["id"], q["amount"]))
                out = out[out["score"] >= out["query_id"].map(limit)]
            return out

        sums = both.union(visiting).groupBy(*keys).applyInPandas(visit, "query_id long, vec_id long, score long, seg int")
    # With one segment the entries are full scores already.
    total = sums.select("query_id", "vec_id", "score").distinct()
    names_q = asked.select(F.col("id").alias("qh"), F.col("vec_id").alias("qid"))
    names_v = own.select(F.col("id").alias("vh"), F.col("vec_id").alias("vid"))
    total = total.join(names_q, F.col("query_id") == F.col("qh")).join(names_v, F.col("vec_id") == F.col("vh"))
    total = total.select(F.col("qid").alias("query_id"), F.col("vid").alias("vec_id"), "score")
    return nearest(total, k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
