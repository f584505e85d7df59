"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample (SAMPLE vectors, chosen by a hash of the id, and
at most SAMPLE_BYTES); every vector is indexed. Inner products are searched as distances: a component that levels all
norms to the largest is appended. A neighbour graph over the centroids, held in memory by every task (at most MOST_LISTS
centroids), is searched best-first for the lists of a vector. A vector near a border goes to several lists, a query to
those lists whose distance is within a ratio of the nearest one, and to more until they hold ENOUGH times what it asks for. A task takes a bucket of neighbouring lists, or a part of a
long one, of at most BUCKET_BYTES of vectors, and QUERIES queries, so its size is bounded whatever one list holds. Scores are inner products of the original
vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import stash
from quasi.llm.vectors import clean, matrix, nearest

SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
LIST = 512
MOST_LISTS = 4096
BUCKET_BYTES = 8 << 20
QUERIES = 1024
ENOUGH = 4
DEGREE = 16
BATCH = 512
PROBES = 64
RECALL = 0.95
JUDGED = 256


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def balanced_assignment(distance: np.ndarray, room: int) -> np.ndarray:
    """Nearest centroid with room: a full one keeps its nearest points, the others go on to their next choice."""
    n, k = distance.shape
    out, cost = np.full(n, -1), distance.copy()
    free = np.full(k, room)
    left = np.arange(n)
    while len(left):
        choice = cost[left].argmin(axis=1)
        for c in np.unique(choice):
            mine = left[choice == c]
            mine = mine[np.argsort(cost[mine, c], kind="stable")][: free[c]]
            out[mine] = c
            free[c] -= len(mine)
        cost[:, free <= 0] = np.inf
        left = left[out[left] < 0]
    return out


def balanced_centroids(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids by recursive balanced k-means with up to eight branches."""
    if k <= 1 or len(points) <= 1:
        return points.mean(axis=0, keepdims=True)
    branch = min(8, k, len(points))
    centers = points[rng.choice(len(points), branch, replace=False)]
    room = int(np.ceil(1.15 * len(points) / branch))
    for _ in range(8):
        own = balanced_assignment(_squares(points, centers), room)
        centers = np.stack([points[own == c].mean(axis=0) if (own == c).any() else centers[c] for c in range(branch)])
    shares = np.bincount(own, minlength=branch) / len(points) * k
    parts = np.maximum(1, np.floor(shares)).astype(int)
    for c in np.argsort(parts - shares, kind="stable")[: max(0, k - parts.sum())]:
        parts[c] += 1
    return np.concatenate([balanced_centroids(points[own == c], parts[c], rng) for c in range(branch) if (own == c).any()])


def leveled(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with a component that brings every norm to ``norm``."""
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))[:, None]], axis=1)


def as_queries(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x * (norm / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))], axis=1)


def build(sample: np.ndarray, lists: int, norm: float) -> Index:
    rng = np.random.default_rng(0)
    centroids = balanced_centroids(leveled(sample, norm), lists, rng)
    k = len(centroids)
    near = np.argsort(_squares(centroids, centroids), axis=1, kind="stable")[:, 1 : DEGREE + 1]
    # A few random links keep the graph connected.
    graph = np.concatenate([near, rng.integers(0, k, (k, min(4, k)))], axis=1) if k > 1 else np.zeros((1, 1), int)
    return Index(centroids, graph, np.unique(np.linspace(0, k - 1, min(k, DEGREE)).astype(int)), norm)


def graph_search(index: Index, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search with a beam of ``width``: nearest centroids and squared distances (unfilled: inf), per point."""
    n, k = len(points), len(index.centroids)
    width = min(width, k)
    row = np.arange(n)[:, None]

    def distances(ids: np.ndarray) -> np.ndarray:
        c = index.centroids[ids]
        return ((c - points[:, None, :]) ** 2).sum(axis=2)

    seen = np.zeros((n, k), bool)
    beam = np.repeat(index.entries[None, :], n, axis=0)
    seen[:, index.entries] = True
    cost, done = distances(beam), np.zeros(beam.shape, bool)
    while True:
        open_cost = np.where(done, np.inf, cost)
        at = open_cost.argmin(axis=1)
        active = np.isfinite(open_cost[np.arange(n), at])
        if not active.any():
            break
        done[np.arange(n), at] = True
        nearby = index.graph[beam[np.arange(n), at]]
        fresh = ~seen[row, nearby] & active[:, None]
        seen[row, nearby] |= fresh
        first = np.zeros(fresh.shape, bool)  # a node may be named twice in one list of links
        order = np.argsort(nearby, axis=1, kind="stable")
        ranked = np.take_along_axis(nearby, order, axis=1)
        np.put_along_axis(first, order, np.concatenate([np.ones((n, 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1), axis=1)
        extra = np.where(fresh & first, distances(nearby), np.inf)
        beam = np.concatenate([beam, nearby], axis=1)
        cost = np.concatenate([cost, extra], axis=1)
        done = np.concatenate([done, ~(fresh & first)], axis=1)
        keep = np.argsort(cost, axis=1, kind="stable")[:, : max(width, len(index.entries))]
        beam, cost, done = (np.take_along_axis(x, keep, axis=1) for x in (beam, cost, done))
    order = np.argsort(cost, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(beam, order, axis=1), np.take_along_axis(cost, order, axis=1)


def nearest_lists(index: Index, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``graph_search``; a beam that would see most centroids is replaced by all distances."""
    if width * DEGREE < len(index.centroids):
        return graph_search(index, points, width)
    cost = _squares(points, index.centroids)
    order = np.argsort(cost, axis=1, kind="stable")[:, :width]
    return order, np.take_along_axis(cost, order, axis=1)


def fewest_probes(ranks: np.ndarray, within: np.ndarray, lists: int) -> tuple[int, bool]:
    """Probes, and whether the ratio may be kept, that find RECALL of the true neighbours: ``ranks`` of the nearest list of
    each in its query's order, and ``within`` the ratio or not. At least PROBES."""
    for keep in (True, False):
        good = np.sort(ranks[within] if keep else ranks)
        need = int(np.ceil(RECALL * len(ranks)))
        if need <= len(good):
            return min(lists, max(PROBES, int(good[need - 1]) + 1 if need else 0)), keep
    return lists, False


def _ranks(
    base: DataFrame, asked: DataFrame, postings: DataFrame, index: Index, sizes: np.ndarray, k: int, ratio: float, enough: int
) -> tuple[np.ndarray, np.ndarray]:
    """For ``fewest_probes``: by brute force over all rows for at most JUDGED queries."""
    judged = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(JUDGED).toPandas()
    if not len(judged):
        return np.empty(0, int), np.empty(0, bool)
    q, asks = matrix(judged["v"]), judged["vec_id"].to_numpy()

    def task(batches):
        top, who = np.full((len(asks), 0), -np.inf), np.empty((len(asks), 0), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 8 * BATCH):
                part = pdf.iloc[at : at + 8 * BATCH]
                ids = part["vec_id"].to_numpy()
                scores = q @ matrix(part["v"]).T
                scores[asks[:, None] == ids[None, :]] = -np.inf
                top = np.concatenate([top, scores], axis=1)
                who = np.concatenate([who, np.broadcast_to(ids, scores.shape)], axis=1)
                best = np.argpartition(-top, min(k, top.shape[1]) - 1, axis=1)[:, :k]
                top, who = np.take_along_axis(top, best, axis=1), np.take_along_axis(who, best, axis=1)
        i, j = np.nonzero(np.isfinite(top))
        yield pd.DataFrame({"query_id": asks[i], "vec_id": who[i, j], "score": top[i, j]})

    true = base.mapInPandas(task, "query_id long, vec_id long, score double")
    true = stash(nearest(true, k).select("query_id", "vec_id"), "judged")
    wanted = F.broadcast(true.select(F.col("vec_id").alias("id")).distinct())
    lists = postings.join(wanted, "id", "left_semi").select("id", "list").distinct().toPandas().groupby("id")["list"].agg(list).to_dict()
    true = true.toPandas()
    cost = _squares(as_queries(q, index.norm), index.centroids)
    order = np.argsort(cost, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    ranked = np.take_along_axis(cost, order, axis=1)
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    near = (ranked <= ratio * ranked[:, :1] + 1e-12) | (before < enough)
    row = {a: i for i, a in enumerate(asks.tolist())}
    ranks, within = [], []
    for a, b in true.itertuples(index=False):
        rank = int(place[row[a], lists[b]].min())
        ranks.append(rank)
        within.append(bool(near[row[a], rank]))
    return np.array(ranks, int), np.array(within, bool)


def search(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
    copies: int = 4, border: float = 1.1, probes: int | None = None, ratio: float = 1.6, list_size: int = LIST,
) -> DataFrame:
    """For each query (id divisible by ``every``) the ``k`` nearest found by inner product, nearest first.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties to the smaller id. A vector joins up to ``copies``
    lists within ``border`` times its least squared distance, a query visits up to ``probes`` lists within ``ratio`` times
    its own. Without ``probes`` their number is measured: the true neighbours of JUDGED queries, chosen by hash and compared
    with all rows, say how many lists reach RECALL of them (and whether the ratio must go). Vectors left out: see ``vectors.clean``; an id with several vectors asks with the least of them.
    """
    spark = rows.sparkSession
    base = stash(clean(rows, id_col, vector_col, False), "vectors")
    facts = base.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"), F.max(F.size("v")).alias("dim")
    ).first()
    n, dim = facts.n, facts.dim or 1
    norm = float(np.sqrt(facts.square or 0.0)) * (1 + 1e-12)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, 1.2 * most / max(n, 1))
    chosen = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share * 1_000_000).limit(most).select("v").toPandas()
    sample = matrix(chosen["v"]) if len(chosen) else np.zeros((1, dim))
    index = spark.sparkContext.broadcast(build(sample, int(min(MOST_LISTS, max(1, -(-n // list_size)))), norm))

    def route(width: int, factor: float, query: bool, sizes: np.ndarray | None = None):
        def task(batches):
            place = index.value
            for pdf in batches:
                for at in range(0, len(pdf), BATCH):
                    part = pdf.iloc[at : at + BATCH]
                    v = matrix(part["v"])
                    points = as_queries(v, place.norm) if query else leveled(v, place.norm)
                    lists, cost = nearest_lists(place, points, width)
                    near = cost <= factor * cost[:, :1] + 1e-12
                    if query:
                        # However near the first lists are, go on until they hold enough.
                        held = np.cumsum(sizes[lists], axis=1) - sizes[lists]
                        near |= held < ENOUGH * copies * k
                    i, j = np.nonzero(np.isfinite(cost) & near)
                    yield pd.DataFrame({"list": lists[i, j].astype(np.int32), "id": part["vec_id"].to_numpy()[i], "v": part["v"].to_numpy()[i]})

        return task

    schema = "list int, id long, v array<double>"
    asked = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    postings = stash(base.mapInPandas(route(copies, border, False), schema), "postings")
    sizes = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(MOST_LISTS)])
    if probes is None:
        probes, keep = fewest_probes(*_ranks(base, asked, postings, index.value, held, k, ratio, ENOUGH * copies * k), len(index.value.centroids))
        ratio = ratio if keep else np.inf
    visits = stash(asked.mapInPandas(route(probes, ratio, True, held), schema), "visits")

    # At most MOST_LISTS rows: neighbouring lists share a bucket of ``room`` postings, a longer list is cut into parts.
    room = max(256, BUCKET_BYTES // (8 * dim))
    places, bucket, filled = [], 0, 0
    for one in sorted(sizes):
        if filled and filled + sizes[one] > room:
            bucket, filled = bucket + 1, 0
        places.append((one, bucket, -(-sizes[one] // room)))
        filled += sizes[one]

    def placed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(spark.createDataFrame(places, "list int, bucket int, np int")), "list")

    visits = placed(visits)
    asking = visits.groupBy("bucket").agg(F.ceil(F.count_distinct("id") / QUERIES).cast("int").alias("nq"), F.max("np").alias("bp"))
    asking = asking.collect()

    def blocked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(spark.createDataFrame(asking, "bucket int, nq int, bp int")), "bucket")

    vectors = blocked(placed(postings))
    vectors = vectors.withColumn("p", F.pmod(F.xxhash64("id"), F.col("np")).cast("int"))
    vectors = vectors.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    visits = blocked(visits).withColumn("q", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
    visits = visits.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("bp") - 1)))

    def best(asks, ids, scores):
        """The k best of each query, once each."""
        order = np.lexsort((ids, -scores, asks))
        asks, ids, scores = asks[order], ids[order], scores[order]
        fresh = np.ones(len(asks), bool)
        fresh[1:] = (asks[1:] != asks[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        asks, ids, scores = asks[fresh], ids[fresh], scores[fresh]
        keep = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
        return asks[keep], ids[keep], scores[keep]

    def scan(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for one, part in queries.groupby("list"):
            mine = vectors[vectors["list"] == one]
            if not len(mine):
                continue
            v, q = matrix(mine["v"]), matrix(part["v"])
            ids, asks = mine["id"].to_numpy(), part["id"].to_numpy()
            scores = q @ v.T
            scores[asks[:, None] == ids[None, :]] = -np.inf
            take = min(k, len(ids))
            cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
            # Products of equal vectors may differ in the last bit; those near the cut are scored anew, one by one.
            i, j = np.nonzero((scores >= (cut - slack)[:, None]) & np.isfinite(scores))
            found.append(best(asks[i], ids[j], (q[i] * v[j]).sum(axis=1)))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        asks, ids, scores = best(*(np.concatenate(x) for x in zip(*found)))
        return pd.DataFrame({"query_id": asks, "vec_id": ids, "score": scores})

    keys = ["bucket", "p", "q"]
    sides = [side.select(*keys, "list", "id", "v").groupBy(*keys) for side in (vectors, visits)]
    found = sides[0].cogroup(sides[1]).applyInPandas(scan, "query_id long, vec_id long, score double")
    return nearest(found.distinct(), k)
