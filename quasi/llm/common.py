"""Helpers the corpus operators share: written intermediates, unique keys, balanced joins, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.session import scratch_path

EDGES_PER_TASK = 250_000
HOT_KEYS = 1000
HOT_ROWS = 1000


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here and lost executors cost one read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Columns ``key`` (unique long), ``id``, ``text`` as UTF-8 bytes (null: empty) and ``carry``, a struct of others.

    A unique id without nulls is the key itself. Otherwise the rows are written once with keys that order them
    by id (nulls last), then by place, so that repeated ids stay separate documents with a fixed order.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    ident = F.col(id_col).cast("long").alias("id")
    others = F.struct(F.col(text_col).isNull().alias("was_null"), *[F.col(c) for c in carry]).alias("carry")
    seen = docs.select(ident).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).first()
    if seen.n == seen.d:
        return docs.select(ident, text, others).select(F.col("id").alias("key"), "id", "text", "carry")
    rows = stash(docs.select(ident, text, others).withColumn("place", F.monotonically_increasing_id()), "rows")
    ranks = rows.select("id", "place").sort(F.col("id").asc_nulls_last(), "place")
    ranks = stash(ranks.select("place", F.monotonically_increasing_id().alias("key")), "ranks")
    return stash(rows.join(ranks, "place").select("key", "id", "text", "carry"), "keyed")


def release():
    """Hand a finished task's memory back: Python workers live on and would add up what each stage has left."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_runs(column: pa.Array, most: int):
    """Runs (first row, texts) of an Arrow column, of about ``most`` bytes each: a batch is never all Python strings at once."""
    ends = np.cumsum(pc.coalesce(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop


def join_one(rows: DataFrame, one: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """``rows`` inner-joined with ``one``, which has at most one row per key; ``size`` is the number of its ``rows``.

    The HOT_KEYS largest keys are broadcast, so their rows stay where they are; only the others are shuffled.
    """
    hot = stash(one.where(F.col(size) > HOT_ROWS).orderBy(F.desc(size)).limit(HOT_KEYS), "hot_keys")
    cold = one.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").drop(size)
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(cold, list(keys))
    return rows.join(F.broadcast(hot.drop(size)), list(keys)).unionByName(rest)


class Forest:
    """Union-find over small integers; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Replace a task's edges by stars around the smallest node of each local component."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    edges = pd.concat(parts)
    nodes, place = np.unique(edges[["v", "u"]].to_numpy(), return_inverse=True)
    place = place.reshape(-1, 2)
    forest = Forest(len(nodes))
    for a, b in place.tolist():
        forest.join(a, b)
    roots = np.array([forest.find(i) for i in range(len(nodes))])
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    yield pd.DataFrame({"v": nodes[moved], "u": nodes[roots[moved]]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, root) per node that has an edge.

    Tasks of EDGES_PER_TASK edges contract what they hold to stars; alternating large-star and small-star steps
    (each two joins on written tables, so that AQE can split a hub's rows) then join the stars of different tasks
    until nothing changes.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct()
    e = stash(e, "edges")
    tasks = max(1, -(-e.count() // EDGES_PER_TASK))
    e = stash(e.repartition(tasks).mapInPandas(_contract, "v long, u long"), "stars")
    if tasks == 1:
        return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
            e.select(F.col("u"), F.col("u")).distinct()
        )

    def mark(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    before = mark(e)
    while True:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        low = stash(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        e = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        e = stash(e, "large")
        low = stash(e.groupBy("v").agg(F.min("u").alias("m")), "low")
        near = e.join(low, "v")
        e = near.select(F.col("u").alias("v"), F.col("m").alias("u")).union(near.select("v", "m")).where("u <> v").distinct()
        e = stash(e, "small")
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u"), F.col("u")).distinct())
