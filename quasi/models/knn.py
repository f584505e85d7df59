"""Exact nearest neighbours and minority oversampling.

Rows are assigned to the nearest of a few pivots. Distances to pivots bound, by the triangle inequality,
which cells can hold a query's k nearest neighbours. Queries of one cell share blocks of bounded size, so a cell
with a large share of the rows is many blocks; a train row is copied only to the query blocks that have a query routed
to its cell. The train rows of a block come as a stream, cell by cell, and meet its queries in tiles of one matrix
product each: a task holds one block, one batch and the k best rows per query so far, at any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quasi.functions.columns import unit_hash, unit_uniform
from quasi.operators.skew import hash_rank

MAX_PIVOTS = 64
PIVOT_SPARSITY = 8
MAX_CLASSES = 1000
BLOCK_ROWS = 16384
BLOCK_KEYS = ["home", "qb"]
TILE_QUERIES, TILE_ROWS = 1024, 2048
TILE_PAIRS = 1 << 14
WAITING_PAIRS = 1 << 18
QUERY, TRAIN = 0, 1


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of matching rows without cancellation, for the few rows that are kept."""
    gap = a - b
    return np.sqrt((gap * gap).sum(-1))


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _routed_blocks(placed: DataFrame, routed: DataFrame, homes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Train rows and queries keyed by BLOCK_KEYS, a query's home cell and its block there.

    A train row goes to the query blocks that hold a query routed to its cell, so both sides have the same keys.
    """
    parts = [F.lit(v) for h, n in homes.items() for v in (h, max(1, math.ceil(n / BLOCK_ROWS)))] or [F.lit(0).cast("long"), F.lit(1)]
    queries = routed.select(
        F.col("id").alias("query_id"), F.col("vec").alias("query_vec"), "home", "bound", "cells",
        F.pmod(F.xxhash64("id", "vec", F.lit("query")), F.element_at(F.create_map(*parts), F.col("home"))).alias("qb"),
    )
    routes = queries.select(*BLOCK_KEYS, F.explode("cells").alias("cell")).distinct()
    # As many routes as there are blocks times cells.
    left = placed.select(F.col("id").alias("train_id"), F.col("vec").alias("train_vec"), "cell").join(F.broadcast(routes), "cell")
    # Both sides come from the queries; new names tell their columns apart.
    return left.select(*[F.col(c).alias(c) for c in left.columns]), queries


class _Block:
    """The queries of one block and the ``wanted`` nearest rows that each has met."""

    def __init__(self, key: tuple, wanted: int):
        self.key, self.wanted, self.parts = key, wanted, []

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _ready(self) -> None:
        rows, self.parts = pa.Table.from_batches(self.parts).combine_chunks(), None
        ids, vec, cells, bound = (rows[c].combine_chunks() for c in ("query_id", "vec", "cells", "bound"))
        self.ids, self.vectors = ids, _vectors(vec)
        self.square = (self.vectors * self.vectors).sum(1)
        self.limit = bound.to_numpy() ** 2
        flat, counts = cells.flatten().to_numpy(), cells.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        self.routed = dict(zip(names.tolist(), np.split(owner[order], first[1:])))
        self.best = pd.DataFrame({"query": np.empty(0, np.int64), "dist": np.empty(0), "train_id": np.empty(0)})
        self.waiting, self.pairs = [], 0

    def meet(self, ids: np.ndarray, rows: np.ndarray, cell: int) -> None:
        """Compare train rows of one cell with the queries routed there."""
        if self.parts is not None:
            self._ready()
        routed = self.routed.get(cell, np.empty(0, np.int64))
        for start in range(0, len(rows), TILE_ROWS):
            t, names = rows[start:start + TILE_ROWS], ids[start:start + TILE_ROWS]
            tt = (t * t).sum(1)
            for first in range(0, len(routed), TILE_QUERIES):
                at = routed[first:first + TILE_QUERIES]
                q, qq = self.vectors[at], self.square[at]
                d = q @ t.T
                d *= -2.0
                d += qq[:, None]
                d += tt[None, :]
                # Everything within rounding of the k-th distance stays in, so that ties resolve by id.
                rounding = 4.0 * np.finfo(float).eps * (t.shape[1] + 8) * (qq + tt.max())
                limit = self.limit[at] + rounding
                hit = d <= limit[:, None]
                if self.wanted < len(t) and np.count_nonzero(hit) > 4 * self.wanted * len(at):
                    kth = np.partition(d, self.wanted - 1, axis=1)[:, self.wanted - 1]
                    hit = d <= np.minimum(limit, kth + 2.0 * rounding)[:, None]
                i, j = np.nonzero(hit)
                for cut in range(0, len(i), TILE_PAIRS):
                    a, b = i[cut:cut + TILE_PAIRS], j[cut:cut + TILE_PAIRS]
                    self.waiting.append((at[a], _pair_distances(q[a], t[b]), names[b]))
                    self.pairs += len(a)
                    if self.pairs >= WAITING_PAIRS:
                        self._merge()
        self._merge()

    def _merge(self) -> None:
        if not self.pairs:
            return
        new = pd.DataFrame(dict(zip(self.best.columns, (np.concatenate(x) for x in zip(*self.waiting)))))
        self.waiting, self.pairs = [], 0
        both = pd.concat([self.best, new], ignore_index=True) if len(self.best) else new
        both = both.sort_values(["query", "dist", "train_id"], kind="stable")
        place = both.groupby("query").cumcount().to_numpy()
        self.best = both[place < self.wanted]
        last = both[place == self.wanted - 1]
        at = last["query"].to_numpy()
        self.limit[at] = np.minimum(self.limit[at], last["dist"].to_numpy() ** 2)

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.parts is not None:
            return
        columns = [
            self.ids.take(pa.array(self.best["query"].to_numpy())),
            pa.array(self.best["train_id"].to_numpy(), schema.field("train_id").type, from_pandas=True),
            pa.array(self.best["dist"].to_numpy()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "train_id", "dist"])


def _search(wanted: int):
    """Nearest rows from batches sorted by block, side and cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in (*BLOCK_KEYS, "side", "cell")])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            ids = batch.column("train_id").to_numpy(zero_copy_only=False)
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                home, qb, side, cell = keys[lo].tolist()
                if block is None or block.key != (home, qb):
                    if block is not None:
                        yield from block.found(batch.schema)
                    block = _Block((home, qb), wanted)
                part = batch.slice(lo, hi - lo)
                if side == QUERY:
                    block.add(part)
                else:
                    block.meet(ids[lo:hi], _vectors(part.column("vec")), cell)
        if block is not None:
            yield from block.found(batch.schema)

    return task


def nearest(train: DataFrame, query: DataFrame, k: int, exclude_self: bool = False, within: str | None = None) -> DataFrame:
    """The k nearest train rows of every query by Euclidean distance.

    Both inputs have columns ``id`` and ``vec`` (array<double>). Result: (query_id, train_id, rank, dist),
    ties by train id. ``exclude_self`` skips a train row with the query's own id. ``within`` names a
    small integer column on both sides; only rows with equal values are neighbours.
    """
    # A query passes over all rows with its own id.
    facts = train.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    n_train, wanted = facts[0] or 0, k + (facts[1] or 0) if exclude_self else k
    n_pivots = max(1, min(MAX_PIVOTS, int(math.sqrt(n_train) / PIVOT_SPARSITY)))
    picked = train.select("vec", unit_hash("id", "pivot").alias("h")).orderBy("h").limit(n_pivots).collect()
    pivots = np.array([r["vec"] for r in picked], dtype=float)
    between = _distances(pivots, pivots)
    part = F.col(within).cast("long") if within else F.lit(0).cast("long")
    id_type = train.schema["id"].dataType.simpleString()
    query_type = query.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            d = _distances(_matrix(batch.vec), pivots)
            cell = d.argmin(1)
            joint = batch.part.to_numpy() * n_pivots + cell
            yield pd.DataFrame({"id": batch.id, "vec": batch.vec, "cell": joint.astype(np.int64), "dist": d[np.arange(len(d)), cell]})

    placed = train.select("id", "vec", part.alias("part")).mapInPandas(
        assign, f"id {id_type}, vec array<double>, cell long, dist double"
    ).persist()
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    w = Window.partitionBy("cell").orderBy("dist", "id")
    closest = placed.select("cell", "dist", "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= wanted).collect()
    near = {c: np.sort([r["dist"] for r in closest if r["cell"] == c]) for c in sizes}
    cells = sorted(sizes)
    pivot_of, part_of = np.array(cells) % n_pivots, np.array(cells) // n_pivots
    lo, hi = (np.array([sizes[c][f] for c in cells]) for f in ("lo", "hi"))
    slack = 1e-9 * (1.0 + float(hi.max()))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), TILE_QUERIES):
                batch = whole.iloc[start:start + TILE_QUERIES]
                d = _distances(_matrix(batch.vec), pivots)
                mine = batch.part.to_numpy()[:, None] == part_of[None, :]
                # A query's k-th distance is at most the k-th smallest of (distance to pivot + pivot to row).
                reach = np.concatenate(
                    [np.where(mine[:, [i]], d[:, [pivot_of[i]]] + near[c][None, :], np.inf) for i, c in enumerate(cells)], axis=1
                )
                at_rank = min(wanted, reach.shape[1]) - 1
                bound = np.partition(reach, at_rank, axis=1)[:, at_rank]
                dc = d[:, pivot_of]
                own = d.argmin(1)
                floor = np.maximum(np.maximum(dc - hi, lo - dc), 0.0)
                gap = between[own][:, pivot_of]
                plane = np.where(gap > 0, (dc**2 - d.min(1)[:, None] ** 2) / (2 * np.where(gap > 0, gap, 1.0)), 0.0)
                need = mine & (np.maximum(floor, plane) <= bound[:, None] * (1 + 1e-9) + slack)
                names = np.array(cells)
                yield pd.DataFrame({
                    "id": batch.id, "vec": batch.vec, "cells": [names[row] for row in need],
                    "home": batch.part.to_numpy() * n_pivots + own, "bound": bound * (1 + 1e-9) + slack,
                })

    routed = query.select("id", "vec", part.alias("part")).mapInPandas(
        route, f"id {query_type}, vec array<double>, cells array<long>, home long, bound double"
    ).persist()
    homes = {r["home"]: r["n"] for r in routed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, right = _routed_blocks(placed, routed, homes)
    left = left.select(
        *BLOCK_KEYS, F.lit(TRAIN).alias("side"), "cell", F.lit(None).cast(query_type).alias("query_id"), "train_id",
        F.col("train_vec").alias("vec"), F.lit(None).cast("array<long>").alias("cells"), F.lit(None).cast("double").alias("bound"),
    )
    right = right.select(
        *BLOCK_KEYS, F.lit(QUERY).alias("side"), F.lit(-1).cast("long").alias("cell"), "query_id", F.lit(None).cast(id_type).alias("train_id"),
        F.col("query_vec").alias("vec"), "cells", "bound",
    )
    # Each block asks for a matrix product with every row of its cells, so small partitions are not merged.
    blocks = sum(max(1, math.ceil(n / BLOCK_ROWS)) for n in homes.values())
    dealt = left.unionByName(right).repartition(2 * max(1, blocks), *BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "side", "cell")
    candidates = dealt.mapInArrow(_search(wanted), f"query_id {query_type}, train_id {id_type}, dist double")
    if exclude_self:
        candidates = candidates.where(F.col("query_id") != F.col("train_id"))
    best = Window.partitionBy("query_id").orderBy("dist", "train_id")
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_predict(
    train: DataFrame, query: DataFrame, k: int, label: str, mode: str = "classification", weighting: str = "uniform"
) -> DataFrame:
    """Neighbour vote or mean: (query_id, pred), or (query_id, pred, share) for classification.

    weighting: 'uniform' or 'inverse' distance. Vote ties go to the smaller label.
    """
    found = nearest(train, query, k)
    labels = train.select(F.col("id").alias("train_id"), F.col(label).alias("__label"))
    joined = found.join(labels, "train_id", "inner")
    w = F.lit(1.0) if weighting == "uniform" else 1.0 / (F.col("dist") + 1e-12)
    if mode == "regression":
        return joined.groupBy("query_id").agg((F.sum(w * F.col("__label")) / F.sum(w)).alias("pred"))
    votes = joined.groupBy("query_id", "__label").agg(F.sum(w).alias("v"))
    return votes.groupBy("query_id").agg(
        F.min(F.struct((-F.col("v")).alias("nv"), F.col("__label").alias("label"))).alias("top"), F.sum("v").alias("total")
    ).select("query_id", F.col("top.label").alias("pred"), (-F.col("top.nv") / F.col("total")).alias("share"))


def smote(
    df: DataFrame, key: str, label: str, features: Sequence[str] | str, over_ratio: float = 0.75, k: int = 5, seed: object = 0
) -> DataFrame:
    """Add synthetic rows to classes smaller than over_ratio times the largest.

    Each class is filled to floor(over_ratio * n_max) rows. Every source row makes the same number of
    copies, and the first ones in hash order one more. A copy lies at a hash-chosen share of the way to a
    hash-chosen one of the row's k nearest class members. Result: (key, label, vec, synthetic).
    """
    vec = F.transform(F.col(features), lambda v: v.cast("double")) if isinstance(features, str) else feature_array(features)
    rows = df.select(F.col(key).alias(key), F.col(label).alias(label), vec.alias("vec"))
    counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(counted) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    counts = {r[label]: r["n"] for r in counted}
    target = math.floor(over_ratio * max(counts.values()))
    minority = [(level, n, target - n) for level, n in sorted(counts.items(), key=lambda kv: str(kv[0])) if 2 <= n < target]
    out = rows.withColumn("synthetic", F.lit(0))
    if not minority:
        return out
    # Class number, copies per row and remainder; the class list was bounded when it was counted.
    kind = df.schema[label].dataType.simpleString()
    classes = df.sparkSession.createDataFrame(
        [(level, i, need // n, need % n, min(k, n - 1)) for i, (level, n, need) in enumerate(minority)],
        f"{label} {kind}, part int, each int, extra int, ties int",
    )
    members = rows.join(F.broadcast(classes), label, "inner").withColumnRenamed(key, "id").persist()
    pairs = nearest(members, members, k, exclude_self=True, within="part")
    ranked = hash_rank(members, "id", ["part"], seed, "__rank", "__n")
    copies = F.col("each") + (F.col("__rank") <= F.col("extra")).cast("int")
    plan = ranked.where(copies > 0).select("id", label, "vec", "ties", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    tag = F.concat_ws(":", F.col("id").cast("string"), F.col("copy"))
    plan = plan.withColumn("rank", (F.floor(unit_uniform(tag, f"{seed}n") * F.col("ties")) + 1).cast("int")).withColumn(
        "gap", unit_uniform(tag, f"{seed}g")
    )
    chosen = plan.join(
        pairs.select(F.col("query_id").alias("id"), "train_id", F.col("rank").cast("int").alias("rank")), ["id", "rank"], "inner"
    )
    other = members.select(F.col("id").alias("train_id"), F.col("vec").alias("other"))
    made = chosen.join(other, "train_id", "inner").select(
        F.col("id").alias(key), label,
        F.zip_with("vec", "other", lambda a, b: a + (b - a) * F.col("gap")).alias("vec"), F.lit(1).alias("synthetic"),
    )
    return out.unionByName(made)
