"""Finding repeated windows of a corpus by content-chosen anchors, for symbols of any kind (bytes, words).

Every window of ``window`` symbols holds an anchor: its smallest ``gram``-symbol hash, leftmost among equals. Equal windows
hold equal anchors at the same offset, so all copies of a window meet under the anchor's hash, while only about
2 / (window - gram + 2) of the positions are sent anywhere.

``repeated`` finds which anchors occur more than once and compares their contexts (all symbols that a window with the
anchor can cover) by hash:

* copies of one context repeat it whole, so all of its windows are known without looking at the text;
* groups with several contexts send on one representative of each, with its text, for an exact comparison inside
  groups of at most GROUP contexts;
* larger groups are cut by the offset of the window in its context: each half has narrower contexts that either become
  equal, or fall apart by the longer text that its windows have in common. After at most log2(window) cuts a half is
  one window, and its groups hold one context each.

Anchors, contexts and spans stay in Spark; a task holds one slice of text or one bundle of groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasi.llm.common import join_one, release, stash

SLICE = 1 << 18
GROUP = 1024
BUNDLE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
POSITION = np.uint64((1 << 22) - 1)

_POWERS: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Shape:
    """Window and anchor length in symbols; ``reach`` is the largest offset of an anchor in its window."""

    window: int
    gram: int

    @property
    def reach(self) -> int:
        return self.window - self.gram


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Rolling:
    """Polynomial hashes (mod 2^64) of ranges of a symbol array."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (blockwise prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchor_rows(docs, shape: Shape):
    """Anchors of (key, symbols) documents, in slices: arrays key, pos, left, right, h, c.

    ``left`` and ``right`` are the symbols of the context before and from the anchor on; ``h`` hashes the anchor and
    ``c`` its context. Documents longer than a slice are cut into overlapping pieces.
    """
    pieces, size, before = [], 0, None

    def flush():
        # Pieces of one document that come in two goes may share their outermost anchor, too.
        nonlocal before
        rows = _anchors(pieces, shape)
        skip = int(before == (rows[0][0], rows[1][0]))
        before = rows[0][-1], rows[1][-1]
        return [x[skip:] for x in rows]

    for key, symbols in docs:
        n = len(symbols)
        if n < shape.window:
            continue
        last = n - shape.window + 1
        for at in range(0, last, SLICE):
            begin, until = max(0, at - shape.reach), min(last, at + SLICE)
            end = min(n, until + 2 * shape.window)
            pieces.append((key, symbols[begin:end], begin, n, at - begin, until - begin))
            size += end - begin
            if size >= SLICE:
                yield flush()
                pieces, size = [], 0
    if pieces:
        yield flush()


def _anchors(pieces, shape: Shape):
    symbols = np.concatenate([p[1] for p in pieces])
    if symbols.dtype == np.uint8:
        symbols = BYTE_HASHES[symbols]
    starts = np.cumsum([0, *(len(p[1]) for p in pieces)])
    rolling = Rolling(symbols)
    grams = rolling.grams(shape.gram)
    order = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_minima(order, shape.reach + 1)
    valid = np.zeros(len(low), bool)
    for start, piece in zip(starts, pieces):
        valid[start + piece[4] : start + piece[5]] = True
    at = (low[valid] & POSITION).astype(np.int64)
    at = np.unique(at[np.flatnonzero(np.diff(at, prepend=-1))])
    which = np.searchsorted(starts, at, side="right") - 1
    begin = np.array([p[2] for p in pieces])[which] - starts[which]
    pos = at + begin
    left = np.minimum(pos, shape.reach)
    right = np.minimum(np.array([p[3] for p in pieces])[which] - pos, shape.window)
    context = mix(rolling.of(at - left, at + right) + left.astype(np.uint64))
    key = np.array([p[0] for p in pieces], np.int64)[which]
    fresh = np.ones(len(at), bool)  # pieces of one document may share their outermost anchor
    fresh[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    return [x[fresh] for x in (key, pos, left, right, grams[at].view(np.int64), context.view(np.int64))]


ANCHORS = "key long, pos int, left int, right int, h long, c long"


def find_anchors(docs: DataFrame, shape: Shape, symbols: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Anchor rows of keyed documents (``key``, ``text``)."""

    def task(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = ((k, symbols(t.as_py())) for k, t in zip(keys, batch.column(1)))
            for key, pos, left, right, h, c in anchor_rows(rows, shape):
                ints = [pa.array(x.astype(np.int32)) for x in (pos, left, right)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *ints, pa.array(h), pa.array(c)], ["key", "pos", "left", "right", "h", "c"]
                )
        release()

    return docs.select("key", "text").mapInArrow(task, ANCHORS)


def attach_bodies(docs: DataFrame, wanted: DataFrame, body: Callable[[bytes, list[int], list[int]], list[bytes]]) -> DataFrame:
    """Add ``body``, the text of the context, to rows with ``key``, ``pos``, ``left``, ``right`` by one join per document."""
    fields = [f for f in wanted.schema.fields if f.name != "key"]
    needs = wanted.groupBy(F.col("key").alias("need")).agg(F.collect_list(F.struct(*[f.name for f in fields])).alias("rows"))
    both = docs.select("key", "text").join(needs.hint("shuffle_hash"), F.col("key") == F.col("need")).drop("need")
    schema = "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", body binary"

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(2)[i].values
                pos, left, right = (rows.field(n).to_numpy() for n in ("pos", "left", "right"))
                bodies = body(batch.column(1)[i].as_py(), (pos - left).tolist(), (pos + right).tolist())
                names = [f.name for f in fields]
                key = pa.array(np.full(len(rows), batch.column(0)[i].as_py(), np.int64))
                columns = [key, *(rows.field(n) for n in names), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", *names, "body"])

    return both.mapInArrow(task, schema)


def repeated(
    docs: DataFrame, shape: Shape, symbols: Callable, body: Callable, part: Callable, compare: Callable, keep_first: bool,
    name: str,
) -> DataFrame:
    """Spans (``key``, ``a``, ``b``) that cover every symbol of a repeated window.

    With ``keep_first`` only windows that also start earlier (smaller key, or earlier in the document) count, else all
    windows that start anywhere else too. ``symbols`` turns a text into bytes or hashes; ``body`` cuts contexts out of a text;
    ``part(start, length)`` is a column with symbols ``start`` (from 0) onwards of ``body``; ``compare`` returns the exact
    spans of a bundle of groups, given as lists of (key, first position, body).
    """
    window, reach = shape.window, shape.reach
    found = stash(find_anchors(docs, shape, symbols), f"{name}_anchors")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    often = stash(often.select("h", (F.col("c0") != F.col("c1")).alias("varied")), f"{name}_often")
    some = stash(found.join(often, "h"), f"{name}_repeated")
    contexts = some.groupBy("h", "c", "varied").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos", "left", "right")).alias("first")
    )
    contexts = stash(contexts, f"{name}_contexts")
    copies = contexts.where("n > 1").select("h", "c", F.col("first.key").alias("fkey"), F.col("first.pos").alias("fpos"), "n")
    other = join_one(some, copies, ["h", "c"], "n")
    if keep_first:
        other = other.where("key <> fkey or pos <> fpos")
    whole = F.col("left") + F.col("right") >= window
    spans = other.where(whole).select("key", (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b"))

    items = contexts.where("varied").select("first.*", "n", F.col("h").alias("g"))
    if not keep_first:
        # A context with copies is covered whole already, but still shows others what repeats.
        items = items.withColumn("n", F.least("n", F.lit(2)))
    items = items.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(reach))
    items = stash(attach_bodies(docs, items, body), f"{name}_items")
    ready = []
    while True:
        sizes = items.groupBy("g", "lo", "hi").agg(F.count(F.lit(1)).alias("m"))
        hot = stash(sizes.where(F.col("m") > GROUP).select("g", "lo", "hi"), f"{name}_hot")
        if hot.isEmpty():
            ready.append(items)
            break
        ready.append(items.join(hot, ["g", "lo", "hi"], "left_anti"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
        cut = items.join(hot, ["g", "lo", "hi"], "left_semi").withColumn("half", F.explode(halves))
        cut = cut.withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).where("lo <= hi")
        # Of the windows at offsets lo..hi those that fit the document; all of them share ``common``.
        low, high = F.greatest("lo", F.lit(window) - F.col("right")), F.least("hi", "left")
        cut = cut.withColumn("low", low).withColumn("high", high).where("low <= high")
        common = part(F.col("left") - F.col("lo"), F.lit(window) - F.col("hi") + F.col("lo"))
        union = part(F.col("left") - F.col("high"), F.col("high") - F.col("low") + window)
        cut = cut.withColumn("g", F.xxhash64("g", "lo", "hi", common)).withColumn("c", F.xxhash64("low", "high", union))
        cut = stash(cut.drop("half"), f"{name}_cut")
        # What equals an earlier item is covered whole; the first stands for it in the groups of this half.
        first = F.min_by(F.struct("left", "right", "low", "high", "body"), F.struct("key", "pos"))
        same = cut.groupBy("g", "lo", "hi", "c").agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "pos")).alias("place"), first.alias("first")
        )
        same = stash(same, f"{name}_same")
        many = same.where("m > 1").select("g", "c", F.col("place.key").alias("fkey"), F.col("place.pos").alias("fpos"), "m")
        covered = join_one(cut.select("g", "c", "key", "pos", "low", "high"), many, ["g", "c"], "m")
        covered = covered.where("key <> fkey or pos <> fpos").select("key", "pos", "low", "high")
        if not keep_first:
            copied = same.where("total > 1").select("place.*", "first.low", "first.high")
            covered = covered.union(copied)
        spans = spans.union(
            covered.select("key", (F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("low") + window).alias("b"))
        )
        items = same.select(
            "place.*", "first.left", "first.right", (F.col("total") if keep_first else F.least("total", F.lit(2))).alias("n"),
            "g", "lo", "hi", "first.body",
        )
        items = stash(items.select(*ready[0].columns), f"{name}_items")

    def task(batches):
        bundle, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for g, key, start, text in zip(*columns):
                if g != last and size >= BUNDLE:
                    yield from emit(bundle)
                    bundle, size = [], 0
                last = g
                bundle.append((key, start, text))
                size += len(text)
        if bundle:
            yield from emit(bundle)
        release()

    def emit(bundle):
        key, a, b = compare(bundle, keep_first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x, t)) for x, t in ((key, np.int64), (a, np.int32), (b, np.int32))], ["key", "a", "b"]
        )

    for group in ready:
        # The window keeps each group in one task, sorted by it. A repartition behind a join on g would not: Spark drops it
        # as the join's own, and then may read that join's rows as they were mapped, or split them as skewed.
        group = group.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("g"))).where("m > 1")
        group = group.select("g", "key", (F.col("pos") - F.col("left")).alias("start"), "body")
        spans = spans.union(group.mapInArrow(task, "key long, a int, b int"))
    return spans


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new], b[last]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Keyed documents with arrays ``a``, ``b`` of their spans (null: none)."""
    per = spans.groupBy(F.col("key").alias("skey")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return docs.join(per.hint("shuffle_hash"), F.col("key") == F.col("skey"), "left").select("key", "id", "text", "a", "b", "carry")
