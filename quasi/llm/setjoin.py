"""Jaccard join of n-gram sets by set relations.

A set is the distinct shingles of a text, as 64-bit hashes. Equal sets are one node. In any common order of the shingles two
sets that link share one of their first n - ceil(t * n) + 1 shingles, so these prefixes are the index. The order is by
frequency, rarest first: all shingles of all texts are counted in a table of bounded size (``COUNTER_BITS``), where
shingles may share a place, which costs selectivity but no links, as any order will do.

Lists are keyed by shingle and size class. Blocks of a list whose sets, by their position in the prefix, have too few
shingles left to reach the smallest overlap the list can ask for, are skipped. What is left of a list goes to the bundle
of its leader, the set of the least hash, so lists of one family of sets meet in few bundles, and each set travels
once per bundle, not once per list. All counts and leaders are aggregated before rows move.

A bundle, or a pair of parts of a large one, is joined in memory (``SetIndex``): prefix lists in order of size are skipped in
blocks by size and position; a set that links to one whose overlaps are known gets its own from those, by adding the
lists of the shingles it has more and taking off those it has less. Sets that are connected already are not
compared again, and a task sends on a forest of exact links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import Forest, components, release, stash

MOST_COUNTER_BITS = 25
BYTES_PER_PLACE = 128
SEGMENT_BITS = 16
CLASS_RATIO = 1.2
BYTES_AT_ONCE = 1 << 21
LONG_WORD = 64
WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
PART = 1024
SHINGLES_PER_PART = 1 << 19
SHINGLES_AT_ONCE = 1 << 20
SKIP = 32


def mix(x: np.ndarray) -> np.ndarray:
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(30))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and how many each text has."""
    raw = b"\n" + b"\n".join(texts).lower() + b"\n" * 9
    data = np.frombuffer(raw, np.uint8)
    inside = ~WHITE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    # Eight bytes from every place on; words are mixed in such steps.
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(size.astype(np.uint64))
    for step in range(0, LONG_WORD, 8):
        at = np.flatnonzero(size > step)
        if not len(at):
            break
        h[at] = mix(h[at] + (eight[begin[at] + step] & LOW_BYTES[np.minimum(size[at] - step, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[begin[i] : end[i]])
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(begin, starts))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def shingle_sets(texts, words: int):
    """Of each text (bytes or None) the sorted distinct hashes of all runs of ``words`` words; of fewer words, one of the whole
    sequence."""

    def sets(run):
        h, counts = word_hashes(run)
        begin = np.cumsum(counts) - counts
        for a, n in zip(begin.tolist(), counts.tolist()):
            width = min(words, n)
            out = np.full(n - width + 1 if n else 0, width, np.uint64)
            for i in range(width):
                out = mix(out + h[a + i : a + i + len(out)])
            yield distinct(out)

    run, size = [], 0
    for text in texts:
        run.append(text or b"")
        size += len(run[-1])
        if size >= BYTES_AT_ONCE:
            yield from sets(run)
            run, size = [], 0
    if run:
        yield from sets(run)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a, b, percent: int):
    """Shingles that sets of ``a`` and ``b`` share at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def _counted(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of two kinds: per document ``key``, ``id``, ``n`` and its set's digest ``d1``, ``d2``; per task and ``segment``
    of the counter its places ``at`` and their counts ``n_at``."""
    names = ["key", "id", "n", "d1", "d2", "segment", "at", "n_at"]

    def task(batches):
        counter = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            n, digests = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.int64)
            for i, s in enumerate(shingle_sets((t.as_py() for t in batch.column(1)), words)):
                n[i] = len(s)
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                np.add.at(counter, (s >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *(pa.array(digests[:, j]) for j in (0, 1)), *none], names)
        segments = counter.reshape(-1, min(len(counter), 1 << SEGMENT_BITS))
        for i, segment in enumerate(segments):
            at = np.flatnonzero(segment)
            if len(at):
                row = [pa.nulls(1, pa.int64())] * 5
                row += [pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([segment[at].tobytes()])]
                yield pa.RecordBatch.from_arrays(row, names)
        release()

    schema = "key long, id long, n long, d1 long, d2 long, segment int, at binary, n_at binary"
    return docs.select("key", F.col("text").cast("binary"), "id").mapInArrow(task, schema)


def _levels(counted: DataFrame, bits: int) -> np.ndarray:
    """By place of the counter, how often its shingles occur, on a scale of eighths of doublings: at most 32 MB."""
    width = min(1 << bits, 1 << SEGMENT_BITS)

    def task(batches):
        # Segments come one after the other.
        segment, total = None, None
        for batch in batches:
            for s, at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if s != segment:
                    if segment is not None:
                        yield done(segment, total)
                    segment, total = s, np.zeros(width, np.int64)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
        if segment is not None:
            yield done(segment, total)

    def done(segment, total):
        level = np.minimum(np.log2(total + 1) * 8, 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([level.tobytes()])], ["segment", "level"])

    rows = counted.where("segment is not null").select("segment", "at", "n_at")
    rows = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(task, "segment int, level binary")
    out = np.zeros(1 << bits, np.uint8)
    for row in rows.collect():
        out[row.segment * width : (row.segment + 1) * width] = np.frombuffer(row.level, np.uint8)
    return out


def _classes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Size class of a set, and the highest class of a set it can link to."""
    return (np.floor(np.log(x) / math.log(CLASS_RATIO)).astype(np.int64) for x in (n, n * 100 / percent + 1))


def _entries(docs: DataFrame, words: int, percent: int, bits: int, levels) -> DataFrame:
    """Prefix index: ``token``, size class ``size``, ``key``, ``n`` and ``left``, the set's shingles from the token on."""

    def task(batches):
        level = levels.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            tokens, which, left, sizes = [], [], [], []
            for i, s in enumerate(shingle_sets((t.as_py() for t in batch.column(1)), words)):
                if not len(s):
                    continue
                p = prefix_size(len(s), percent)
                often = level[(s >> np.uint64(64 - bits)).astype(np.int64)]
                tokens.append(s[np.argsort(often, kind="stable")[:p]])
                which.append(np.full(p, i))
                left.append(len(s) - np.arange(p))
                sizes.append(np.full(p, len(s)))
            if not tokens:
                continue
            token, w, rest, n = (np.concatenate(x) for x in (tokens, which, left, sizes))
            low, high = _classes(n, percent)
            copies = high - low + 1
            at = np.repeat(np.arange(len(n)), copies)
            size = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            columns = [token[at].view(np.int64), size.astype(np.int32), keys[w[at]], n[at].astype(np.int64), rest[at].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "size", "key", "n", "left"])
        release()

    return docs.select("key", F.col("text").cast("binary")).mapInArrow(task, "token long, size int, key long, n long, left long")


def _members(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``g`` (the leader's key), ``key`` and ``n`` of every set that shares a list with another one, after skipping."""
    lists = ["token", "size"]
    often = entries.groupBy(*lists).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1").drop("m")
    # The smallest partner is in the list, and no smaller than percent of the set.
    partner = F.greatest("least", F.ceil(F.col("n") * percent / F.lit(100.0)))
    need = F.ceil((F.col("n") + partner) * percent / F.lit(100.0 + percent) - 1e-6)
    kept = entries.join(often, lists).where(F.col("left") >= need).select(*lists, "key", "n")
    # Of equal sets one goes on; by now few entries are left.
    kept = stash(kept.join(nodes.select(F.col("node").alias("key")), "key", "left_semi"), "setjoin_kept")
    first = F.min(F.struct(F.xxhash64("key").alias("h"), "key"))
    leaders = kept.groupBy(*lists).agg(F.count(F.lit(1)).alias("m"), first.alias("leader")).where("m > 1")
    return kept.join(leaders.select(*lists, F.col("leader.key").alias("g")), lists).select("g", "key", "n").distinct()


class SetIndex:
    """Sets of one task, by ascending size, with prefix lists in blocks and whole lists."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.m = percent, len(sets)
        self.n = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        names, flat, often = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(names))
        owner = np.repeat(np.arange(self.m), self.n)
        order = np.lexsort((rank[flat], owner))
        self.tokens, self.begin = rank[flat][order], np.cumsum(self.n) - self.n
        by_token = np.argsort(self.tokens, kind="stable")  # within a token by size, as the sets are
        self.lists, self.upto = owner[by_token], np.searchsorted(self.tokens[by_token], np.arange(len(names) + 1))
        place = np.arange(len(flat)) - np.repeat(self.begin, self.n)
        prefix = np.array([prefix_size(int(n), percent) for n in self.n])
        inside = by_token[place[by_token] < prefix[owner[by_token]]]
        self.p_set, self.p_left = owner[inside], self.n[owner[inside]] - place[inside]
        self.p_upto = np.searchsorted(self.tokens[inside], np.arange(len(names) + 1))
        self.prefix = prefix
        blocks = np.arange(0, len(inside), SKIP)
        self.b_left = np.maximum.reduceat(self.p_left, blocks) if len(inside) else np.empty(0, np.int64)
        self.b_most = np.maximum.reduceat(self.n[self.p_set], blocks) if len(inside) else np.empty(0, np.int64)
        self.overlaps: dict[int, np.ndarray] = {}

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.begin[i] : self.begin[i] + self.n[i]]

    def candidates(self, i: int) -> np.ndarray:
        """Later sets that meet set i in a prefix list with enough shingles left."""
        t = self.of(i)[: self.prefix[i]]
        a, b = self.p_upto[t], self.p_upto[t + 1]
        most = self.n[i] * 100 // self.percent
        mine = self.n[i] - np.arange(len(t))
        need = least_overlap(self.n[i], self.n[i], self.percent)
        use = (b - a > 1) & (mine >= need)
        a, b = a[use], b[use]
        if not len(a):
            return a
        first, last = a // SKIP, (b - 1) // SKIP
        # Blocks of the lists; those in which nothing has enough left, or all sets come before, are skipped.
        which = np.repeat(np.arange(len(a)), last - first + 1)
        block = np.arange(len(which)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[which]
        keep = (self.b_left[block] >= need) & (self.b_most[block] >= self.n[i])
        which, block = which[keep], block[keep]
        lo, hi = np.maximum(a[which], block * SKIP), np.minimum(b[which], (block + 1) * SKIP)
        at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        j, left = self.p_set[at], self.p_left[at]
        mine = np.repeat(mine[use][which], hi - lo)
        need = least_overlap(self.n[i], self.n[j], self.percent)
        return np.unique(j[(j > i) & (self.n[j] <= most) & (np.minimum(left, mine) >= need)])

    def _listed(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has."""
        a, size = self.upto[tokens], self.upto[tokens + 1] - self.upto[tokens]
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.lists[at], minlength=self.m)

    def overlap(self, i: int, like: int | None) -> np.ndarray:
        """Shingles that set i shares with every set; from those of the set ``like``, if that is given."""
        if like is None:
            return self._listed(self.of(i))
        mine, its = self.of(i), self.of(like)
        return self.overlaps[like] + self._listed(np.setdiff1d(mine, its, True)) - self._listed(np.setdiff1d(its, mine, True))


def forest_of_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links between the sets connect; with ``side`` only between sets of different sides."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    index = SetIndex([sets[i] for i in order], percent)
    side = np.arange(len(sets)) if side is None else side[order]
    forest, like, found = Forest(len(sets)), {}, []
    for i in range(len(sets)):
        own = forest.find(i)
        later = [j for j in index.candidates(i).tolist() if side[j] != side[i] and forest.find(j) != own]
        if not later:
            continue
        index.overlaps[i] = shared = index.overlap(i, like.get(i))
        for j in later:
            if 100 * int(shared[j]) >= percent * int(index.n[i] + index.n[j] - shared[j]) and forest.join(i, j):
                like[j] = i
                found.append((int(order[i]), int(order[j])))
    return found


def _tiles(members: DataFrame) -> DataFrame:
    """``key`` and, per bundle ``g`` it belongs to, the tiles (``ti``, ``tj``) that it visits from its ``part``."""
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("total") / SHINGLES_PER_PART)).cast("int")
    sizes = sizes.select("g", parts.alias("parts")).where("parts > 1")
    tiled = members.join(sizes, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # A part meets every part, itself included: tile (i, j) with i <= j holds the sets of both.
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return tiled.select("key", "g", F.least("part", "other").alias("ti"), F.greatest("part", "other").alias("tj"), "part")


def _with_sets(docs: DataFrame, tiles: DataFrame, words: int) -> DataFrame:
    """``g``, ``ti``, ``tj``, ``part``, ``key`` and ``s``, the document's shingle hashes."""
    names = ["g", "ti", "tj", "part", "key", "s"]
    needs = tiles.groupBy(F.col("key").alias("need")).agg(F.collect_list(F.struct(*names[:4])).alias("visits"))
    both = docs.select("key", F.col("text").cast("binary").alias("text")).join(needs.hint("shuffle_hash"), F.col("key") == F.col("need")).drop("need")

    def task(batches):
        for batch in batches:
            rows, sets, size = [], [], 0
            for i, s in enumerate(shingle_sets((t.as_py() for t in batch.column(1)), words)):
                key, s = batch.column(0)[i].as_py(), s.view(np.int64)
                for visit in batch.column(2)[i].as_py():
                    rows.append((*visit.values(), key))
                    sets.append(s)
                    size += len(s)
                    if size >= SHINGLES_AT_ONCE:
                        yield packed(rows, sets)
                        rows, sets, size = [], [], 0
            if rows:
                yield packed(rows, sets)
        release()

    def packed(rows, sets):
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.list_(pa.int64()))], names)

    return both.mapInArrow(task, "g long, ti int, tj int, part int, key long, s array<long>")


def _links(tiled: DataFrame, percent: int) -> DataFrame:
    """Exact links (u, v) that connect the sets of each bundle."""

    def joined(tile):
        keys = np.array([t[0] for t in tile], np.int64)
        side = np.array([t[1] for t in tile])
        pairs = forest_of_links([t[2] for t in tile], percent, side if len(np.unique(side)) > 1 else None)
        return [(int(keys[a]), int(keys[b])) for a, b in pairs]

    def task(batches):
        # Tiles come whole, one after the other, over batches of any size.
        current, tile = None, []
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in range(5))))
            sets, found = batch.column(5), []
            for i, (g, ti, tj, part, key) in enumerate(at):
                if (g, ti, tj) != current:
                    if len(tile) > 1:
                        found += joined(tile)
                    current, tile = (g, ti, tj), []
                tile.append((key, part, sets[i].values.to_numpy().view(np.uint64).copy()))
            yield _pairs(found)
        if len(tile) > 1:
            yield _pairs(joined(tile))
        release()

    keys = ["g", "ti", "tj"]
    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(task, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array([p[j] for p in found], np.int64) for j in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90
) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``.

    Texts are lower-cased (A-Z) and split at ASCII white space; two documents link when 100 * intersection >= ``percent`` *
    union of their shingle sets; a component carries the smallest id that links reach. Null texts and texts without
    words have no shingles and link with nothing. Repeated rows are rows of their own; rows of a null id, or of one id,
    are told apart, and a component whose ids are all null has a null component_id. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size, named, distinct, n = rows.agg(
        F.sum(F.octet_length("text")), F.count("id"), F.count_distinct("id"), F.count(F.lit(1))
    ).first()
    if named == distinct == n:
        rows = rows.withColumn("key", F.col("id"))
    else:
        rows = stash(rows.withColumn("key", F.monotonically_increasing_id()), "setjoin_rows")
    bits = min(MOST_COUNTER_BITS, max(SEGMENT_BITS, ((size or 0) // BYTES_PER_PLACE).bit_length()))
    counted = stash(_counted(rows, words, bits), "setjoin_counted")
    prints = counted.where("segment is null").select("id", "key", "n", "d1", "d2")
    nodes = prints.where("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("node"), F.min("id").alias("least"))
    nodes = stash(nodes, "setjoin_nodes")
    levels = rows.sparkSession.sparkContext.broadcast(_levels(counted, bits))
    entries = stash(_entries(rows, words, percent, bits, levels), "setjoin_entries")
    tiles = stash(_tiles(stash(_members(entries, nodes, percent), "setjoin_members")), "setjoin_tiles")
    found = stash(_links(_with_sets(rows, tiles, words), percent), "setjoin_links")
    named = nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("least").alias("low"))
    named = stash(named.join(low, "root").select("d1", "d2", "low"), "setjoin_components")
    out = prints.join(named, ["d1", "d2"], "left")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("low"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))
