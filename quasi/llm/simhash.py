"""Near-duplicate groups by SimHash with bit-sliced comparison.

Fingerprints are compared in blocks. A block holds its bit planes vertically, 64 fingerprints to a machine word;
carry-save counters add up the differing planes of many pairs at once, and words whose 64 distances all exceed the
radius are abandoned between rounds of planes. A block returns a minimum spanning forest of its links, never all
pairs, so a group of m copies sends on at most m - 1 links per block.

Blocks come from tables of bit positions. ``exact_tables`` cuts the fingerprint so that any two within the radius agree
on a whole table entry (nothing is missed). The number of bits in a key follows the number of fingerprints, so a block holds
about BLOCK of them; larger blocks are cut into tiles and compared tile by tile.

Empty and null texts have fingerprint zero. Rows of a null id keep their row and get the component of their text.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import Forest, components, release, stash

SEED = 42
BLOCK = 1024
TILE_OVER = 4 * BLOCK
ROUND = 16
WORDS_AT_ONCE = 1 << 13
PAIRS_AT_ONCE = 1 << 20
SHINGLES_AT_ONCE = 1 << 15
HOT_BROADCAST = 50_000


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of every shingle: lower-cased A-Z, words split at ASCII white space, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = itertools.chain((0,), ends)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1
    )


def remix(h: np.ndarray, lane: int) -> np.ndarray:
    """The hash of further fingerprint words, from the first."""
    if lane == 0:
        return h
    x = h ^ np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """Fingerprint words: a bit is one if set in over half the hashes."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SHINGLES_AT_ONCE):
            h = remix(hashes[at : at + SHINGLES_AT_ONCE], lane)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """Columns ``id``, ``digest`` (hash of the text), ``n`` (shingles) and fingerprint words ``f0``, ``f1``, ... of whole
    texts."""
    names = [f"f{i}" for i in range(lanes)]

    def task(batches):
        for batch in batches:
            texts = batch.column(2)
            prints, counts = np.zeros((len(texts), lanes), np.uint64), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                hashes = shingle_hashes(text.as_py(), words)
                prints[i], counts[i] = simhash(hashes, lanes), len(hashes)
            columns = [pa.array(counts), *(pa.array(prints[:, j].view(np.int64)) for j in range(lanes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "digest", "n", *names])

    text = F.col(text_col).cast("binary").alias("text")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), text)
    return narrow.mapInArrow(task, "id long, digest long, n long, " + ", ".join(f"{n} long" for n in names))


def key_bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / BLOCK)))


def exact_tables(bits: int, radius: int, rows: int) -> list[list[int]]:
    """Positions such that fingerprints within ``radius`` agree on all positions of at least one table."""
    need = key_bits(rows)
    if need == 0:
        return [[]]
    agree = 1
    while (bits // (radius + agree)) * agree < need and radius + agree < bits:
        agree += 1
    parts = [list(x) for x in np.array_split(np.arange(bits), radius + agree)]
    tables = []
    for chosen in itertools.combinations(parts, agree):
        inter = [p for row in itertools.zip_longest(*chosen) for p in row if p is not None]
        tables.append([int(p) for p in inter[:need]])
    return tables


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical count exceeds ``radius``."""
    over = np.zeros_like(counter[0])
    same = ~over
    for place in range(len(counter) - 1, -1, -1):
        c = counter[place]
        if radius >> place & 1:
            same &= c
        else:
            over |= same & c
            same &= ~c
    return over


def close_pairs(prints: np.ndarray, radius: int, split: int = 0):
    """Arrays of index pairs (i < j) at most ``radius`` bits apart; ``split`` > 0 keeps only i < split <= j."""
    m, lanes = prints.shape
    bits = 64 * lanes
    padded = np.zeros((-(-m // 64) * 64, lanes), np.uint64)
    padded[:m] = prints
    set_bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(set_bits.T, axis=1, bitorder="little")).view(np.uint64)
    masks = np.ascontiguousarray((np.uint64(0) - set_bits[:m].T.astype(np.uint64)))
    queries = np.arange(split or m)
    first = np.full(len(queries), split // 64) if split else queries // 64
    counts = planes.shape[1] - first
    qs = np.repeat(queries, counts)
    ws = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    width = radius.bit_length()
    for at in range(0, len(qs), WORDS_AT_ONCE):
        q, w = qs[at : at + WORDS_AT_ONCE], ws[at : at + WORDS_AT_ONCE]
        zero = np.zeros(len(q), np.uint64)
        counter = [zero.copy() for _ in range(width)]
        over = zero
        for plane in range(0, bits, 4):
            d = [planes[p][w] ^ masks[p][q] for p in range(plane, plane + 4)]
            ones, t1 = _csa(counter[0], d[0], d[1])
            counter[0], t2 = _csa(ones, d[2], d[3])
            # Two carries of weight two; what runs out at the top is past the radius for good.
            if width > 1:
                counter[1], carry = _csa(counter[1], t1, t2)
            else:
                over, carry = over | t1 | t2, zero
            for place in range(2, width):
                counter[place], carry = counter[place] ^ carry, counter[place] & carry
            over = over | carry
            if (plane + 4) % ROUND == 0 or plane + 4 == bits:
                alive = np.flatnonzero(~(over | _over(counter, radius)))
                if len(alive) < len(q):
                    q, w, over, zero = q[alive], w[alive], over[alive], zero[alive]
                    counter = [c[alive] for c in counter]
                if not len(q):
                    break
        if len(q):
            near = ~(over | _over(counter, radius))
            row, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[row], w[row] * 64 + bit
            keep = (j < m) & ((j >= split) if split else (j > i))
            yield np.stack([i[keep], j[keep]], axis=1).astype(np.int32)


def kruskal(pairs: np.ndarray, apart: np.ndarray, m: int) -> np.ndarray:
    """Which of the pairs make a minimum spanning forest of ``m`` nodes."""
    forest, roots, kept = Forest(m), np.arange(m), []
    order = np.argsort(apart, kind="stable")
    for at in range(0, len(order), 1 << 13):
        part = order[at : at + (1 << 13)]
        ends = roots[pairs[part]]
        part = part[ends[:, 0] != ends[:, 1]]
        new = [n for n, (a, b) in zip(part.tolist(), pairs[part].tolist()) if forest.join(a, b)]
        if new:
            kept += new
            roots = np.fromiter(map(forest.find, range(m)), np.int64, m)
    return np.array(kept, np.int64)


def spanning(prints: np.ndarray, chunks) -> np.ndarray:
    """The nearest links that keep everything connected, out of arrays of pairs; a forest is kept of those seen so far."""
    pairs, apart = np.empty((0, 2), np.int32), np.empty(0, np.uint16)

    def reduced(pairs, apart):
        keep = kruskal(pairs, apart, len(prints))
        return pairs[keep], apart[keep]

    for chunk in chunks:
        d = np.zeros(len(chunk), np.uint16)
        for lane in range(prints.shape[1]):
            d += np.bitwise_count(prints[chunk[:, 0], lane] ^ prints[chunk[:, 1], lane])
        pairs, apart = np.concatenate([pairs, chunk]), np.concatenate([apart, d])
        if len(pairs) > PAIRS_AT_ONCE:
            pairs, apart = reduced(pairs, apart)
    return reduced(pairs, apart)[0]


def links(nodes: DataFrame, radius: int, tables: list[list[int]], lanes: int) -> DataFrame:
    """Distinct links (u, v) between nodes (``node``, ``f0``...) that span what lies within ``radius`` per block."""
    names = [f"f{i}" for i in range(lanes)]
    schema = "slot int, key long, node long, " + ", ".join(f"{n} long" for n in names)

    def spread(batches):
        for pdf in batches:
            prints = np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint64)
            for slot, positions in enumerate(tables):
                key = np.zeros(len(pdf), np.int64)
                for p in positions:
                    key = key << 1 | ((prints[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)).astype(np.int64)
                yield pdf.assign(slot=np.int32(slot), key=key)[["slot", "key", "node", *names]]

    rows = nodes.mapInPandas(spread, schema)
    sizes = rows.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_OVER)
    sizes = stash(sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "hot_blocks")
    n_hot = sizes.count()
    if n_hot:
        if n_hot <= HOT_BROADCAST:
            sizes = F.broadcast(sizes)
        rows = rows.join(sizes, ["slot", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        rows = rows.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # A part meets every part, itself included: tile (i, j) with i <= j holds the rows of both.
    tiled = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select(
        "slot", "key", F.least("part", "other").alias("ti"), F.greatest("part", "other").alias("tj"), "part", "node", *names
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        pdf = pdf.sort_values(["part", "node"])
        prints = np.ascontiguousarray(pdf[names].to_numpy(np.int64)).view(np.uint64)
        cut = int((pdf["part"] == i).sum()) if i != j else 0
        none = i != j and cut in (0, len(pdf))
        pairs = np.empty((0, 2), np.int32) if none else spanning(prints, close_pairs(prints, radius, cut))
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    found = tiled.groupBy("slot", "key", "ti", "tj").applyInPandas(compare, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``, exact.

    Fingerprints at ``radius`` or fewer differing bits are linked; a component carries the smallest id that can be
    reached, null only if all its ids are null.
    """
    prints = stash(fingerprints(docs, id_col, text_col, words, 1), "fingerprints")
    nodes = stash(prints.groupBy("f0").agg(F.min("id").alias("least")).withColumn("node", F.col("f0")), "nodes")
    found = links(nodes.select("node", "f0"), radius, exact_tables(64, radius, nodes.count()), 1)
    roots = components(found)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(named.select("node", "root").join(low, "root").select("node", "component_id"), "components")
    return prints.join(named, prints.f0 == named.node).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )
