"""Set joins, hard negatives and resampling against brute force, and on odd input."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quasi.llm import negatives, resample, setjoin

DOCS = "doc_id long, text string, lang string, key int, id string, n int, rank string, part int"
VECTORS = "vec_id long, embedding array<double>, label int, id string, v int, kind string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(7)
    words = ["alpha", "Beta", "gämma", "delta9", "été", "zeta", "eta", "theta", "ІЙ", "x-y"] + [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 40, 120]))]
        rows.append([i, " ".join(text)])
        for j in range(rnd.choice([0, 0, 1, 6])):
            copy = list(text)
            for _ in range(rnd.choice([0, 1, 1, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append([100 + 10 * i + j, "  ".join(copy)])
    rows += [[900, None], [901, ""], [902, " \n\t "], [903, "one"], [904, "ONE"], [905, "one two"], [906, "one two three"], [907, "-- ."]]
    rows += [[None, rows[3][1]], [None, None], rows[5], rows[5], [5, "another text of id five " * 8]]
    rows.append([908, " ".join(rnd.choice(words) for _ in range(60_000))])
    return spark.createDataFrame([(*r, "en", 1, "i", 2, "r", 3) for r in rows], DOCS)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def expected_components(rows, n, percent):
    sets, parent = [shingles(r.text, n) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)] += [] if r.doc_id is None else [r.doc_id]
    return collections.Counter((r.doc_id, len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("part, skip", [(1024, 32), (3, 2)])
def test_linked_sets(docs, monkeypatch, part, skip):
    monkeypatch.setattr(setjoin, "PART", part)
    monkeypatch.setattr(setjoin, "SKIP", skip)
    rows = docs.select("doc_id", "text").collect()
    for n, percent in ((3, 90), (2, 60)):
        got = setjoin.link(docs, words=n, percent=percent).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components(rows, n, percent)
    got = setjoin.link(docs.where("doc_id < 100 and doc_id <> 5")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components(
        [r for r in rows if r.doc_id is not None and r.doc_id < 100 and r.doc_id != 5], 3, 90
    )
    assert setjoin.link(docs.limit(0)).collect() == []


def test_forest_connects_what_all_links_connect(monkeypatch):
    rng = np.random.default_rng(4)
    for trial in range(30):
        base = [rng.choice(2000, 80, replace=False) for _ in range(4)]
        sets = []
        for _ in range(120):
            s = set(base[rng.integers(4)].tolist())
            for _ in range(rng.integers(0, 8)):
                s.discard(int(rng.choice(sorted(s))))
                s.add(int(rng.integers(2000)))
            sets.append(np.array(sorted(s), np.uint64))
        side = rng.integers(0, 2, len(sets)) if trial % 2 else None
        linked = []
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both) and (side is None or side[i] != side[j]):
                    linked.append((i, j))
        found = setjoin.forest_of_links(sets, 90, side)
        assert {tuple(sorted(x, reverse=True)) for x in found} <= set(linked) and len(found) < len(sets)

        def roots(pairs):
            forest = setjoin.Forest(len(sets))
            for a, b in pairs:
                forest.join(a, b)
            return [forest.find(i) for i in range(len(sets))]

        assert roots(found) == roots(linked)


def test_overlaps_follow_from_a_similar_set():
    rng = np.random.default_rng(5)
    sets = sorted((np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)), key=len)
    index = setjoin.SetIndex(sets, 90)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for i in range(40):
        index.overlaps[i] = index.overlap(i, None)
        assert (index.overlaps[i] == want[i]).all() and (index.overlap(i, rng.integers(i + 1)) == want[i]).all()


def test_products_by_residues():
    rng = np.random.default_rng(6)
    for high, dim in ((130, 64), (10**6, 200), (2**62, 5), (2**63 - 1, 3), (0, 4)):
        a, b = rng.integers(-high - 1, high, (7, dim)), rng.integers(-high - 1, high, (9, dim), endpoint=True)
        exact = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        want = np.clip(np.array(exact, object), -(2**63) + 1, 2**63 - 1).astype(np.int64)
        assert (negatives.products(a, b) == want).all()


def expected_negatives(rows, every, positives, count, lower, upper, scale):
    least = {}
    sizes = collections.Counter()
    for r in rows:
        x = r.embedding
        if r.vec_id is None or r.label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(min(max(c * scale, -(2.0**63)), float(np.nextafter(2.0**63, 0)))) for c in x)
        sizes[len(v)] += 1
        least.setdefault(r.vec_id, []).append((r.label, v))
    dim = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    table = {k: min(x for x in v if len(x[1]) == dim) for k, v in least.items() if any(len(x[1]) == dim for x in v)}
    out = []
    for a, (label, v) in table.items():
        if a % every:
            continue
        scores = {k: max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -(2**63) + 1) for k, (_, w) in table.items()}
        order = sorted((k for k in table if k != a), key=lambda k: (-scores[k], k))
        for p in [k for k in order if table[k][0] == label][:positives]:
            near = [k for k in order if table[k][0] != label and lower * scores[p] <= 100 * scores[k] <= upper * scores[p]]
            out += [(a, p, i + 1, k, scores[p], scores[k]) for i, k in enumerate(near[:count])]
    return sorted(out)


def vectors(spark, kind):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        x = rng.normal(size=4) if kind == "plain" else rng.integers(-1, 3, 4) / 2.0
        rows.append([i, x.tolist(), int(rng.integers(0, 3))])
    if kind != "plain":
        rows += [[None, [1.0] * 4, 1], [200, None, 1], [205, [1.0] * 4, None], [210, [1.0, None, 1.0, 1.0], 2], [215, [], 1]]
        rows += [[220, [1.0, float("nan"), 0.0, 1.0], 1], [225, [float("inf")] * 4, 1], [230, [1.0] * 3, 1], [235, [0.0] * 4, 1]]
        rows += [rows[10], rows[10], [10, [0.5] * 4, 0], [10, [0.5] * 4, 2], [-5, [1.0] * 4, 1]]
    if kind == "large":
        rows += [[300, [1e300, 1.0, 0.0, 0.0], 1], [305, [1e17, -1e300, 1.0, 0.0], 1], [310, [1e12, 1e12, 3.0, 0.0], 2], [316, [3e12, 1e11, 3.0, 0.0], 1]]
    return spark.createDataFrame([(*r, "i", 1, "k", 2) for r in rows], VECTORS)


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_hard_negatives(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 8), ("SLAB", 3), ("ROWS", 16)) if kind != "plain" else ():
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(spark, kind)
    got = negatives.mine(rows, every=5).collect()
    want = expected_negatives(rows.collect(), 5, 5, 3, 50, 95, 256)
    assert sorted(tuple(r) for r in got) == want and len(want) > 50
    assert negatives.mine(rows.limit(0)).collect() == []


def expected_draw(rows, target, longest, buckets, percent, least):
    def features(text):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    mine = [features(r.text) for r in rows]
    s = collections.Counter(b for _, f in mine for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    s_all, t_all = s.total() + buckets, t.total() + buckets
    out = []
    for i, (r, (n, f)) in enumerate(zip(rows, mine)):
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append([r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for i, o in enumerate(able):
        o[4] = i + 1 if i < len(able) * percent // 100 else None
    for o in out:
        o[4] = o[4] if o in able else None
    return collections.Counter(tuple(o) for o in out)


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 20), (3, 40, 2), (2, 100, 0)])
def test_draw(spark, docs, monkeypatch, longest, percent, least):
    monkeypatch.setattr(resample, "SLICE", 64)
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 500)
    target = ["alpha beta w1 w2 w3", None, "été x y"]
    bench = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id long, text string, doc_id int")
    rows = docs.select("doc_id", "text").collect()
    got = resample.resample(docs, bench, longest=longest, buckets=500, percent=percent, min_words=least).collect()
    assert collections.Counter(tuple(r) for r in got) == expected_draw(rows, target, longest, 500, percent, least)


def test_draw_from_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs.limit(0), bench).collect() == []
    got = resample.resample(docs, bench, percent=0).collect()
    assert len(got) == docs.count() and all(r.rank is None for r in got)


def test_crc_of_any_run():
    words = [w.encode() for w in "a bb cçc ddddddddddddddddddddd e".split()]
    ends, sizes = resample.running(b" ".join(words))
    arrays = np.array(ends, np.uint32), np.array(sizes), np.zeros(len(ends), np.int64)
    for n, (at, crc) in enumerate(resample.feature_crcs(*arrays, 5), 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in at]
    long = np.array([zlib.crc32(b"x")], np.uint32)
    assert resample.shift(long, np.array([100_003]))[0] ^ zlib.crc32(b"y" * 100_003) == zlib.crc32(b"x" + b"y" * 100_003)
