"""Corpus operators against brute force, and on nulls, empties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import collections
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quasi.llm import anchors, ann, common, langid, licences, mixing, phrases, pieces, simhash, suffix, topk, urlrules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, row int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gämma", "delta", "été", "zeta", "eta", "theta"]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = []
    for i in range(40):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30)))
        if i % 2:
            text += " " + passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 20)))
        rows.append([i, text, "en" if i % 3 else "fr", "hot" if i % 3 else None])
    rows[4][1], rows[5][1], rows[6][1], rows[7][1] = None, "", "  \n\t ", "### 123"
    rows[8][2], rows[9][0] = None, None
    rows.append([10, "x" * 50_000 + " " + passage, "en", "hot"])
    rows += [rows[11], rows[11], rows[1][:]]
    return spark.createDataFrame([(*r, 1, "i", 2, 3) for r in rows], SCHEMA)


def covered(sequences, n, keep_first):
    places = collections.defaultdict(list)
    for k, s in enumerate(sequences):
        for i in range(len(s) - n + 1):
            places[tuple(s[i : i + n])].append((k, i))
    out = [[False] * len(s) for s in sequences]
    for found in places.values():
        if len(found) > 1:
            for k, i in found[1:] if keep_first else found:
                out[k][i : i + n] = [True] * n
    return out


def in_order(docs):
    rows = docs.select("doc_id", "text").collect()
    return [rows[i] for i in sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, i))]


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeats_with_hot_groups(odd_docs, monkeypatch, keep_first):
    monkeypatch.setattr(anchors, "GROUP", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    docs = odd_docs.where("doc_id is null or doc_id <> 10")
    rows = in_order(docs)
    texts = [(r.text or "").encode() for r in rows]
    cover = covered(texts, 30, keep_first)
    want = collections.Counter((r.doc_id, sum(c), bytes(x for x, y in zip(t, c) if not y)) for r, t, c in zip(rows, texts, cover))
    got = suffix.remove_repeats(docs, length=30, keep_first=keep_first).collect()
    assert collections.Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == want
    words = [t.split() for t in texts]
    cover = covered(words, 9, keep_first)
    want = collections.Counter((r.doc_id, len(w), sum(c), b" ".join(x for x, y in zip(w, c) if not y)) for r, w, c in zip(rows, words, cover))
    got = phrases.remove_phrases(docs, window=9, keep_first=keep_first).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want


def test_groups_stay_whole_when_a_join_becomes_a_broadcast(spark):
    rnd = random.Random(11)

    def some(n):
        return " ".join(f"{rnd.randrange(10**5)}" for _ in range(n))

    passages = [some(130) for _ in range(12)]
    texts = [" ".join([some(70), passages[i % 12], some(70), passages[i * 7 % 12], some(rnd.randrange(80))]) for i in range(96)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    # Above what a group list takes when counted, below what it is guessed to take before.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "15k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = suffix.remove_repeats(docs, length=400, keep_first=False).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    texts = [t.encode() for t in texts]
    often = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {}
    for k, t in enumerate(texts):
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if often[t[i : i + 400]] > 1:
                cover[i : i + 400] = True
        want[k] = (int(cover.sum()), bytes(np.frombuffer(t, np.uint8)[~cover]))
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == want


def test_close_pairs_and_spanning():
    rng = np.random.default_rng(1)
    for lanes, radius in ((1, 4), (4, 50)):
        prints = rng.integers(0, 2**63, (700, lanes), dtype=np.uint64)
        for i in range(200):
            prints[i + 400] = prints[i % 40]
            for p in rng.integers(0, 64 * lanes, rng.integers(0, radius + 3)):
                prints[i + 400, p // 64] ^= np.uint64(1) << np.uint64(p % 64)
        apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
        want = {(i, j) for i, j in np.argwhere(apart <= radius).tolist() if i < j}
        assert {tuple(x) for c in simhash.close_pairs(prints, radius) for x in c.tolist()} == want
        cut = {tuple(x) for c in simhash.close_pairs(prints, radius, 431) for x in c.tolist()}
        assert cut == {(i, j) for i, j in want if i < 431 <= j}

        def roots(pairs):
            forest = common.Forest(700)
            for a, b in pairs:
                forest.join(a, b)
            return [forest.find(i) for i in range(700)]

        assert roots(simhash.spanning(prints, simhash.close_pairs(prints, radius)).tolist()) == roots(want)


def test_tables_meet_every_close_pair():
    rng = random.Random(2)
    for rows in (1_000, 10**6, 10**9):
        tables = simhash.exact_tables(64, 4, rows)
        for _ in range(200):
            flipped = set(rng.sample(range(64), 4))
            assert any(not flipped & set(t) for t in tables)


@pytest.mark.parametrize("block", [1024, 4])
def test_simhash_components(odd_docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "TILE_OVER", 2 * block)
    got = simhash.near_duplicates(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()

    def fingerprint(text):
        w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r.text) for r in rows]
    forest = common.Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.join(i, j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[forest.find(i)] = min(r.doc_id, least.get(forest.find(i), r.doc_id))
    want = collections.Counter((r.doc_id, format(p, "016x"), least.get(forest.find(i))) for i, (r, p) in enumerate(zip(rows, prints)))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_components_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES_PER_TASK", 7)
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_near_duplicates_of_one_id_and_of_none(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m n"), (None, "o p q r s t"), (None, "o p q r s t"), (3, "O P q r s t"), (None, "u")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == collections.Counter([(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "O P q r s t"), (None, "u")])


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeats_in_documents_longer_than_a_slice(spark, keep_first):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (600_000, 500)]
    texts[0] = texts[0][:400_000] + texts[0][1000:1100] + texts[0][400_000:]
    places = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - 29):
            places[t[i : i + 30]].append((k, i))
    cover = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        for k, i in (found[1:] if keep_first else found) if len(found) > 1 else []:
            cover[k][i : i + 30] = True
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = suffix.remove_repeats(docs, length=30, keep_first=keep_first).collect()
    want = {k: (int(c.sum()), bytes(np.frombuffer(t, np.uint8)[~c])) for k, (t, c) in enumerate(zip(texts, cover))}
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == want


def test_anchors_of_slices(monkeypatch):
    symbols = np.random.default_rng(3).integers(0, 4, 5000).astype(np.uint8)
    shape = anchors.Shape(30, 7)
    whole = [np.concatenate(x) for x in zip(*anchors.anchor_rows([(1, symbols), (2, symbols)], shape))]
    monkeypatch.setattr(anchors, "SLICE", 100)
    cut = [np.concatenate(x) for x in zip(*anchors.anchor_rows([(1, symbols), (2, symbols)], shape))]
    assert all((a == b).all() for a, b in zip(whole, cut))


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [rows[20]]
    rows += [(400, None), (420, [float("nan")] * 8), (440, [None] * 8), (460, []), (480, [1.0] * 3), (None, rows[0][1]), (500, [0.0] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_fewest_probes():
    ranks = np.arange(200)
    assert ann.fewest_probes(ranks, np.ones(200, bool), 1000) == (190, True)
    assert ann.fewest_probes(ranks, ranks < 150, 1000) == (190, False)
    assert ann.fewest_probes(ranks // 10, np.ones(200, bool), 1000) == (64, True)


def test_posting_lists_of_many_lists(spark):
    x = np.random.default_rng(9).normal(size=(8000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    scores = x[::100].astype(float) @ x.T.astype(float)
    scores[np.arange(80), np.arange(0, 8000, 100)] = -1
    want = {100 * i: set(np.argsort(-s)[:10].tolist()) for i, s in enumerate(scores)}
    hits = sum(r.vec_id in want[r.query_id] for r in ann.search(df, k=10, every=100, list_size=4).collect())
    assert hits >= 0.9 * 800


def test_exact_top_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rows, df = vectors(spark)
    good = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()}
    got = collections.defaultdict(list)
    for r in topk.search(df, k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = {q: [(n + 1, i, s) for n, (s, i) in enumerate(sorted(((-int(v @ good[q]), i) for i, v in good.items() if i != q))[:5])] for q in good if q % 20 == 0}
    assert {q: sorted(x) for q, x in got.items()} == {q: [(n, i, -s) for n, i, s in x] for q, x in want.items()}


def test_top_scores_beyond_longs(spark):
    """Large finite components take part; scores past a long count as its ends."""
    values = [[1e300, 1.0], [1e17, -1e300], [3.0, 1e17], [-2.0, 5.0], [1e9, 1e9], [1e9, 1e9 + 1], [0.5, 0.25]]
    df = spark.createDataFrame([(20 * i, v, "i", 1) for i, v in enumerate(values)], "vec_id long, embedding array<double>, id string, kind int")
    high = float(np.nextafter(2.0**63, 0))
    v = [[int(np.floor(min(max(64 * x, -(2.0**63)), high))) for x in row] for row in values]
    for rows in (range(7), range(3, 7)):
        got = collections.defaultdict(list)
        for r in topk.search(df.where(F.col("vec_id").isin([20 * i for i in rows])), k=4).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        for q in rows:
            scores = [(max(min(sum(a * b for a, b in zip(v[q], v[i])), 2**63 - 1), -(2**63) + 1), 20 * i) for i in rows if i != q]
            want = sorted(scores, key=lambda x: (-x[0], x[1]))[:4]
            assert sorted(got[20 * q]) == [(n + 1, i, s) for n, (s, i) in enumerate(want)]


def test_mixtures_that_cannot_be(spark, odd_docs):
    with pytest.raises(ValueError, match="more than 2"):
        mixing.plan(odd_docs, factor=3.0, repeat=2.0)
    with pytest.raises(ValueError, match="entropy"):
        mixing.plan(odd_docs, repeat=None, entropy=5.0)
    unnamed = spark.createDataFrame([(None, "a " * n, "s") for n in range(1, 40)], "doc_id long, text string, source string")
    rows = mixing.plan(unnamed, factor=0.5, repeat=2.0).collect()
    assert len({r.block for r in rows}) == 39 and sum(r.n_tokens * r.copies for r in rows) <= 39 * 40 // 4


def test_kneser_ney_against_a_dictionary():
    """The model's probabilities, recomputed from counts in plain dictionaries."""
    rnd = random.Random(11)
    marked = lambda w: langid.START * 3 + w + langid.END
    grams = {x: collections.Counter() for x in ("aa", "bb")}
    for lang, letters in (("aa", "abcde"), ("bb", "cdefg")):
        for _ in range(300):
            w = marked("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))))
            grams[lang].update(w[i : i + 4] for i in range(len(w) - 3))
    frame = pd.DataFrame([(x, g, n) for x, c in grams.items() for g, n in c.items()], columns=["lang", "gram", "n"])
    model = langid.fit(frame)
    alphabet = len({g[-1] for c in grams.values() for g in c}) + 1

    def table(counts):
        levels = {4: dict(counts)}
        for order in (3, 2, 1):
            levels[order] = collections.Counter(g[1:] for g in levels[order + 1])
        discount = {}
        for order, c in levels.items():
            once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            discount[order] = once / (once + 2 * twice) if once and twice else 0.5

        def prob(gram, order=4):
            if order == 0:
                return 1 / alphabet
            tail = gram[4 - order :]
            follow = {g: n for g, n in levels[order].items() if g[:-1] == tail[:-1]}
            if not follow:
                return prob(gram, order - 1)
            total = sum(follow.values())
            left = discount[order] * len(follow) / total
            return max(follow.get(tail, 0) - discount[order], 0) / total + left * prob(gram, order - 1)

        return prob

    wanted = [table(grams[x]) for x in model.languages]
    texts = [marked(w)[i : i + 4] for w in ("abc", "gfe", "zzz", "cdcdab", "q", "eeee") for i in range(len(w) + 1)]
    codes = np.array([[ord(c) for c in t] for t in texts])
    got = model.log_prob(codes.astype(np.uint32))
    for t, row in zip(texts, got):
        assert np.exp(row) == pytest.approx([w(t) for w in wanted])


def test_posting_lists(spark):
    rows, df = vectors(spark)
    good = {i: np.float32(v).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)}
    got = collections.defaultdict(list)
    for r in ann.search(df, k=5, list_size=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    queries = [q for q in good if q % 20 == 0]
    for q in queries:
        want = sorted((-float((v * good[q]).sum()), i) for i, v in good.items() if i != q)[:5]
        assert [n for n, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(abs(s - float((good[i] * good[q]).sum())) < 1e-12 for _, i, s in got[q])
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 5 * len(queries)


def test_pieces_equal_the_library(odd_docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(1)
    texts = ["", " ", " a  b   c ", "▁a ▁▁b", "\n x\ty\r\n", "日本語 𝔘 😀😀", "a\x00b", "<s> <0x41>", "x" * 3000, "ab" * 900 + " " * 300]
    texts += ["".join(rnd.choice("aeinrst  the\n.,éü漢01-") for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    coder = pieces.Encoder()
    flat, per = coder.encode(texts)
    at = np.concatenate([[0], np.cumsum(per)])
    for i, text in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == model.encode(text)
        assert coder.decode(ids) == model.decode(ids)
    coded = pieces.encode(odd_docs, carry=[F.col("text").alias("was")])
    for r in pieces.decode(coded, carry=[F.col("was")]).collect():
        assert r.decoded == r.was


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "http://com/x", "http://xnet/fr/", "http://b.net/fr/y", "http://b.net/frx", "http://net", "x://example.com#/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*urls, urls[4]])], "page_id int, url string, host string, rule string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/fr"), ("block", None, "/")]
    rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()}
    assert len(got) == 12 and got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4] == got[11] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[5][2:] == ("com/", "allow") and got[6][2:] == (None, "allow")
    assert got[7][2:] == got[8][2:] == ("net/fr", "block") and got[9][2] is None and got[10] == ("example.com", "", None, "allow")


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where("doc_id % 4 <> 0"), "doc_id", "text", "lang")
    got = langid.identify(docs.where("doc_id % 4 = 0"), model, "text", carry=[F.col("lang")]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert np.mean([r.rejected for r in got]) < 0.02
    odd = spark.createDataFrame([(None,), ("",), ("12 ##",), ("zxq" * 3000,)], "text string")
    got = langid.identify(odd, model, "text").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in got[:3])
    assert got[3].lang_pred in model.languages and got[3].rejected
    assert langid.train(docs.where("false"), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in langid.identify(odd, None, "text").collect()} == {"und"}


def test_mixture_keeps_budgets(odd_docs):
    rows = mixing.plan(odd_docs, repeat=1.5).collect()
    assert sum(r.rows for r in rows) == odd_docs.count()
    tokens, read = collections.Counter(), collections.Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens * r.rows
        read[r.source] += r.n_tokens * r.rows * r.copies
    for r in rows:
        assert read[r.source] <= r.budget <= 1.5 * tokens[r.source] + 1
    assert mixing.mix(odd_docs, repeat=1.5).count() == sum(r.rows * r.copies for r in rows)
    flat = mixing.plan(odd_docs, repeat=None, entropy=0.6).first()
    shares = np.array([w for w in {r.source: r.weight for r in mixing.plan(odd_docs, repeat=None, entropy=0.6).collect()}.values()])
    assert flat.exponent > 0 and abs(-(shares * np.log(shares)).sum() - 0.6) < 1e-6


def test_licences(spark):
    known = licences.known_texts(spark)
    full = [t for n, t in licences.LICENCES if n == "MIT"][0]
    texts = ["© 2020 A\nCopyright (c) 2021 Someone\n" + full.upper().replace(",", ";"), "x\nReleased  under the MIT Licence!\nLicensed under CC BY 4.0", None, "", full[:50]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.licence, r.notices, r.n_notices) for r in licences.scan(docs, known, carry=[F.col("doc_id")]).collect()}
    assert got == {0: ("MIT", None, 0), 1: (None, "CC-BY-4.0,MIT", 2), 2: (None, None, 0), 3: (None, None, 0), 4: (None, None, 0)}


def test_licences_of_whole_texts(spark):
    want = {}
    for at, path in enumerate(sorted(Path(licences.__file__).with_name("licence_files").glob("*.txt"))):
        text = path.read_text("utf-8")
        want |= {2 * at: (path.stem, text), 2 * at + 1: (path.stem, "Copyright 2020 Someone\n" + text.upper())}
    text = next(t for n, t in want.values() if n == "Apache-2.0")
    want[100] = ("Apache-2.0", text[: text.index("APPENDIX")].replace("http://", "https://"))
    want[101] = (None, text[:5000])
    docs = spark.createDataFrame([(i, t) for i, (_, t) in want.items()], "doc_id int, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_texts(spark), carry=[F.col("doc_id")]).collect()}
    assert got == {i: n for i, (n, _) in want.items()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(got.values())


def test_stages_on_odd_and_empty_tables(spark, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.collect()


def test_operators_on_empty_tables(spark, odd_docs):
    none = odd_docs.where("false")
    assert simhash.near_duplicates(none).collect() == [] and phrases.remove_phrases(none).collect() == []
    assert suffix.remove_repeats(none).collect() == [] and mixing.plan(none).collect() == []
    assert licences.scan(none, licences.known_texts(spark), carry=[F.col("doc_id")]).collect() == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty).collect() == [] and topk.search(empty).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge(pages, urlrules.rule_table(spark, [("allow", "com", "/")])).collect() == []
