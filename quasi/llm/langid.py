"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order ORDER inside words (a word ends with an end mark and starts in marked
context). Highest-order counts are frequencies, lower orders count distinct left neighbours; every order discounts its
counts by one estimated amount and passes the rest on to the next, down to a uniform base. All languages share sorted
hash arrays per order, with one column per language, which tasks search for the n-grams of words they have not met.

A text's measure is its cross-entropy per predicted character; the lowest wins. Rejection is calibrated on a fifth of the
sample that is kept out of the counts: a text is rejected if its excess over the language's mean, widened for short texts,
is above ``margin`` times what all but one in a thousand of those show, and above LEAST_EXCESS nats per character in any
case (few documents say little about the tail). A language without any rejects nothing.

The classifier is fitted on a bounded sample of the labelled documents (whole texts): about ``sample`` documents in all,
shared evenly among languages and chosen by a hash of the id (of the text, without an id), at least LEAST_DOCS for each
language. Rows that repeat an id with its text and language count once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasi.llm.common import release, text_runs

ORDER = 4
SAMPLE = 6000
LEAST_DOCS = 50
START, END = "\x02", "\x03"
OTHER = re.compile(r"[\W\d_]+")
CACHE_TOKENS = 120_000
RUN_BYTES = 1 << 20
LONG_TOKEN = 48
SHORT_TEXT = 60.0
CONFIDENT = 40.0
LEAST_EXCESS = 1.4
UNKNOWN = "und"


def letters(token: str) -> str:
    """The lower-cased letters of a token."""
    if not token.isalpha():
        token = OTHER.sub("", token)
        if not token.isalpha():
            token = "".join(c for c in token if c.isalpha())
    return token.lower()


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash rows of code points."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for i in range(codes.shape[1]):
        out = (out ^ codes[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all ORDER-grams of marked words, and how many each word has."""
    joined = "".join(START * (ORDER - 1) + w + END for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes + ORDER - 1)
    at = np.repeat(ends - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.stack([codes[at - (ORDER - 1) + i] for i in range(ORDER)], axis=1), sizes


@dataclass
class Model:
    languages: list[str]
    #: per order 1..ORDER: sorted hashes and log probabilities (not seen: nan)
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: per order 2..ORDER: sorted hashes of contexts and log weights of the lower order (not seen: 0)
    contexts: list[tuple[np.ndarray, np.ndarray]]
    base: float
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character of each ORDER-gram, by language."""
        _, first, which = np.unique(gram_hash(codes), return_index=True, return_inverse=True)
        return self._search(codes[first])[which]

    def _search(self, codes: np.ndarray) -> np.ndarray:
        out = np.full((len(codes), len(self.languages)), self.base)
        for order in range(1, ORDER + 1):
            if order > 1:
                out += _look_up(*self.contexts[order - 2], gram_hash(codes[:, ORDER - order : -1]), 0.0)
            seen = _look_up(*self.grams[order - 1], gram_hash(codes[:, ORDER - order :]), np.nan)
            out = np.where(np.isnan(seen), out, seen)
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, hashes: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(hashes), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], values[at], missing)


def _fit_language(grams: np.ndarray, counts: np.ndarray, alphabet: int):
    """Interpolated Kneser-Ney for one language: per order (hashes, log prob), per context (hashes, log weight)."""
    levels = [(grams, counts.astype(float))]
    for _ in range(ORDER - 1):
        suffixes = levels[-1][0][:, 1:]
        unique, n = np.unique(suffixes, axis=0, return_counts=True)
        levels.append((unique, n.astype(float)))
    levels.reverse()
    probs, weights = [], []
    lower_hash, lower_prob = None, None
    for codes, n in levels:
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = gram_hash(codes[:, :-1])
        keys, which = np.unique(context, return_inverse=True)
        total = np.bincount(which, n)
        left = discount * np.bincount(which) / total
        if lower_hash is None:
            below = np.full(len(codes), 1.0 / alphabet)
        else:
            below = lower_prob[np.searchsorted(lower_hash, gram_hash(codes[:, 1:]))]
        p = np.maximum(n - discount, 0) / total[which] + left[which] * below
        hashes = gram_hash(codes)
        order = np.argsort(hashes)
        lower_hash, lower_prob = hashes[order], p[order]
        probs.append((lower_hash, np.log(lower_prob)))
        weights.append((keys, np.log(left)))
    return probs, weights[1:], weights[0][1][0] - np.log(alphabet)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), missing, np.float64)
    for i, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def fit(counts: pd.DataFrame) -> Model | None:
    """A model from (lang, gram, n), grams of ORDER characters."""
    if not len(counts):
        return None
    languages = sorted(counts["lang"].unique())
    codes = np.frombuffer("".join(counts["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    alphabet = len(np.unique(codes[:, -1])) + 1
    n, lang = counts["n"].to_numpy(), counts["lang"].to_numpy()
    fitted = [_fit_language(codes[lang == x], n[lang == x], alphabet) for x in languages]
    grams = [_merge([f[0][o] for f in fitted], np.nan) for o in range(ORDER)]
    contexts = [_merge([f[1][o] for f in fitted], 0.0) for o in range(ORDER - 1)]
    return Model(languages, grams, contexts, np.array([f[2] for f in fitted]))


class Scorer:
    """Scores texts; remembers the sums of tokens met before."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self):
        self.places: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1))

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """Log probability by language and number of predictions of each token."""
        words = [letters(t) for t in tokens]
        out = np.zeros((len(words), len(self.model.languages) + 1))
        some = [i for i, w in enumerate(words) if w]
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            codes, sizes = word_grams([words[i] for i in part])
            for lo in range(0, len(codes), 1 << 17):  # a token may be as long as a text
                hi = lo + (1 << 17)
                owner = np.repeat(np.arange(len(part)), sizes)[lo:hi]
                values = self.model.log_prob(codes[lo:hi])
                for j in range(values.shape[1]):
                    out[part, j] += np.bincount(owner, values[:, j], len(part))
            out[part, -1] = sizes
        return out

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy by language, and number of predictions (0: no letter)."""
        if len(self.places) > CACHE_TOKENS:
            self._clear()
        rows, totals = [], np.zeros((len(texts), len(self.model.languages) + 1))
        for i, text in enumerate(texts):
            tokens = text.split()
            if len(text) > LONG_TOKEN and max(map(len, tokens), default=0) > LONG_TOKEN:
                long = [t for t in tokens if len(t) > LONG_TOKEN]
                totals[i] += self._learn(long).sum(axis=0)
                tokens = [t for t in tokens if len(t) <= LONG_TOKEN]
            rows.append(tokens)
        places = self.places
        new = list({t for tokens in rows for t in tokens if t not in places})
        if new:
            start = len(places)
            places.update(zip(new, range(start, start + len(new))))
            if len(places) > len(self.sums):
                grown = np.zeros((2 * len(places), self.sums.shape[1]))
                grown[: len(self.sums)] = self.sums
                self.sums = grown
            self.sums[start : start + len(new)] = self._learn(new)
        for i, tokens in enumerate(rows):
            for at in range(0, len(tokens), 1 << 16):
                part = tokens[at : at + (1 << 16)]
                totals[i] += self.sums[np.fromiter(map(places.__getitem__, part), np.int64, len(part))].sum(axis=0)
        n = totals[:, -1]
        return -totals[:, :-1] / np.maximum(n, 1)[:, None], n


def _excess(entropy: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (entropy - mean) * np.sqrt(n / (n + SHORT_TEXT))


def _batches(texts: list, most: int = RUN_BYTES):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE, margin: float = 2.5) -> Model | None:
    """Fit on a sample of documents with a language and a text (see the module's head). None without any."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = max(LEAST_DOCS, sample // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, each / n))) for x, n in sorted(sizes.items())])
    # A null id would choose all its rows or none; those go by their text. Repeated rows count once.
    key = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text"))
    chosen = rows.where(F.pmod(key, F.lit(1_000_000)) < share * 1_000_000)
    chosen = chosen.withColumn("digest", F.xxhash64("text")).dropDuplicates(["id", "digest", "lang"]).drop("digest")
    other = F.when(F.col("id").isNotNull(), F.xxhash64("id", F.lit("calibration"))).otherwise(F.xxhash64("text", F.lit("calibration")))
    apart = F.pmod(other, F.lit(5)) == 0

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                words: Counter = Counter()
                for text in part["text"]:
                    words.update(text.split())
                found: Counter = Counter()
                for token, n in words.items():
                    if w := letters(token):
                        marked = START * (ORDER - 1) + w + END
                        for i in range(len(w) + 1):
                            found[marked[i : i + ORDER]] += n
                if found:
                    yield pd.DataFrame({"lang": [lang] * len(found), "gram": list(found), "n": list(found.values())})

    counts = chosen.where(~apart).select("text", "lang").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = fit(counts.orderBy("lang", "gram").toPandas())
    if model is None:
        return None
    shared = spark.sparkContext.broadcast(model)
    known = {x: i for i, x in enumerate(model.languages)}

    def measure(batches):
        scorer = Scorer(shared.value)
        for pdf in batches:
            pdf = pdf[pdf["lang"].isin(list(known))]
            texts = pdf["text"].tolist()
            for a, b in _batches(texts):
                entropy, n = scorer.measure(texts[a:b])
                own = pdf["lang"].iloc[a:b].map(known).to_numpy()
                yield pd.DataFrame({"lang": own, "entropy": entropy[np.arange(b - a), own], "n": n})

    seen = chosen.where(apart).select("text", "lang").mapInPandas(measure, "lang int, entropy double, n double").where("n > 0").toPandas()
    width = len(model.languages)
    model.mean, model.limit = np.zeros(width), np.full(width, np.inf)
    for i, part in seen.groupby("lang"):
        h, n = part["entropy"].to_numpy(), part["n"].to_numpy()
        model.mean[i] = np.average(h, weights=n)
        model.limit[i] = max(margin * np.quantile(_excess(h, model.mean[i], n), 0.999), LEAST_EXCESS)
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str, carry: list[Column] = ()) -> DataFrame:
    """Columns ``carry`` with ``lang_pred``, ``score`` (0 to 1), ``entropy`` and ``rejected``.

    A null text, one without a letter, or any text without a model: ``und``, score 0, rejected. Otherwise the language of
    the lowest cross-entropy (ties: the first by name); the score is its share of exp(-n * entropy) with n at most CONFIDENT.
    """
    narrow = docs.select(*carry, F.col(text_col).alias("__text"))
    names = narrow.columns[:-1]
    added = {"lang_pred": "string", "score": "double", "entropy": "double", "rejected": "boolean"}
    schema = narrow.drop("__text").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            for a, texts in text_runs(batch.column(len(names)), RUN_BYTES):
                texts = [t or "" for t in texts]
                b = a + len(texts)
                pred, score, low, no = [UNKNOWN] * (b - a), np.zeros(b - a), np.full(b - a, np.nan), np.ones(b - a, bool)
                if scorer:
                    m = scorer.model
                    entropy, n = scorer.measure(texts)
                    best = entropy.argmin(axis=1)
                    row = np.arange(b - a)
                    ahead = np.exp((entropy[row, best][:, None] - entropy) * np.minimum(n, CONFIDENT)[:, None])
                    some = n > 0
                    pred = [m.languages[k] if s else UNKNOWN for k, s in zip(best, some)]
                    score = np.where(some, 1 / ahead.sum(axis=1), 0.0)
                    low = np.where(some, entropy[row, best], np.nan)
                    no = ~some | (_excess(low, m.mean[best], n) > m.limit[best])
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(len(names))]
                columns += [pa.array(pred, pa.string()), pa.array(score), pa.array(low), pa.array(no)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])
        scorer = None
        release()

    return narrow.mapInArrow(task, schema)
