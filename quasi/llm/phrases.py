"""Removal of repeated word windows with sharded Aho-Corasick automata.

Candidate windows come from ``anchors`` over word hashes, so every window that recurs meets all its copies in one shard.
A shard confirms which word sequences recur, compiles them into an automaton over word numbers and streams all
passages of its documents through it, which gives each occurrence of each sequence. Shards are bundles of bounded size.

Words are what stands between ASCII white space. Null texts have no words; repeated ids are separate documents.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.llm.anchors import Rolling, Shape, merged, mix, repeated, with_spans
from quasi.llm.common import keyed

SEED = 7


def word_symbols(text: bytes) -> np.ndarray:
    words = text.split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))


def word_bodies(text: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in zip(starts, ends)]


def word_part(start, length):
    return F.slice(F.split(F.col("body").cast("string"), " "), start + 1, length)


def recurring(numbers: np.ndarray, places: np.ndarray, window: int) -> ahocorasick.Automaton | None:
    """Automaton of the sequences at ``places`` that occur at two or more of them, by their hash."""
    hashes = Rolling(mix(numbers.astype(np.uint64) + np.uint64(1))).of(places, places + window)
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    places = places[counts[which] > 1]
    if not len(places):
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for at in places.tolist():
        sequence = tuple(numbers[at : at + window].tolist())
        if sequence not in automaton:
            automaton.add_word(sequence, len(automaton))
    automaton.make_automaton()
    return automaton


def compare_with(window: int):
    def compare(bundle, keep_first: bool):
        """Exact spans of the windows that repeat inside a bundle of contexts (key, first word, text)."""
        bundle.sort(key=lambda x: (x[0], x[1]))
        segments: list[list] = []
        for key, start, text in bundle:
            words = text.split()
            if segments and segments[-1][0] == key and start <= segments[-1][1] + len(segments[-1][2]):
                segments[-1][2] += words[segments[-1][1] + len(segments[-1][2]) - start :]
            else:
                segments.append([key, start, words])
        vocabulary: dict[bytes, int] = {}
        number = vocabulary.setdefault
        numbers = np.array([number(w, len(vocabulary)) for s in segments for w in s[2]], np.int64)
        sizes = np.array([len(s[2]) for s in segments])
        begins = np.cumsum(sizes) - sizes
        stops = np.repeat(begins + sizes, sizes)
        places = np.flatnonzero(np.arange(len(numbers)) + window <= stops)
        automaton = recurring(numbers, places, window)
        if automaton is None:
            return [], [], []
        at, which = [], []
        for begin, size in zip(begins.tolist(), sizes.tolist()):
            if size >= window:
                for end, pattern in automaton.iter(tuple(numbers[begin : begin + size].tolist())):
                    at.append(begin + end + 1 - window)
                    which.append(pattern)
        at, which = np.array(at, np.int64), np.array(which, np.int64)
        order = np.lexsort((at, which))
        at, which = at[order], which[order]
        like = which[1:] == which[:-1]
        hit = np.zeros(len(at), bool)
        hit[1:] |= like
        if not keep_first:
            hit[:-1] |= like
        at = at[hit]
        segment = np.searchsorted(begins, at, side="right") - 1
        first = np.array([s[1] for s in segments])[segment] + at - begins[segment]
        return np.array([s[0] for s in segments])[segment], first, first + window

    return compare


def remove_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep_first: bool = True,
    gram: int | None = None,
) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed`` and ``kept`` (remaining words joined by one space, as bytes).

    Removed is every word covered by a window of ``window`` words whose sequence also starts earlier (smaller id, or
    earlier in the document); with ``keep_first=False`` one that also starts anywhere else. Windows are judged on
    the input.
    """
    rows = keyed(docs, id_col, text_col)
    shape = Shape(window, gram or max(1, window // 3))
    spans = repeated(rows, shape, word_symbols, word_bodies, word_part, compare_with(window), keep_first, "phrases")

    def task(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words, a = batch.column(1)[i].as_py().split(), batch.column(2)[i]
                n = len(words)
                if a.as_py() is not None:
                    a, b = merged(a.values.to_numpy(), batch.column(3)[i].values.to_numpy())
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), n]
                    words = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
                out.append((n, n - len(words), b" ".join(words)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])

    out = with_spans(rows, spans).select("id", "text", "a", "b")
    return out.mapInArrow(task, "id long, n_words long, n_removed long, kept binary").withColumnRenamed("id", id_col)
