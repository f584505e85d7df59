"""Removal of repeated substrings by suffix order.

Candidate passages come from ``anchors``. A task concatenates the passages of its groups in document order, each place
of a document once, and sorts their suffixes by the first ``length`` bytes, equal ones by place. The longest-previous-factor
array is read off the previous and next smaller places in that order. For the question whether it reaches ``length`` only
neighbours count: among equal prefixes the nearest smaller place is the suffix just before, the nearest larger the one just
after. A place with an equal predecessor is a later copy; one with an equal successor has a copy further on.

Null texts are empty; matches never cross documents; repeated ids are separate documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasi.llm.anchors import Shape, merged, repeated, with_spans
from quasi.llm.common import keyed

def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def byte_bodies(text: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip(starts, ends)]


def byte_part(start, length):
    return F.substring(F.col("body"), start + 1, length)


def prefix_order(keys: np.ndarray, length: int, depth: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first ``length`` symbols (ties by place), and the rank of each place by that prefix.

    ``keys`` order the places by their first ``depth`` symbols. Prefix doubling goes on from there; the last step joins two
    overlapping ranks, so the depth is exactly ``length``. What lies past the end sorts first.
    """
    n = len(keys)
    ranks = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
    while depth < length:
        step = min(depth, length - depth)
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = ranks[step:]
        ranks = np.unique(ranks * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    # Distinct keys need no stable sort.
    return np.argsort(ranks * n + np.arange(n)), ranks


def packed_order(text: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``prefix_order`` for bytes: places with fewer than ``length`` bytes before their segment's end (``stops``) are
    left out, all others are ranked by eight packed bytes first and then by doubling inside what can still match."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    packed = np.zeros(n, np.uint64)
    for i in range(8):
        packed = packed << np.uint64(8) | wide[i : i + n]
    depth = 8
    ranks = np.unique(packed, return_inverse=True)[1].astype(np.int64) + 1
    while depth < length:
        step = min(depth, length - depth)
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = ranks[step:]
        ranks = np.unique(ranks * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    places = np.flatnonzero(np.arange(n) + length <= stops)
    return places[np.argsort(ranks[places], kind="stable")], ranks


def char_starts(text: bytes, at: np.ndarray, step: int) -> np.ndarray:
    """Places moved by ``step`` as long as they are inside a UTF-8 character."""
    data = np.append(np.frombuffer(text, np.uint8), np.uint8(0))
    at = at.copy()
    while (inside := data[at] & 0xC0 == 0x80).any():
        at[inside] += step
    return at


def compare_with(length: int):
    def compare(bundle, keep_first: bool):
        """Exact spans of the windows that repeat inside a bundle of contexts (key, start, bytes)."""
        bundle.sort(key=lambda x: (x[0], x[1]))
        segments: list[list] = []
        for key, start, text in bundle:
            if segments and segments[-1][0] == key and start <= segments[-1][1] + len(segments[-1][2]):
                have = segments[-1][1] + len(segments[-1][2]) - start
                if have < len(text):
                    segments[-1][2] += text[have:]
            else:
                segments.append([key, start, bytearray(text)])
        sizes = np.array([len(s[2]) for s in segments])
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
        stops = np.repeat(begins + sizes, sizes)
        if length >= 8:
            order, ranks = packed_order(text, stops, length)
        else:
            order, ranks = prefix_order(text.astype(np.int64), length)
            order = order[order + length <= stops[order]]
        like = ranks[order[1:]] == ranks[order[:-1]]
        hit = np.zeros(len(order), bool)
        hit[1:] |= like
        if not keep_first:
            hit[:-1] |= like
        places = np.sort(order[hit])
        segment = np.searchsorted(begins, places, side="right") - 1
        # Runs of neighbouring starts become one span.
        new = np.ones(len(places), bool)
        new[1:] = (np.diff(places) > 1) | (np.diff(segment) > 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(places) - 1)[: len(first)]
        keys, starts = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
        shift = starts[segment[first]] - begins[segment[first]]
        return keys[segment[first]], places[first] + shift, places[last] + shift + length

    return compare


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_first: bool = True,
    gram: int | None = None, whole_chars: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: id, ``carry`` columns, ``was_null`` (the text), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (remaining bytes).

    Removed is every byte covered by a ``length``-byte string that also starts earlier (smaller id, or earlier in the
    document); with ``keep_first=False`` one that also starts anywhere else. Overlaps count, and strings are judged
    on the input. With ``whole_chars`` a character goes whole if one of its bytes goes, so that what is kept is UTF-8.
    """
    rows = keyed(docs, id_col, text_col, carry)
    shape = Shape(length, gram or max(1, length // 4))
    spans = repeated(rows, shape, byte_symbols, byte_bodies, byte_part, compare_with(length), keep_first, "suffix")

    def task(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, a = batch.column(1)[i].as_py(), batch.column(2)[i]
                if a.as_py() is None:
                    out.append((len(text), 0, 0, text))
                    continue
                a, b = a.values.to_numpy(), batch.column(3)[i].values.to_numpy()
                if whole_chars:
                    a, b = char_starts(text, a, -1), char_starts(text, b, 1)
                a, b = merged(a, b)
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(a), kept))
            n, removed, runs, kept = zip(*out) if out else ((), (), (), ())
            counts = [pa.array(x, pa.int64()) for x in (n, removed, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), *counts, pa.array(kept, pa.binary())],
                ["id", "carry", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = with_spans(rows, spans).select("id", "text", "a", "b", "carry")
    schema = out.select("id", "carry").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    out = out.mapInArrow(task, schema.add("kept", "binary"))
    return out.select(F.col("id").alias(id_col), "carry.*", "n_bytes", "n_removed", "n_spans", "kept")
