"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is cut where no piece can cross: before every run of spaces. Units not met before are joined to one text and
indexed by a suffix array; two binary searches per piece of the vocabulary give the range of all its occurrences. The
resulting edges are sorted by the position where they end and relaxed in that order: each position gets the one last piece
whose predecessor, the last piece at the edge's start, it can follow. For a model of merges a piece can follow another
exactly if merging the text of both gives the two back, and a text whose neighbouring pieces all can follow each other is
the model's own encoding, so the result equals that of the model's merges. Units with a run of spaces are merged directly,
as the pieces of spaces tie in score.

The model file (piece_bpe_32k.model or another with merges, byte fallback, identity normaliser and dummy prefix) is read from
``path``; it is never copied. Characters outside the vocabulary become bytes. Null texts have null ids, empty texts none.
Decoding gives the text back, except that U+2581 comes back as a space, as the model defines it.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quasi.llm.anchors import mix
from quasi.llm.common import release, text_runs
from quasi.llm.suffix import prefix_order

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(" +[^ ]*|[^ ]+")
NEW_CHARS = 250_000
CACHE_UNITS = 120_000
LONG_UNIT = 64
BATCH_CHARS = 1 << 20
KEPT_PAIRS = 1 << 20
KEPT_CHARACTERS = 1 << 16
PACK = 3
NORMAL, CONTROL, UNKNOWN, BYTE = 1, 3, 2, 6


class Vocabulary:
    """Pieces of a model and what can follow what. Characters without a piece get numbers after the pieces."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("the model must have an identity normaliser, a dummy prefix and byte fallback")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        self.plain: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.plain.append(bytes([value]))
            elif p.type == NORMAL:
                self.plain.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.plain.append(b"" if p.type == CONTROL else " ⁇ ".encode())
        self.longest = max(map(len, self.ids))
        self.strings = list(self.pieces)
        self.others: dict[str, int] = {}
        # Pieces that their own text gives back; the others never occur.
        self.real = sorted(p for p in self.ids if len(p) == 1 or self.merge(p) == [p])
        self.real_ids = np.array([self.ids[p] for p in self.real], np.int64)
        self.real_sizes = np.array([len(p) for p in self.real], np.int64)
        # Characters of pieces are numbered from one in code order, all others are zero; PACK of them fit a word.
        alphabet = sorted(set("".join(self.real)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet).bit_length()
        padded = np.array([[ord(c) for c in p.ljust(self.longest + PACK, "\0")] for p in self.real])
        self.words = self.pack(self.letter[padded].astype(np.int64))
        self._table(1 << 18)

    def pack(self, numbers: np.ndarray) -> np.ndarray:
        """Words of PACK letters each, along the last axis."""
        n = numbers.shape[-1] // PACK
        parts = numbers[..., : n * PACK].reshape(*numbers.shape[:-1], n, PACK)
        out = np.zeros(parts.shape[:-1], np.int64)
        for i in range(PACK):
            out = out << self.width | parts[..., i]
        return out

    def merge(self, text: str) -> list[str]:
        """Best-scored neighbours first, leftmost among equals."""
        parts, scores = list(text), self.scores
        if len(parts) > LONG_UNIT:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        import heapq

        n, scores = len(parts), self.scores
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int):
            if right[i] < n:
                both = parts[i] + parts[right[i]]
                s = scores.get(both)
                if s is not None:
                    heapq.heappush(heap, (-s, i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p]

    def number(self, char: str) -> int:
        """The piece of one character, or its number after the pieces."""
        found = self.ids.get(char)
        if found is None:
            found = self.others.get(char)
            if found is None:
                found = self.others[char] = len(self.strings)
                self.strings.append(char)
        return found

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of the characters of a text."""
        met = np.zeros(len(self.letter), bool)
        met[codes] = True
        found = np.zeros(len(self.letter), np.int32)
        letters = np.flatnonzero(met)
        found[letters] = [self.number(chr(c)) for c in letters.tolist()]
        return found[codes]

    def can_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces can follow others; answers are kept in an open-addressing table."""
        keys = before << 32 | piece
        at = self._slots(keys)
        new = np.unique(keys[self.pair_keys[at] < 0])
        if len(new):
            if 2 * (self.pairs + len(new)) > len(self.pair_keys):
                old = np.flatnonzero(self.pair_keys >= 0)
                known, fits = self.pair_keys[old], self.pair_fits[old]
                self._table(4 * (self.pairs + len(new)))
                self._put(known, fits)
            fits = np.empty(len(new), bool)
            for n, key in enumerate(new.tolist()):
                a, b = self.strings[key >> 32], self.strings[key & 0xFFFFFFFF]
                fits[n] = self.merge(a + b) == [a, b]
            self._put(new, fits)
            at = self._slots(keys)
        return self.pair_fits[at]

    def _table(self, size: int):
        size = 1 << size.bit_length()
        self.pair_keys, self.pair_fits, self.pairs = np.full(size, -1, np.int64), np.zeros(size, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where the search for it ends."""
        mask = len(self.pair_keys) - 1
        at = (mix(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
        todo = np.flatnonzero((self.pair_keys[at] != keys) & (self.pair_keys[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.pair_keys[at[todo]]
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return at

    def _put(self, keys: np.ndarray, fits: np.ndarray):
        """Add keys that are not in the table; of those that meet in one slot one is put down a round."""
        self.pairs += len(keys)
        while len(keys):
            at = self._slots(keys)
            _, first = np.unique(at, return_index=True)
            self.pair_keys[at[first]], self.pair_fits[at[first]] = keys[first], fits[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, fits = keys[left], fits[left]


def piece_edges(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of all pieces in a text (zeros separate units): starts, ends, pieces.

    The range of a piece in suffix order is narrowed word by word: inside the suffixes that share the words so far, the
    next word is searched from both sides, with free letters lowest and highest.
    """
    v = vocabulary
    letters = v.letter[codes].astype(np.int64)
    padded = np.concatenate([letters, np.zeros(v.longest + PACK, np.int64)])
    four = np.zeros(len(letters), np.int64)
    for i in range(4):
        four = four << v.width | padded[i : i + len(letters)]
    order, _ = prefix_order(four, v.longest, 4)
    low, high = np.zeros(len(v.real), np.int64), np.full(len(v.real), len(order))
    ranks = np.zeros(len(order), np.int64)
    for step in range(-(-v.longest // PACK)):
        word = np.zeros(len(order), np.int64)
        for i in range(PACK):
            word = word << v.width | padded[order + step * PACK + i]
        keys = ranks << PACK * v.width | word
        here = np.flatnonzero((v.real_sizes > step * PACK) & (low < high))
        prefix = ranks[low[here]] << PACK * v.width
        free = np.maximum(0, (step + 1) * PACK - v.real_sizes[here]) * v.width
        least = prefix | v.words[here, step]
        low[here] = np.searchsorted(keys, least)
        high[here] = np.searchsorted(keys, least | (1 << free) - 1, side="right")
        ranks = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
    counts = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), counts)
    at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts - low, counts)
    starts = order[at]
    return starts, starts + v.real_sizes[which], v.real_ids[which]


def relax(vocabulary: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all units one after another, and how many each unit has."""
    text = "\0".join(units) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    sizes = np.array([len(u) for u in units])
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    starts, stops, pieces = piece_edges(vocabulary, np.where(inner, codes, 0))
    # Characters without a piece are edges of their own.
    numbers = vocabulary.numbers(codes)
    lone = np.flatnonzero(inner & (numbers >= len(vocabulary.pieces)))
    starts, stops, pieces = (np.concatenate(x) for x in ((starts, lone), (stops, lone + 1), (pieces, numbers[lone])))
    offset = stops - np.repeat(begins, sizes + 1)[starts]
    order = np.argsort(offset.astype(np.uint16) if sizes.max() < 1 << 16 else offset, kind="stable")
    starts, stops, pieces, offset = starts[order], stops[order], pieces[order], offset[order]
    last = np.full(len(codes) + 1, -1, np.int64)
    at_begin = np.zeros(len(codes) + 1, bool)
    at_begin[begins] = True
    cuts = np.flatnonzero(np.diff(offset, prepend=0, append=offset[-1] + 1 if len(offset) else 1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        s, e, p = starts[lo:hi], stops[lo:hi], pieces[lo:hi]
        fits = at_begin[s]
        rest = np.flatnonzero(~fits & (last[s] >= 0))
        fits[rest] = vocabulary.can_follow(last[s[rest]], p[rest])
        last[e[fits]] = p[fits]
    lengths = np.array([len(x) for x in vocabulary.strings])
    on_path = np.zeros(len(codes) + 1, bool)
    cur, floor = ends.copy(), begins
    live = sizes > 0
    cur, floor = cur[live], floor[live]
    while len(cur):
        on_path[cur] = True
        cur = cur - lengths[last[cur]]
        live = cur > floor
        cur, floor = cur[live], floor[live]
    at = np.flatnonzero(on_path)
    return last[at], np.bincount(np.searchsorted(ends, at), minlength=len(units))


class Encoder:
    """Encodes texts; remembers the tokens of units met before."""

    def __init__(self, path: str = MODEL):
        self.vocabulary = Vocabulary(path)
        self._clear()

    def _clear(self):
        self.places: dict[str, int] = {}
        self.tokens, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def rest(self):
        """Forget units, and what else has grown past its bound: the worker lives on."""
        self._clear()
        v = self.vocabulary
        if v.pairs > KEPT_PAIRS or len(v.others) > KEPT_CHARACTERS:
            v.others.clear()
            del v.strings[len(v.pieces) :]
            v._table(1 << 18)

    def _as_bytes(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers with characters outside the vocabulary written as bytes."""
        v = self.vocabulary
        other = np.flatnonzero(numbers >= len(v.pieces))
        if not len(other):
            return numbers.astype(np.int32), counts
        encoded = [v.strings[i].encode("utf-8", "surrogatepass") for i in numbers[other].tolist()]
        width = np.ones(len(numbers), np.int64)
        width[other] = [len(b) for b in encoded]
        out = np.repeat(numbers, width).astype(np.int32)
        first = np.cumsum(width) - width
        flat = np.frombuffer(b"".join(encoded), np.uint8)
        place = np.repeat(first[other], width[other]) + np.arange(len(flat)) - np.repeat(np.cumsum(width[other]) - width[other], width[other])
        out[place] = v.byte_ids[flat]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, width, len(counts)).astype(np.int64)

    def _learn(self, units: list[str]):
        """Tokens of units, each given without its first space."""
        v = self.vocabulary
        for at, end in _by_size(units, NEW_CHARS):
            part = units[at:end]
            # Spaces stand before the rest of a unit only.
            spaced = [u for u in part if u[:1] == " "]
            plain = [u for u in part if u[:1] != " "] if spaced else part
            numbers, counts = relax(v, [SPACE + u for u in plain]) if plain else (np.empty(0, np.int64), np.empty(0, np.int64))
            if spaced:
                found = [[v.number(p) for p in v.merge(SPACE + u.replace(" ", SPACE))] for u in spaced]
                numbers = np.concatenate([numbers, *(np.array(f, np.int64) for f in found)])
                counts = np.concatenate([counts, [len(f) for f in found]]).astype(np.int64)
            tokens, counts = self._as_bytes(numbers, counts)
            start = len(self.counts)
            self.places.update(zip(chain(plain, spaced), range(start, start + len(part))))
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.tokens = np.concatenate([self.tokens, tokens])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        cut = []
        for text in texts:
            # Units without their first space, the dummy one for the first.
            text = text.replace(SPACE, " ")
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                cut.append([u[1:] for u in UNIT.findall(" " + text)])
            else:
                cut.append(text.split(" ") if text else [])
        places = self.places
        new = list({u for units in cut for u in units if u not in places})
        if new:
            if len(places) + len(new) > CACHE_UNITS:
                self._clear()
                places = self.places
                new = list({u for units in cut for u in units})
            self._learn(new)
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        counts = self.counts[at]
        flat = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        per = np.bincount(np.repeat(np.arange(len(cut)), [len(u) for u in cut]), counts, len(cut)).astype(np.int64)
        return self.tokens[flat], per

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy space goes, and bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.vocabulary.plain.__getitem__, ids))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def _by_size(items: list[str], most: int):
    start, size = 0, 0
    for i, x in enumerate(items):
        size += len(x)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(items):
        yield start, len(items)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, text_col: str = "text", carry: list[Column] = (), path: str = MODEL) -> DataFrame:
    """Columns ``carry`` with ``ids`` (array of int) of whole texts."""
    narrow = docs.select(*carry, F.col(text_col).alias("__text"))
    names = narrow.columns[:-1]
    schema = narrow.drop("__text").schema.add("ids", ArrayType(IntegerType()))

    def task(batches):
        coder = encoder(path)
        for batch in batches:
            for a, texts in text_runs(batch.column(len(names)), BATCH_CHARS):
                flat, per = coder.encode([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                null = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=null)
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), ids], [*names, "ids"])
        coder.rest()
        release()

    return narrow.mapInArrow(task, schema)


def decode(rows: DataFrame, ids_col: str = "ids", carry: list[Column] = (), path: str = MODEL) -> DataFrame:
    """Columns ``carry`` with ``decoded``, the text of ids."""
    narrow = rows.select(*carry, F.col(ids_col).alias("__ids"))
    names = narrow.columns[:-1]
    schema = narrow.drop("__ids").schema.add("decoded", "string")

    def task(batches):
        coder = encoder(path)
        for batch in batches:
            ids = batch.column(len(names))
            known, offsets, flat = ids.is_valid().to_pylist(), ids.offsets.to_numpy(), ids.values.to_numpy()
            spans = zip(known, offsets[:-1].tolist(), offsets[1:].tolist())
            out = [coder.decode(flat[a:b].tolist()) if some else None for some, a, b in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.string())], [*names, "decoded"])

    return narrow.mapInArrow(task, schema)
