"""Byte-level BPE encoding and decoding through a pair occurrence index.

The distinct words of a run of rows are laid out as one array of symbols with links to the next and
the previous symbol. An index maps every mergeable pair to all positions where it occurs. Active
ranks are taken in ascending order; all occurrences of a rank's pair are merged together, and only
the pairs beside them are looked up again and added to the lists of their ranks. Rows then take
their ids from the words. No row, word or vocabulary entry passes through the driver.

Nulls and empty texts give no ids and decode to an empty text; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skylattice.llm.flattext import offsets_of, ragged, strings_of
from skylattice.session import ship_package

#: The pattern that cuts a text into words before any merge.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that one indexing round takes, and distinct words kept between rounds of a task.
ROUND_CHARS = 24 << 20
KEPT_WORDS = 400_000
#: Rows and characters of one output batch.
OUT_ROWS, OUT_CHARS = 4_000, 4 << 20


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = np.array([vocab[letter] for letter in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        keys = self.left.astype(np.int64) * size + self.right
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.zeros(0, bool)
        self._keys, self._ranks = keys[order][first], order[first].astype(np.int32)
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.token_offsets = offsets_of(np.array([len(s) for s in strings], np.int64))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where the pair never merges."""
        if not len(self._keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.int32(-1))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and n + 1 offsets."""
        ends = offsets_of(np.array([len(w) for w in words], np.int64))
        n = int(ends[-1])
        symbols = np.empty(n + 1, np.int32)
        symbols[:n] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        symbols[n] = -1
        following = np.arange(1, n + 2, dtype=np.int32)
        preceding = np.arange(-1, n, dtype=np.int32)
        filled = ends[1:] > ends[:-1]
        following[ends[1:][filled] - 1] = n  # n stands for "none" on either side
        preceding[ends[:-1][filled]] = n
        lists: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def post(positions: np.ndarray) -> None:
            found = self.ranks(symbols[positions], symbols[following[positions]])
            positions, found = positions[found >= 0], found[found >= 0]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for a, b in zip(begins, [*begins[1:], len(found)], strict=True):
                rank = int(found[a])
                if rank in lists:
                    lists[rank].append(positions[a:b])
                else:
                    lists[rank] = [positions[a:b]]
                    heapq.heappush(waiting, rank)

        post(np.flatnonzero(following[:n] < n).astype(np.int32))
        while waiting:
            rank = heapq.heappop(waiting)
            parts = lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            after = following[at]
            live = (symbols[at] == a) & (symbols[after] == b)  # else a neighbour merged meanwhile
            at = at[live]
            if a == b and len(at) > 1:
                at = np.unique(at)
                after = following[at]
                chained = np.r_[False, at[1:] == after[:-1]]
                index = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, index))
                at = at[(index - run) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            beyond = following[gone]
            symbols[at] = made
            symbols[gone] = -2
            following[at] = beyond
            preceding[beyond] = at  # writes to n are never read
            before = preceding[at]
            before = before[(before != n) & (symbols[before] != made)]
            post(np.concatenate([before, at[beyond != n]]))
        alive = symbols[:n] >= 0
        return symbols[:n][alive], offsets_of(alive)[ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids: flat bytes and n + 1 offsets."""
        positions, lengths = ragged(self.token_offsets, ids)
        return self.token_bytes[positions], offsets_of(lengths)[offsets]


@functools.lru_cache(maxsize=4)
def _loaded(text: str) -> Vocabulary:
    return Vocabulary(text)


class Encoder:
    """Texts to ids with the distinct units of earlier rounds kept.

    A unit is a stretch of text between single spaces, with the space before it; words never cross
    such a space, so equal units always give equal ids.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self._words_of = regex.compile(WORD_PATTERN).findall
        self._odd_space = regex.compile(r" \s|\s ").search
        self._clean_cut = regex.compile(r"(?<=\S) (?=\S)").split
        special = sorted(vocabulary.special, key=len, reverse=True)
        self._cut_special = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self._special = tuple(special)
        self.limit: int | None = None  # kept units, if other than KEPT_WORDS
        self._forget()

    def _forget(self) -> None:
        number = count().__next__
        self._spaced: dict[str, int] = defaultdict(number)  # with a space before
        self._plain: dict[str, int] = defaultdict(number)
        self._known = 0
        self._ids, self._offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _units(self, text: str) -> np.ndarray:
        pieces = [text]
        if any(s in text for s in self._special):
            pieces = self._cut_special(text)
        units: list[int] = []
        for k, piece in enumerate(pieces):
            if k % 2:
                units.append(self._plain[piece])  # a special token; no word contains it
            elif piece:
                parts = self._clean_cut(piece) if self._odd_space(piece) else piece.split(" ")
                if parts[0]:
                    units.append(self._plain[parts[0]])
                if len(parts) > 1:
                    units.extend(map(self._spaced.__getitem__, parts[1:]))
        return np.array(units, np.int64)

    def _fresh_units(self) -> list[str]:
        """The units that came up since the last round, in order of their numbers."""
        fresh: list[str] = [""] * (len(self._spaced) + len(self._plain) - self._known)
        for table, lead in ((self._spaced, " "), (self._plain, "")):
            for unit, number in reversed(table.items()):
                if number < self._known:
                    break
                fresh[number - self._known] = lead + unit
        return fresh

    def _learn(self) -> None:
        """Encode the units that came up since the last round."""
        fresh = self._fresh_units()
        numbers: dict[str, int] = defaultdict(count().__next__)
        flat: list[int] = []
        lengths = np.empty(len(fresh), np.int64)
        for k, unit in enumerate(fresh):
            found = [unit] if unit in self.vocabulary.special else self._words_of(unit)
            flat.extend(map(numbers.__getitem__, found))
            lengths[k] = len(found)
        words = np.array(flat, np.int64)
        plain = [b"" if w in self.vocabulary.special else w.encode() for w in numbers]
        ids, offsets = self.vocabulary.encode_words(plain)
        marked = [(k, self.vocabulary.special[w]) for k, w in enumerate(numbers) if w in self.vocabulary.special]
        if marked:
            at = np.array([k for k, _ in marked])
            ids = np.insert(ids, offsets[at], [i for _, i in marked])
            sizes = np.diff(offsets)
            sizes[at] = 1
            offsets = offsets_of(sizes)
        positions, sizes = ragged(offsets, words)
        self._extend(ids[positions], offsets_of(sizes)[offsets_of(lengths)])

    def _extend(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        self._ids = np.concatenate([self._ids, ids])
        self._offsets = np.concatenate([self._offsets, self._offsets[-1] + offsets[1:]])
        self._known = len(self._offsets) - 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and n + 1 offsets."""
        if self._known > (KEPT_WORDS if self.limit is None else self.limit):
            self._forget()
        rows = [self._units(t) if t else np.zeros(0, np.int64) for t in texts]
        self._learn()
        units = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        positions, sizes = ragged(self._offsets, units)
        ends = offsets_of(sizes)[offsets_of(np.array([len(r) for r in rows], np.int64))]
        return self._ids[positions], ends


def _rounds(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` characters; one longer text is a range of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = offsets_of(sizes)
    row = 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, end
        row = end


def _id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    new = {f.name for f in fields}
    if clash := new & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; name others")
    return T.StructType([*df.schema.fields, *fields])


def vocabulary_text(path: str) -> str:
    """The vocabulary file, read by the driver; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(df: DataFrame, vocabulary_path: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) of the whole text, and its decoding in ``decoded`` if that is named.

    Narrow: no shuffle, memory bounded by rounds of :data:`ROUND_CHARS` characters and one text.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        extra.append(T.StructField(decoded, T.StringType()))
    schema = _with(df, *extra)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_loaded(shared.value))
        for batch in batches:
            column = batch.column(text)
            for first, end in _rounds(column, ROUND_CHARS):
                texts = column.slice(first, end - first)
                flat, ends = encoder.encode(texts.to_pylist())
                for a, b in _rounds(texts, OUT_CHARS):
                    for a, b in ((x, min(x + OUT_ROWS, b)) for x in range(a, b, OUT_ROWS)):  # noqa: B020, PLW2901
                        own, cuts = flat[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
                        columns = [*batch.slice(first + a, b - a).columns, _id_lists(own, cuts)]
                        if decoded:
                            columns.append(_decoded(encoder.vocabulary, own, cuts))
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(kernel, schema)


def _decoded(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    data, cuts = vocabulary.decode(ids, ends)
    raw = data.tobytes()
    begins = data[cuts[:-1][cuts[:-1] < len(data)]]
    try:
        raw.decode()
        whole = not ((begins & 0xC0) == 0x80).any()  # two rows may hold the halves of one character
    except UnicodeDecodeError:  # ids that cut a character apart
        whole = False
    if whole:
        return strings_of(data, cuts).cast(pa.string())
    rows = cuts.tolist()
    return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(rows, rows[1:], strict=False)], pa.string())


def decode(df: DataFrame, vocabulary_path: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    schema = _with(df, T.StructField(decoded, T.StringType()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                lists = batch.column(ids)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                column = _decoded(vocabulary, flat, offsets_of(sizes))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)

    return df.mapInArrow(kernel, schema)
