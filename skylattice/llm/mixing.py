"""Language-model scores by online logistic context mixing.

A text counts as its tokens: words, A-Z lower-cased, one space between them, and an end. Its bytes are written
in a code of one to three half bytes, shorter for the bytes that are frequent in the corpus, and every bit of
these is predicted by four contexts (the last 3, 4 and 6 bytes, and the word so far). Each hashes into a
table of counts for half bytes; its log odds are an input of a mixer, whose weights are gated by how often
the corpus has shown the context and by the place of the bit. What is left is refined adaptively: a
table by mixed prediction and place tells the true chance, and every text moves the gains of its own four
inputs after each of its blocks, from bits already coded. So a score is a true probability of the whole
text, whatever its length.

Counts are sums over all learning documents: every task adds up its own tables and sends them packed,
and they are merged by table and block. The tables used for scores have a fixed size that is a parameter
(``TABLE_BITS``), which bounds what is broadcast; more text fills them better and never lengthens them.
Weights and chances are learned on every 18th learning document with the counts of the others;
afterwards those documents' counts join the tables. Each task of that pass goes over its documents
online; the mean by bits is what the tasks learned together, so weights differ a little with the
cutting of the input. Scores are the same for the same input files.

The base score needs exact counts of words. Words of the ``FREQUENT`` most frequent are looked up inside
the scoring pass; the others, none of which can be hot any more, are joined as (text, word, occurrences).

Null and empty texts are the end alone. Rows that repeat are separate documents, for learning and in the
result. Rows without a doc_id take part like others. Other columns are not read. Without any document to
learn from, every bit gets 1/2 and no token is known. Frequent words are recognised by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.flattext import BYTE_VALUES, NOT_SPACE, lower_ascii, offsets_of, pieces, power_tables, span_hashes, spans, strings_of
from skylattice.session import materialize, ship_package

#: Bytes of history of the first inputs; the last input is the word so far.
ORDERS = (3, 4, 6)
#: Slots of each input's table, as powers of two.
TABLE_BITS = (22, 22, 22, 22)
#: Slots in one packed row of counts, as a power of two.
BLOCK_BITS = 14
#: Words that are looked up within the scoring pass.
FREQUENT = 1 << 17
#: Texts are counted and scored in windows of about this many bytes.
COUNT_BYTES, SCORE_BYTES = 256 << 10, 24 << 10
#: Words are counted in runs of about this many bytes.
WORD_BYTES = 4 << 20
#: The word so far starts again after this many bytes.
LONGEST_WORD = 64
#: A text's own weights move after 256 bytes, then after blocks that double up to this many.
LONGEST_BLOCK = 4096
#: Steps of log odds in a table entry; cells of mixed log odds, and steps among them.
SCALE = 12.0
CELLS, CELL_SCALE = 321, 16.0
INPUTS = len(ORDERS) + 1
#: What both values of a bit count for before they are seen.
UNSEEN = 0.1
#: How often a context must have been seen for each next gate; the first has not been seen at all.
SEEN = (1, 4, 16, 128, 2048)
CONFIDENCES = len(SEEN) + 1
#: Where the weights start, by input.
START = (0.3, 0.4, 0.3, 0.3)
#: Cells are apart by place of the bit, for the first half byte of a code and for later ones.
GATES = 8

_U = np.uint64
_SALT = np.array([0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) for k in range(INPUTS)], np.uint64)
_C1, _C2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
_LEAVES = np.arange(16)
#: The four nodes on the way to each of a half byte's 16 values, and the bits taken there as 1 and -1.
_PATHS = np.stack([(1 << j) | (_LEAVES >> (4 - j)) for j in range(4)], 1)
_TURNS = np.where((_LEAVES[:, None] >> np.arange(3, -1, -1)) & 1, 1, -1).astype(np.int8)
_LN10 = float(np.log(10.0))


class Code(NamedTuple):
    """The half bytes of every byte value: how many, and for each its value and what tells its place in the code."""

    sizes: np.ndarray
    values: np.ndarray
    salts: np.ndarray


def byte_code(counts: np.ndarray) -> Code:
    """A complete code: the 12 most frequent bytes take one half byte, the next 52 two, the others three."""
    codes = np.zeros((256, 3), np.int64)
    sizes, places = np.zeros(256, np.int64), np.zeros((256, 3), np.int64)
    for rank, byte in enumerate(np.lexsort((np.arange(256), -counts)).tolist()):
        if rank < 12:
            code = [rank]
        elif rank < 60:
            code = [12 + (rank - 12) // 16, (rank - 12) % 16]
        elif rank < 64:
            code = [15, rank - 60]
        else:
            code = [15, 4 + (rank - 64) // 16, (rank - 64) % 16]
        sizes[byte], codes[byte, : len(code)] = len(code), code
        places[byte, 1] = 1 + code[0]
        places[byte, 2] = 17 + code[1] if len(code) > 2 else 0
    return Code(sizes, codes.reshape(-1), places.reshape(-1).astype(np.uint64) * _SALT[0])


def half_bytes(code: Code, flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every half byte of these bytes: its byte's index, value and salt, and whether it is a later one of its byte."""
    sizes = code.sizes[flat]
    of = np.repeat(np.arange(len(flat)), sizes)
    stage = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    entry = flat[of] * np.int64(3) + stage
    return of, code.values[entry], code.salts[entry], stage > 0


class Run(NamedTuple):
    """Whole rows, or one part of a long row, as coded bytes."""

    first: int
    end: int
    #: False for the later parts of a row, and for all but its last part.
    head: bool
    tail: bool
    #: A-Z lower-cased, with the spans of its words and the row offsets among them.
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    flat: np.ndarray
    offsets: np.ndarray
    tokens: np.ndarray


def _word_start(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a word begins after white space; the end if there is none."""
    while at < len(data):
        inside = NOT_SPACE[data[at - 1 : at + (64 << 10)]]
        found = np.flatnonzero(inside[1:] & ~inside[:-1])
        if len(found):
            return at + int(found[0])
        at += (64 << 10)
    return len(data)


def runs(column: pa.Array, limit: int) -> Iterator[Run]:
    """The rows of a column in runs of about ``limit`` bytes; a longer text is cut before words."""
    for first, end, data, starts in pieces(column, limit):
        at = 0
        while True:
            cut = len(data) if end - first > 1 or len(data) - at <= 2 * limit else _word_start(data, at + limit)
            bounds = starts if end - first > 1 else np.array([0, cut - at])
            yield _run(first, end, at == 0, cut == len(data), lower_ascii(data[at:cut]), bounds)
            at = cut
            if at == len(data):
                break


def _run(first: int, end: int, head: bool, tail: bool, data: np.ndarray, starts: np.ndarray) -> Run:
    begins, ends, rows = spans(data, starts, NOT_SPACE)
    counts = np.diff(rows)
    # A text without words is an end alone; white space before a long row's first word is nothing.
    bare = np.flatnonzero(counts == 0) if tail else np.zeros(0, np.int64)
    from_ = np.insert(begins, rows[bare], starts[bare])
    length = np.insert(ends, rows[bare], starts[bare]) - from_ + 1
    tokens = offsets_of(length)
    source = np.arange(tokens[-1]) + np.repeat(from_ - tokens[:-1], length)
    flat = np.append(data, np.uint8(32))[source]
    flat[tokens[1:] - 1] = 32
    offsets = tokens[offsets_of(np.maximum(counts, 1) if tail else counts)]
    if tail:
        flat[offsets[1:] - 1] = 10
    return Run(first, end, head, tail, data, begins, ends, rows, flat, offsets, tokens)


class Window(NamedTuple):
    """Coded bytes that are handled at once, with what came before them in their row."""

    flat: np.ndarray
    offsets: np.ndarray
    tokens: np.ndarray
    before: np.ndarray
    place: int


class Windows:
    """Cuts runs to windows, so that neither long texts nor long words need more memory; knows the bytes before."""

    def __init__(self, limit: int) -> None:
        self.limit, self.before, self.place = limit, np.zeros(0, np.uint8), 0

    def __call__(self, run: Run) -> Iterator[Window]:
        if run.head:
            self.before, self.place = np.zeros(0, np.uint8), 0
        tokens = run.tokens
        if (sizes := np.diff(tokens)).max(initial=0) > LONGEST_WORD:
            parts = -(-sizes // LONGEST_WORD)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            tokens = np.append(np.repeat(tokens[:-1], parts) + within * LONGEST_WORD, tokens[-1])
        if len(run.offsets) > 2 or len(run.flat) <= 2 * self.limit and run.head:
            yield Window(run.flat, run.offsets, tokens, self.before, self.place)
            at = 0
        else:
            at = 0
            while at < len(tokens) - 1:
                end = min(max(int(np.searchsorted(tokens, tokens[at] + self.limit)), at + 1), len(tokens) - 1)
                flat = run.flat[tokens[at] : tokens[end]]
                yield Window(flat, np.array([0, len(flat)]), tokens[at : end + 1] - tokens[at], self.before, self.place)
                self.before = np.concatenate([self.before, flat])[-max(ORDERS) :]
                self.place += len(flat)
                at = end
            return
        self.before, self.place = run.flat[-max(ORDERS) :], len(run.flat)


def _contexts(window: Window) -> Iterator[np.ndarray]:
    """One scrambled 64-bit value per input and byte; what came before the byte in its own row."""
    flat, offsets, tokens, before, _ = window
    n, first = len(flat), len(before)
    last = np.concatenate([before, flat]).astype(np.uint64)
    last[1:], last[0] = last[:-1].copy(), 0
    history, size = last, 1
    while size < max(ORDERS):
        longer = history.copy()
        longer[size:] |= history[:-size] << _U(8 * size)
        history, size = longer, 2 * size
    history = history[first:]
    # Bytes of the row before are cut off behind every row's start.
    for place in range(min(size, 8)):
        at = offsets[:-1][np.diff(offsets) > place] + place
        known = place + first
        if known < 8:
            history[at] &= _MASKS[known]
    for k, order in enumerate(ORDERS):
        yield _scrambled(history & _MASKS[order], k)
    powers, inverses = power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[flat] * powers[:n], out=total[1:])
    sizes = np.diff(tokens)
    total[:n] -= np.repeat(total[tokens[:-1]], sizes)
    yield _scrambled(total[:n] * np.repeat(inverses[tokens[:-1]], sizes), len(ORDERS))


def _scrambled(value: np.ndarray, k: int) -> np.ndarray:
    value *= _C1
    value += _SALT[k]
    value ^= value >> _U(32)
    return value


def _slots(context: np.ndarray, salts: np.ndarray, bits: int) -> np.ndarray:
    """The first slot of every half byte's 16 in a table of 2**bits slots; changes ``context``."""
    context += salts
    context *= _C2
    context ^= context >> _U(29)
    context *= _C1
    context >>= _U(64 - (bits - 4))
    context <<= _U(4)
    return context.view(np.int64)


def _add_counts(tables: list[np.ndarray], code: Code, window: Window) -> None:
    of, values, salts, _ = half_bytes(code, window.flat)
    for table, context, bits in zip(tables, _contexts(window), TABLE_BITS, strict=True):
        slots = _slots(context[of], salts, bits)
        slots += values
        np.add.at(table, slots, np.uint32(1))


def _words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = offsets_of(ends - begins)
    return strings_of(data[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], ends - begins)], offsets)


def _folds(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """text, fold: fold 1 is every 18th document, by its id."""
    number = F.floor(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) / 10)
    return docs.select(F.col(text).cast("string").alias("text"), (number % 18 == 0).cast("int").alias("fold"))


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n) over all documents; the end is the row without a word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(0), WORD_BYTES):
                coded = _words(run.data, run.begins, run.ends).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                words = pa.concat_arrays([coded.dictionary, pa.array([None], pa.large_string())]).cast(pa.string())
                ends = run.end - run.first if run.tail else 0
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, ends))], names=["word", "n"])

    ship_package(docs.sparkSession)
    part = docs.select(F.col(text).cast("string")).mapInArrow(kernel, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def byte_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte value occurs in the tokens of ``counts``, (word, n)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            weights = batch.column(1).to_numpy().astype(np.float64)
            for first, end, data, starts in pieces(batch.column(0)):
                total += np.bincount(data, weights=np.repeat(weights[first:end], np.diff(starts)), minlength=256)
                total[32] += weights[first:end].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(256)
    for byte, n in counts.select("word", "n").mapInArrow(kernel, "byte int, n double").groupBy("byte").agg(F.sum("n")).collect():
        out[byte] = n
    return out


def _packed_counts(docs: DataFrame, code: Code, text: str, doc_id: str) -> DataFrame:
    """(input, block, fold, counts): each task's sums, packed, without the blocks that it has nothing for."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        windows = Windows(COUNT_BYTES)
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fold in (0, 1):
                column = batch.column(0).filter(pa.array(folds == fold))
                if len(column) and fold not in sums:
                    sums[fold] = [np.zeros(1 << bits, np.uint32) for bits in TABLE_BITS]
                for run in runs(column, COUNT_BYTES):
                    for window in windows(run):
                        _add_counts(sums[fold], code, window)
        for fold, tables in sums.items():
            for k, table in enumerate(tables):
                rows = [(block, part) for block, part in enumerate(table.reshape(-1, 1 << BLOCK_BITS)) if part.any()]
                packed = [pa.compress(part.tobytes(), "zstd", asbytes=True) for _, part in rows]
                columns = [[k] * len(rows), [block for block, _ in rows], [fold] * len(rows), packed]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["input", "block", "fold", "counts"])

    return _folds(docs, text, doc_id).mapInArrow(kernel, "input int, block int, fold int, counts binary")


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Entries of a run of slots: log odds of a 1 bit at each of the 15 nodes of a half byte, and first how often it was seen."""
    level = leaves = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros(leaves.shape, np.int8)
    for width in (8, 4, 2, 1):
        pairs = level.reshape(len(leaves), width, 2)
        odds = np.rint(np.log((pairs[:, :, 1] + UNSEEN) / (pairs[:, :, 0] + UNSEEN)) * SCALE)
        out[:, width : 2 * width] = np.clip(odds, -126, 126)
        level = pairs.sum(2)
    out[:, 0] = np.searchsorted(SEEN, level[:, 0], "right")
    return out.reshape(-1)


def _merged(packed: DataFrame) -> DataFrame:
    """(input, block, part, whole): entries from the counts of fold 0, and from all. One block at a time is in memory."""

    def entries(key: tuple[int, int], sums: np.ndarray) -> list:
        return [*key, _log_odds(sums[0]).tobytes(), _log_odds(sums[0] + sums[1]).tobytes()]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["input", "block", "part", "whole"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        open_key, sums = None, np.zeros((2, 1 << BLOCK_BITS), np.uint64)
        for batch in batches:
            done = []
            for k, block, fold, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = (k.as_py(), block.as_py())
                if key != open_key:
                    if open_key is not None:
                        done.append(entries(open_key, sums))
                    open_key, sums = key, np.zeros_like(sums)
                raw = pa.decompress(counts.as_buffer(), 4 << BLOCK_BITS, "zstd")
                sums[fold.as_py()] += np.frombuffer(raw, np.uint32)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if open_key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(entries(open_key, sums), kinds, strict=True)], names=names)

    ordered = packed.repartition("input", "block").sortWithinPartitions("input", "block")
    return ordered.mapInArrow(kernel, "input int, block int, part binary, whole binary")


def _tables(merged: DataFrame, column: str) -> list[np.ndarray]:
    """The entries of all inputs; their size is fixed by TABLE_BITS."""
    tables = [np.zeros(1 << bits, np.int8) for bits in TABLE_BITS]
    found = merged.select("input", "block", column).toArrow()
    for k, block, entries in zip(*(found.column(i) for i in range(3)), strict=True):
        start = block.as_py() << BLOCK_BITS
        tables[k.as_py()][start : start + (1 << BLOCK_BITS)] = np.frombuffer(entries.as_buffer(), np.int8)
    return tables


def _paths(table: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For every slot the four log odds on the way to its value, each for the bit taken there, as one number.

    With an input's ``weights`` by confidence and place they are weighted, in steps of the cells.
    """
    out = np.empty((len(table) // 16, 16, 4), np.int8)
    entries = table.reshape(-1, 16)
    factors = None if weights is None else (weights * np.float32(CELL_SCALE / SCALE))[entries[:, 0]]
    for leaf in range(16):
        way = entries[:, _PATHS[leaf]] * _TURNS[leaf]
        out[:, leaf] = way if factors is None else np.clip(np.rint(way * factors), -127, 127)
    return out.reshape(-1).view(np.uint32)


class Mixer:
    """Weights by input, confidence and place, chances by gate and cell, and each input's usual curvature.

    All work on log odds for the bit that is really there. ``cells`` has its chance for every gate and cell of mixed log
    odds; cells of opposite odds sum up to 1, for the two values of a bit share one probability.
    """

    def __init__(self) -> None:
        self.weights = np.tile(np.array(START, np.float32)[:, None, None], (1, CONFIDENCES, 4))
        self.cells = np.tile(_plain_chances(), (GATES, 1)).astype(np.float32)
        self.curvature = np.full(INPUTS, 5.0, np.float32)


def _plain_chances() -> np.ndarray:
    """The chance that the odds in the middle of a cell stand for."""
    return 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / CELL_SCALE))


def _segments(offsets: np.ndarray, place: int) -> tuple[np.ndarray, ...]:
    """Begin, end, row and block of every row's blocks: all first blocks in order of rows, then all second ones, and so on.

    Blocks end at fixed places of a text; ``place`` is where a row begins that has parts before.
    """
    lengths = np.diff(offsets)
    sizes = np.minimum(256 << np.minimum(np.arange((place + lengths.max()) // 256 // 2 + 2), 40), LONGEST_BLOCK)
    limits = offsets_of(sizes)
    first = int(np.searchsorted(limits, place, "right")) - 1
    blocks = np.searchsorted(limits, place + lengths, "left") - first
    row = np.repeat(np.arange(len(lengths)), blocks)
    block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = offsets[row] + np.maximum(limits[first + block] - place, 0)
    end = offsets[row] + np.minimum(limits[first + block + 1] - place, lengths[row])
    order = np.lexsort((row, block))
    return begin[order], end[order], row[order], block[order]


#: The middle cell of every place, of first and of later half bytes.
_GATES = (np.arange(GATES) * CELLS + CELLS // 2).astype(np.int32).reshape(2, 4)


def _rows_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of four 32-bit values, each fetched as one value."""
    return np.ascontiguousarray(table).view(np.complex128).reshape(-1).take(rows).view(table.dtype)


def refined(right: np.ndarray) -> np.ndarray:
    """Chances by gate and cell: how often the odds of a cell were right, against the opposite ones, next to what they say."""
    right = right.reshape(GATES, CELLS) + 50 * _plain_chances()
    return (right / (right + right[:, ::-1])).astype(np.float32)


class Scorer:
    """Scores runs of texts; with ``learn`` it also moves the shared weights and counts cells."""

    def __init__(self, tables: list[np.ndarray], mixer: Mixer, code: Code, learn: bool = False) -> None:
        self.mixer, self.code, self.learn, self.windows = mixer, code, learn, Windows(SCORE_BYTES)
        self.weights = mixer.weights.copy()
        self.paths = [_paths(table, None if learn else weights) for table, weights in zip(tables, self.weights, strict=True)]
        self.seen = [np.ascontiguousarray(table[::16]) for table in tables] if learn else []
        # A chance and its logarithm are fetched as one value.
        self.cells = np.stack([mixer.cells.reshape(-1), np.log(mixer.cells.reshape(-1))], 1).view(np.complex64).reshape(-1)
        self.cell_counts = np.zeros(GATES * CELLS)
        self.curvature = np.zeros(INPUTS)
        self.bits = 0
        self.gradient, self.hessian = np.zeros((2, *self.weights.shape))

    def __call__(self, run: Run) -> np.ndarray:
        """Natural log probability of every row of the run, or of its part of a row."""
        if run.head:
            rows = len(run.offsets) - 1
            self.gains, self.coded_bits = np.ones((rows, INPUTS), np.float32), np.zeros(rows, np.float32)
        total = np.zeros(len(run.offsets) - 1)
        for window in self.windows(run):
            total += self._window(window)
        return total

    def _window(self, window: Window) -> np.ndarray:
        flat, offsets, place = window.flat, window.offsets, window.place
        gains, coded_bits = self.gains, self.coded_bits
        rows, n = len(offsets) - 1, len(flat)
        total = np.zeros(rows)
        if not n:
            return total
        begin, end, row, block = _segments(offsets, place)
        edges = offsets_of(end - begin)
        order = np.arange(n) + np.repeat(begin - edges[:-1], end - begin)
        steps = np.searchsorted(block, np.arange(block[-1] + 2))
        of, values, salts, later = half_bytes(self.code, flat[order])
        edges = offsets_of(self.code.sizes[flat[order]])[edges] * 4
        of = order[of]
        fetched, seen = np.empty((INPUTS, len(of)), np.uint32), []
        for k, (paths, context) in enumerate(zip(self.paths, _contexts(window), strict=True)):
            slots = _slots(context[of], salts, TABLE_BITS[k])
            if self.learn:
                seen.append(self.seen[k].take(slots >> 4))
            slots += values
            fetched[k] = paths.take(slots)
        inputs = fetched.view(np.int8).astype(np.float32)
        if self.learn:
            raw = inputs * np.float32(CELL_SCALE / SCALE)
            inputs = np.stack([x * _rows_of(w, s) for x, w, s in zip(raw, self.weights, seen, strict=True)])
        gate = _rows_of(_GATES, later.astype(np.int64))

        for step in range(len(steps) - 1):
            bounds, lanes = edges[steps[step] : steps[step + 1] + 1], row[steps[step] : steps[step + 1]]
            here, at = slice(bounds[0], bounds[-1]), bounds[:-1] - bounds[0]
            segments = list(zip(lanes.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            value = np.empty(bounds[-1] - bounds[0], np.float32)
            for lane, a, b in segments:
                np.matmul(gains[lane], inputs[:, a:b], out=value[a - bounds[0] : b - bounds[0]])
            np.clip(value, -(CELLS // 2), CELLS // 2, out=value)
            cell = np.rint(value, out=value).astype(np.int64)
            cell += gate[here]
            if self.learn:
                self.cell_counts += np.bincount(cell, minlength=GATES * CELLS)
            told = self.cells.take(cell).view(np.float32)
            total[lanes] += np.add.reduceat(told[1::2], at, dtype=np.float64)
            if step + 2 == len(steps) and rows > 1 and not self.learn:
                break
            error = np.float32(1) - told[::2]
            coded_bits[lanes] += np.diff(bounds)
            for lane, a, b in segments:
                slope = inputs[:, a:b] @ error[a - bounds[0] : b - bounds[0]]
                gains[lane] += slope / (self.mixer.curvature * (coded_bits[lane] + 4000)) * np.float32(CELL_SCALE / 2)
            if self.learn:
                bend = error * told[::2]
                for k in range(INPUTS):
                    self.curvature[k] += (bend * inputs[k, here] ** 2).sum()
                    self._count(k, seen[k][bounds[0] // 4 : bounds[-1] // 4], error, raw[k, here], bend)
        if self.learn:
            self.bits += fetched.shape[1] * 4
            self.weights += (self.gradient * CELL_SCALE / (self.hessian + 200 * CELL_SCALE**2) / INPUTS * 2).astype(np.float32)
            # Earlier runs fade, so the step follows the present slope.
            self.gradient *= 0.5
            self.hessian *= 0.9
        return total

    def _count(self, k: int, seen: np.ndarray, error: np.ndarray, values: np.ndarray, bend: np.ndarray) -> None:
        gate = (seen[:, None] * np.int64(4) + np.arange(4)).reshape(-1)
        sums = lambda weights: np.bincount(gate, weights=weights, minlength=CONFIDENCES * 4).reshape(CONFIDENCES, 4)
        self.gradient[k] += sums(error * values)
        self.hessian[k] += sums(bend * values * values)


def _learned(docs: DataFrame, tables, mixer: Mixer, code: Code, text: str, doc_id: str) -> Mixer:
    """One online pass of every task over the documents of fold 1, and the mean of what they learned."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for run in runs(batch.column(0), SCORE_BYTES):
                scorer = scorer or Scorer(tables.value, mixer, code, learn=True)
                scorer(run)
        if scorer and scorer.bits:
            parts = [[scorer.bits], scorer.weights.reshape(-1).astype(np.float64) * scorer.bits, scorer.cell_counts, scorer.curvature]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tolist()])], names=["sums"])

    sample = _folds(docs, text, doc_id).filter("fold = 1").select("text")
    parts = sample.mapInArrow(kernel, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    # One sum for each of a few thousand places, whatever the input.
    sizes = [INPUTS * CONFIDENCES * 4, GATES * CELLS, INPUTS]
    sums = np.zeros(1 + sum(sizes))
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():
        sums[place] = value
    out, bits = Mixer(), sums[0]
    if bits:
        weights, right, curvature = np.split(sums[1:], np.cumsum(sizes)[:-1])
        out.weights = (weights / bits).reshape(INPUTS, CONFIDENCES, 4).astype(np.float32)
        out.curvature = np.maximum(curvature / bits, 0.1).astype(np.float32)
        out.cells = refined(right)
    return out


def _columns(parts: list[tuple], rows: int) -> list[pa.Array]:
    """Numbers and word lists of the rows; the parts are those of one row if there are several."""
    tokens, known, base, score, size = sum(part[0] for part in parts)
    words = pa.concat_arrays([part[2] for part in parts])
    times = np.concatenate([part[3] for part in parts])
    lengths = parts[0][1] if len(parts) == 1 else [len(words)]
    pairs = pa.StructArray.from_arrays([words, pa.array(times.astype(np.int32))], names=["word", "k"])
    lists = pa.ListArray.from_arrays(pa.array(offsets_of(np.asarray(lengths)).astype(np.int32)), pairs)
    longs = lambda values: pa.array(values.astype(np.int64))
    return [longs(tokens), longs(known), pa.array(base), pa.array(score), longs(size), lists]


def _scored_words(rows, hashes, known, logs):
    """Of every row: the sum over frequent words and their number, and the other words as (row, first span, occurrences)."""
    n = len(rows) - 1
    of = np.repeat(np.arange(n), np.diff(rows))
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    base = np.bincount(of[hit], weights=logs[at[hit]], minlength=n)
    number = np.bincount(of[hit], minlength=n)
    rest = np.flatnonzero(~hit)
    order = rest[np.lexsort((rest, hashes[rest], of[rest]))]
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])] if len(order) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    return base, number, of[order[firsts]], order[firsts], np.diff(np.append(firsts, len(order)))


class Model(NamedTuple):
    """What ``fit`` learned; ``counts`` is the only part that grows, and it is a table."""

    tables: list[np.ndarray]
    mixer: Mixer
    code: Code
    counts: DataFrame
    frequent: pa.Table
    #: All tokens, the different ones, and the ends among them.
    tokens: int
    different: int
    endings: int


def fit(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learn counts, weights and corrections from all of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = materialize(word_counts(docs, text=text))
    ends = F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))
    tokens, different, endings = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), ends).first()
    frequent = counts.filter("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    code = byte_code(byte_counts(counts))
    merged = materialize(_merged(_packed_counts(docs, code, text, doc_id)))
    part = spark.sparkContext.broadcast(_tables(merged, "part"))
    mixer = _learned(docs, part, Mixer(), code, text, doc_id)
    part.unpersist()
    return Model(_tables(merged, "whole"), mixer, code, counts, frequent, tokens, different, endings)


def scored(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    tail = np.log10(0.1)
    below = np.log10(model.tokens + 0.1 * (model.different + 1))
    base_of = lambda n: np.log10(np.asarray(n, np.float64) + 0.1) - below
    end_base, end_known = float(base_of(model.endings)), int(model.endings > 0)
    sent = spark.sparkContext.broadcast((model.tables, model.mixer, model.code, model.frequent))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, learned, code, words = sent.value
        scorer = Scorer(tables, learned, code)
        known, logs = np.zeros(0, np.uint64), np.zeros(0)
        if len(words):
            held = words.column(0).combine_chunks().cast(pa.large_string())
            offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            hashes = span_hashes(np.frombuffer(held.buffers()[2], np.uint8), offsets[:-1], offsets[1:])
            order = np.argsort(hashes)
            known, logs = hashes[order], base_of(words.column(1).to_numpy())[order]
        for batch in batches:
            parts = []
            for run in runs(batch.column(0), SCORE_BYTES):
                parts.append(measured(run, scorer(run), known, logs))
                if run.tail:
                    kept = batch.slice(run.first, run.end - run.first).columns[1:]
                    yield pa.RecordBatch.from_arrays([*kept, *_columns(parts, run.end - run.first)], names=names)
                    parts = []

    def measured(run: Run, score: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple:
        hashes = span_hashes(run.data, run.begins, run.ends)
        base, number, of, chosen, times = _scored_words(run.rows, hashes, known, logs)
        rows = len(run.rows) - 1
        base = base + np.bincount(of, weights=times, minlength=rows) * (tail - below) + run.tail * end_base
        words = _words(run.data, run.begins[chosen], run.ends[chosen]).cast(pa.string())
        sums = np.stack([np.diff(run.rows) + run.tail, number + run.tail * end_known, base, score / _LN10, np.diff(run.offsets)])
        return sums, np.bincount(of, minlength=rows), words, times

    rows = docs.select(
        F.col(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
    )
    names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "words"]
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, n_bytes long, words array<struct<word string, k int>>"
    passed = materialize(rows.mapInArrow(kernel, schema))
    # At most FREQUENT words, which the pass has done.
    done = F.broadcast(spark.createDataFrame(model.frequent.select(["word"]).cast(pa.schema([("word", pa.string())]))))
    others = model.counts.filter("word IS NOT NULL").join(done, "word", "left_anti")
    more = (
        passed.select("row", F.explode("words").alias("w"))
        .select("row", "w.*")
        .join(others, "word")
        .groupBy("row")
        .agg(F.sum(F.col("k") * (F.log10(F.col("n") + 0.1) - float(tail))).alias("_more"), F.sum("k").alias("_known"))
    )
    return passed.drop("words").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (F.col("score") * float(-np.log2(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

