"""Phrase collocations by prefix-free parsing.

Texts, A-Z lower-cased, are split into pieces at punctuation and line ends, pieces into words. A parse cuts
every piece into chunks wherever the content triggers it: after a word that, with the word before it, hashes
to 0 modulo ``TRIGGER``, and at ``LONGEST`` words. A chunk owns its words and carries up to two more words of
the piece behind them, so that every n-gram lies whole inside the chunk that owns its first word, and in
no other: an overlap is assigned once. The distinct chunks of each language form the dictionary; the parse
is kept as how often each occurs. Copies and repeated passages are thus counted once, with a weight.

N-grams are counted inside distinct chunks, weighted. One pass over the dictionary counts words and pairs.
A phrase of three words can only reach the least count if both its pairs do, so a Bloom filter of those pairs,
of fixed size, comes before the second pass; what it lets through by mistake is counted exactly and falls
by the least count like the rest. All counts are by the phrases' own bytes, scores by whole numbers.

Null texts have no words, a null language is ``und``. Repeated rows count again. Other columns are not read.
A single word is handled whole; a long text is cut before words, with two more words behind the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.flattext import lower_ascii, mix, offsets_of, pieces, span_hashes, spans, strings_of
from skylattice.session import materialize, ship_package

TRIGGER = 16
LONGEST = 256
#: Words of the longest phrases.
PHRASE = 3
PIECE_BYTES = 2 << 20
#: Distinct chunks are counted in runs of about this many bytes.
COUNT_BYTES = 8 << 20
#: Bits of the filter of pairs, as a power of two; 8 MB are broadcast.
FILTER_BITS = 26
#: A language's candidates are ranked in this many parts first.
RANK_PARTS = 256
SCHEMA = "lang string, phrase string, size int, n long"

_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_STOP
_WORD[[0x20, 0x09]] = False
_SLOT = np.ones(256, bool)
_SLOT[[0x20, 0x09]] = False


def _word_start(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a word begins after something else; the end if there is none."""
    while at < len(data):
        inside = _WORD[data[at - 1 : at + (64 << 10)]]
        found = np.flatnonzero(inside[1:] & ~inside[:-1])
        if len(found):
            return at + int(found[0])
        at += 64 << 10
    return len(data)


def _texts(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, lower-cased bytes, offsets, where owned words end); long texts come in several parts."""
    for first, end, data, starts in pieces(column, limit):
        data = lower_ascii(data)
        if end - first > 1 or len(data) <= 2 * limit:
            yield first, end, data, starts, len(data)
            continue
        at = 0
        while at < len(data):
            cut = ahead = _word_start(data, at + limit)
            for _ in range(PHRASE):
                ahead = _word_start(data, ahead + 1)
            yield first, end, data[at:ahead], np.array([0, ahead - at]), cut - at
            at = cut


def _heads(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A value of every word from its first eight bytes and its length."""
    value = (ends - begins).astype(np.uint64)
    for k in range(8):
        value = value * np.uint64(257) + np.where(begins + k < ends, data[np.minimum(begins + k, len(data) - 1)], 0).astype(np.uint64)
    return value


def parse(data: np.ndarray, starts: np.ndarray, owned: int) -> tuple[np.ndarray, pa.Array]:
    """The row of every chunk and the chunk: each owned word after a space, each further one after a tab."""
    begins, ends, rows = spans(data, starts, _WORD)
    n = len(begins)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    of_row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    new_piece = np.r_[True, (stops[begins[1:]] != stops[ends[:-1]]) | (of_row[1:] != of_row[:-1])]
    heads = _heads(data, begins, ends)
    pairs = mix(heads + np.r_[np.uint64(0), np.where(new_piece[1:], np.uint64(0), heads[:-1])] * np.uint64(0x9E3779B97F4A7C15))
    last = np.r_[new_piece[1:], True] | (pairs % np.uint64(TRIGGER) == 0)
    # Only words in front of the cut are owned; the parse starts again there.
    n_owned = int(np.searchsorted(begins, owned))
    if n_owned == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    last[n_owned - 1] = True
    first = np.r_[True, last[:-1]]
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    last |= place % LONGEST == LONGEST - 1
    chunk_ends = np.flatnonzero(last[:n_owned]) + 1
    chunk_starts = np.r_[0, chunk_ends[:-1]]
    piece_ends = np.append(np.flatnonzero(new_piece[1:]) + 1, n)
    until = np.minimum(chunk_ends + PHRASE - 1, piece_ends[np.searchsorted(piece_ends, chunk_ends)])
    sizes = until - chunk_starts
    slots = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(chunk_starts, sizes)
    lengths = (ends - begins)[slots] + 1
    offsets = offsets_of(lengths)
    flat = data[np.arange(offsets[-1]) + np.repeat(begins[slots] - 1 - offsets[:-1], lengths)]
    flat[offsets[:-1]] = np.where(slots < np.repeat(chunk_ends, sizes), 32, 9)
    return of_row[chunk_starts], strings_of(flat, offsets[offsets_of(sizes)])


def dictionary(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often the parse has them."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, starts, owned in _texts(batch.column(1), PIECE_BYTES):
                of_row, chunks = parse(data, starts, owned)
                langs = batch.column(0).take(pa.array(of_row + first))
                yield pa.RecordBatch.from_arrays([langs, chunks.cast(pa.string())], names=["lang", "chunk"])

    ship_package(docs.sparkSession)
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(kernel, "lang string, chunk string").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n"))


class _Counted:
    """The words of a run of distinct chunks, as numbers, with their languages and weights."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        self.langs, lang_of = coded.dictionary, coded.indices.to_numpy()
        _, _, data, starts = next(pieces(table.column(1).combine_chunks(), 1 << 62))
        self.begins, self.ends, rows = spans(data, starts, _SLOT)
        self.owned = data[self.begins - 1] == 32
        self.data = np.where(data == 9, np.uint8(32), data)
        of_row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        self.weights, self.lang = table.column(2).to_numpy()[of_row], lang_of[of_row].astype(np.int64)
        self.left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(of_row))
        words = self.strings(np.arange(len(of_row)), 1).dictionary_encode()
        self.words, self.n_words = words.indices.to_numpy().astype(np.int64), len(words.dictionary)

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words that begin at these words."""
        begins, ends = self.begins[at], self.ends[at + size - 1]
        offsets = offsets_of(ends - begins)
        return strings_of(self.data[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], ends - begins)], offsets)

    def sums(self, size: int, at: np.ndarray) -> pa.RecordBatch:
        """Rows of SCHEMA for the phrases of ``size`` words that begin at these words."""
        key = self.lang[at]
        for k in range(size):
            if k == 2:  # numbers of three words may not fit; pairs are numbered first
                key = np.unique(key, return_inverse=True)[1]
            key = key * self.n_words + self.words[at + k]
        _, firsts, which = np.unique(key, return_index=True, return_inverse=True)
        n = np.zeros(len(firsts), np.int64)
        np.add.at(n, which, self.weights[at])
        at = at[firsts]
        sizes = pa.array(np.full(len(at), size, np.int32))
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(self.lang[at])), self.strings(at, size).cast(pa.string()), sizes, pa.array(n)],
            names=["lang", "phrase", "size", "n"],
        )

    def begin(self, size: int) -> np.ndarray:
        """Owned words that begin a phrase of this size."""
        return np.flatnonzero(self.owned & (self.left >= size))


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[_Counted]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= COUNT_BYTES:
            yield _Counted(held)
            held, size = [], 0
    if any(len(batch) for batch in held):
        yield _Counted(held)


def words_and_pairs(chunks: DataFrame) -> DataFrame:
    """(lang, phrase, size, n) of all phrases of one and two words, and of each language's words together as size 0."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counted in _collected(batches):
            for size in (1, 2):
                yield counted.sums(size, counted.begin(size))
            n = np.zeros(len(counted.langs), np.int64)
            np.add.at(n, counted.lang[counted.owned], counted.weights[counted.owned])
            arrays = [counted.langs, pa.nulls(len(n), pa.string()), pa.array(np.zeros(len(n), np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "size", "n"])

    return chunks.mapInArrow(kernel, SCHEMA).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _hashes(langs: pa.Array, lang_of: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of language and phrase."""
    names = langs.cast(pa.large_string())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    text = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    return mix(span_hashes(data, begins, ends) ^ span_hashes(text, offsets[:-1], offsets[1:])[lang_of])


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


def _pair_filter(pairs: DataFrame) -> np.ndarray:
    """The bits of all pairs; 2**FILTER_BITS of them, whatever the number of pairs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column(0).dictionary_encode()
            _, _, data, starts = next(pieces(batch.column(1), 1 << 62))
            both = np.unique(np.concatenate(_bits(_hashes(coded.dictionary, coded.indices.to_numpy(), data, starts[:-1], starts[1:]))))
            yield pa.RecordBatch.from_arrays([pa.array(both)], names=["bit"])

    words = (
        pairs.select("lang", "phrase")
        .mapInArrow(kernel, "bit long")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint8)


def triples(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of three words both of whose pairs may be among ``pairs``."""
    sent = chunks.sparkSession.sparkContext.broadcast(_pair_filter(pairs))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for counted in _collected(batches):
            two = np.flatnonzero(counted.left >= 2)
            hashes = _hashes(counted.langs, counted.lang[two], counted.data, counted.begins[two], counted.ends[two + 1])
            may = np.zeros(len(counted.left) + 1, bool)
            may[two] = np.logical_and(*((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 for bit in _bits(hashes)))
            at = counted.begin(3)
            yield counted.sums(3, at[may[at] & may[at + 1]])

    return chunks.mapInArrow(kernel, SCHEMA).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000
) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Candidates have two or three words and at least ``least`` occurrences. The cut with the lowest score counts.
    A candidate inside a longer one with at least ``share`` percent of its occurrences is dropped.
    """
    chunks = materialize(dictionary(docs, text=text, lang=lang))
    short = materialize(words_and_pairs(chunks).filter((F.col("n") >= least) | (F.col("size") == 0)))
    pairs = short.filter("size = 2")
    three = materialize(triples(chunks, pairs).filter(F.col("n") >= least))
    counts = short.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))

    candidates = pairs.unionByName(three)
    word = lambda i, k: F.array_join(F.slice(F.split("phrase", " "), i, k), " ")
    cuts = candidates.select(
        "lang",
        "phrase",
        "size",
        F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).select("*", word(F.lit(1), F.col("k")).alias("first"), word(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, value: counts.withColumnsRenamed({"part": name, "count": value})
    rated = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    rated = rated.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = rated.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = (
        three.select("lang", F.explode(F.array(word(F.lit(1), F.lit(2)), word(F.lit(2), F.lit(2)))).alias("phrase"), F.col("n"))
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter(
        (F.col("size") == PHRASE) | F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    spread = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    best = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = short.filter("size = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
