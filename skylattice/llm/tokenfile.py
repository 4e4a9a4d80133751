"""Token-id files in Simple-8b: each 64-bit word says in 4 bits how many ids of how many bits it holds.

A table of payloads is the file set, one row for each segment: documents in ascending order of their
id, cut into segments of bounded text. A payload is little-endian and self-contained::

    magic "S8T1", documents n, blocks m, escapes e (u32 each), ids k (u64)
    document ids i64[n], validity u8[n] padded to 8, end of each document's ids u64[n]
    first word of each block u32[m + 1] padded to 8, escapes u64[e], words u64[...]

Ids are packed in blocks of ``BLOCK`` ids, so blocks decode independently and all at once. An id that
needs more than 60 bits is an escape: its word holds its place among the escapes. Payloads are stored
by Spark's Parquet writer, which brings them to any file system and commits whole tasks only.

Null texts have no ids but the end id; null doc_ids come first; repeated rows are documents of their own.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.bpe import KEPT_WORDS, Encoder, Vocabulary, _rounds, vocabulary_text
from skylattice.llm.flattext import offsets_of, ragged
from skylattice.session import shared_folder, ship_package

BLOCK = 4096
SEGMENT_CHARS = 4 << 20
KEPT_UNITS = 1_000_000
#: Units that the library gets as one text, at most.
JOINED = 64
#: Fixed values, by selector: bits of an id and ids in a word; selector 0 is an escape.
BITS = np.array([60, 60, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30], np.uint8)
COUNTS = np.array([1, 1, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
ESCAPE, SINGLE = 0, 2
_MAGIC = b"S8T1"
_U = np.uint64


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) > 1 << 16 and int(ids.max()) < 1 << 16:
        return _small_bit_lengths()[ids.astype(np.int64)]
    out = np.zeros(len(ids), np.uint8)
    for bits in sorted({int(b) for b in BITS}, reverse=True):
        out[ids < (_U(1) << _U(bits))] = bits
    out[ids >= (_U(1) << _U(60))] = 64
    return out


@functools.lru_cache(maxsize=1)
def _small_bit_lengths() -> np.ndarray:
    return _bit_lengths(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (m + 1), and escapes of a run of ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    m = -(-n // BLOCK)
    wide = BLOCK + int(COUNTS.max())
    values = np.zeros((m, wide), np.uint64)
    lengths = np.zeros((m, wide), np.uint8)
    full = np.zeros(m * BLOCK, np.uint64)
    full[:n] = ids
    values[:, :BLOCK] = full.reshape(m, BLOCK)
    bit_lengths = np.zeros(m * BLOCK, np.uint8)
    bit_lengths[:n] = _bit_lengths(ids)
    lengths[:, :BLOCK] = bit_lengths.reshape(m, BLOCK)
    sizes = np.full(m, BLOCK, np.int64)
    if m:
        sizes[-1] = n - (m - 1) * BLOCK
    # The widest need among the next c ids, for every c that a selector packs; the most ids in a word win.
    choice = np.where(lengths == 64, ESCAPE, SINGLE).astype(np.uint8)
    need, span = lengths, 1
    for selector in np.argsort(COUNTS, kind="stable")[3:]:
        count = int(COUNTS[selector])
        while span < count:
            step = min(span, count - span)
            moved = np.zeros_like(need)
            moved[:, : wide - step] = need[:, step:]
            need, span = np.maximum(need, moved), span + step
        fits = need <= BITS[selector]
        if not fits[:-1, :BLOCK].any() and not fits[-1:, : n - (m - 1) * BLOCK].any():
            break  # more ids of fewer bits fit nowhere either
        choice[fits] = selector
    at = np.zeros(m, np.int64)
    rows = np.arange(m)
    taken_rows, taken_at = [], []
    while len(rows):
        taken_rows.append(rows)
        taken_at.append(at)
        at = at + COUNTS[choice[rows, at]]
        going = at < sizes[rows]
        rows, at = rows[going], at[going]
    row = np.concatenate(taken_rows or [np.zeros(0, np.int64)])
    at = np.concatenate(taken_at or [np.zeros(0, np.int64)])
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    selector = choice[row, at]
    words = selector.astype(np.uint64) << _U(60)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[own] |= np.arange(len(own), dtype=np.uint64)
            continue
        start, bits = row[own] * wide + at[own], _U(BITS[s])
        flat = values.reshape(-1)
        packed = words[own]
        for k in range(int(COUNTS[s])):
            packed |= flat[start + k] << (_U(k) * bits)
        words[own] = packed
    escapes = values[row[selector == ESCAPE], at[selector == ESCAPE]]
    return words, np.searchsorted(row, np.arange(m + 1)).astype(np.uint32), escapes


def unpack(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All ids of all blocks at once."""
    selector = (words >> _U(60)).astype(np.uint8)
    counts = COUNTS[selector]
    before = offsets_of(counts)[:-1]
    block = np.repeat(np.arange(len(block_words) - 1), np.diff(block_words.astype(np.int64)))
    start = before - before[block_words[:-1].astype(np.int64)][block] + block * BLOCK if len(words) else before
    out = np.zeros(n + int(COUNTS.max()), np.uint64)
    end_of_block = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        payload = words[own] & _U((1 << 60) - 1)
        if s == ESCAPE:
            out[start[own]] = escapes[payload.astype(np.int64)]
            continue
        bits = _U(BITS[s])
        mask = (_U(1) << bits) - _U(1)
        for k in range(int(COUNTS[s])):
            place = start[own] + k
            inside = place < end_of_block[own]
            out[place[inside]] = (payload[inside] >> (_U(k) * bits)) & mask
    return out[:n]


def write_payload(doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray) -> bytes:
    words, block_words, escapes = pack(ids)
    valid = np.array(doc_ids.is_valid()).astype(np.uint8)
    named = np.array(doc_ids.fill_null(0)).astype(np.int64)
    pad = lambda raw: raw + bytes(-len(raw) % 8)
    head = _MAGIC + np.array([len(named), len(block_words) - 1, len(escapes)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return b"".join([
        head, named.tobytes(), pad(valid.tobytes()), ends.astype("<u8").tobytes(), pad(block_words.tobytes()), escapes.tobytes(), words.tobytes(),
    ])


def read_payload(raw: bytes | memoryview) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, n + 1 offsets of their ids, and all ids."""
    if bytes(raw[:4]) != _MAGIC:
        raise ValueError("not a token file")
    n, m, e = (int(x) for x in np.frombuffer(raw, "<u4", 3, 4))
    k = int(np.frombuffer(raw, "<u8", 1, 16)[0])
    at = 24

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, kind, count, at)
        at += -(-part.nbytes // 8) * 8
        return part

    named, valid, ends = take("<i8", n), take("u1", n), take("<u8", n)
    block_words, escapes = take("<u4", m + 1), take("<u8", e)
    words = np.frombuffer(raw, "<u8", int(block_words[-1]), at)
    ids = unpack(words, block_words, escapes, k)
    return pa.array(named, mask=valid == 0), np.r_[0, ends.astype(np.int64)], ids


class LibraryEncoder(Encoder):
    """The tokenizers library over the distinct units of the texts (see :class:`Encoder`), many units in one call's text."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(Vocabulary(text))
        self._library = Tokenizer.from_str(text)
        self._library.no_truncation()
        self._library.no_padding()
        self._token_sizes = np.diff(self.vocabulary.token_offsets)

    def _learn(self) -> None:
        fresh = self._fresh_units()
        if not fresh:
            return
        # Units go to the library as one text where no word crosses from one into the next, and are cut at its tokens again.
        units = pa.array(fresh, pa.large_string())
        lengths = pc.binary_length(units).to_numpy(zero_copy_only=False)
        bare = pc.binary_length(pc.utf8_ltrim_whitespace(units)).to_numpy(zero_copy_only=False)
        led = pc.starts_with(units, " ").to_numpy(zero_copy_only=False) & (lengths - bare == 1)
        closes = pc.not_equal(pc.utf8_rtrim_whitespace(units), units).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(~led | np.r_[True, closes[:-1]] | (np.arange(len(fresh)) % JOINED == 0)).tolist()
        flat, _ = self._coded(["".join(fresh[a:b]) for a, b in zip(begins, [*begins[1:], len(fresh)], strict=True)])
        token_ends, unit_ends = np.cumsum(self._token_sizes[flat]), np.cumsum(lengths)
        last = np.minimum(np.searchsorted(token_ends, unit_ends), max(len(flat) - 1, 0))
        if len(flat) and token_ends[-1] == unit_ends[-1] and np.array_equal(token_ends[last], unit_ends):
            self._extend(flat, np.r_[0, last + 1])
        else:  # a vocabulary whose tokens are not the text's bytes, or reach across units
            self._extend(*self._coded(fresh))

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.int32, int(lengths.sum())), offsets_of(lengths)

    def _column_units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts and n + 1 offsets; each distinct piece between spaces is looked up once."""
        column = pc.fill_null(column, "")
        if not len(column):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        split = pc.split_pattern(column, " ")
        ends = offsets_of(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        pieces = split.flatten()
        first = np.zeros(len(pieces), bool)
        first[ends[:-1]] = True
        last = np.zeros(len(pieces), bool)
        last[ends[1:] - 1] = True
        units = np.empty(len(pieces), np.int64)
        odd = np.zeros(len(pieces), bool)  # white space beside the space at which a text is cut
        for own, table in ((~first, self._spaced), (first, self._plain)):
            coded = pieces.filter(pa.array(own)).dictionary_encode()
            codes, spelled = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            names = spelled.to_numpy(zero_copy_only=False)
            if table is self._plain:
                numbers = np.fromiter((table[x] if x else -1 for x in names), np.int64, len(names))
                opens = np.zeros(len(names), bool)
            else:
                numbers = np.fromiter(map(table.__getitem__, names), np.int64, len(names))
                opens = pc.not_equal(pc.utf8_ltrim_whitespace(spelled), spelled).to_numpy(zero_copy_only=False)
                opens |= names == ""
            closes = pc.not_equal(pc.utf8_rtrim_whitespace(spelled), spelled).to_numpy(zero_copy_only=False)
            units[own] = numbers[codes]
            odd[own] = opens[codes] | (closes[codes] & ~last[own])
        odd_rows = np.logical_or.reduceat(odd, ends[:-1])
        for special in self._special:
            odd_rows |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        if odd_rows.any():
            rows = np.split(units, ends[1:-1])
            for k in np.flatnonzero(odd_rows):
                rows[k] = self._units(column[k].as_py())
            units, ends = np.concatenate(rows), offsets_of(np.fromiter(map(len, rows), np.int64, len(rows)))
        there = units >= 0
        return units[there], offsets_of(there)[ends]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and n + 1 offsets."""
        if self._known > (KEPT_WORDS if self.limit is None else self.limit):
            self._forget()
        units, ends = self._column_units(column)
        self._learn()
        positions, sizes = ragged(self._offsets, units)
        return self._ids[positions], offsets_of(sizes)[ends]


@functools.lru_cache(maxsize=2)
def _library(text: str) -> LibraryEncoder:
    return LibraryEncoder(text)


FILES = "shard int, segment int, n_ids long, payload binary"


def token_files(docs: DataFrame, vocabulary_path: str, *, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The payload rows of ``docs`` in ascending order of their id: shard, segment in it, n_ids, payload."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = narrow.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _library(shared.value)
        encoder.limit = KEPT_UNITS
        shard, segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column("text")
            for first, end in _rounds(column, SEGMENT_CHARS):
                flat, ends = encoder.encode_column(column.slice(first, end - first))
                rows = np.arange(end - first)
                closed = np.empty(len(flat) + len(rows), np.uint32)
                closed_ends = ends[1:] + rows + 1
                closed[closed_ends - 1] = end_id
                closed[np.arange(len(flat)) + np.repeat(rows, np.diff(ends))] = flat
                payload = write_payload(batch.column("doc_id").slice(first, end - first), closed_ends, closed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(closed)], pa.int64()), pa.array([payload], pa.binary())],
                    names=["shard", "segment", "n_ids", "payload"],
                )
                segment += 1

    return ordered.mapInArrow(kernel, FILES)


def write_token_files(docs: DataFrame, vocabulary_path: str, folder: str, **options) -> None:
    token_files(docs, vocabulary_path, **options).write.parquet(folder)


def starts(files: DataFrame) -> DataFrame:
    """(shard, segment, first): ids of all segments before. Sums by shard first, one row for each shard."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_own"))
    return own.join(before, "shard").select("shard", "segment", (F.col("_before") + F.col("_own")).alias("first"))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the payloads."""
    ship_package(files.sparkSession)
    schema = T._parse_datatype_string("shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, ends, ids = read_payload(batch.column("payload")[k].as_buffer())
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = (4 * ends).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                same = lambda name, n=len(doc_ids), k=k: pa.array(np.full(n, batch.column(name)[k].as_py(), np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same("shard"), same("segment"), doc_ids, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    names=schema.names,
                )

    local = files.select("shard", "segment", "payload").mapInArrow(kernel, schema)
    return local.join(starts(files), ["shard", "segment"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
