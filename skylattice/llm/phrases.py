"""Exact phrase and proximity search over a stored positional inverted index.

The index is cut by documents: each row is one segment of about a megabyte of text, whole documents
only, with its sorted terms, the posting list of every term and the bounds of its documents. Building
it is one narrow pass and searching it another; neither shuffles text or postings, and no list grows
beyond its segment. In a segment a phrase takes the postings of its rarest term, shifts them by the
term's place to candidate starts, and intersects these with the shifted lists of the other terms in
order of rarity. A phrase with a term that the segment lacks costs nothing more.

Queries are taken in blocks of bounded size, each against all segments, so their number is free.
Null texts have no words; repeated rows are documents of their own; a document longer than a segment
is a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.flattext import ALNUM, lower_ascii, offsets_of, pieces, ragged, span_hashes, spans, string_bytes
from skylattice.session import materialize, ship_package

SEGMENT_BYTES = 1 << 20
#: Bytes of query texts that one block holds; a block is broadcast.
BLOCK_BYTES = 8 << 20
#: Words of a window of the contamination rule.
WINDOW = 13

_INDEX = "terms binary, list_ends binary, positions binary, doc_starts binary"


def term_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased alphanumeric words of each row, and n + 1 word offsets."""
    data = lower_ascii(data)
    begins, ends, rows = spans(data, starts, ALNUM)
    return span_hashes(data, begins, ends), rows


def posting_lists(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, the end of each list, and the positions of all lists in order."""
    order = np.argsort(terms, kind="stable")
    ordered = terms[order]
    last = np.flatnonzero(np.r_[ordered[1:] != ordered[:-1], True]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[last], (last + 1).astype(np.int32), order.astype(np.int32)


def build_index(docs: DataFrame, *, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The stored index: ``segment``, ``docs`` (array of the key columns in row order) and the segment's tables."""
    ship_package(docs.sparkSession)
    key_type = T.StructType([docs.schema[k] for k in keys])
    schema = T.StructType([T.StructField("docs", T.ArrayType(key_type)), *T._parse_datatype_string(_INDEX).fields])
    narrow = docs.select(F.struct(*keys).alias("key"), F.col(text).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("key")
            for first, end, data, starts in pieces(batch.column("text"), SEGMENT_BYTES):
                terms, rows = term_hashes(data, starts)
                tables = [*posting_lists(terms), rows.astype(np.int32)]
                own = names.slice(first, end - first)
                docs_column = pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), own)
                yield pa.RecordBatch.from_arrays(
                    [docs_column, *(pa.array([t.tobytes()], pa.binary()) for t in tables)], names=schema.names
                )

    segments = narrow.mapInArrow(kernel, schema)
    return materialize(segments.withColumn("segment", F.monotonically_increasing_id()))


def indexed_documents(index: DataFrame) -> DataFrame:
    """One row per indexed document: segment, row in it, its key columns, n_words."""
    ship_package(index.sparkSession)
    key_type = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()),
                           T.StructField("key", key_type), T.StructField("n_words", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = batch.column("docs").slice(k, 1).flatten()
                rows = np.frombuffer(batch.column("doc_starts")[k].as_buffer(), np.int32)
                n = len(keys)
                segment = np.full(n, batch.column("segment")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment), pa.array(np.arange(n, dtype=np.int32)), keys, pa.array(np.diff(rows).astype(np.int64))],
                    names=schema.names,
                )

    return index.select("segment", "docs", "doc_starts").mapInArrow(kernel, schema).select("segment", "row", "key.*", "n_words")


class Phrases:
    """Distinct phrases of a block of query texts; each knows the texts it comes from."""

    def __init__(self, texts: pa.Array, window: int):
        data, starts = string_bytes(texts)
        terms, rows = term_hashes(data, starts)
        counts = np.diff(rows)
        sizes = np.minimum(counts, window)
        per_item = np.where(counts > 0, counts - sizes + 1, 0)
        item = np.repeat(np.arange(len(counts)), per_item)
        begin = np.repeat(rows[:-1] - offsets_of(per_item)[:-1], per_item) + np.arange(len(item))
        length = sizes[item] if len(item) else np.zeros(0, np.int64)
        self.vocabulary, coded = np.unique(terms, return_inverse=True)
        places = np.arange(window)
        inside = places[None, :] < length[:, None]
        at = np.where(inside, begin[:, None] + places[None, :], 0)
        table = np.where(inside, coded[at] if len(coded) else -1, -1).reshape(len(item), window)
        self.table, which = np.unique(table, axis=0, return_inverse=True) if len(item) else (table, item)
        self.lengths = (self.table >= 0).sum(1)
        order = np.lexsort((item, which.reshape(-1)))
        pairs = np.stack([which.reshape(-1)[order], item[order]], 1)
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]] if len(pairs) else pairs.reshape(0, 2)
        self.items = pairs[:, 1]
        self.item_ends = np.searchsorted(pairs[:, 0], np.arange(len(self.table) + 1))


def find(phrases: Phrases, terms, list_ends, positions, doc_starts, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in one segment: phrase, row and first position (in the segment) of each."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(phrases.table):
        return none, none, none
    at = np.minimum(np.searchsorted(terms, phrases.vocabulary), len(terms) - 1)
    known = terms[at] == phrases.vocabulary
    begins = np.r_[0, list_ends[:-1]].astype(np.int64)
    count = np.where(known, list_ends[at] - begins[at], 0)
    used = phrases.table >= 0
    rarity = np.where(used, count[phrases.table], np.iinfo(np.int64).max)
    alive = np.flatnonzero(rarity.min(1) > 0)
    if not len(alive):
        return none, none, none
    order = np.argsort(rarity[alive], axis=1, kind="stable")
    table = phrases.table[alive]
    rarest = order[:, 0]
    lists = at[table[np.arange(len(alive)), rarest]]
    places, sizes = ragged(np.r_[begins, len(positions)], lists)
    length = phrases.lengths[alive]
    shifts = np.arange(-slop, slop + 1)
    own = np.repeat(np.repeat(np.arange(len(alive)), sizes), len(shifts))
    centre = np.repeat(positions[places].astype(np.int64), len(shifts))
    start = centre - rarest[own] + np.tile(shifts, len(places))
    row = np.searchsorted(doc_starts, centre, "right") - 1
    low, high = doc_starts[row].astype(np.int64), doc_starts[row + 1].astype(np.int64)
    fits = (start >= low - slop) & (start + length[own] <= high + slop)
    own, start, low, high, row = own[fits], start[fits], low[fits], high[fits], row[fits]
    keys = np.repeat(np.arange(len(terms), dtype=np.int64), list_ends - begins) << 32 | positions
    for k in range(1, table.shape[1]):
        place = order[own, k]
        open_ = k < length[own]
        near = at[np.where(open_, table[own, place], 0)].astype(np.int64) << 32
        first = np.maximum(start + place - slop, low)
        last = np.minimum(start + place + slop, high - 1)
        found = np.minimum(np.searchsorted(keys, near | np.maximum(first, 0)), len(keys) - 1)
        met = (keys[found] >= (near | np.maximum(first, 0))) & (keys[found] <= (near | np.maximum(last, 0))) & (last >= first)
        keep = met | ~open_
        own, start, low, high, row = own[keep], start[keep], low[keep], high[keep], row[keep]
        if not len(own):
            break
    return alive[own], row, start


def _merged(row, item, begin, end) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of the same row and item as one."""
    order = np.lexsort((begin, item, row))
    row, item, begin, end = row[order], item[order], begin[order], end[order]
    if not len(row):
        return row, item, begin, end
    fresh = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    cut = fresh.copy()
    cut[1:] |= begin[1:] > reach[:-1]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(row)] - 1
    return row[first], item[first], begin[first], reach[last]


def search(
    index: DataFrame, queries: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0
) -> DataFrame:
    """Spans of documents that match windows of the queries: segment, row, item, begin, end (word positions in the document).

    A window is ``window`` consecutive words of a query; a shorter query is one window. With ``slop``
    0 the words follow each other as in the query; otherwise each may stand up to ``slop`` words from
    its place. Windows of one query that overlap or touch in a document are one span.
    """
    spark = index.sparkSession
    ship_package(spark)
    queries = queries.select(F.col(item).alias("item"), F.col(text).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()),
                           T.StructField("item", queries.schema["item"].dataType),
                           T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    found = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        items = part.column("item").combine_chunks()
        shared = spark.sparkContext.broadcast((Phrases(part.column("text").combine_chunks(), window), items))

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, items = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    terms, list_ends, positions, doc_starts = (
                        np.frombuffer(batch.column(name)[k].as_buffer(), kind)
                        for name, kind in (("terms", np.uint64), ("list_ends", np.int32), ("positions", np.int32), ("doc_starts", np.int32))
                    )
                    which, row, start = find(phrases, terms, list_ends, positions, doc_starts, slop)
                    if not len(which):
                        continue
                    at, sizes = ragged(phrases.item_ends, which)
                    row, start, length = (np.repeat(x, sizes) for x in (row, start, phrases.lengths[which]))
                    begin = start - doc_starts[row]
                    total = doc_starts[row + 1] - doc_starts[row]
                    row, own, begin, end = _merged(
                        row, phrases.items[at], np.maximum(begin, 0), np.minimum(begin + length, total)
                    )
                    segment = np.full(len(row), batch.column("segment")[k].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(segment), pa.array(row.astype(np.int32)), items.take(pa.array(own)),
                         pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                        names=schema.names,
                    )

        one = index.select("segment", "terms", "list_ends", "positions", "doc_starts").mapInArrow(kernel, schema)
        found = one if found is None else found.unionByName(one)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, *, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: the keys, n_words, n_hit (words inside an occurrence of a window), items (sorted texts of ids), contaminated.

    Contaminated: at least one word in twenty is hit.
    """
    index = build_index(docs, keys=keys)
    spans_found = materialize(search(index, benchmark))
    place = ["segment", "row"]
    earlier = Window.partitionBy(*place).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(earlier), F.lit(0))
    covered = (
        spans_found.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", reach)))
        .groupBy(*place)
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    return (
        indexed_documents(index)
        .join(covered, place, "left")
        .select(
            *keys,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
