"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Documents with the same shingle set are one class from the start. Every class posts itself under the
pairs (coordinate, value) of its signature. Two sets of the wanted similarity agree in at least
``MATCHES`` of the ``COORDINATES`` coordinates, so they meet within the ``COORDINATES - MATCHES + 1``
rarest pairs of either one (one order for all, by list length): only these prefixes are merged, the
long lists behind them are skipped and merely counted when two signatures are compared. Pairs above
the match threshold are confirmed on the full shingle sets.

Groups of thousands of near copies must not become all their pairs. First each list is joined to one
of its members, another for each list; confirmed links give components. What is then left of a list
are the pairs across components, and all of these are tested: short lists by a join, long ones in
blocks of bounded size, where every pair comes out of one list only. Pairs inside a component cannot
change the result, so components are those of all links.

Null or wordless texts have an empty set, are linked with nothing and stay. Rows without a doc_id
are never linked. Rows that share a doc_id are judged by their own texts under that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.flattext import (
    NOT_SPACE,
    lower_ascii,
    mix,
    offsets_of,
    pieces,
    ragged,
    span_hashes,
    spans,
    window_hashes,
)
from skylattice.session import materialize, ship_package

SHINGLE = 5
COORDINATES = 48
#: At similarity 0.75 a pair agrees in 36 coordinates on average, deviation 3: 24 lose about 1 pair in 20 000.
MATCHES = 24
#: Lists up to this length are paired by a join, longer ones in blocks.
SHORT_LIST = 64
#: Shingles that a block of a long list holds on either side.
LEFT_BLOCK, RIGHT_BLOCK = 500_000, 1_000_000

_SEEDS = mix(np.arange(11, 11 + COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one row after the other, and n + 1 offsets."""
    data = lower_ascii(data)
    begins, ends, rows = spans(data, starts, NOT_SPACE)
    words = span_hashes(data, begins, ends)
    counts = np.diff(rows)
    n_windows = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = offsets_of(n_windows)
    values = np.empty(offsets[-1], np.uint64)
    long_rows = np.flatnonzero(counts >= SHINGLE)
    full = window_hashes(words, SHINGLE)
    source, _ = ragged(np.r_[rows, 0], long_rows)
    of_row = np.repeat(long_rows, counts[long_rows])
    inside = source < rows[of_row + 1] - SHINGLE + 1
    target, _ = ragged(offsets, long_rows)
    values[target] = full[source[inside]]
    for size in range(1, SHINGLE):
        few = np.flatnonzero(counts == size)
        if len(few):
            values[offsets[few]] = mix(window_hashes(words, size)[rows[few]] + np.uint64(size))
    cuts = offsets.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[offsets[:-1][n_windows > 0]] = True
    return values[fresh], offsets_of(fresh)[offsets]


def _set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    keys = []
    for seed in (0x1B873593, 0x85EBCA6B):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + np.uint64(seed)), out=total[1:])
        keys.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return keys[0], keys[1]


def min_hashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signature of each row as int32; rows with an empty set get zeros."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.int32)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        at = offsets[filled]
        for k, seed in enumerate(_SEEDS):
            least = np.minimum.reduceat(values * seed, at)
            out[filled, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, two keys of the shingle set, and its signature, for every row."""
    ship_package(docs.sparkSession)
    schema = T._parse_datatype_string("doc_id long, n_shingles long, set_a long, set_b long, signature array<int>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                values, offsets = shingle_sets(data, starts)
                set_a, set_b = _set_keys(values, offsets)
                flat = min_hashes(values, offsets)
                ends = np.arange(0, flat.size + 1, COORDINATES, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), pa.array(np.diff(offsets)), pa.array(set_a), pa.array(set_b), lists],
                    names=schema.names,
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The whole shingle sets of the documents in ``wanted`` (node)."""
    schema = T._parse_datatype_string("node long, shingles array<long>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                values, offsets = shingle_sets(data, starts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, end - first), lists], names=schema.names)

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return rows.join(wanted, "node", "left_semi").mapInArrow(kernel, schema)


def _postings(classes: DataFrame) -> DataFrame:
    """(node, token, mask): the lists of every class's prefix. mask has a bit for each prefix coordinate."""
    tokens = classes.select("node", F.posexplode("signature").alias("c", "v")).select(
        "node", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token")
    )
    lists = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    prefix = COORDINATES - MATCHES + 1
    ranked = tokens.join(lists, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    # Pairs that no other class has come first in the order and lead nowhere.
    used = F.slice("own", 1, F.greatest(F.lit(0), F.lit(prefix - COORDINATES) + F.size("own")))
    bit = lambda x: F.pow(F.lit(2.0), F.shiftright(x["token"], 32)).cast("long")  # noqa: E731  exact below 2**53
    return (
        ranked.select("node", used.alias("used"))
        .select("node", "used", F.aggregate("used", F.lit(0).cast("long"), lambda acc, x: acc + bit(x)).alias("mask"))
        .select("node", "mask", F.explode("used").alias("x"))
        .select("node", "mask", F.col("x.token").alias("token"), F.col("x.n").alias("n"))
    )


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of sets of comparable size whose signatures agree in enough coordinates."""
    own = classes.select("node", "signature", "n_shingles")
    both = pairs.join(own.toDF("a", "sa", "na"), "a").join(own.toDF("b", "sb", "nb"), "b")
    both = both.filter(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    agree = F.aggregate(
        F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda total, one: total + one
    )
    return both.filter(agree >= MATCHES).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union of the full sets."""
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.filter(100 * common >= 75 * (F.size("xa") + F.size("xb") - common)).select("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches.

    Every round takes the least label among the neighbours and then the label of the label; each
    round is a table in the shared folder, so lost executors cost no earlier round.
    """
    arcs = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = arcs.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("next"))
        jumped = told.join(labels.toDF("next", "far"), "next", "left")
        moved = materialize(jumped.select("node", "old", F.coalesce(F.least("next", "far"), "next").alias("label")))
        labels = moved.select("node", "label")
        if not moved.filter("label <> old").limit(1).count():
            return labels


def _block_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links across components of long lists.

    members: token, node, label, mask, top (label of the list's largest component). A list is dealt
    into blocks of bounded total set size on both sides, left only what is outside its largest
    component, and each task holds one block of either side. A pair is taken in the list of its
    lowest common prefix coordinate only, and only if its signatures agree; it is then confirmed on
    the full sets there and then, so nothing but links leaves the task.
    """
    rows = members.join(classes.select("node", "signature", "n_shingles"), "node")
    outside = F.when(F.col("label") != F.col("top"), F.col("n_shingles"))
    sizes = rows.groupBy("token").agg(F.sum("n_shingles").alias("all"), F.sum(outside).alias("outside"))
    rows = rows.join(sizes, "token").join(sets, "node")
    n_left = F.ceil(F.col("outside") / LEFT_BLOCK).cast("int")
    n_right = F.ceil(F.col("all") / RIGHT_BLOCK).cast("int")
    own = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.filter("label <> top").select("*", F.pmod(own, n_left).cast("int").alias("i"), every(n_right).alias("j"), F.lit(True).alias("is_left"))
    right = rows.select("*", every(n_left).alias("i"), F.pmod(own, n_right).cast("int").alias("j"), F.lit(False).alias("is_left"))
    columns = ["token", "i", "j", "is_left", "node", "label", "mask", "signature", "shingles"]

    def links(table: pa.Table) -> pa.Table:
        side = table.column("is_left").to_numpy()
        node, label, mask = (table.column(c).to_numpy() for c in ("node", "label", "mask"))
        signature = table.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        lists = table.column("shingles").combine_chunks()
        offsets = offsets_of(lists.value_lengths().to_numpy())
        known, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = np.diff(offsets)
        place = int(table.column("token")[0].as_py()) >> 32
        below = (1 << place) - 1
        bits = np.int64(1) << np.arange(COORDINATES, dtype=np.int64)
        right = np.flatnonzero(~side)
        marked = np.zeros(len(known), bool)
        found_a, found_b = [], []
        for x in np.flatnonzero(side):
            near = right[(label[right] != label[x]) & (4 * np.minimum(size[right], size[x]) >= 3 * np.maximum(size[right], size[x]))]
            equal = signature[near] == signature[x]
            common = (equal * bits).sum(1) & mask[near] & mask[x]
            near = near[(equal.sum(1) >= MATCHES) & ((common & below) == 0)]
            if not len(near):
                continue
            own_set = flat[offsets[x] : offsets[x + 1]]
            marked[own_set] = True
            at, lengths = ragged(offsets, near)
            both = np.add.reduceat(marked[flat[at]].astype(np.int64), offsets_of(lengths)[:-1])
            marked[own_set] = False
            linked = near[100 * both >= 75 * (size[near] + size[x] - both)]
            found_b.append(node[linked])
            found_a.append(np.full(len(linked), node[x]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    dealt = left.select(columns).unionByName(right.select(columns))
    return dealt.groupBy("token", "i", "j").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept."""
    signed = materialize(signatures(docs, text=text, doc_id=doc_id))
    key = ["set_a", "set_b", "n_shingles"]
    grouped = materialize(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    )
    classes = grouped.select("node", "signature", "n_shingles")
    posts = materialize(_postings(classes))
    sets = materialize(full_sets(docs, posts.select("node").distinct(), text=text, doc_id=doc_id))

    # One member for each list, another for each, to be joined to all others of the list.
    hubs = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", "token"), "node"))["node"].alias("hub"))
    first = materialize(_similar(_ordered(posts.join(hubs, "token"), "node", "hub"), classes))
    labels = connected(_confirmed(first, sets))

    # All pairs across components that share a prefix list.
    placed = posts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    largest = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = (
        largest.groupBy("token")
        .agg(F.max(F.struct("size", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members"))
        .filter("parts > 1 AND members > 2")
        .drop("parts")
    )
    open_lists = materialize(placed.drop("n").join(mixed, "token"))
    short = open_lists.filter(F.col("members") <= SHORT_LIST).select("token", "node", "label")
    other = short.toDF("token", "node_b", "label_b")
    across = _ordered(short.join(other, "token").filter("label < label_b"), "node", "node_b").join(first, ["a", "b"], "left_anti")
    rest = materialize(_similar(across, classes))
    links = _confirmed(rest, sets).unionByName(
        _block_links(open_lists.filter(F.col("members") > SHORT_LIST), classes, sets)
    )
    by_node = lambda side: labels.toDF(side, f"label_{side}")
    contracted = (
        links.join(by_node("a"), "a", "left")
        .join(by_node("b"), "b", "left")
        .select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
        .filter("a <> b")
    )
    merged = connected(contracted).toDF("label", "root")
    placed_classes = (
        grouped.select(*key, "node")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(merged, "label", "left")
        .select(*key, F.col("node").alias("class_id"), F.coalesce("root", "label").alias("component_id"))
    )
    rows = signed.select("doc_id", *key).join(placed_classes, key, "left")
    linked = F.col("doc_id").isNotNull() & F.col("component_id").isNotNull()
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller id."""
    version = F.xxhash64(text)
    versions = docs.groupBy(doc_id).agg(F.min(version).alias("low"), F.max(version).alias("high"))
    if not versions.filter(F.col(doc_id).isNotNull() & (F.col("low") < F.col("high"))).head(1):
        found = near_duplicates(docs, text=text, doc_id=doc_id)
        gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
        return docs.join(gone, doc_id, "left_anti")
    # An id with several texts would be one node: number the texts in the order of their ids instead.
    own = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), version.alias("_version")).distinct()
    numbers = materialize(own.orderBy("_id", "_version").withColumn("_node", F.monotonically_increasing_id()))
    same = (F.col(doc_id) == F.col("_id")) & (version == F.col("_version"))
    found = near_duplicates(docs.join(numbers, same, "left"), text=text, doc_id="_node").filter(~F.col("kept")).select("doc_id", "component_id").distinct()
    first = numbers.select(F.col("_node").alias("component_id"), F.col("_id").alias("_first"))
    gone = found.join(numbers, F.col("doc_id") == F.col("_node")).join(first, "component_id").filter("_id <> _first").select("_id", "_version")
    return docs.join(gone, same, "left_anti")
