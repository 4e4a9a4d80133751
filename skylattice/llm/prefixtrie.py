"""A trie of conversation prefixes, from ternary search trees over range shards.

A turn's id is a 128-bit digest of its role and text. Conversations with equal turns are one sequence with
members; sequences are ordered by their ids and cut into range shards. Each shard numbers the ids it holds and
puts its sequences into a ternary search tree, medians first, which balances the tree of the alternatives at
every node. An iterative traversal from the last node to the first then adds up members, children, leaves and
savings. Only nodes on the way to a shard's first or last sequence can go on in another shard. Those two ways
leave the shard as two rows, with what hangs on them added up, and one pass over these rows in order of the
shards merges equal nodes on a stack as deep as the longest way.

Turns are ordered by turn, null first, and where that is equal by id. Null roles and texts are empty. Rows
without a conv_id belong to no conversation. Repeated rows are turns of their own. Other columns are not read.
Without conversations there is no node, and no root either.

The ids and sizes of one conversation (24 bytes a turn) are held by one task; its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.session import materialize, ship_package

#: Turns of distinct sequences in one shard, about.
SHARD_TURNS = 200_000
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id, size: the turns of every conversation in order, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.unhex(F.substring(digest, 1, 32)).alias("id"), F.octet_length(text).cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "id")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "id", "size")


def shared_starts(rows: DataFrame, *, every: int = 5, longest: int = 9) -> DataFrame:
    """conv_id, turns: every conversation with the first h turns of its base, then its own turns after the first h.

    The base of c is c - c % ``every``, and h is the CRC of c in decimal modulo ``longest``.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % longest
    turn = F.struct("place", "id", "size")
    bases = (
        rows.filter((F.col("conv_id") % every == 0) & (F.col("place") < longest))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("start"))
    )
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("place") > shared, turn))).alias("own"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    start = F.coalesce(F.filter("start", lambda t: t["place"] <= shared), F.array().cast("array<struct<place:int,id:binary,size:bigint>>"))
    return joined.select("conv_id", F.concat(start, "own").alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """ids, sizes, n, least, ends: the distinct sequences, their members' number, smallest id and digest."""
    keyed = conversations.select(
        "conv_id",
        F.transform("turns", lambda t: t["id"]).alias("ids"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    ).withColumn("key", F.unhex(F.sha2(F.concat_ws("", F.transform("ids", F.hex)), 256)))
    keyed = materialize(keyed)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key and conversation, so one digest is open at a time."""
        key, n, least, digest = None, 0, None, None
        for batch in batches:
            done = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((key, n, least, digest.hexdigest()))
                    key, n, least, digest = own, 0, conv, hashlib.sha256()
                digest.update((f",{conv}" if n else str(conv)).encode())
                n += 1
            yield _batch(done)
        yield _batch([(key, n, least, digest.hexdigest())] if key is not None else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "least", "ends"])

    ordered = keyed.select("key", F.col("conv_id").cast("long").alias("conv_id")).repartition("key").sortWithinPartitions("key", "conv_id")
    counted = ordered.mapInArrow(members, "key binary, n long, least long, ends string")
    distinct = keyed.groupBy("key").agg(F.min(F.struct("ids", "sizes")).alias("s")).select("key", "s.*")
    return distinct.join(counted, "key").drop("key")


class TernaryTree:
    """Sequences of numbers. Node 0 is the root; every other node has its number, and is found among the
    alternatives under its parent by a binary tree of ``low`` and ``high`` links that starts at ``equal``."""

    def __init__(self) -> None:
        self.number, self.low, self.high, self.equal, self.parent = [-1], [0], [0], [0], [-1]

    def _new(self, number: int, parent: int) -> int:
        self.number.append(number)
        self.parent.append(parent)
        for links in (self.low, self.high, self.equal):
            links.append(0)
        return len(self.number) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """The nodes on the way, from the root."""
        way = [0]
        for number in sequence:
            here = way[-1]
            links, at = self.equal, here
            while (node := links[at]) and self.number[node] != number:
                links, at = (self.low if number < self.number[node] else self.high), node
            if not node:
                node = links[at] = self._new(number, here)
            way.append(node)
        return way


def medians_first(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle first, then the middles of both halves, and so on."""
    ranges = [(0, n)]
    while ranges:
        later = []
        for low, high in ranges:
            if low < high:
                middle = (low + high) // 2
                yield middle
                later += [(low, middle), (middle + 1, high)]
        ranges = later


NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
#: Where a node's parent is on one of the two ways, it is named by shard and way.
PARENT = [("shard", pa.int32()), ("way", pa.int32())]
#: One row for each way: its ids and the sums of its nodes, from the root on; n is 0 where the shard's other way has the node.
WAY = [("ids", pa.list_(pa.binary())), *((name, pa.list_(pa.int64())) for name in ("sizes", "n", "least", "children", "leaves", "saved")), ("ends", pa.list_(pa.string()))]
SHARD_SCHEMA = pa.schema([*NODE, *PARENT, *WAY])
_SPARK = {"int32": "int", "int64": "long", "string": "string", "list<item: binary>": "array<binary>", "list<item: int64>": "array<long>", "list<item: string>": "array<string>"}


def _schema(fields) -> str:
    return ", ".join(f"{name} {_SPARK[str(kind)]}" for name, kind in fields)


def shard_nodes(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes that no other shard can have, and the two ways; ``table`` has the shard's sequences in order."""
    ids, sizes = (table.column(k).combine_chunks() for k in ("ids", "sizes"))
    offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    coded = ids.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    numbers = rank[coded.indices.to_numpy()].tolist() if len(coded) else []
    flat_sizes = sizes.flatten().to_pylist()
    n_of, least_of, ends_of = (table.column(k).to_pylist() for k in ("n", "least", "ends"))

    tree, ways, ending = TernaryTree(), {}, {}
    size = [0]
    last = len(n_of) - 1
    for k in medians_first(len(n_of)):
        a, b = offsets[k], offsets[k + 1]
        way = tree.insert(numbers[a:b])
        if fresh := len(tree.number) - len(size):
            size += flat_sizes[b - fresh : b]
        ending[way[-1]] = k
        if k in (0, last):
            ways[k] = way
    nodes = len(tree.number)
    n, least = [0] * nodes, [None] * nodes
    children, leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    on_way = {node: (which, depth) for which, k in reversed(list(enumerate(dict.fromkeys((0, last))))) for depth, node in enumerate(ways[k])}
    depth_of = [0] * nodes
    for node in range(1, nodes):
        depth_of[node] = depth_of[tree.parent[node]] + 1
    # A node comes after its parent, so from the last to the first everything below a node is complete.
    for node in range(nodes - 1, -1, -1):
        if (k := ending.get(node)) is not None:
            n[node] += n_of[k]
            least[node] = least_of[k] if least[node] is None else min(least[node], least_of[k])
        above = tree.parent[node]
        if above >= 0:
            n[above] += n[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
        if node in on_way:
            continue
        leaves[node] = leaves[node] if children[node] else 1
        saved[node] += (n[node] - 1) * size[node]
        children[above] += 1
        leaves[above] += leaves[node]
        saved[above] += saved[node]
    ends = lambda node: ends_of[ending[node]] if node in ending else None

    inner = [node for node in range(nodes) if node not in on_way]
    places = [on_way.get(tree.parent[node]) for node in inner]
    columns = {
        "conv_id": [least[v] for v in inner],
        "depth": [depth_of[v] for v in inner],
        "parent_conv_id": [None if p else least[tree.parent[v]] for v, p in zip(inner, places, strict=True)],
        "n_convs": [n[v] for v in inner],
        "n_children": [children[v] for v in inner],
        "n_leaves": [leaves[v] for v in inner],
        "saved_tokens": [saved[v] for v in inner],
        "ends_sha256": [ends(v) or EMPTY for v in inner],
        "shard": [shard if p else None for p in places],
        "way": [p[0] if p else None for p in places],
    }
    yield from _padded(columns).to_batches(max_chunksize=10_000)
    for which, k in enumerate(dict.fromkeys((0, last))):
        way = ways[k]
        mine = [on_way[v][0] == which for v in way]
        part = lambda values, none=0: [values[v] if m else none for v, m in zip(way, mine, strict=True)]  # noqa: E731, B023
        row = {"shard": shard, "way": which, "ids": ids[k].as_py(), "sizes": [0, *sizes[k].as_py()], "n": part(n), "least": part(least, None)}
        row |= {"children": part(children), "leaves": part(leaves), "saved": part(saved), "ends": [ends(v) if m else None for v, m in zip(way, mine, strict=True)]}
        yield from _padded({name: [value] for name, value in row.items()}).to_batches()


def _padded(columns: dict[str, list]) -> pa.Table:
    rows = len(next(iter(columns.values())))
    return pa.table([pa.array(columns.get(f.name, [None] * rows), f.type) for f in SHARD_SCHEMA], schema=SHARD_SCHEMA)


class _Open:
    """A node on the stack of the merge."""

    def __init__(self, size: int) -> None:
        self.size, self.n, self.least, self.children, self.leaves, self.saved, self.ends = size, 0, None, 0, 0, 0, None
        self.ways: list[tuple[int, int]] = []
        self.below: list[tuple] = []

    def add(self, way: dict, depth: int) -> None:
        if not way["n"][depth]:
            return
        self.n += way["n"][depth]
        self.least = way["least"][depth] if self.least is None else min(self.least, way["least"][depth])
        self.children += way["children"][depth]
        self.leaves += way["leaves"][depth]
        self.saved += way["saved"][depth]
        self.ends = self.ends or way["ends"][depth]
        if way["children"][depth]:
            self.ways.append((way["shard"], way["way"]))


def merged_ways(ways: Iterator[dict]) -> Iterator[tuple]:
    """Rows of NODE and PARENT for all nodes on ways: complete nodes, and (conv_id, depth, shard, way) for parents named so."""
    stack: list[_Open] = []
    before: list[bytes] = []

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n - 1) * node.size
            for row in node.below:
                yield (*row[:2], node.least, *row[3:], None, None)
            for way in node.ways:
                yield (node.least, len(stack), None, None, None, None, None, None, *way)
            mine = (node.least, len(stack), None, node.n, node.children, leaves, saved, node.ends or EMPTY)
            if stack:
                above = stack[-1]
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                above.below.append(mine)
            else:
                yield (*mine, None, None)

    for way in ways:
        same = 0
        while same < min(len(before), len(way["ids"])) and before[same] == way["ids"][same]:
            same += 1
        yield from close(same + 1)
        for depth, size in enumerate(way["sizes"]):
            if depth == len(stack):
                stack.append(_Open(size))
            stack[depth].add(way, depth)
        before = way["ids"]
    yield from close(0)


def trie(found: DataFrame) -> DataFrame:
    """All nodes of the trie over distinct sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_package(found.sparkSession)
    found = materialize(found)
    turns = found.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-turns // SHARD_TURNS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), TaskContext.get().partitionId())

    ranged = found.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
    built = materialize(ranged.mapInArrow(build, _schema([*NODE, *PARENT, *WAY])))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = merged_ways(row for batch in batches for row in batch.to_pylist())
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == 10_000:
                yield _rows(held)
                held = []
        yield _rows(held)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        fields = [*NODE, *PARENT]
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    # Two rows a shard, whatever is in it.
    ways = built.filter("ids IS NOT NULL").select("shard", "way", *(name for name, _ in WAY))
    merged = materialize(ways.coalesce(1).sortWithinPartitions("shard", "way").mapInArrow(merge, _schema([*NODE, *PARENT])))
    names = [name for name, _ in NODE]
    parents = merged.filter("shard IS NOT NULL").select("shard", "way", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_above"))
    inner = built.filter("ids IS NULL").join(parents, ["shard", "way", "depth"], "left")
    above = F.coalesce("parent_conv_id", "_above").alias("parent_conv_id")
    return inner.select(*(above if n == "parent_conv_id" else n for n in names)).unionByName(merged.filter("shard IS NULL").select(*names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations that ``shared_starts`` builds."""
    return trie(sequences(shared_starts(turn_rows(turns))))
