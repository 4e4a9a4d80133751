"""URL rules by a Bloom filter cascade: exact membership without a join.

A rule is (host, path, action): it fits its host and all subdomains where the url's path starts with
the rule's path; the longest fitting rule (characters of host and path, then of host) decides. The
keys of a url are all its host suffixes with all its path beginnings of a length that some rule has.

Level 1 of a cascade holds the listed keys. The corpus's complete key universe is known, so the keys
of the universe that level 1 takes for listed though they are not can be told and are held in level 2,
the listed ones that level 2 takes in level 3, and so on until nothing is left. For every key of the
universe the first level that does not hold it decides exactly. Only the keys that pass a level go on
to the next, so the work after level 1 is small. There is one cascade for each action.

The bits of a level are set in tasks and combined by word, so a level's size in bits is
``BITS_PER_KEY`` times its number of keys and nothing else reaches the driver. Levels are broadcast;
keys are dealt into as many shards by hash as keep each level of a shard within ``MAX_LEVEL_BYTES``,
and the urls pass once over each shard. Null urls and urls without ``://`` have an empty host and
path and fit no rule. Rules with nulls or unknown actions are ignored, repeated rules count once; of
a key with both actions, block wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.flattext import mix, offsets_of
from skylattice.session import materialize, ship_package

BITS_PER_KEY = 12
HASHES = 6
MAX_LEVEL_BYTES = 64 << 20
#: Actions, the winning one first where a key is listed under both.
ACTIONS = ("block", "allow")
_NONE = np.int32(1 << 30)

Level = tuple[int, int, np.ndarray]  # number, bits, words


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    key = F.concat(host, F.lit("\n"), path)  # with the host's length the two parts cannot shift
    return F.xxhash64(key, F.length(host)), F.xxhash64(F.length(host), key)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys of a url, the longest first: host suffixes at dots with path beginnings of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    begins = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)] or [F.lit(None).cast("string")]),
        lambda x: x.isNotNull(),
    )
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("size"), (-F.length(s)).alias("host_size"), s.alias("host"), p.alias("path")))))
    known = F.when(F.length(host) > 0, F.array_sort(every)).otherwise(F.slice(F.array_sort(every), 1, 0))
    return known


def _bit_places(h1: np.ndarray, h2: np.ndarray, number: int, bits: int) -> np.ndarray:
    """Places of the keys' bits; every level hashes anew, else two keys could stand in for each other for ever."""
    seed = np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    first, second = mix(h1.view(np.uint64) + seed), mix(h2.view(np.uint64) ^ seed) | np.uint64(1)
    return (first + np.arange(HASHES, dtype=np.uint64)[:, None] * second) % np.uint64(bits)


def _passes(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    number, bits, words = level
    places = _bit_places(h1, h2, number, bits)
    return ((words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)


def listed(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: the first level that does not hold a key decides."""
    result = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for number, level in enumerate(levels, start=1):
        if not len(open_):
            break
        held = _passes(level, h1[open_], h2[open_])
        result[open_[~held]] = number % 2 == 0
        open_ = open_[held]
    result[open_] = len(levels) % 2 == 1
    return result


def _built(keys: DataFrame, number: int, bits: int) -> Level:
    """One level over keys (h1, h2): words set in each task, combined by word."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _bit_places(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), number, bits).reshape(-1)
            places = np.unique(places)
            word, first = np.unique(places >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select("h1", "h2").mapInArrow(kernel, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).collect()
    words = np.zeros(-(-bits // 64), np.uint64)
    for row in rows:
        words[row.word] = np.uint64(row.value & 0xFFFFFFFFFFFFFFFF)
    return number, bits, words


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(shared.value, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())))

    return keys.mapInArrow(kernel, keys.schema)


def cascade(positives: DataFrame, negatives: DataFrame) -> list[Level]:
    """The levels over two disjoint tables of keys (h1, h2)."""
    levels: list[Level] = []
    hold, against = positives, negatives
    count = hold.count()
    while count:
        level = _built(hold, len(levels) + 1, max(64, BITS_PER_KEY * count))
        levels.append(level)
        hold, against = materialize(_passing(against, level)), hold
        count = hold.count()
    return levels


def url_keys(urls: DataFrame, rules: DataFrame, *, url: str = "url") -> DataFrame:
    """``urls`` with host, path and keys: array of (host, path, h1, h2), the longest key first."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None]  # at most the longest path
    parts = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ordered = parts.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    hashed = F.transform(
        "_keys",
        lambda k: F.struct(k["host"].alias("host"), k["path"].alias("path"), _hashes(k["host"], k["path"])[0].alias("h1"), _hashes(k["host"], k["path"])[1].alias("h2")),
    )
    return ordered.withColumn("keys", hashed).drop("_keys")


def _decide(keyed: DataFrame, cascades: list[list[Level]], shard: int, shards: int) -> DataFrame:
    """Lower ``place`` (of the first listed key) and its ``action`` by the keys of one shard."""
    shared = keyed.sparkSession.sparkContext.broadcast(cascades)
    at = keyed.columns.index("place"), keyed.columns.index("action")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten()
            h1, h2 = flat.field("h1").to_numpy(), flat.field("h2").to_numpy()
            ends = offsets_of(lists.value_lengths().to_numpy())
            own = np.flatnonzero(h1.view(np.uint64) % np.uint64(shards) == shard)
            action = np.full(len(h1), -1, np.int32)
            for number in reversed(range(len(ACTIONS))):  # the winning action is written last
                action[own[listed(shared.value[number], h1[own], h2[own])]] = number
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            hits = np.flatnonzero(action >= 0)
            first = np.full(batch.num_rows, _NONE, np.int32)
            np.minimum.at(first, row[hits], (hits - ends[row[hits]]).astype(np.int32))
            place, chosen = (np.array(batch.column(k).to_numpy()) for k in at)
            better = first < place
            place[better] = first[better]
            chosen[better] = action[ends[:-1][better] + first[better]]
            columns = list(batch.columns)
            columns[at[0]], columns[at[1]] = pa.array(place), pa.array(chosen)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return keyed.mapInArrow(kernel, keyed.schema)


def judged(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (host and path of the deciding rule, else null) and verdict.

    rules: host, path, action.
    """
    new = {"host", "path", "keys", "place", "action", "rule", "verdict", "_keys"}
    if clash := new & set(urls.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; rename them first")
    ship_package(urls.sparkSession)
    known = rules.select("host", "path", "action").dropna().filter(F.col("action").isin(*ACTIONS)).distinct()
    h1, h2 = _hashes(F.col("host"), F.col("path"))
    known = materialize(known.select("host", "path", "action", h1.alias("h1"), h2.alias("h2")))
    keyed = url_keys(urls, known, url=url)
    universe = materialize(keyed.select(F.explode_outer("keys").alias("k")).filter("k IS NOT NULL").select("k.h1", "k.h2").distinct())
    shards = max(1, -(-universe.count() * BITS_PER_KEY // (8 * MAX_LEVEL_BYTES)))
    decided = keyed.withColumn("place", F.lit(int(_NONE))).withColumn("action", F.lit(-1))
    for shard in range(shards):
        mine = universe.filter(_shard(shards) == shard)
        cascades = []
        for action in ACTIONS:
            keys = known.filter(F.col("action") == action).select("h1", "h2")
            cascades.append(cascade(materialize(mine.join(keys, ["h1", "h2"], "left_semi")), mine.join(keys, ["h1", "h2"], "left_anti")))
        decided = _decide(decided, cascades, shard, shards)
    key = F.try_element_at("keys", F.col("place") + 1)
    names = F.array(*[F.lit(a) for a in ACTIONS])
    return decided.select(
        *urls.columns,
        "host",
        "path",
        F.when(F.col("action") >= 0, F.concat(key["host"], key["path"])).alias("rule"),
        F.coalesce(F.try_element_at(names, F.col("action") + 1 + F.when(F.col("action") < 0, 100).otherwise(0)), F.lit(default)).alias("verdict"),
    )


def _shard(shards: int) -> Column:
    """The key's shard, with h1 taken as an unsigned number."""
    wrapped = F.when(F.col("h1") < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0))
    return F.pmod(F.pmod("h1", F.lit(shards)) + wrapped, F.lit(shards))
