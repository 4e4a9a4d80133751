"""Per-entity history: previous row, last known value, newest row, sessions.

An entity may own a large share of all rows, so no window here spans a whole entity. Rows are cut
into time chunks; the last row of each chunk is found with a pre-aggregated ``max_by``, a window
over those few summaries links the chunks, and the row-level window only covers one chunk.

Rows without a key are the history of one more entity. Rows without a time come before the others of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions.timecols import micros

DEFAULT_CHUNK_SECONDS = 3600


def _chunk(ts: str, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).alias("_chunk")


def _with_carry(df: DataFrame, keys: list[str], order: list[str], carried: Column, ts: str, seconds: int) -> DataFrame:
    """Add ``_chunk`` and ``_before``: the last non-null ``carried`` struct of all earlier chunks."""
    df = df.withColumn("_chunk", _chunk(ts, seconds)).withColumn("_carried", carried)
    summary = df.groupBy(*keys, "_chunk").agg(
        F.max_by(
            "_carried", F.when(F.col("_carried").isNotNull(), F.struct(*order))
        ).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    # Null-safe, so that rows without a key or a time meet their own summary.
    own = [*keys, "_chunk"]
    summary = summary.withColumnsRenamed({c: f"_s_{i}" for i, c in enumerate(own)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s_{i}")) for i, c in enumerate(own)])
    return df.join(summary, same).drop(*[f"_s_{i}" for i in range(len(own))])


def with_previous(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    ts: str | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    name: str = "previous",
) -> DataFrame:
    """Add a struct with ``values`` of the entity's previous row (NULL for its first row)."""
    keys, order = list(keys), list(order)
    df = _with_carry(df, keys, order, F.struct(*values), ts or order[0], chunk_seconds)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return df.withColumn(name, F.coalesce(F.lag("_carried").over(within), "_before")).drop(
        "_chunk", "_carried", "_before"
    )


def with_last_known(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    ts: str | None = None,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    name: str = "last_known",
) -> DataFrame:
    """Add the entity's last non-null ``value`` up to and including each row."""
    keys, order = list(keys), list(order)
    carried = F.when(value.isNotNull(), F.struct(value.alias("v")))
    df = _with_carry(df, keys, order, carried, ts or order[0], chunk_seconds)
    so_far = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.last("_carried", ignorenulls=True).over(so_far), F.col("_before"))
    return df.withColumn(name, known["v"]).drop("_chunk", "_carried", "_before")


def latest_per_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, by ``order``; an aggregate with map-side combine, not a window."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def staleness_flags(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ttl_seconds: int,
    ts: str = "fetched_at",
    tie: Sequence[str] = (),
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Add ``age_seconds`` since the key's previous fetch and ``due``: refetch at ``ttl_seconds`` or first ever."""
    df = with_previous(
        df, keys=keys, order=[ts, *tie], values=[ts], ts=ts, chunk_seconds=chunk_seconds, name="_previous"
    )
    gap = (micros(ts) - micros(F.col("_previous")[ts])) / 1.0e6
    return (
        df.withColumn("age_seconds", gap)
        .withColumn("due", F.coalesce(F.col("age_seconds") >= ttl_seconds, F.lit(True)))
        .drop("_previous")
    )


def track_sessions(df: DataFrame, *, keys: Sequence[str], ts: str, gap_seconds: int = C.SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions per key that end once it is ``gap_seconds`` unseen: session_start, session_end, sightings.

    All rows within one gap-wide slot are less than a gap apart, so slots are pre-aggregated first;
    what a window then holds of a key is bounded by the time covered, not by the number of rows.
    """
    keys = list(keys)
    slots = df.groupBy(*keys, _chunk(ts, gap_seconds).alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    history = Window.partitionBy(*keys).orderBy("_first")
    silent = micros("_first") - micros(F.lag("_last").over(history))
    opened = slots.withColumn("_opens", F.coalesce((silent >= gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_session", F.sum("_opens").over(history))
    return (
        numbered.groupBy(*keys, "_session")
        .agg(F.min("_first").alias("session_start"), F.max("_last").alias("session_end"), F.sum("_n").alias("sightings"))
        .drop("_session")
    )
