"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smaller inputs, by the planner's estimate, are not counted.
COUNTED_BYTES = 64 << 20
DEFAULT_HOT_ROWS = 20_000
_INLINE_KEYS = 10_000


def may_be_hot(df: DataFrame) -> bool:
    """By the planner's size estimate. An input this small cannot keep a task long, so its keys are not counted."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= COUNTED_BYTES


def listed_side(df: DataFrame) -> DataFrame:
    """``df``, exploded before, as a side of a join that Spark must not broadcast.

    The planner's size of exploded rows is that of the rows before, so it would gather a table of any size
    in the driver.
    """
    return df.hint("merge")


def fan_out_join(
    large: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    *,
    spread_by: Sequence[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """Inner join where hot keys of ``large`` are cut into parts and only their rows of ``small`` are repeated.

    Keys are counted unless the input is small; a given ``hot_rows`` has them counted in any case.
    ``small`` must be the side whose repetition is cheap (view requests); it is never broadcast, see
    :func:`listed_side`.
    """
    counted = hot_rows is not None or may_be_hot(large)
    hot = hot_keys(large, keys, DEFAULT_HOT_ROWS if hot_rows is None else hot_rows) if counted else None
    if hot is None:
        return large.join(listed_side(small), list(keys))
    parts = F.coalesce("_parts", F.lit(1))
    picked = large.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*spread_by), parts).cast("int")).drop("_parts")
    copies = small.join(hot, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return picked.join(listed_side(copies), [*keys, "_part"]).drop("_part")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and the number of parts to cut them into; None if there are none.

    One pre-aggregated count, run now, because the answer picks the plan: usually no key is hot and
    the join stays plain. Up to ``_INLINE_KEYS`` hot keys come back as a broadcast table of known
    size; more of them stay a distributed table.
    """
    counts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    found = counts.limit(_INLINE_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= _INLINE_KEYS:
        return F.broadcast(df.sparkSession.createDataFrame(found, counts.schema))
    return counts


def split_hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    hot: DataFrame | None,
    hot_on: Sequence[str],
    left_id: str,
    right_id: str,
) -> DataFrame:
    """Inner equi-join that cuts the block of every hot key into a grid of smaller blocks.

    ``hot`` comes from :func:`hot_keys` on ``hot_on``, a subset of ``keys``. Rows of a hot key are
    numbered by hash along their own side and repeated along the other one, so each pair still
    meets exactly once while the block is shared by parts * parts tasks.
    """
    keys = list(keys)
    if hot is None:
        return left.join(right, keys)
    parts = F.coalesce("_parts", F.lit(1))
    every = F.explode(F.sequence(F.lit(0), parts - 1))

    def cut(side: DataFrame, own: str, row_id: str, other: str) -> DataFrame:
        sized = side.join(hot, list(hot_on), "left")
        mine = F.pmod(F.xxhash64(row_id), parts).cast("int")
        return sized.withColumn(own, mine).withColumn(other, every).drop("_parts")

    return (
        cut(left, "_row", left_id, "_col")
        .join(cut(right, "_col", right_id, "_row"), [*keys, "_row", "_col"])
        .drop("_row", "_col")
    )
