"""Structured Streaming twins of the feed and track operators.

Everything stateful is a built-in stateful operator (aggregates, group state, deduplication, session
windows behind a watermark). Where a step needs batch joins or windows, ``foreachBatch`` runs the
batch operator on the micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylattice import constants as C
from skylattice.operators import feeds, surveillance, timeline
from skylattice.operators import weather as W
from skylattice.session import temporary_tables

BatchSink = Callable[[DataFrame, int], None]


def start(stream: DataFrame, step: BatchSink, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Run ``step`` on every micro-batch: each poll interval, or over what is there now with ``once``."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{C.POLL_SECONDS} seconds")
    return writer.start()


def parquet_sink(folder: str) -> BatchSink:
    """Write each batch to its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def stream_tracks(raw: DataFrame, sink: BatchSink, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Raw polls to clean tracks without ghosts.

    A snapshot must arrive within one micro-batch: one file per snapshot, as the reader expects.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by cleaning, pairing and the final anti-join
        try:
            with temporary_tables(batch.sparkSession):
                sink(surveillance.ghost_dedup(surveillance.clean_tracks(batch)), batch_id)
        finally:
            batch.unpersist()

    return start(raw, step, checkpoint, once=once)


def keep_last_good(polls: DataFrame, *, keys: Sequence[str], ts: str) -> DataFrame:
    """Newest successful poll per key and how many succeeded; write it in update mode.

    One row per key as built-in aggregate state; failed polls change nothing.
    """
    return feeds.keep_last_good(polls, keys=keys, ts=ts)


def carry_offsets(
    readings: DataFrame, sink: BatchSink, folder: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Readings with ``offset_sec``, their site's last known UTC offset, across batches; 0 before the first one.

    Within a batch the batch operator carries the offsets, by time chunks, so no site is gathered. Across
    batches the sites' last offsets are a table below ``folder``, one folder per batch: a batch reads
    that of the batch before and writes its own, so a repeated batch starts from the same offsets.
    Rows count in order of (fetched_at, reading_id) within their batch; readings that are not valid
    set no offset.
    """
    last = ["site_id", "utc_offset_sec"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # read for the rows and for the sites' last offsets
        try:
            with temporary_tables(spark):
                before = _offsets_before(spark, folder, batch_id, batch.select(*last).limit(0))
                sink(W.carry_forward_offset(batch, before=before), batch_id)
                newest = timeline.latest_per_key(
                    batch.filter("valid AND utc_offset_sec IS NOT NULL"), keys=["site_id"], order=["fetched_at", "reading_id"]
                ).select(*last)
                kept = before.join(newest.select(F.col("site_id").alias("_site")), F.col("site_id").eqNullSafe(F.col("_site")), "left_anti")
                kept.unionByName(newest).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return start(readings, step, checkpoint, once=once)


def _offsets_before(spark: SparkSession, folder: str, batch_id: int, none: DataFrame) -> DataFrame:
    """The sites' offsets after the batch before this one; batches have consecutive numbers from 0."""
    if batch_id == 0:
        return none
    return spark.read.schema(none.schema).parquet(f"{folder}/batch_id={batch_id - 1}")


def discard_superseded(results: DataFrame, *, keys: Sequence[str], generation: str) -> DataFrame:
    """Running answer per key of its last-started request; write it in update mode to a table keyed by ``keys``.

    One value per key as state: answers of earlier requests that arrive late never replace it.
    """
    return feeds.discard_superseded(results, keys=keys, generation=generation)


def answers_in_time(
    results: DataFrame, starts: DataFrame, *, max_age: str = "60 seconds", late_seconds: int = C.LATE_SECONDS, **columns
) -> DataFrame:
    """Answers that no later-started request of their key overtook, as a stream-stream join; see :func:`feeds.answers_in_time`.

    Both sides have a watermark. An answer comes out once the watermark has passed it, when no start that could
    overtake it is still due; starts older than ``max_age`` before the watermark leave the state.
    """
    finished, started = columns.get("finished", "finished_at"), columns.get("started", "started_at")
    late = f"{late_seconds} seconds"
    return feeds.answers_in_time(results.withWatermark(finished, late), starts.withWatermark(started, late), max_age=max_age, **columns)


def track_sessions(
    seen: DataFrame, *, keys: Sequence[str], ts: str, gap_seconds: int = C.SESSION_GAP_SECONDS, late_seconds: int = C.LATE_SECONDS
) -> DataFrame:
    """Sessions per key that close ``gap_seconds`` after the last sighting."""
    sessions = (
        seen.withWatermark(ts, f"{late_seconds} seconds")
        .groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds").alias("_s"))
        .agg(F.count(F.lit(1)).alias("sightings"), F.max(ts).alias("session_end"))
    )
    return sessions.select(*keys, F.col("_s.start").alias("session_start"), "session_end", "sightings")


def snapshot_rates(
    successes: DataFrame, *, ts: str, width: str = "1 minute", slide: str | None = None, late_seconds: int = C.LATE_SECONDS
) -> DataFrame:
    """Successful fetches per window; rows later than the watermark are dropped."""
    return feeds.snapshot_rates(successes.withWatermark(ts, f"{late_seconds} seconds"), ts=ts, width=width, slide=slide)


def exactly_one_per_key(df: DataFrame, *, keys: Sequence[str], ts: str, late_seconds: int = C.LATE_SECONDS) -> DataFrame:
    """The same delivery twice counts once, as long as the repeat comes within the watermark."""
    return df.withWatermark(ts, f"{late_seconds} seconds").dropDuplicatesWithinWatermark(list(keys))


def readings_at_current_home(readings: DataFrame, homes: DataFrame) -> DataFrame:
    """Stream-static join: readings fetched for a former home are dropped."""
    return W.readings_at_current_home(readings, homes)


def split_late(df: DataFrame, *, ts: str, seen_at: str, late_seconds: int = C.LATE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived more than ``late_seconds`` after their own time, to be counted."""
    late = F.col(seen_at) > F.col(ts) + F.make_dt_interval(secs=F.lit(late_seconds))
    return df.filter(~late), df.filter(late).withColumn("reason", F.lit("late"))


def late_counts(late: DataFrame) -> DataFrame:
    return late.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
