"""Streams that are run: tables replayed as files in order, and the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from drivercheck.track_queries import ORACLES as TRACK_ORACLES
from drivercheck.views import cte, table, view
from drivercheck.weather_queries import ORACLES as WEATHER_ORACLES
from skylattice.functions.timecols import micros
from skylattice.operators import weather as W
from skylattice.session import shared_folder
from skylattice.streaming import replay, streams

_LATE_SECONDS = 600


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/replay/{uuid.uuid4().hex}"


def _ten_days(ts: str):
    """The number of the ten days a time lies in."""
    return F.floor(micros(ts) / (86_400 * 10 * 1_000_000))


def _events(spark, sf_dir):
    """Events with a time that a watermark can follow."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_tracks_replayed(spark, sf_dir):
    """Raw polls as a stream, twelve snapshots to a file."""
    folder = _folder(spark)
    raw = view(spark, sf_dir, "raw_tracks")
    files = replay.write_slices(raw, F.floor(F.col("snapshot_id") / 12), f"{folder}/in", most_files=spark.sparkContext.defaultParallelism)
    stream = replay.stream_of(spark, f"{folder}/in", raw, files)
    streams.stream_tracks(stream, streams.parquet_sink(f"{folder}/out"), f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("snapshot_id", "feed_pos", "callsign", "source")


def q_offsets_replayed(spark, sf_dir):
    """Readings in time order, cut into slices of time."""
    folder = _folder(spark)
    readings = W.convert_readings(view(spark, sf_dir, "readings"))
    # Slices of about a third of the time the events cover.
    files = replay.write_slices(readings, _ten_days("fetched_at"), f"{folder}/in", most_files=spark.sparkContext.defaultParallelism)
    stream = replay.stream_of(spark, f"{folder}/in", readings, files)
    sink = streams.parquet_sink(f"{folder}/out")
    streams.carry_offsets(stream, sink, f"{folder}/offsets", f"{folder}/checkpoint", once=True).awaitTermination()
    carried = spark.read.schema(T.StructType([*readings.schema.fields, T.StructField("offset_sec", T.IntegerType())])).parquet(f"{folder}/out")
    return carried.select("reading_id", "site_id", "offset_sec")


def _requests(spark, sf_dir):
    """Every event is a request of its user; it takes up to an hour."""
    number = F.col("event_id")
    took = (number * 37) % 3600
    events = _events(spark, sf_dir)
    starts = events.select(F.col("user_id").alias("device_id"), number.alias("generation"), F.col("ts").alias("started_at"))
    finished = F.expr("ts + make_dt_interval(0, 0, 0, (event_id * 37) % 3600)")
    results = events.select(F.col("user_id").alias("device_id"), number.alias("generation"), finished.alias("finished_at"), took.alias("took"))
    return starts, results


def q_answers_in_time(spark, sf_dir):
    starts, results = _requests(spark, sf_dir)
    return streams.feeds.answers_in_time(results, starts, keys=["device_id"], max_age="6 hours").select("device_id", "generation", "took")


def q_answers_replayed(spark, sf_dir):
    """Starts and answers as two streams that are joined; a last row far ahead lets the watermark pass all others."""
    folder = _folder(spark)
    starts, results = _requests(spark, sf_dir)
    ahead = "max({0}) + INTERVAL 30 DAYS"
    starts = starts.unionByName(starts.selectExpr("-1L AS device_id", "-1L AS generation", ahead.format("started_at") + " AS started_at"))
    results = results.unionByName(results.selectExpr("-1L AS device_id", "-1L AS generation", ahead.format("finished_at") + " AS finished_at", "0L AS took"))
    slices = {"starts": ("started_at", starts), "results": ("finished_at", results)}
    inputs = {}
    for name, (ts, rows) in slices.items():
        replay.write_slices(rows, _ten_days(ts), f"{folder}/{name}")
        inputs[name] = replay.stream_of(spark, f"{folder}/{name}", rows)
    # The two streams are cut at the same times, but their files come side by side, so a slice may be early.
    joined = streams.answers_in_time(inputs["results"], inputs["starts"], keys=["device_id"], max_age="6 hours", late_seconds=86_400 * 10)
    replay.run_through(joined, f"{folder}/out", f"{folder}/checkpoint")
    found = spark.read.schema(results.schema).parquet(f"{folder}/out")
    return found.filter("device_id >= 0").select("device_id", "generation", "took")


def q_late_rows_replayed(spark, sf_dir):
    """Events that arrive by slices of ten days, every 40th a whole slice late or more: what is kept, and what the watermark drops."""
    folder = _folder(spark)
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    arrives = _ten_days("ts") + F.when(F.col("event_id") % 40 == 0, 2).otherwise(0)
    replay.write_slices(events, arrives, f"{folder}/in")
    stream = replay.stream_of(spark, f"{folder}/in", events)
    once = streams.exactly_one_per_key(stream, keys=["event_id"], ts="ts", late_seconds=_LATE_SECONDS)
    query = replay.run_through(once, f"{folder}/out", f"{folder}/checkpoint")
    kept = spark.read.schema(events.schema).parquet(f"{folder}/out").groupBy(F.lit("kept").alias("kind"), "user_id").agg(F.count(F.lit(1)).alias("rows"))
    dropped = spark.createDataFrame([("dropped", -1, replay.dropped_by_watermark(query))], "kind string, user_id long, rows long")
    return kept.withColumn("user_id", F.col("user_id").cast("long")).unionByName(dropped)


def _moves(spark, sf_dir):
    """Every site's home, which moves with each 50th reading."""
    readings = view(spark, sf_dir, "readings").filter("reading_id % 50 = 0")
    return readings.select("site_id", *_home("reading_id"), F.col("fetched_at").alias("valid_from"))


def _home(number: str):
    return (F.col(number) % 3 * 1.0).alias("lat"), (F.col(number) % 4 * 1.0).alias("lon")


def q_readings_at_valid_home(spark, sf_dir):
    """Readings of one of twelve places, against homes that move again and again."""
    readings = view(spark, sf_dir, "readings").select("reading_id", "site_id", "fetched_at", *_home("reading_id"))
    # At a site two homes of one moment would be told apart by place only.
    moves = _moves(spark, sf_dir).dropDuplicates(["site_id", "valid_from", "lat", "lon"])
    return W.readings_at_valid_home(readings, moves).select("reading_id", "site_id")


QUERIES = {
    "stream_tracks_replayed": q_stream_tracks_replayed,
    "offsets_replayed": q_offsets_replayed,
    "answers_in_time": q_answers_in_time,
    "answers_replayed": q_answers_replayed,
    "late_rows_replayed": q_late_rows_replayed,
    "readings_at_valid_home": q_readings_at_valid_home,
}

_ANSWERS = """WITH r AS (SELECT user_id AS device_id, event_id AS generation, ts AS started_at, (event_id * 37) % 3600 AS took,
                 ts + to_seconds((event_id * 37) % 3600) AS finished_at FROM events)
SELECT device_id, generation, took FROM r a WHERE NOT EXISTS (
  SELECT 1 FROM r b WHERE b.device_id = a.device_id AND b.generation > a.generation AND b.started_at <= a.finished_at
    AND b.started_at >= a.finished_at - INTERVAL 6 HOURS)"""

ORACLES = {
    "stream_tracks_replayed": TRACK_ORACLES["ghost_dedup"],
    "offsets_replayed": WEATHER_ORACLES["offset_carry"],
    "answers_in_time": _ANSWERS,
    "answers_replayed": _ANSWERS,
    # A batch drops by the watermark that held in the batch before it: that of the newest row two batches back.
    "late_rows_replayed": f"""WITH e AS (
  SELECT *, CAST(floor(epoch(ts) / (86400 * 10)) AS BIGINT) + CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END AS slice FROM events),
b AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL {_LATE_SECONDS} SECONDS AS mark FROM e GROUP BY slice),
j AS (SELECT e.*, mark IS NOT NULL AND date_trunc('millisecond', ts) <= date_trunc('millisecond', mark) AS late FROM e JOIN b USING (slice))
SELECT 'kept' AS kind, CAST(user_id AS BIGINT) AS user_id, count(*) AS rows FROM j WHERE NOT late GROUP BY 2
UNION ALL SELECT 'dropped', -1, count(*) FROM j WHERE late""",
    "readings_at_valid_home": f"""WITH {cte("readings")},
moves AS (SELECT site_id, fetched_at AS valid_from, reading_id % 3 * 1e0 AS lat, reading_id % 4 * 1e0 AS lon FROM readings WHERE reading_id % 50 = 0
          QUALIFY row_number() OVER (PARTITION BY site_id, fetched_at ORDER BY reading_id % 3 DESC, reading_id % 4 DESC) = 1)
SELECT r.reading_id, r.site_id FROM readings r ASOF JOIN moves m ON r.site_id = m.site_id AND r.fetched_at >= m.valid_from
WHERE m.lat = r.reading_id % 3 * 1e0 AND m.lon = r.reading_id % 4 * 1e0""",
}
