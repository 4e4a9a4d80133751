"""Requests and upstream feeds: failover, superseded results, rates, focus lists, quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import geo
from skylattice.sources import readers


def union_feed_failover(feeds: Sequence[DataFrame], *, request_key: str, ok: str = "ok") -> DataFrame:
    """Per request the answer of the first upstream (in list order) that succeeded.

    An aggregate with map-side combine; requests where every upstream failed give no row.
    """
    tagged = [feed.withColumn("priority", F.lit(i)) for i, feed in enumerate(feeds)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged).filter(F.col(ok))
    rest = [c for c in merged.columns if c != request_key]
    first = merged.groupBy(request_key).agg(F.min_by(F.struct(*rest), "priority").alias("_row"))
    return first.select(request_key, *[F.col("_row")[c].alias(c) for c in rest])


def discard_superseded(
    results: DataFrame, *, keys: Sequence[str], generation: str, finished: str | None = None
) -> DataFrame:
    """Only the last-started request of a key may write; answers of earlier ones are dropped.

    With ``finished`` (a flag column) the last-started request wins even if it never finished:
    then the key has no row, as an older answer must not fill in.
    """
    keys = list(keys)
    rest = [c for c in results.columns if c not in keys]
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), generation).alias("_row"))
    rows = last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*results.columns)
    return rows.filter(F.col(finished)) if finished else rows


def answers_in_time(
    results: DataFrame,
    starts: DataFrame,
    *,
    keys: Sequence[str],
    generation: str = "generation",
    finished: str = "finished_at",
    started: str = "started_at",
    max_age: str = "60 seconds",
) -> DataFrame:
    """Results that no later request of their key had overtaken when they finished.

    ``starts`` has the keys, the generation and its start; a request is given up ``max_age`` after it, so no
    start counts that lies further back. An anti join over time ranges, for tables and for streams.
    """
    keys = list(keys)
    later = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(generation).alias("_generation"), F.col(started).alias("_started"))
    overtakes = reduce(
        lambda a, b: a & b,
        [F.col(k) == F.col(f"_{k}") for k in keys],
        (F.col("_generation") > F.col(generation))
        & (F.col("_started") <= F.col(finished))
        & (F.col("_started") >= F.col(finished) - F.expr(f"INTERVAL {max_age}")),
    )
    return results.join(later, overtakes, "left_outer").filter(F.col("_generation").isNull()).select(*results.columns)


def snapshot_rates(
    successes: DataFrame, *, ts: str, width: str = "1 minute", slide: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Successful fetches per time window (tumbling, or sliding with ``slide``)."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = successes.groupBy(*by, window.alias("_w")).agg(F.count(F.lit(1)).alias("fetches"))
    return counted.select(
        *by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "fetches"
    )


def exactly_one_per_key(df: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def keep_last_good(polls: DataFrame, *, keys: Sequence[str], ts: str, ok: str = "ok") -> DataFrame:
    """Newest successful poll per key; failed polls neither replace it nor touch its time."""
    keys = list(keys)
    good = polls.filter(F.col(ok))
    rest = [c for c in good.columns if c not in keys]
    kept = good.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), ts).alias("_row"), F.count(F.lit(1)).alias("fetch_count")
    )
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], "fetch_count")


# --- request validation ---------------------------------------------------------------------


def valid_request_box(min_lat, min_lon, max_lat, max_lon) -> Column:
    lat_span, lon_span = geo.col(max_lat) - geo.col(min_lat), geo.col(max_lon) - geo.col(min_lon)
    ok = (lat_span <= C.MAX_BOX_LAT_SPAN) & (lon_span <= C.MAX_BOX_LON_SPAN) & ~F.isnan(lat_span) & ~F.isnan(lon_span)
    return F.coalesce(ok, F.lit(False))


def valid_request_radius(radius_nm) -> Column:
    radius = geo.col(radius_nm)
    return F.coalesce((radius > 0) & (radius <= C.MAX_TRACK_RADIUS_NM), F.lit(False))


def split_valid(df: DataFrame, valid: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with a ``reason`` for the quarantine table."""
    passed = F.coalesce(valid, F.lit(False))
    return df.filter(passed), df.filter(~passed).withColumn("reason", F.lit(reason))


# --- focus lists ----------------------------------------------------------------------------

_FOCUS_ENTRY = "name string, lat double, lon double, range_idx int"
_FOCUS_SCHEMA = "array<struct<name:string,lat:double,lon:double,range_idx:int>>"


def default_focus_points(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *point) for i, point in enumerate(C.DEFAULT_FOCUS_POINTS)]
    return spark.createDataFrame(rows, "slot int, name string, lat double, lon double, range_idx int")


def load_focus_points(configs: DataFrame) -> DataFrame:
    """Device configurations (device_id, home_lat, home_lon, json) to focus points.

    Slot 0 is the device's home. The JSON list gives up to six more; entries with unusable
    coordinates or that are no objects are skipped; without a list, or without any usable entry the two default points are taken. All of
    it happens inside the row, so a device never needs a shuffle.
    """
    elements = F.filter(readers.json_list(F.col("json")), readers.is_object)
    entries = F.transform(elements, lambda e: F.from_json(e, _FOCUS_ENTRY))
    usable = F.filter(entries, lambda e: geo.valid_lat_lon(e["lat"], e["lon"]))
    named = F.transform(
        F.slice(usable, 1, C.MAX_FOCUS_POINTS),
        lambda e: F.struct(
            F.coalesce(e["name"], F.lit("?")).alias("name"),
            e["lat"].alias("lat"),
            e["lon"].alias("lon"),
            F.when(e["range_idx"].between(0, 255), e["range_idx"]).otherwise(C.DEFAULT_RANGE_IDX).alias("range_idx"),
        ),
    )

    def point(name, lat, lon, range_idx) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            geo.col(lat).cast("double").alias("lat"),
            geo.col(lon).cast("double").alias("lon"),
            F.lit(range_idx).alias("range_idx"),
        )

    defaults = F.array(*[point(*p) for p in C.DEFAULT_FOCUS_POINTS])
    chosen = F.when(F.size(F.coalesce(named, F.array().cast(_FOCUS_SCHEMA))) > 0, named).otherwise(defaults)
    home = F.array(point(C.HOME_POINT[0], "home_lat", "home_lon", C.HOME_POINT[3]))
    listed = configs.select("device_id", F.posexplode(F.concat(home, chosen)).alias("slot", "_p"))
    return listed.select(
        "device_id", "slot", "_p.name", "_p.lat", "_p.lon", "_p.range_idx", (F.col("slot") == 0).alias("is_home")
    )
