"""Weather: station reports, nearest stations per view, point readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import geo
from skylattice.functions import weather as Wx
from skylattice.operators import nearest, quadtree
from skylattice.operators.skew import may_be_hot
from skylattice.operators.timeline import staleness_flags, with_last_known
from skylattice.session import materialize


def stations(raw_metar: DataFrame) -> DataFrame:
    """Raw reports to stations with ceiling, visibility and flight category; unusable rows go."""
    feed_fields = {"icaoId", "lat", "lon", "visib", "wdir", "wspd", "clouds"}
    passed = [c for c in raw_metar.columns if c not in feed_fields]
    usable = raw_metar.filter(Wx.valid_metar("icaoId", "lat", "lon"))
    read = usable.select(
        *passed,
        F.col("icaoId").alias("icao"),
        "lat",
        "lon",
        Wx.wind_value("wdir").alias("wind_dir_deg"),
        Wx.wind_value("wspd").alias("wind_speed_kt"),
        Wx.parse_visibility("visib").alias("visibility_sm"),
        Wx.ceiling_ft("clouds").cast("int").alias("ceiling_ft_agl"),
    )
    return read.withColumn("category", Wx.flight_category("ceiling_ft_agl", "visibility_sm"))


def stations_in_bbox(
    stations: DataFrame, views: DataFrame, *, inflate: float = C.BBOX_INFLATE, hot_rows: int | None = None
) -> DataFrame:
    """Stations inside each view's box, with ``dist_nm`` from the view's centre.

    Views have view_id, center_lat, center_lon, radius_nm. They meet the stations on cells whose size
    follows the box (:mod:`quadtree`). Boxes do not wrap at the antimeridian.
    """
    met = quadtree.meet(stations, _boxed(views, inflate), _box("_box"), hot_rows=hot_rows)
    return met.filter(_inside(_box("_box"))).select(*views.columns, *stations.columns, _distance())


def _boxed(views: DataFrame, inflate: float) -> DataFrame:
    return views.withColumn("_box", geo.make_bbox("center_lat", "center_lon", "radius_nm", inflate))


def _box(name: str) -> quadtree.Box:
    return tuple(F.col(f"{name}.{side}") for side in ("min_lat", "max_lat", "min_lon", "max_lon"))


def _inside(box: quadtree.Box) -> Column:
    return F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3])


def _distance() -> Column:
    return geo.distance_nm("center_lat", "center_lon", "lat", "lon").alias("dist_nm")


def nearest_k_stations(
    stations: DataFrame, views: DataFrame, *, k: int = C.NEAREST_STATIONS, inflate: float = C.BBOX_INFLATE, narrowed: bool | None = None
) -> DataFrame:
    """The ``k`` stations nearest to each view's centre inside its box; ties by identifier.

    Large tables are met within each view's reach (:func:`nearest.with_reach`), a circle around its centre that
    holds ``k`` stations, where that lies in the box, so a view meets a few times ``k`` stations however many there are.
    Spark cuts each view to ``k`` rows per task before the shuffle (window group limit).
    """
    narrowed = (may_be_hot(stations) or may_be_hot(views)) if narrowed is None else narrowed
    near = _in_reach(stations, views, k, inflate) if narrowed else stations_in_bbox(stations, views, inflate=inflate)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("view_id").orderBy("dist_nm", "icao")))
    return ranked.filter(F.col("rank") <= k)


def _in_reach(stations: DataFrame, views: DataFrame, k: int, inflate: float) -> DataFrame:
    """Of the stations in each view's box those that can be among the nearest ``k``."""
    stations = materialize(stations)
    reaching = nearest.with_reach(_boxed(views, inflate), stations, k, lat="center_lat", lon="center_lon")
    # Near the poles boxes are not widened, so a circle need not lie in its box.
    circle = (F.col("_reach") <= F.col("radius_nm") * inflate) & (F.cos(F.radians("center_lat")) > 0.01)
    cut = F.when(circle, F.col("_reach"))
    drawn = reaching.withColumn("_reach", cut).withColumn(
        "_near", F.when(F.col("_reach").isNull(), F.col("_box")).otherwise(geo.make_bbox("center_lat", "center_lon", "_reach", 1 + 1e-9))
    )
    # Large cells: with few stations in reach, copies of views cost more to move than stations that are met for nothing.
    met = quadtree.meet(stations, drawn, _box("_near"), cells=2).filter(_inside(_box("_box")))
    placed = met.select(*views.columns, *stations.columns, _distance(), "_reach")
    return placed.filter(F.col("_reach").isNull() | (F.col("dist_nm") <= F.col("_reach"))).drop("_reach")


def category_counts(in_view: DataFrame) -> DataFrame:
    return in_view.groupBy("view_id", "category").agg(F.count(F.lit(1)).alias("stations"))


# --- point readings -------------------------------------------------------------------------


def convert_readings(raw: DataFrame) -> DataFrame:
    """Pressure in inHg and a ``valid`` flag: no temperature, no reading. Wind and pressure may be NULL."""
    return raw.select(
        *[c for c in raw.columns if c != "pressure_hpa"],
        Wx.hpa_to_inhg("pressure_hpa").alias("baro_inhg"),
        F.col("temp_f").isNotNull().alias("valid"),
    )


def valid_readings(readings: DataFrame) -> DataFrame:
    return readings.filter("valid")


def carry_forward_offset(
    readings: DataFrame,
    *,
    key: str = "site_id",
    ts: str = "fetched_at",
    tie: str = "reading_id",
    chunk_seconds: int = 86_400,
    before: DataFrame | None = None,
) -> DataFrame:
    """Each site's last known UTC offset at every reading, 0 before the first.

    Rejected readings (no temperature) do not update the offset. ``before`` has the offsets (key,
    utc_offset_sec) that are known from earlier on, one for each site.
    """
    fresh = F.when(F.col("valid"), F.col("utc_offset_sec"))
    known = with_last_known(
        readings, keys=[key], order=[ts, tie], value=fresh, ts=ts, chunk_seconds=chunk_seconds, name="_known"
    )
    if before is None:
        return known.withColumn("offset_sec", F.coalesce("_known", F.lit(0))).drop("_known")
    earlier = before.select(F.col(key).alias("_key"), F.col("utc_offset_sec").alias("_earlier"))
    met = known.join(earlier, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn("offset_sec", F.coalesce("_known", "_earlier", F.lit(0))).drop("_known", "_key", "_earlier")


def reading_staleness(readings: DataFrame, *, ttl_seconds: int = C.READING_TTL_SECONDS) -> DataFrame:
    return staleness_flags(readings, keys=["site_id"], ttl_seconds=ttl_seconds, tie=["reading_id"])


def readings_at_current_home(readings: DataFrame, homes: DataFrame) -> DataFrame:
    """Drop readings fetched for a place that is no longer the site's home."""
    return readings.join(homes.select("site_id", "lat", "lon"), ["site_id", "lat", "lon"], "left_semi")


def readings_at_valid_home(
    readings: DataFrame, homes: DataFrame, *, ts: str = "fetched_at", tie: str = "reading_id", chunk_seconds: int = 86_400
) -> DataFrame:
    """Readings fetched for the place that was their site's home at their time.

    ``homes`` has site_id, lat, lon and valid_from: a home holds until the site's next one. Homes and
    readings become one history, and the last home is carried forward by time chunks, so neither a site
    with many readings nor one that moved often is gathered. Readings before the first home go.
    """
    moved = homes.select(
        "site_id", F.col("valid_from").alias(ts), F.lit(0).alias("_kind"), F.struct("lat", "lon").alias("_home"), F.lit(None).cast(readings.schema[tie].dataType).alias(tie)
    )
    both = readings.withColumn("_kind", F.lit(1)).unionByName(moved, allowMissingColumns=True)
    # At one moment the home comes first; of several homes at one moment the last by place.
    placed = with_last_known(
        both, keys=["site_id"], order=[ts, "_kind", "_home", tie], value=F.col("_home"), ts=ts, chunk_seconds=chunk_seconds, name="_at"
    )
    there = (F.col("_kind") == 1) & (F.col("_at.lat") == F.col("lat")) & (F.col("_at.lon") == F.col("lon"))
    return placed.filter(there).select(*readings.columns)
