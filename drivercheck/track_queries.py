"""Surveillance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivercheck.views import cte, table, view
from skylattice.functions import geo, tilemath
from skylattice.functions import tracks as T
from skylattice.operators import surveillance as S


def r6(value, name: str | None = None):
    """Round to six places without negative zero."""
    column = F.round(geo.col(value), 6) + F.lit(0.0)
    return column.alias(name or value)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean_tracks(view(spark, sf_dir, "raw_tracks"))


def _all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every focus point at every preset."""
    focus = view(spark, sf_dir, "focus").drop("range_idx")
    focus = focus.withColumn("range_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return S.focus_views(focus, view(spark, sf_dir, "ranges"))


def near_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tracks_in_radius(tracks(spark, sf_dir), _all_views(spark, sf_dir))


# Clean tracks in the checking engine.
TRACKS_CTE = (
    cte("raw_tracks")
    + """,
tracks AS (
  SELECT feed_pos, snapshot_id, fetched_at, entity_id, hex,
         CASE WHEN trim(flight) <> '' THEN trim(flight) ELSE trim(r) END AS callsign,
         trim(r) AS reg, trim(t) AS actype, lat, lon,
         coalesce(true_heading, mag_heading, track, dir, 0e0) AS nose_deg,
         coalesce(track, true_heading, mag_heading, dir, 0e0) AS track_deg,
         coalesce(gs, tas, ias, 0e0) AS gs_kt,
         coalesce(baro_rate, geom_rate, 0e0) AS vs_fpm,
         CAST(round(coalesce(TRY_CAST(alt_baro AS DOUBLE), alt_geom)) AS INT) AS alt_ft,
         coalesce(CAST(squawk AS INT), 0) AS squawk,
         type AS source,
         CASE WHEN type IN ('adsb_icao','adsb_icao_nt') THEN 3 WHEN type IN ('adsr_icao','tisb_icao') THEN 2
              WHEN type = 'mlat' THEN 1 ELSE 0 END AS tier
  FROM raw_tracks WHERE lat IS NOT NULL AND lon IS NOT NULL AND coalesce(alt_baro, '') <> 'ground'
),
ident AS (
  SELECT *, upper(CASE WHEN callsign LIKE '~%' THEN substr(callsign, 2) ELSE callsign END) AS c,
            upper(CASE WHEN reg LIKE '~%' THEN substr(reg, 2) ELSE reg END) AS g FROM tracks
)"""
)

EDGES_CTE = (
    TRACKS_CTE
    + """,
pairs AS (
  SELECT a.snapshot_id, a.feed_pos AS low_pos, b.feed_pos AS high_pos, a.tier AS low_tier, b.tier AS high_tier
  FROM ident a JOIN ident b ON a.snapshot_id = b.snapshot_id AND a.tier < b.tier
   AND b.lat BETWEEN a.lat - 0.005e0 AND a.lat + 0.005e0
  WHERE sqrt(pow((b.lat - a.lat)*111320e0, 2) + pow((b.lon - a.lon)*111320e0*cos(radians((a.lat + b.lat)*0.5e0)), 2)) <= 460e0
    AND (a.alt_ft IS NULL OR b.alt_ft IS NULL OR abs(a.alt_ft - b.alt_ft) <= 300)
    AND (NOT (a.track_deg > 0 AND b.track_deg > 0)
         OR least(abs(a.track_deg - b.track_deg), 360e0 - abs(a.track_deg - b.track_deg)) <= 30e0)
    AND (NOT (a.gs_kt > 0 AND b.gs_kt > 0)
         OR abs(a.gs_kt - b.gs_kt) / greatest(a.gs_kt, b.gs_kt) <= 0.30e0)
    AND ((a.callsign = '' AND a.reg = '') OR (a.c <> '' AND a.c = b.c) OR (a.g <> '' AND a.g = b.g))
)"""
)

SURVIVORS_CTE = (
    EDGES_CTE
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY least(low_pos, high_pos), greatest(low_pos, high_pos)) AS rn
  FROM pairs
),
walk AS (
  SELECT DISTINCT snapshot_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS dropped FROM ranked
  UNION ALL
  SELECT w.snapshot_id, r.rn,
         CASE WHEN list_contains(w.dropped, r.low_pos) OR list_contains(w.dropped, r.high_pos) THEN w.dropped
              ELSE list_append(w.dropped, r.low_pos) END
  FROM walk w JOIN ranked r ON r.snapshot_id = w.snapshot_id AND r.rn = w.rn + 1
),
gone AS (SELECT snapshot_id, unnest(arg_max(dropped, rn)) AS feed_pos FROM walk GROUP BY snapshot_id),
survivors AS (SELECT t.* FROM tracks t ANTI JOIN gone g ON t.snapshot_id = g.snapshot_id AND t.feed_pos = g.feed_pos)"""
)


def _near(source: str) -> str:
    return f""",
{cte("focus", "ranges")},
near AS (
  SELECT t.*, f.slot, f.name, f.lat AS center_lat, f.lon AS center_lon, r.range_idx, r.nm, r.outer_km, r.tag_budget,
         (t.lon - f.lon)*111e0*cos(radians(f.lat)) AS dx_km, (t.lat - f.lat)*111e0 AS dy_km,
         sqrt(pow((t.lon - f.lon)*111e0*cos(radians(f.lat)), 2) + pow((t.lat - f.lat)*111e0, 2)) AS dist_km
  FROM {source} t CROSS JOIN focus f CROSS JOIN ranges r
  WHERE sqrt(pow((t.lon - f.lon)*111e0*cos(radians(f.lat)), 2) + pow((t.lat - f.lat)*111e0, 2)) <= r.outer_km*118e0/107e0
)"""


_RANK_SQL = """,
scored AS (
  SELECT *, squawk IN (7500,7600,7700) AS urgent,
         coalesce(alt_ft, 0) + gs_kt*20e0 + abs(vs_fpm)/5e0
           + CASE WHEN squawk IN (7500,7600,7700) THEN 1e9 ELSE 0e0 END AS score
  FROM near
  WHERE dist_km <= outer_km AND (callsign <> '' OR squawk IN (7500,7600,7700))
    AND (callsign <> '' OR actype <> '' OR alt_ft IS NOT NULL)
),
labelled AS (
  SELECT *, CASE WHEN urgent THEN 0 ELSE row_number() OVER (
              PARTITION BY snapshot_id, slot, range_idx, urgent ORDER BY score DESC, dist_km DESC, feed_pos) END AS tag_rank
  FROM scored
)
SELECT snapshot_id, slot, range_idx, feed_pos, callsign, CAST(tag_rank AS INT) AS tag_rank,
       round(score, 6) + 0e0 AS score, round(dist_km, 6) + 0e0 AS dist_km
FROM labelled WHERE tag_rank <= tag_budget"""


def q_clean_tracks(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t.select(
        "snapshot_id", "feed_pos", "hex", "callsign", "reg", "actype", "source", F.col("tier").cast("int").alias("tier"),
        "alt_ft", "squawk", *[r6(c) for c in ("lat", "lon", "nose_deg", "track_deg", "gs_kt", "vs_fpm")],
    )


def q_airborne_tracks(spark, sf_dir):
    return S.airborne_tracks(tracks(spark, sf_dir)).select("snapshot_id", "feed_pos", "alt_ft")


def q_source_mix(spark, sf_dir):
    return S.source_mix(tracks(spark, sf_dir)).withColumn("tier", F.col("tier").cast("int"))


def q_ghost_edges(spark, sf_dir):
    edges = S.ghost_edges(tracks(spark, sf_dir))
    return edges.withColumns({c: F.col(c).cast("int") for c in ("low_tier", "high_tier")})


def q_ghost_dedup(spark, sf_dir):
    return S.ghost_dedup(tracks(spark, sf_dir)).select("snapshot_id", "feed_pos", "callsign", "source")


def q_ghost_dedup_stratified(spark, sf_dir):
    return S.ghost_dedup(tracks(spark, sf_dir), mode="stratified").select("snapshot_id", "feed_pos", "callsign", "source")


def q_tracks_in_radius(spark, sf_dir):
    return near_tracks(spark, sf_dir).select(
        "snapshot_id", "feed_pos", "slot", "range_idx", r6("dx_km"), r6("dy_km"), r6("dist_km")
    )


def q_range_class(spark, sf_dir):
    classed = S.range_class(near_tracks(spark, sf_dir), inset_frac=94.0 / 107.0)
    return classed.groupBy("slot", "range_idx", "range_class").agg(F.count(F.lit(1)).alias("tracks"))


def _ranking(rows: DataFrame) -> DataFrame:
    return S.tag_ranking(S.range_class(rows)).select(
        "snapshot_id", "slot", "range_idx", "feed_pos", "callsign", "tag_rank", r6("score"), r6("dist_km")
    )


def q_tag_ranking(spark, sf_dir):
    return _ranking(near_tracks(spark, sf_dir))


def q_radar_tick(spark, sf_dir):
    """The whole radar pass: clean, drop ghosts, gather around the views, classify, rank."""
    clean = S.ghost_dedup(tracks(spark, sf_dir))
    return _ranking(S.tracks_in_radius(clean, _all_views(spark, sf_dir)))


def q_traffic_density(spark, sf_dir):
    return S.traffic_density(near_tracks(spark, sf_dir))


def q_emergency_tracks(spark, sf_dir):
    return tracks(spark, sf_dir).filter(T.is_emergency()).select("snapshot_id", "feed_pos", "callsign", "squawk")


def q_trend_labels(spark, sf_dir):
    return (
        tracks(spark, sf_dir)
        .groupBy(T.altitude_label().alias("altitude"), T.trend().alias("trend"))
        .agg(F.count(F.lit(1)).alias("tracks"))
    )


def q_predict_position(spark, sf_dir):
    ahead = geo.predict_position("lat", "lon", "track_deg", "gs_kt")
    return tracks(spark, sf_dir).select(
        "snapshot_id", "feed_pos", r6(ahead["lat"], "lat_ahead"), r6(ahead["lon"], "lon_ahead")
    )


def q_tile_of_points(spark, sf_dir):
    zooms = F.explode(F.array(*[F.lit(z) for z in (3, 5, 7)])).alias("z")
    placed = tracks(spark, sf_dir).select("lat", "lon", zooms)
    placed = placed.select("z", tilemath.tile_x("z", "lon").alias("x"), tilemath.tile_y("z", "lat").alias("y"))
    return placed.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("points"))


def q_tile_transitions(spark, sf_dir):
    moved = S.tile_transitions(tracks(spark, sf_dir), key="entity_id", ts="fetched_at")
    return moved.select("entity_id", "feed_pos", "fetched_at", F.col("z").cast("int").alias("z"), "x", "y")


def q_tiles_covering(spark, sf_dir):
    """One disc per customer, spread over the map."""
    number = F.col("c_custkey")
    discs = table(spark, sf_dir, "customer").select(
        number.alias("view_id"),
        (((number * 7919) % 1301) / 10.0 - 70.0).alias("lat"),
        (((number * 104729) % 3301) / 10.0 - 170.0).alias("lon"),
        (number % 290 + 10.0).alias("km"),
    )
    return discs.select(
        "view_id", F.explode(tilemath.disc_columns(7, "lat", "lon", "km")).alias("x"), "lat", "km"
    ).select("view_id", "x", F.explode(tilemath.disc_rows(7, "lat", "km")).alias("y"))


QUERIES = {
    "clean_tracks": q_clean_tracks,
    "airborne_tracks": q_airborne_tracks,
    "source_mix": q_source_mix,
    "ghost_edges": q_ghost_edges,
    "ghost_dedup": q_ghost_dedup,
    "ghost_dedup_stratified": q_ghost_dedup_stratified,
    "tracks_in_radius": q_tracks_in_radius,
    "range_class": q_range_class,
    "tag_ranking": q_tag_ranking,
    "radar_tick": q_radar_tick,
    "traffic_density": q_traffic_density,
    "emergency_tracks": q_emergency_tracks,
    "trend_labels": q_trend_labels,
    "predict_position": q_predict_position,
    "tile_of_points": q_tile_of_points,
    "tile_transitions": q_tile_transitions,
    "tiles_covering": q_tiles_covering,
}

ORACLES = {
    "clean_tracks": f"""WITH {TRACKS_CTE}
SELECT snapshot_id, feed_pos, hex, callsign, reg, actype, source, tier, alt_ft, squawk,
       round(lat,6)+0e0 AS lat, round(lon,6)+0e0 AS lon, round(nose_deg,6)+0e0 AS nose_deg,
       round(track_deg,6)+0e0 AS track_deg, round(gs_kt,6)+0e0 AS gs_kt, round(vs_fpm,6)+0e0 AS vs_fpm FROM tracks""",
    "airborne_tracks": f"""WITH {TRACKS_CTE}
SELECT snapshot_id, feed_pos, alt_ft FROM tracks WHERE alt_ft IS NOT NULL AND NOT (alt_ft < 100 AND gs_kt < 40)""",
    "source_mix": f"WITH {TRACKS_CTE} SELECT source, tier, count(*) AS tracks FROM tracks GROUP BY 1, 2",
    "ghost_edges": f"WITH {EDGES_CTE} SELECT * FROM pairs",
    "ghost_dedup": f"WITH RECURSIVE {SURVIVORS_CTE} SELECT snapshot_id, feed_pos, callsign, source FROM survivors",
    "ghost_dedup_stratified": f"""WITH {EDGES_CTE},
out2 AS (SELECT DISTINCT snapshot_id, low_pos AS p FROM pairs WHERE low_tier = 2),
out1 AS (SELECT DISTINCT q.snapshot_id, low_pos AS p FROM pairs q LEFT JOIN out2 ON q.snapshot_id = out2.snapshot_id AND high_pos = p
         WHERE low_tier = 1 AND p IS NULL),
out0 AS (SELECT DISTINCT q.snapshot_id, low_pos AS p FROM pairs q
         LEFT JOIN (SELECT * FROM out2 UNION ALL SELECT * FROM out1) o ON q.snapshot_id = o.snapshot_id AND high_pos = p
         WHERE low_tier = 0 AND p IS NULL),
gone AS (SELECT * FROM out2 UNION ALL SELECT * FROM out1 UNION ALL SELECT * FROM out0)
SELECT snapshot_id, feed_pos, callsign, source FROM tracks t
ANTI JOIN gone g ON t.snapshot_id = g.snapshot_id AND t.feed_pos = g.p""",
    "tracks_in_radius": f"""WITH {TRACKS_CTE}{_near("tracks")}
SELECT snapshot_id, feed_pos, slot, range_idx, round(dx_km,6)+0e0 AS dx_km, round(dy_km,6)+0e0 AS dy_km,
       round(dist_km,6)+0e0 AS dist_km FROM near""",
    "range_class": f"""WITH {TRACKS_CTE}{_near("tracks")}
SELECT slot, range_idx, CASE WHEN dist_km <= outer_km*(94e0/107e0) THEN 'inside' ELSE 'rim' END AS range_class, count(*) AS tracks
FROM near GROUP BY ALL""",
    "tag_ranking": f"WITH {TRACKS_CTE}{_near('tracks')}{_RANK_SQL}",
    "radar_tick": f"WITH RECURSIVE {SURVIVORS_CTE}{_near('survivors')}{_RANK_SQL}",
    "traffic_density": f"""WITH {TRACKS_CTE}{_near("tracks")}
SELECT slot, range_idx, px, py, count(*) AS tracks
FROM (SELECT slot, range_idx, CAST(120 + round(dx_km*107e0/outer_km) AS INT) AS px,
             CAST(120 - round(dy_km*107e0/outer_km) AS INT) AS py FROM near)
WHERE px BETWEEN 0 AND 239 AND py BETWEEN 0 AND 239 GROUP BY 1, 2, 3, 4""",
    "emergency_tracks": f"""WITH {TRACKS_CTE}
SELECT snapshot_id, feed_pos, callsign, squawk FROM tracks WHERE squawk IN (7500,7600,7700)""",
    "trend_labels": f"""WITH {TRACKS_CTE}
SELECT CASE WHEN alt_ft IS NULL THEN 'GND' ELSE lpad(CAST(CAST(floor(alt_ft/100e0 + 0.5e0) AS INT) AS VARCHAR), 3, '0') END AS altitude,
       CASE WHEN alt_ft IS NULL THEN 'unknown' WHEN vs_fpm >= 500 THEN 'climb' WHEN vs_fpm <= -500 THEN 'descent' ELSE 'level' END AS trend,
       count(*) AS tracks FROM tracks GROUP BY 1, 2""",
    "predict_position": f"""WITH {TRACKS_CTE}
SELECT snapshot_id, feed_pos,
       round(lat + gs_kt*(1.852e0/3600e0*6e0)*cos(radians(track_deg))/111e0, 6)+0e0 AS lat_ahead,
       round(lon + gs_kt*(1.852e0/3600e0*6e0)*sin(radians(track_deg))/(111e0*cos(radians(lat))), 6)+0e0 AS lon_ahead FROM tracks""",
    "tile_of_points": f"""WITH {TRACKS_CTE}
SELECT z, CAST(floor((lon + 180e0)/(360e0/pow(2,z))) AS INT) AS x, CAST(floor((90e0 - lat)/(180e0/pow(2,z))) AS INT) AS y, count(*) AS points
FROM tracks CROSS JOIN (VALUES (3),(5),(7)) AS t(z) GROUP BY ALL""",
    "tile_transitions": f"""WITH {TRACKS_CTE},
placed AS (SELECT *, 7 AS z, CAST(floor((lon + 180e0)/(360e0/128)) AS INT) AS x, CAST(floor((90e0 - lat)/(180e0/128)) AS INT) AS y FROM tracks),
linked AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM placed WINDOW w AS (PARTITION BY entity_id ORDER BY fetched_at, feed_pos))
SELECT entity_id, feed_pos, fetched_at, z, x, y FROM linked WHERE px IS NULL OR px <> x OR py <> y""",
    "tiles_covering": """WITH v AS (
  SELECT c_custkey AS view_id, (c_custkey*7919) % 1301/10e0 - 70e0 AS lat, (c_custkey*104729) % 3301/10e0 - 170e0 AS lon, c_custkey % 290 + 10e0 AS km FROM customer),
b AS (SELECT *, km/111e0 AS dlat, km/(111e0*greatest(0.05e0, cos(radians(lat)))) AS dlon FROM v),
k AS (SELECT *, CAST(floor((lon - dlon + 180e0)/2.8125e0) AS INT) AS x0, CAST(floor((lon + dlon + 180e0)/2.8125e0) AS INT) AS x1,
         CAST(floor((90e0 - lat - dlat)/1.40625e0) AS INT) AS y0, CAST(floor((90e0 - lat + dlat)/1.40625e0) AS INT) AS y1 FROM b)
SELECT view_id, unnest(range(x0, x1 + 1)) AS x, y FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM k)""",
}
