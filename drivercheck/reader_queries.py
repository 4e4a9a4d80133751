"""Parsers, field rules and tile keys over documents and rows derived from the driver's tables, and their SQL.

JSON documents are built from whole tables with bad elements mixed in, and parsed back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from drivercheck.views import cte, table, view
from skylattice.functions import airports as Ap
from skylattice.functions import tilemath
from skylattice.functions import weather as Wx
from skylattice.operators import airports as A
from skylattice.operators import feeds
from skylattice.sources import readers


def _documents(rows, element, n: int):
    """Lists of about ``n`` elements by id, in id order, as JSON array texts."""
    bundle = F.floor(F.col("id") / n)
    listed = rows.select(bundle.alias("doc"), F.struct("id", element.alias("e")).alias("s")).groupBy("doc").agg(F.sort_array(F.collect_list("s")).alias("l"))
    return listed.select("doc", F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["e"]), ","), F.lit("]")).alias("list"))


def q_snapshots_parsed(spark, sf_dir):
    """Snapshot documents: every 13th element is a number, every 17th has text for a latitude, every 9th document another root."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    track = F.format_string('{"hex":"h%d","lat":%s,"lon":%d,"alt_baro":%s,"gs":%d}', F.col("id"),
                            F.when(F.col("id") % 17 == 0, F.lit('"bad"')).otherwise((F.col("id") % 80).cast("string")), F.col("id") % 170,
                            F.when(F.col("id") % 5 == 0, F.lit('"ground"')).otherwise((F.col("id") % 400 * 100).cast("string")), F.col("id") % 300)
    docs = _documents(events, F.when(F.col("id") % 13 == 0, F.lit("5")).otherwise(track), 40)
    body = F.when(F.col("doc") % 9 == 0, F.col("list")).when(F.col("doc") % 2 == 0, F.concat(F.lit('{"ac":'), "list", F.lit("}")))
    body = body.otherwise(F.concat(F.lit('{"aircraft":'), "list", F.lit("}")))
    parsed = readers.parse_snapshots(docs.select("doc", body.alias("body")))
    return parsed.select("doc", F.col("feed_pos").cast("long").alias("feed_pos"), "hex", "lat", "lon", "alt_baro", "gs")


def q_metar_parsed(spark, sf_dir):
    """Station documents: visibility as number, text and mixed; every 11th element is text, every 7th document an object."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    visib = F.when(F.col("id") % 3 == 0, F.format_string("%d.5", F.col("id") % 9)).when(F.col("id") % 3 == 1, F.format_string('"%d.5"', F.col("id") % 9))
    visib = visib.otherwise(F.lit('"10+"'))
    report = F.format_string('{"icaoId":"K%d","lat":%d,"lon":-%d,"visib":%s}', F.col("id"), F.col("id") % 80, F.col("id") % 170, visib)
    docs = _documents(orders, F.when(F.col("id") % 11 == 0, F.lit('"x"')).otherwise(report), 50)
    body = F.when(F.col("doc") % 7 == 0, F.concat(F.lit('{"a":'), "list", F.lit("}"))).otherwise(F.col("list"))
    parsed = readers.parse_metar(docs.select("doc", body.alias("body")))
    return parsed.select("doc", F.col("icaoId").alias("icao"), "lat", "lon", Wx.parse_visibility("visib").alias("visibility_sm"))


def q_point_weather_parsed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    temp = F.when(F.col("id") % 6 == 0, F.lit("null")).when(F.col("id") % 6 == 1, F.lit('"warm"')).otherwise((F.col("id") % 110).cast("string"))
    body = F.format_string('{"current":{"temperature_2m":%s,"wind_speed_10m":%d},"utc_offset_seconds":%d}', temp, F.col("id") % 40, F.col("id") % 12 * 3600)
    body = F.when(F.col("id") % 10 == 0, F.lit("[1]")).otherwise(body)
    parsed = readers.parse_point_weather(events.select(F.col("id").alias("site_id"), body.alias("body")))
    return parsed.select("site_id", "temp_f", "wind_kts", "utc_offset_sec", "valid")


def q_features_parsed(spark, sf_dir):
    """GeoJSON lines and polygons with holes, one feature per customer."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    x, y = F.col("id") % 170, F.col("id") % 80
    line = F.format_string('{"properties":{"area":%d},"geometry":{"type":"LineString","coordinates":[[%d,%d],[%d,%d]]}}', F.col("id"), x, y, x + 1, y + 2)
    ring = F.format_string(
        '{"properties":{"area":%d},"geometry":{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]],[[0,0],[1,1],[2,2],[0,0]]]}}',
        F.col("id"), x, y, x + 1, y, x + 1, y + 1, x, y,
    )
    text = F.when(F.col("id") % 3 == 0, line).when(F.col("id") % 3 == 1, ring).otherwise(F.lit('{"geometry":{"type":"Point","coordinates":[1,2]}}'))
    parsed = readers.parse_features(rows.select(text.alias("value")), "land")
    total = lambda axis: F.aggregate(F.col("points")[axis], F.lit(0.0), lambda a, b: a + b)
    return parsed.select("layer", F.col("part").cast("long").alias("part"), "area", F.size("points").cast("long").alias("n"), total("lon").alias("lon_sum"), total("lat").alias("lat_sum"))


def q_geocode_clean(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("qu"), (F.col("o_custkey") % 2000).cast("string")).alias("query"), F.col("o_orderkey").alias("hit_no"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("display_name"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise((F.col("o_orderkey") % 90).cast("string")).alias("lat"),
        (F.col("o_orderkey") % 180).cast("string").alias("lon"),
    )
    return A.geocode_clean(rows).select("query", "hit_no", "display_name", "lat", "lon")


def q_field_rules(spark, sf_dir):
    """Fixed-point degrees and back, airport flag bits, default range, times of day."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    deg = (F.col("k") % 3600) * 0.05 - 90.0
    rows = p.select(
        "k", deg.alias("deg"), (F.col("k") % 4).cast("int").alias("tier"), (F.col("k") % 3 == 0).alias("iap"), (F.col("k") % 5 == 0).alias("strip"),
        F.when(F.col("k") % 2 == 0, F.lit("AB")).when(F.col("k") % 3 == 0, F.lit("")).alias("iata"),
        F.concat_ws(":", (F.col("k") % 26).cast("string"), (F.col("k") % 64).cast("string")).alias("clock"),
    )
    e7 = tilemath.deg_to_e7("deg")
    return rows.select(
        "k", e7.cast("long").alias("e7"), F.round(tilemath.e7_to_deg(e7), 7).alias("back"),
        Ap.airport_flags("tier", "iap", "strip").cast("long").alias("flags"), Ap.infer_default_range("iata").cast("long").alias("range_idx"),
        Wx.parse_hhmm("clock").cast("long").alias("hhmm"),
    )


def q_tile_bounds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = c.select("k", F.lit(5).alias("z"), (F.col("k") % 32).cast("int").alias("x"), (F.col("k") % 31).cast("int").alias("y"))
    return rows.select("k", tilemath.tile_bounds("z", "x", "y").alias("b")).select("k", "b.*")


def q_corner_tiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = c.select("k", F.lit(4).alias("z"), ((F.col("k") % 1201) / 10.0 - 60.0).alias("lat"), ((F.col("k") % 3001) / 10.0 - 150.0).alias("lon"), F.lit(333.0).alias("r"))
    tiles = rows.select("k", F.explode(tilemath.corner_tiles("z", "lat", "lon", "r")).alias("t"))
    return tiles.select("k", F.col("t.x").cast("long").alias("x"), F.col("t.y").cast("long").alias("y"))


def q_once_per_key(spark, sf_dir):
    """Deliveries that come twice count once."""
    raw = view(spark, sf_dir, "raw_tracks").select("snapshot_id", "entity_id", (F.col("feed_pos") % 3).alias("part"))
    return feeds.exactly_one_per_key(raw, keys=["snapshot_id", "entity_id", "part"])


QUERIES = {
    "snapshots_parsed": q_snapshots_parsed,
    "metar_parsed": q_metar_parsed,
    "point_weather_parsed": q_point_weather_parsed,
    "features_parsed": q_features_parsed,
    "geocode_clean": q_geocode_clean,
    "field_rules": q_field_rules,
    "tile_bounds": q_tile_bounds,
    "corner_tiles": q_corner_tiles,
    "once_per_key": q_once_per_key,
}

ORACLES = {
    "snapshots_parsed": """
SELECT event_id // 40 AS doc, row_number() OVER (PARTITION BY event_id // 40 ORDER BY event_id) - 1 AS feed_pos, event_id,
       'h' || event_id AS hex, CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 80 AS DOUBLE) END AS lat, CAST(event_id % 170 AS DOUBLE) AS lon,
       CASE WHEN event_id % 5 = 0 THEN 'ground' ELSE CAST(event_id % 400 * 100 AS VARCHAR) END AS alt_baro, CAST(event_id % 300 AS DOUBLE) AS gs
FROM events""",
    "metar_parsed": """
SELECT o_orderkey // 50 AS doc, 'K' || o_orderkey AS icao, CAST(o_orderkey % 80 AS DOUBLE) AS lat, -CAST(o_orderkey % 170 AS DOUBLE) + 0e0 AS lon,
       CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 9 + 1 WHEN 1 THEN o_orderkey % 9 ELSE 10 END AS visibility_sm
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey // 50 % 7 <> 0""",
    "point_weather_parsed": """
SELECT event_id AS site_id, CASE WHEN ok AND event_id % 6 > 1 THEN CAST(event_id % 110 AS DOUBLE) END AS temp_f,
       CASE WHEN ok THEN CAST(event_id % 40 AS DOUBLE) END AS wind_kts, CASE WHEN ok THEN event_id % 12 * 3600 END AS utc_offset_sec,
       ok AND event_id % 6 > 1 AS valid
FROM (SELECT event_id, event_id % 10 <> 0 AS ok FROM events)""",
    "features_parsed": """
SELECT 'land' AS layer, 0 AS part, CAST(k AS DOUBLE) AS area, CASE WHEN k % 3 = 0 THEN 2 ELSE 4 END AS n,
       CAST(CASE WHEN k % 3 = 0 THEN 2*x + 1 ELSE 4*x + 2 END AS DOUBLE) AS lon_sum, CAST(CASE WHEN k % 3 = 0 THEN 2*y + 2 ELSE 4*y + 1 END AS DOUBLE) AS lat_sum
FROM (SELECT c_custkey AS k, c_custkey % 170 AS x, c_custkey % 80 AS y FROM customer) WHERE k % 3 <> 2""",
    "geocode_clean": """
SELECT query, hit_no, display_name, lat, lon FROM (
  SELECT 'qu' || CAST(o_custkey % 2000 AS VARCHAR) AS query,
         o_orderkey AS hit_no, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE '' END AS display_name,
         CAST(o_orderkey % 90 AS DOUBLE) AS lat, CAST(o_orderkey % 180 AS DOUBLE) AS lon FROM orders WHERE o_orderkey % 5 <> 0)
WHERE length(query) >= 4 QUALIFY row_number() OVER (PARTITION BY query ORDER BY hit_no) <= 5""",
    "field_rules": """
SELECT k, e7, round(e7/1e7, 7) AS back, k % 4 + CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 8 ELSE 0 END AS flags,
       CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS range_idx,
       CASE WHEN k % 26 <= 23 AND k % 64 <= 59 THEN k % 26 * 100 + k % 64 ELSE -1 END AS hhmm
FROM (SELECT p_partkey AS k, CAST(round_even((p_partkey % 3600)*0.05e0*1e7 - 90e0*1e7, 0) AS BIGINT) AS e7 FROM part)""",
    "tile_bounds": """
SELECT k, 90e0 - (k % 31 + 1)*180e0/32 AS min_lat, k % 32*360e0/32 - 180e0 AS min_lon, 90e0 - k % 31*180e0/32 AS max_lat,
       (k % 32 + 1)*360e0/32 - 180e0 AS max_lon
FROM (SELECT c_custkey AS k FROM customer)""",
    "corner_tiles": """
SELECT DISTINCT k, CAST(floor((lon + h*(333e0/(cos(radians(lat))*111e0)) + 180e0)/22.5e0) AS BIGINT) AS x,
       CAST(floor((90e0 - (lat + v*(333e0/111e0)))/11.25e0) AS BIGINT) AS y
FROM (SELECT c_custkey AS k, (c_custkey % 1201)/10e0 - 60e0 AS lat, (c_custkey % 3001)/10e0 - 150e0 AS lon FROM customer),
     (VALUES (-1, 1), (1, 1), (-1, -1), (1, -1)) AS t(h, v)""",
    "once_per_key": f"""WITH {cte("raw_tracks")}
SELECT DISTINCT snapshot_id, entity_id, feed_pos % 3 AS part FROM raw_tracks""",
}
ORACLES["snapshots_parsed"] = f"""
SELECT doc, feed_pos, hex, lat, lon, alt_baro, gs FROM ({ORACLES["snapshots_parsed"]}) WHERE event_id % 13 <> 0 AND doc % 9 <> 0"""
