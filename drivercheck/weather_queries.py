"""Weather, reading and feed queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivercheck.track_queries import r6
from drivercheck.views import cte, table, view
from skylattice.functions import weather as Wx
from skylattice.operators import feeds, timeline
from skylattice.operators import weather as W


def _raw_metar(spark, sf_dir):
    clouds = F.array(
        F.struct(F.col("cover1").alias("cover"), F.col("base1").cast("double").alias("base")),
        F.struct(F.col("cover2").alias("cover"), F.col("base2").cast("double").alias("base")),
    )
    return view(spark, sf_dir, "metar").select(
        "obs_id", F.col("icao").alias("icaoId"), "lat", "lon", "visib", "wdir", "wspd", clouds.alias("clouds"), "fetched_at"
    )


def _stations(spark, sf_dir):
    return W.stations(_raw_metar(spark, sf_dir))


def _latest(spark, sf_dir):
    return timeline.latest_per_key(_stations(spark, sf_dir), keys=["icao"], order=["fetched_at", "obs_id"])


_VIEWS = "metar_views"
_STATION_CTE = (
    cte("metar", "metar_views")
    + """,
station AS (
  SELECT obs_id, icao, lat, lon, fetched_at,
         coalesce(TRY_CAST(regexp_extract(wdir, '^([0-9]+)$', 1) AS INT), 0) AS wind_dir_deg,
         coalesce(TRY_CAST(wspd AS INT), 0) AS wind_speed_kt,
         CASE WHEN visib IS NULL THEN 10 ELSE least(10, CAST(regexp_extract(visib, '^([0-9]+)', 1) AS INT)) END AS visibility_sm,
         CASE WHEN upper(cover1) IN ('BKN','OVC','VV') AND upper(cover2) IN ('BKN','OVC','VV') THEN least(base1, coalesce(base2, base1))
              WHEN upper(cover1) IN ('BKN','OVC','VV') THEN base1
              WHEN upper(cover2) IN ('BKN','OVC','VV') THEN base2 END AS ceiling_ft_agl
  FROM metar WHERE icao <> '' AND lat IS NOT NULL AND lon IS NOT NULL
),
graded AS (
  SELECT *, greatest(CASE WHEN ceiling_ft_agl < 500 THEN 3 WHEN ceiling_ft_agl < 1000 THEN 2 WHEN ceiling_ft_agl <= 3000 THEN 1 ELSE 0 END,
                     CASE WHEN visibility_sm < 1 THEN 3 WHEN visibility_sm < 3 THEN 2 WHEN visibility_sm <= 5 THEN 1 ELSE 0 END) AS worst
  FROM station
),
cat AS (SELECT *, CASE worst WHEN 3 THEN 'LIFR' WHEN 2 THEN 'IFR' WHEN 1 THEN 'MVFR' ELSE 'VFR' END AS category FROM graded),
newest AS (SELECT * FROM cat QUALIFY row_number() OVER (PARTITION BY icao ORDER BY fetched_at DESC, obs_id DESC) = 1),
boxed AS (
  SELECT v.view_id, s.*, sqrt(pow((s.lat - center_lat)*60e0, 2) + pow((s.lon - center_lon)*60e0*cos(radians(center_lat)), 2)) AS dist_nm
  FROM newest s JOIN metar_views v
    ON s.lat BETWEEN center_lat - radius_nm*1.1e0/60e0 AND center_lat + radius_nm*1.1e0/60e0
   AND s.lon BETWEEN center_lon - radius_nm*1.1e0/60e0/cos(radians(center_lat)) AND center_lon + radius_nm*1.1e0/60e0/cos(radians(center_lat))
)"""
)
_READING_CTE = (
    cte("readings")
    + """,
conv AS (SELECT *, pressure_hpa/33.8639e0 AS baro_inhg, temp_f IS NOT NULL AS valid FROM readings),
offs AS (
  SELECT *, coalesce(last_value(CASE WHEN valid THEN utc_offset_sec END IGNORE NULLS) OVER (
              PARTITION BY site_id ORDER BY fetched_at, reading_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS offset_sec
  FROM conv
)"""
)


def q_flight_category(spark, sf_dir):
    return _stations(spark, sf_dir).select(
        "obs_id", "icao", "wind_dir_deg", "wind_speed_kt", "visibility_sm", "ceiling_ft_agl", "category"
    )


def q_latest_per_key(spark, sf_dir):
    return _latest(spark, sf_dir).select("icao", "obs_id", "fetched_at", "category")


def q_stations_in_bbox(spark, sf_dir):
    found = W.stations_in_bbox(_latest(spark, sf_dir), view(spark, sf_dir, _VIEWS))
    return found.select("view_id", "icao", "category", r6("dist_nm"))


def q_nearest_k_stations(spark, sf_dir):
    found = W.nearest_k_stations(_latest(spark, sf_dir), view(spark, sf_dir, _VIEWS))
    return found.select("view_id", "icao", "rank", "category", r6("dist_nm"))


def q_category_counts(spark, sf_dir):
    return W.category_counts(W.nearest_k_stations(_latest(spark, sf_dir), view(spark, sf_dir, _VIEWS)))


def _readings(spark, sf_dir):
    return W.convert_readings(view(spark, sf_dir, "readings"))


def q_reading_units(spark, sf_dir):
    return W.valid_readings(_readings(spark, sf_dir)).select(
        "reading_id",
        "site_id",
        r6(Wx.f_to_c("temp_f"), "temp_c"),
        r6("wind_kts"),
        r6(Wx.wind_going_to_deg("wind_deg_from"), "wind_going_to"),
        r6("baro_inhg"),
    )


def q_offset_carry(spark, sf_dir):
    return W.carry_forward_offset(_readings(spark, sf_dir)).select("reading_id", "site_id", "offset_sec")


def q_staleness(spark, sf_dir):
    flagged = W.reading_staleness(_readings(spark, sf_dir))
    return flagged.select("reading_id", "site_id", r6("age_seconds"), F.col("due").cast("int").alias("due"))


def q_quiet_hours(spark, sf_dir):
    """Readings taken while their site sleeps; the schedule is derived from the site number."""
    carried = W.carry_forward_offset(_readings(spark, sf_dir))
    local = Wx.local_time("fetched_at", "offset_sec")
    sleep = F.when(F.col("site_id") % 11 == 0, -1).otherwise((F.col("site_id") * 7) % 24 * 100 + 30)
    wake = (F.col("site_id") * 13) % 24 * 100 + 15
    quiet = carried.filter(Wx.in_quiet_hours(local, sleep, wake))
    return quiet.select("reading_id", "site_id", Wx.hhmm_of(local).alias("hhmm"))


def q_local_clock(spark, sf_dir):
    carried = W.carry_forward_offset(_readings(spark, sf_dir))
    return (
        carried.select("site_id", Wx.zulu_label("fetched_at").alias("zulu"), Wx.format_hhmm(Wx.hhmm_of(Wx.local_time("fetched_at", "offset_sec"))).alias("local"))
        .groupBy("site_id", "local", "zulu")
        .agg(F.count(F.lit(1)).alias("readings"))
    )


def q_freshness(spark, sf_dir):
    """Minutes since each site's last valid reading at a fixed moment after the feed."""
    readings = _readings(spark, sf_dir)
    last = readings.groupBy("site_id").agg(F.max(F.when(F.col("valid"), F.col("fetched_at"))).alias("last_good"))
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return last.select("site_id", Wx.freshness_minutes(now, "last_good").alias("minutes"))


def q_readings_at_current_home(spark, sf_dir):
    placed = view(spark, sf_dir, "readings").withColumns(
        {"lat": F.col("site_id") % 60 + F.col("home_moved") * 0.5, "lon": F.col("site_id") % 100 * 1.0}
    )
    newest = timeline.latest_per_key(
        placed.select("site_id", "lat", "lon", "fetched_at", "reading_id"), keys=["site_id"], order=["fetched_at", "reading_id"]
    )
    return W.readings_at_current_home(placed, newest).select("reading_id", "site_id")


def _polls(spark, sf_dir):
    """Events as request results: a key, a start order, an outcome."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("device_id"),
        F.col("ts").alias("fetched_at"),
        F.col("value").alias("payload"),
        (F.col("event_type") != "error").alias("ok"),
    )


def q_feed_failover(spark, sf_dir):
    polls = _polls(spark, sf_dir)
    second = polls.withColumns({"payload": F.col("payload") + 1000.0, "ok": F.col("request_id") % 3 != 0})
    third = polls.withColumns({"payload": F.col("payload") + 2000.0, "ok": F.col("request_id") % 2 == 0})
    merged = feeds.union_feed_failover([polls, second, third], request_key="request_id")
    return merged.select("request_id", "priority", r6("payload"))


def q_superseded(spark, sf_dir):
    kept = feeds.discard_superseded(_polls(spark, sf_dir), keys=["device_id"], generation="request_id", finished="ok")
    return kept.select("device_id", "request_id", r6("payload"))


def q_keep_last_good(spark, sf_dir):
    kept = feeds.keep_last_good(_polls(spark, sf_dir), keys=["device_id"], ts="request_id")
    return kept.select("device_id", "request_id", "fetch_count")


def q_track_sessions(spark, sf_dir):
    seen = view(spark, sf_dir, "raw_tracks").select("entity_id", "fetched_at")
    return timeline.track_sessions(seen, keys=["entity_id"], ts="fetched_at", gap_seconds=3600)


def q_snapshot_rates(spark, sf_dir):
    good = _polls(spark, sf_dir).filter("ok")
    return feeds.snapshot_rates(good, ts="fetched_at", width="1 hour").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


def q_snapshot_rates_sliding(spark, sf_dir):
    good = _polls(spark, sf_dir).filter("ok")
    return feeds.snapshot_rates(good, ts="fetched_at", width="2 hours", slide="1 hour").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


def q_focus_points(spark, sf_dir):
    """Device lists from customers: valid, partly valid, broken, empty and over-long JSON."""
    number = F.col("c_custkey")
    entry = F.concat(
        F.lit('{"name":"F'), number.cast("string"), F.lit('","lat":'), (number % 120).cast("string"),
        F.lit(',"lon":'), (number % 170).cast("string"), F.lit(',"range_idx":'), (number % 4).cast("string"), F.lit("}"),
    )
    text = (
        F.when(number % 5 == 0, "not json")
        .when(number % 5 == 1, F.concat(F.lit("["), entry, F.lit("]")))
        .when(number % 5 == 2, F.concat(F.lit("["), F.array_join(F.array_repeat(entry, 9), ","), F.lit("]")))
        .when(number % 5 == 3, "[]")
        .otherwise(F.concat(F.lit('[{"lat":1.5},'), entry, F.lit("]")))
    )
    configs = table(spark, sf_dir, "customer").select(
        number.alias("device_id"), (number % 50 * 1.0).alias("home_lat"), (number % 90 * 1.0).alias("home_lon"), text.alias("json")
    )
    return feeds.load_focus_points(configs).select("device_id", "slot", "name", r6("lat"), r6("lon"), "range_idx")


def q_quarantined_requests(spark, sf_dir):
    """View requests outside the limits, from orders: radius and box span derived from the keys."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_orderkey") % 300 - 10.0).alias("radius_nm"),
        (F.col("o_custkey") % 30 * 1.0).alias("lat_span"),
        (F.col("o_custkey") % 50 * 1.0).alias("lon_span"),
    )
    ok = feeds.valid_request_radius("radius_nm") & feeds.valid_request_box(F.lit(0.0), F.lit(0.0), "lat_span", "lon_span")
    _, rejected = feeds.split_valid(orders, ok, "outside limits")
    return rejected.select("request_id", "reason")


QUERIES = {
    "flight_category": q_flight_category,
    "latest_per_key": q_latest_per_key,
    "stations_in_bbox": q_stations_in_bbox,
    "nearest_k_stations": q_nearest_k_stations,
    "category_counts": q_category_counts,
    "reading_units": q_reading_units,
    "offset_carry": q_offset_carry,
    "staleness": q_staleness,
    "quiet_hours": q_quiet_hours,
    "local_clock": q_local_clock,
    "freshness": q_freshness,
    "readings_at_current_home": q_readings_at_current_home,
    "feed_failover": q_feed_failover,
    "superseded": q_superseded,
    "keep_last_good": q_keep_last_good,
    "track_sessions": q_track_sessions,
    "snapshot_rates": q_snapshot_rates,
    "snapshot_rates_sliding": q_snapshot_rates_sliding,
    "focus_points": q_focus_points,
    "quarantined_requests": q_quarantined_requests,
}

_POLLS = "polls AS (SELECT event_id AS request_id, user_id AS device_id, ts AS fetched_at, value AS payload, event_type <> 'error' AS ok FROM events)"

ORACLES = {
    "flight_category": f"""WITH {_STATION_CTE}
SELECT obs_id, icao, wind_dir_deg, wind_speed_kt, visibility_sm, ceiling_ft_agl, category FROM cat""",
    "latest_per_key": f"WITH {_STATION_CTE} SELECT icao, obs_id, fetched_at, category FROM newest",
    "stations_in_bbox": f"WITH {_STATION_CTE} SELECT view_id, icao, category, round(dist_nm, 6)+0e0 AS dist_nm FROM boxed",
    "nearest_k_stations": f"""WITH {_STATION_CTE}
SELECT view_id, icao, row_number() OVER (PARTITION BY view_id ORDER BY dist_nm, icao) AS rank, category, round(dist_nm, 6)+0e0 AS dist_nm
FROM boxed QUALIFY rank <= 32""",
    "category_counts": f"""WITH {_STATION_CTE}
SELECT view_id, category, count(*) AS stations FROM (
  SELECT * FROM boxed QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY dist_nm, icao) <= 32) GROUP BY 1, 2""",
    "reading_units": f"""WITH {_READING_CTE}
SELECT reading_id, site_id, round((temp_f - 32e0)*5e0/9e0, 6)+0e0 AS temp_c, round(wind_kts, 6)+0e0 AS wind_kts,
       round((wind_deg_from + 180e0) % 360e0, 6)+0e0 AS wind_going_to, round(baro_inhg, 6)+0e0 AS baro_inhg FROM conv WHERE valid""",
    "offset_carry": f"WITH {_READING_CTE} SELECT reading_id, site_id, offset_sec FROM offs",
    "staleness": f"""WITH {_READING_CTE},
gaps AS (SELECT *, (epoch_us(fetched_at) - epoch_us(lag(fetched_at) OVER (PARTITION BY site_id ORDER BY fetched_at, reading_id)))/1e6 AS age_seconds FROM conv)
SELECT reading_id, site_id, round(age_seconds, 6)+0e0 AS age_seconds, CASE WHEN age_seconds IS NULL OR age_seconds >= 900 THEN 1 ELSE 0 END AS due FROM gaps""",
    "quiet_hours": f"""WITH {_READING_CTE},
clock AS (SELECT *, fetched_at + to_seconds(offset_sec) AS local_ts,
            CASE WHEN site_id % 11 = 0 THEN -1 ELSE (site_id*7) % 24 * 100 + 30 END AS sleep, (site_id*13) % 24 * 100 + 15 AS wake FROM offs),
t AS (SELECT *, hour(local_ts)*100 + minute(local_ts) AS hhmm FROM clock WHERE local_ts >= TIMESTAMP '2024-01-01')
SELECT reading_id, site_id, hhmm FROM t
WHERE sleep >= 0 AND ((sleep < wake AND hhmm >= sleep AND hhmm < wake) OR (sleep > wake AND (hhmm >= sleep OR hhmm < wake)))""",
    "local_clock": f"""WITH {_READING_CTE}
SELECT site_id, strftime(fetched_at + to_seconds(offset_sec), '%H:%M') AS local, strftime(fetched_at, '%H:%M') || 'Z' AS zulu, count(*) AS readings
FROM offs GROUP BY 1, 2, 3""",
    "freshness": f"""WITH {_READING_CTE}
SELECT site_id, CAST(floor((epoch(TIMESTAMP '2025-01-01') - floor(epoch_us(max(fetched_at) FILTER (valid))/1e6))/60e0) AS INT) AS minutes
FROM conv GROUP BY 1""",
    "readings_at_current_home": f"""WITH {cte("readings")},
placed AS (SELECT *, site_id % 60 + home_moved*0.5e0 AS lat FROM readings),
home AS (SELECT site_id, arg_max(lat, (fetched_at, reading_id)) AS lat FROM placed GROUP BY 1)
SELECT reading_id, p.site_id FROM placed p JOIN home h ON p.site_id = h.site_id AND p.lat = h.lat""",
    "feed_failover": f"""WITH {_POLLS}
SELECT request_id, CASE WHEN ok THEN 0 WHEN request_id % 3 <> 0 THEN 1 ELSE 2 END AS priority,
       round(payload + CASE WHEN ok THEN 0e0 WHEN request_id % 3 <> 0 THEN 1000e0 ELSE 2000e0 END, 6)+0e0 AS payload
FROM polls WHERE ok OR request_id % 3 <> 0 OR request_id % 2 = 0""",
    "superseded": f"""WITH {_POLLS}
SELECT device_id, request_id, round(payload, 6)+0e0 AS payload FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY request_id DESC) AS rn FROM polls) WHERE rn = 1 AND ok""",
    "keep_last_good": f"WITH {_POLLS} SELECT device_id, max(request_id) AS request_id, count(*) AS fetch_count FROM polls WHERE ok GROUP BY 1",
    "track_sessions": f"""WITH {cte("raw_tracks")},
g AS (SELECT entity_id, fetched_at, CASE WHEN fetched_at - lag(fetched_at) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS opens
      FROM raw_tracks WINDOW w AS (PARTITION BY entity_id ORDER BY fetched_at)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY entity_id ORDER BY fetched_at ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT entity_id, min(fetched_at) AS session_start, max(fetched_at) AS session_end, count(*) AS sightings FROM s GROUP BY entity_id, no""",
    "snapshot_rates": f"""WITH {_POLLS}
SELECT h AS window_start, h + INTERVAL 1 HOUR AS window_end, n AS fetches
FROM (SELECT date_trunc('hour', fetched_at) AS h, count(*) AS n FROM polls WHERE ok GROUP BY 1)""",
    "snapshot_rates_sliding": f"""WITH {_POLLS}
SELECT h AS window_start, h + INTERVAL 2 HOUR AS window_end, n AS fetches
FROM (SELECT date_trunc('hour', fetched_at) - to_hours(k) AS h, count(*) AS n
      FROM polls CROSS JOIN (VALUES (0),(1)) AS t(k) WHERE ok GROUP BY 1)""",
    "focus_points": """WITH c AS (SELECT c_custkey AS k FROM customer),
own AS (
  SELECT k, unnest(range(1, CASE WHEN k % 5 = 2 THEN 7 ELSE 2 END)) AS slot FROM c WHERE k % 5 IN (1, 2) AND k % 120 <= 90
),
listed AS (
  SELECT k AS device_id, 0 AS slot, 'Home' AS name, k % 50 * 1e0 AS lat, k % 90 * 1e0 AS lon, 1 AS range_idx FROM c
  UNION ALL SELECT k, slot, 'F' || k, k % 120 * 1e0, k % 170 * 1e0, k % 4 FROM own
  UNION ALL SELECT k, 1, 'F' || k, k % 120 * 1e0, k % 170 * 1e0, k % 4 FROM c WHERE k % 5 = 4 AND k % 120 <= 90
  UNION ALL SELECT k, v.* FROM c CROSS JOIN (VALUES (1,'KSFO',37.6188e0,-122.3750e0,2),(2,'KOAK',37.7213e0,-122.2214e0,2)) AS v(slot,name,lat,lon,r)
            WHERE k % 5 IN (0, 3) OR k % 120 > 90
)
SELECT device_id, slot, name, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon, CAST(range_idx AS INT) AS range_idx FROM listed""",
    "quarantined_requests": """SELECT o_orderkey AS request_id, 'outside limits' AS reason FROM orders
WHERE NOT (o_orderkey % 300 - 10 > 0 AND o_orderkey % 300 - 10 <= 250 AND o_custkey % 30 <= 20 AND o_custkey % 50 <= 40)""",
}
