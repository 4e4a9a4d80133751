"""Domain tables derived from the driver's tables by integer arithmetic.

The driver's tables hold no coordinates. Each view is one SQL text that Spark and DuckDB both run,
over whole tables, so results can be compared. ``{name}`` marks a driver table. Literals such as
``2000e0`` are doubles in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "CAST(floor(event_id/3e0) AS BIGINT)"

# Three consecutive events are one real aircraft seen through up to three receivers.
RAW_TRACKS = f"""
SELECT event_id AS feed_pos,
       {_PLACE} % 24 AS snapshot_id,
       ts AS fetched_at,
       user_id AS entity_id,
       'h' || CAST(event_id AS STRING) AS hex,
       CASE WHEN event_id % 4 = 0 THEN ''
            WHEN {_PLACE} % 5 = 0 THEN 'X' || CAST(event_id AS STRING)
            WHEN event_id % 7 = 0 THEN '~fl' || CAST({_PLACE} AS STRING)
            ELSE 'FL' || CAST({_PLACE} AS STRING) END AS flight,
       CASE WHEN event_id % 6 = 1 THEN 'N' || CAST({_PLACE} AS STRING) ELSE '' END AS r,
       CASE WHEN event_id % 9 = 2 THEN 'B738' ELSE '' END AS t,
       CASE event_id % 5 WHEN 0 THEN 'adsb_icao' WHEN 1 THEN 'tisb_other' WHEN 2 THEN 'mlat'
                         WHEN 3 THEN 'adsr_icao' ELSE 'adsb_icao_nt' END AS type,
       CASE WHEN event_id % 101 = 100 THEN NULL ELSE
         37.7552e0 + (({_PLACE}*7919) % 2001 - 1000)/2000e0
         + CASE event_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.001e0 ELSE 0.0047e0 END END AS lat,
       -122.4528e0 + (({_PLACE}*104729) % 1999 - 1000)/2000e0 AS lon,
       CASE WHEN event_id % 53 = 0 THEN 'ground'
            WHEN event_id % 59 = 0 THEN NULL
            ELSE CAST(({_PLACE}*37) % 40000 + (event_id % 3)*({_PLACE} % 4)*100 AS STRING) END AS alt_baro,
       CASE WHEN event_id % 118 = 0 THEN NULL ELSE ({_PLACE}*37) % 40000 + 12.5e0 END AS alt_geom,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE ({_PLACE}*17) % 400 * 1e0 END AS gs,
       CASE WHEN event_id % 16 = 0 THEN ({_PLACE}*17) % 400 + 20e0 ELSE NULL END AS tas,
       CAST(NULL AS DOUBLE) AS ias,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE ({_PLACE}*13) % 360 * 1e0 END AS track,
       CASE WHEN event_id % 20 = 0 THEN ({_PLACE}*13) % 360 + 2e0 ELSE NULL END AS true_heading,
       CASE WHEN event_id % 30 = 10 THEN ({_PLACE}*13) % 360 + 1e0 ELSE NULL END AS mag_heading,
       CAST(NULL AS DOUBLE) AS dir,
       CASE WHEN event_id % 41 = 7 THEN NULL ELSE (event_id % 41 - 20)*100e0 END AS baro_rate,
       CASE WHEN event_id % 82 = 7 THEN 640e0 ELSE NULL END AS geom_rate,
       CASE WHEN event_id % 97 = 0 THEN '7700' WHEN event_id % 89 = 0 THEN NULL ELSE '1200' END AS squawk
FROM {{events}}
"""

# Identifiers are 'K' and three base-36 digits.
_DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def _ident(number: str) -> str:
    parts = [
        f"substr({_DIGITS}, CAST(floor(({number}) / {d}e0) AS INT) % 36 + 1, 1)" for d in (1296, 36, 1)
    ]
    return "'K' || " + " || ".join(parts)


def _lat(number: str, base: str = "37.7552e0") -> str:
    return f"{base} + ((({number})*7907) % 2001 - 1000)/1000e0"


def _lon(number: str, base: str = "-122.4528e0") -> str:
    return f"{base} + ((({number})*6151) % 1999 - 1000)/1000e0"


AIRPORTS = f"""
SELECT s_suppkey AS row_no,
       {_ident("s_suppkey")} AS ident,
       CASE s_suppkey % 6 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' WHEN 2 THEN 'small_airport'
                          WHEN 3 THEN 'small_airport' WHEN 4 THEN 'heliport' ELSE 'closed' END AS type,
       CASE WHEN s_suppkey % 12 = 3 THEN 'yes' ELSE 'no' END AS scheduled_service,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Q' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') ELSE '' END AS iata_code,
       n_name AS municipality,
       s_name AS name,
       CAST({_lat("s_suppkey")} AS STRING) AS latitude_deg,
       CASE WHEN s_suppkey % 47 = 46 THEN '3824610.0' ELSE CAST({_lon("s_suppkey")} AS STRING) END AS longitude_deg
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
"""

_RUNWAY_OF = "p_partkey % 120"
RUNWAYS = f"""
SELECT p_partkey AS row_no,
       {_ident(_RUNWAY_OF)} AS airport_ident,
       CASE WHEN p_size % 2 = 1 AND p_partkey % 120 % 5 <> 1 THEN '1' ELSE '0' END AS lighted,
       CASE WHEN p_size % 7 = 0 THEN '1' ELSE '0' END AS closed,
       CAST(p_size*200 AS STRING) AS length_ft,
       CASE WHEN p_partkey % 11 = 0 THEN 'H1' ELSE '28L' END AS le_ident,
       CASE WHEN p_partkey % 22 = 0 THEN 'H2' ELSE '10R' END AS he_ident,
       CASE WHEN p_partkey % 61 = 60 THEN '' ELSE CAST({_lat(_RUNWAY_OF)} - 0.01e0 AS STRING) END AS le_latitude_deg,
       CAST({_lon(_RUNWAY_OF)} - 0.012e0 AS STRING) AS le_longitude_deg,
       CAST({_lat(_RUNWAY_OF)} + (p_partkey % 5)*0.004e0 AS STRING) AS he_latitude_deg,
       CAST({_lon(_RUNWAY_OF)} + (p_partkey % 7)*0.003e0 AS STRING) AS he_longitude_deg
FROM {{part}}
"""

NAVAIDS = f"""
SELECT n_nationkey,
       CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE {_ident("n_nationkey*4 + 2")} END AS associated_airport,
       CASE WHEN n_regionkey % 2 = 0 THEN 'VOR' ELSE 'NDB' END AS type
FROM {{nation}}
"""

METAR = f"""
SELECT o_orderkey AS obs_id,
       {_ident("o_custkey")} AS icao,
       {_lat("o_custkey", "37.661e0")} AS lat,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE {_lon("o_custkey", "-122.160e0")} END AS lon,
       CASE o_orderkey % 6 WHEN 0 THEN '10+' WHEN 1 THEN '3' WHEN 2 THEN '2 1/2' WHEN 3 THEN '0'
                           WHEN 4 THEN '6' ELSE NULL END AS visib,
       CASE WHEN o_orderkey % 9 = 0 THEN 'VRB' ELSE CAST((o_orderkey*10) % 360 AS STRING) END AS wdir,
       CAST(o_orderkey % 40 AS STRING) AS wspd,
       CASE o_orderkey % 5 WHEN 0 THEN 'BKN' WHEN 1 THEN 'FEW' WHEN 2 THEN 'ovc' WHEN 3 THEN 'VV' ELSE 'SCT' END AS cover1,
       CAST((o_orderkey*37) % 60 AS INT)*100 AS base1,
       CASE o_orderkey % 7 WHEN 0 THEN 'OVC' WHEN 1 THEN 'BKN' ELSE 'FEW' END AS cover2,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey*53) % 80 AS INT)*100 END AS base2,
       o_orderdate AS fetched_at
FROM {{orders}}
"""

READINGS = """
SELECT event_id AS reading_id,
       user_id AS site_id,
       ts AS fetched_at,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id % 110) - 10e0 END AS temp_f,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 45)*1e0 END AS wind_kts,
       (event_id*37) % 360 * 1e0 AS wind_deg_from,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 980e0 + (event_id % 60) END AS pressure_hpa,
       CASE WHEN event_id % 4 = 0 THEN CAST((user_id % 25 - 12)*3600 AS INT) ELSE NULL END AS utc_offset_sec,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS home_moved
FROM {events}
"""

# One octagon per customer: its shape attributes, then its eight vertices.
_OCTAGON = ((1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7))
RINGS = """
SELECT c_custkey AS feature_id,
       CASE WHEN c_custkey % 4 = 3 THEN 'water' ELSE 'land' END AS layer,
       -170e0 + ((c_custkey*104729) % 3301)/10e0 AS mid_lon,
       -70e0 + ((c_custkey*7919) % 1301)/10e0 AS mid_lat,
       0.5e0 + (c_custkey % 40)/10e0 AS radius,
       CASE WHEN c_custkey % 13 = 5 THEN 0.2e0 ELSE 3.5e0 END AS area
FROM {customer}
"""
OCTAGON = _OCTAGON
VERTICES = (
    "SELECT feature_id, layer, area, v, mid_lon + dx*radius AS lon, mid_lat + dy*radius AS lat FROM ("
    + RINGS
    + ") r CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {dx!r}e0, {dy!r}e0)" for i, (dx, dy) in enumerate(_OCTAGON))
    + ") AS t(v, dx, dy)"
)

# Inline tables: fixed presets and view requests.
RANGES_VALUES = "(0,5,9.26e0,20), (1,10,18.52e0,15), (2,15,27.78e0,10), (3,25,46.3e0,6)"
FOCUS_VALUES = (
    "(0,'Home',37.7552e0,-122.4528e0,1), (1,'KSFO',37.6188e0,-122.3750e0,2), (2,'KOAK',37.7213e0,-122.2214e0,2)"
)
METAR_VIEW_VALUES = "(0,37.661e0,-122.160e0,28e0), (1,37.7552e0,-122.4528e0,15e0), (2,38.2e0,-121.9e0,40e0)"
QUERY_VALUES = "(0,'k01'), (1,'q0'), (2,'nation_1'), (3,'supplier'), (4,'  K003 '), (5,''), (6,'1'), (7,'#0000')"

SQL = {
    "raw_tracks": RAW_TRACKS,
    "airports": AIRPORTS,
    "runways": RUNWAYS,
    "navaids": NAVAIDS,
    "metar": METAR,
    "readings": READINGS,
    "rings": RINGS,
    "vertices": VERTICES,
    "ranges": f"SELECT * FROM (VALUES {RANGES_VALUES}) AS t(range_idx, nm, outer_km, tag_budget)",
    "focus": f"SELECT * FROM (VALUES {FOCUS_VALUES}) AS t(slot, name, lat, lon, range_idx)",
    "metar_views": f"SELECT * FROM (VALUES {METAR_VIEW_VALUES}) AS t(view_id, center_lat, center_lon, radius_nm)",
    "search_queries": f"SELECT * FROM (VALUES {QUERY_VALUES}) AS t(query_id, q)",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores if its files hold fewer splits than there are cores.

    The test tables are single files of one row group, so one task would do all per-row work. Tables
    of many row groups, and nations and regions, are taken as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("nation", "region") or rows.rdd.getNumPartitions() >= cores:
        return rows
    # Filters on worked-out columns would be moved ahead of the spreading, into the one task; none passes this one.
    return rows.repartition(cores).filter(F.monotonically_increasing_id() >= 0)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a Spark DataFrame over the parquet tables of ``sf_dir``."""
    text = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def cte(*names: str) -> str:
    """The same views as a WITH list for the checking engine."""
    return ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in _TABLES})})" for n in names)
