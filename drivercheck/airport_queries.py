"""Airport queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivercheck.track_queries import r6
from drivercheck.views import cte, table, view
from skylattice.operators import airports as A

_VIEW_KM = 1.852


def _sources(spark, sf_dir):
    return tuple(view(spark, sf_dir, name) for name in ("airports", "runways", "navaids"))


def built(spark, sf_dir):
    airports, runways, navaids = _sources(spark, sf_dir)
    return A.build_airports(airports, runways, A.approach_idents(runways, navaids))


def _index(spark, sf_dir):
    return A.airport_index(*_sources(spark, sf_dir))


def _sites(spark, sf_dir):
    """One site per customer, so the work grows with the table."""
    number = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        number.alias("site_id"),
        (F.lit(37.7552) + ((number * 7919) % 2001 - 1000) / 700.0).alias("lat"),
        (F.lit(-122.4528) + ((number * 104729) % 1999 - 1000) / 700.0).alias("lon"),
    )


_SITES_SQL = """sites AS (SELECT c_custkey AS site_id, 37.7552e0 + ((c_custkey*7919) % 2001 - 1000)/700e0 AS lat,
  -122.4528e0 + ((c_custkey*104729) % 1999 - 1000)/700e0 AS lon FROM customer)"""


def _views(spark, sf_dir):
    return view(spark, sf_dir, "metar_views").withColumn("radius_km", F.col("radius_nm") * _VIEW_KM)


def q_approach_idents(spark, sf_dir):
    _, runways, navaids = _sources(spark, sf_dir)
    return A.approach_idents(runways, navaids)


def q_airports_built(spark, sf_dir):
    return built(spark, sf_dir).select(
        "ident", r6("lat"), r6("lon"), "tier", F.col("instrument_approach").cast("int").alias("approach"), "runway_count"
    )


def q_airport_runways(spark, sf_dir):
    runways = A.airport_runways(view(spark, sf_dir, "runways"), include_closed=False)
    return runways.select("ident", "row_no", *[r6(c) for c in ("lat1", "lon1", "lat2", "lon2")])


def q_airport_index(spark, sf_dir):
    return _index(spark, sf_dir).select("icao", "iata", "city", "name", r6("lat"), r6("lon"), "iap")


def q_top_hubs(spark, sf_dir):
    return A.top_hubs(built(spark, sf_dir)).select("ident", "tier", r6("lat"), r6("lon"))


def q_airport_search(spark, sf_dir):
    found = A.airport_search(_index(spark, sf_dir), view(spark, sf_dir, "search_queries"))
    return found.select("query_id", "rank", "score", "icao", "name")


def q_resolve_points(spark, sf_dir):
    """Requests from suppliers: names, codes, coordinate pairs and junk."""
    number = F.col("s_suppkey")
    text = (
        F.when(number % 4 == 0, F.concat(F.lit(" "), (number % 100).cast("string"), F.lit(".5,"), (number % 200).cast("string")))
        .when(number % 4 == 1, F.col("s_name"))
        .when(number % 4 == 2, F.lit("zzz"))
        .otherwise(F.lit("K003"))
    )
    requests = table(spark, sf_dir, "supplier").select(number.alias("request_id"), text.alias("text"))
    return A.resolve_points(requests, _index(spark, sf_dir)).select("request_id", r6("lat"), r6("lon"), "label")


def q_nearest_approach_airport(spark, sf_dir):
    found = A.nearest_approach_airport(_sites(spark, sf_dir), built(spark, sf_dir))
    return found.select("site_id", "icao", r6("dist_nm"))


def q_nearest_in_tile(spark, sf_dir):
    found = A.nearest_approach_airport(_sites(spark, sf_dir), built(spark, sf_dir), same_tile_zoom=7)
    return found.select("site_id", "icao", r6("dist_nm"))


def q_reference_label(spark, sf_dir):
    found = A.nearest_approach_airport(_sites(spark, sf_dir), built(spark, sf_dir))
    return A.reference_label(found).select("site_id", "label")


def q_airports_near(spark, sf_dir):
    return A.airports_near(built(spark, sf_dir), _views(spark, sf_dir)).select("view_id", "ident", r6("dist_km"))


def q_runways_in_view(spark, sf_dir):
    runways = A.airport_runways(view(spark, sf_dir, "runways"))
    shown = A.runways_in_view(built(spark, sf_dir), runways, _views(spark, sf_dir))
    return shown.select("view_id", "ident", "row_no", *[r6(c) for c in ("x0", "y0", "x1", "y1")])


def q_airport_labels(spark, sf_dir):
    runways = A.airport_runways(view(spark, sf_dir, "runways"))
    return A.labelled_airports(built(spark, sf_dir), runways, _views(spark, sf_dir)).select("view_id", "ident")


QUERIES = {
    "approach_idents": q_approach_idents,
    "airports_built": q_airports_built,
    "airport_runways": q_airport_runways,
    "airport_index": q_airport_index,
    "top_hubs": q_top_hubs,
    "airport_search": q_airport_search,
    "resolve_points": q_resolve_points,
    "nearest_approach_airport": q_nearest_approach_airport,
    "nearest_in_tile": q_nearest_in_tile,
    "reference_label": q_reference_label,
    "airports_near": q_airports_near,
    "runways_in_view": q_runways_in_view,
    "airport_labels": q_airport_labels,
}

AIRPORT_CTE = (
    cte("airports", "runways", "navaids", "metar_views", "search_queries")
    + """,
approach AS (
  SELECT airport_ident AS ident FROM runways WHERE lighted = '1' AND closed <> '1'
  UNION SELECT associated_airport FROM navaids WHERE associated_airport <> ''
),
rated AS (
  SELECT a.*, CASE type WHEN 'large_airport' THEN 3 WHEN 'medium_airport' THEN 2 WHEN 'small_airport' THEN 1 ELSE 0 END AS tier,
         CAST(latitude_deg AS DOUBLE) AS lat, CAST(longitude_deg AS DOUBLE) AS lon, ident IN (SELECT ident FROM approach) AS approach
  FROM airports a
),
pads AS (
  SELECT *, CAST(le_ident LIKE 'H%' AS INT) + CAST(he_ident LIKE 'H%' AS INT) AS h FROM runways
),
strips AS (
  SELECT airport_ident AS ident, row_no, closed, TRY_CAST(le_latitude_deg AS DOUBLE) AS lat1, CAST(le_longitude_deg AS DOUBLE) AS lon1,
         CAST(he_latitude_deg AS DOUBLE) AS lat2, CAST(he_longitude_deg AS DOUBLE) AS lon2
  FROM pads WHERE NOT (h = 2 OR (h = 1 AND CAST(length_ft AS INT) < 2500)) AND le_latitude_deg <> ''
),
built AS (
  SELECT r.ident, lat, lon, tier, approach, coalesce(n, 0) AS runway_count
  FROM rated r LEFT JOIN (SELECT ident, count(*) AS n FROM strips GROUP BY 1) s ON r.ident = s.ident
  WHERE (tier >= 2 OR (tier = 1 AND (scheduled_service = 'yes' OR approach))) AND abs(lat) <= 90 AND abs(lon) <= 180
),
idx AS (
  SELECT ident AS icao, iata_code AS iata, municipality AS city, name, round(lat, 5) AS lat, round(lon, 5) AS lon,
         CAST(approach AS INT) AS iap, tier
  FROM rated WHERE tier >= 2 OR (tier = 1 AND scheduled_service = 'yes')
),
disc AS (SELECT view_id, center_lat, center_lon, radius_nm*1.852e0 AS radius_km FROM metar_views),
near AS (
  SELECT * FROM (SELECT v.*, b.*, sqrt(pow((lon - center_lon)*111e0*cos(radians(center_lat)), 2) + pow((lat - center_lat)*111e0, 2)) AS dist_km
                 FROM built b CROSS JOIN disc v) WHERE dist_km <= radius_km
)"""
)

_CUT = (
    AIRPORT_CTE
    + """,
flat AS (
  SELECT view_id, s.ident, row_no, radius_km AS r,
         (lon1 - center_lon)*111e0*cos(radians(center_lat)) AS x0, (lat1 - center_lat)*111e0 AS y0,
         (lon2 - center_lon)*111e0*cos(radians(center_lat)) AS x1, (lat2 - center_lat)*111e0 AS y1
  FROM near n JOIN strips s ON n.ident = s.ident
),
q AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) AS a, 2*(x0*(x1-x0) + y0*(y1-y0)) AS b, x0*x0 + y0*y0 - r*r AS c,
             x0*x0 + y0*y0 <= r*r AS in0, x1*x1 + y1*y1 <= r*r AS in1 FROM flat),
d AS (SELECT *, b*b - 4*a*c AS disc FROM q),
t AS (SELECT *, CASE WHEN in0 THEN 0e0 ELSE greatest(0e0, (-b - sqrt(greatest(disc, 0e0)))/(2*a)) END AS ta,
                CASE WHEN in1 THEN 1e0 ELSE least(1e0, (-b + sqrt(greatest(disc, 0e0)))/(2*a)) END AS tb FROM d),
cut AS (SELECT view_id, ident, row_no, CASE WHEN in0 AND in1 THEN x0 ELSE x0 + dx*ta END AS cx0, CASE WHEN in0 AND in1 THEN y0 ELSE y0 + dy*ta END AS cy0,
               CASE WHEN in0 AND in1 THEN x1 ELSE x0 + dx*tb END AS cx1, CASE WHEN in0 AND in1 THEN y1 ELSE y0 + dy*tb END AS cy1
        FROM t WHERE (in0 AND in1) OR (a > 0 AND disc >= 0 AND ta <= tb))"""
)

_SCORED = """,
scored AS (
  SELECT query_id, lower(trim(q)) AS q, i.*, CASE
    WHEN lower(icao) = lower(trim(q)) OR lower(iata) = lower(trim(q)) THEN 1000
    WHEN starts_with(lower(icao), lower(trim(q))) OR starts_with(lower(iata), lower(trim(q))) THEN 500
    WHEN starts_with(lower(city), lower(trim(q))) OR starts_with(lower(name), lower(trim(q))) THEN 200
    WHEN contains(lower(icao), lower(trim(q))) OR contains(lower(iata), lower(trim(q))) THEN 100
    WHEN contains(lower(city), lower(trim(q))) OR contains(lower(name), lower(trim(q))) THEN 50 ELSE 0 END AS score
  FROM idx i CROSS JOIN asked WHERE trim(q) <> ''
),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier DESC, icao, name) AS rank FROM scored WHERE score > 0)"""

_NEAREST = (
    AIRPORT_CTE
    + f""",
{_SITES_SQL},
tried AS (
  SELECT s.site_id, s.lat, s.lon, b.ident AS icao, b.lat AS ilat, b.lon AS ilon,
         sqrt(pow((b.lat - s.lat)*60e0, 2) + pow((b.lon - s.lon)*60e0*cos(radians(s.lat)), 2)) AS dist_nm
  FROM sites s CROSS JOIN built b WHERE b.approach
)"""
)

_LABEL = """,
best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY dist_nm, icao) = 1),
ang AS (
  SELECT *, degrees(atan2(sin(radians(lon - ilon))*cos(radians(lat)),
                          cos(radians(ilat))*sin(radians(lat)) - sin(radians(ilat))*cos(radians(lat))*cos(radians(lon - ilon)))) AS brg,
         degrees(atan2(sin(radians(-72.68e0 - ilon)), cos(radians(ilat))*tan(radians(80.65e0)) - sin(radians(ilat))*cos(radians(-72.68e0 - ilon)))) AS decl
  FROM best
)
SELECT site_id, CASE WHEN dist_nm <= 0.1e0 THEN icao ELSE format('{:.1f}', dist_nm) || ' nm ' ||
  list_extract(['N','NE','E','SE','S','SW','W','NW'], 1 + CAST(floor(((brg - decl + 720e0) % 360e0)/45e0 + 0.5e0) AS INT) % 8) || ' of ' || icao END AS label
FROM ang"""

ORACLES = {
    "approach_idents": f"WITH {AIRPORT_CTE} SELECT ident FROM approach",
    "airports_built": f"""WITH {AIRPORT_CTE}
SELECT ident, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon, tier, CAST(approach AS INT) AS approach, runway_count FROM built""",
    "airport_runways": f"""WITH {AIRPORT_CTE}
SELECT ident, row_no, round(lat1, 6)+0e0 AS lat1, round(lon1, 6)+0e0 AS lon1, round(lat2, 6)+0e0 AS lat2, round(lon2, 6)+0e0 AS lon2
FROM strips WHERE closed <> '1'""",
    "airport_index": f"""WITH {AIRPORT_CTE}
SELECT icao, iata, city, name, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon, iap FROM idx""",
    "top_hubs": f"""WITH {AIRPORT_CTE}
SELECT ident, tier, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon FROM built WHERE tier >= 3 ORDER BY tier DESC, ident LIMIT 150""",
    "airport_search": f"""WITH {AIRPORT_CTE}, asked AS (SELECT * FROM search_queries){_SCORED}
SELECT query_id, rank, score, icao, name FROM hits WHERE rank <= 8""",
    "resolve_points": f"""WITH {AIRPORT_CTE},
requests AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 1 THEN s_name WHEN 2 THEN 'zzz' ELSE 'K003' END AS q FROM supplier WHERE s_suppkey % 4 <> 0),
asked AS (SELECT request_id AS query_id, q FROM requests){_SCORED},
pairs AS (SELECT s_suppkey AS request_id, s_suppkey % 100 + 0.5e0 AS lat, s_suppkey % 200 * 1e0 AS lon FROM supplier WHERE s_suppkey % 4 = 0)
SELECT request_id, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon, format('{{:.4f}},{{:.4f}}', lat, lon) AS label FROM pairs WHERE lat <= 90 AND lon <= 180
UNION ALL SELECT query_id, round(lat, 6)+0e0, round(lon, 6)+0e0, icao FROM hits WHERE rank = 1""",
    "nearest_approach_airport": f"""WITH {_NEAREST}
SELECT site_id, icao, round(dist_nm, 6)+0e0 AS dist_nm FROM tried
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY dist_nm, icao) = 1""",
    "nearest_in_tile": f"""WITH {_NEAREST}
SELECT site_id, icao, round(dist_nm, 6)+0e0 AS dist_nm FROM tried
WHERE floor((lon + 180e0)/2.8125e0) = floor((ilon + 180e0)/2.8125e0) AND floor((90e0 - lat)/1.40625e0) = floor((90e0 - ilat)/1.40625e0)
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY dist_nm, icao) = 1""",
    "reference_label": f"WITH {_NEAREST}{_LABEL}",
    "airports_near": f"WITH {AIRPORT_CTE} SELECT view_id, ident, round(dist_km, 6)+0e0 AS dist_km FROM near",
    "runways_in_view": f"""WITH {_CUT}
SELECT view_id, ident, row_no, round(cx0, 6)+0e0 AS x0, round(cy0, 6)+0e0 AS y0, round(cx1, 6)+0e0 AS x1, round(cy1, 6)+0e0 AS y1 FROM cut""",
    "airport_labels": f"WITH {_CUT} SELECT DISTINCT view_id, ident FROM cut",
}
