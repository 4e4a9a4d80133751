"""What only larger tables showed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import airports as A
from skylattice.operators import geometry_kernels as K
from skylattice.operators import quadtree
from skylattice.operators import tilepyramid as P
from skylattice.sources import tile_blobs

OCTAGON = ((1.0, 0.0), (0.7, 0.7), (0.0, 1.0), (-0.7, 0.7), (-1.0, 0.0), (-0.7, -0.7), (0.0, -1.0), (0.7, -0.7))


def test_of_equally_far_corners_the_one_of_the_plain_formula_stays():
    lon = np.array([-170.0 + (20177 * 104729 % 3301) / 10.0 + dx * 2.2 for dx, _ in OCTAGON])
    lat = np.array([-70.0 + (20177 * 7919 % 1301) / 10.0 + dy * 2.2 for _, dy in OCTAGON])
    thinned = K.thin(K.Rings(lon, lat, np.array([8])), np.float64(1.0))
    assert thinned.lens.tolist() == [5]
    assert (round(thinned.lat.sum(), 6), round(thinned.lon.sum(), 6)) == (-27.04, -3.96)


def test_hubs_that_share_an_ident_are_cut_by_place(spark):
    rows = [("K000", 3.0, 0.0, 3), ("K001", 2.0, 1.0, 3), ("K001", 1.0, 7.0, 3), ("K001", 1.0, 5.0, 3)]
    for order in (rows, rows[::-1]):
        ports = spark.createDataFrame(order, "ident string, lat double, lon double, tier int")
        assert [(r.ident, r.lat, r.lon) for r in A.top_hubs(ports, n=2).collect()] == [("K000", 3.0, 0.0), ("K001", 1.0, 5.0)]


PORTS = "ident string, lat double, lon double, tier int, instrument_approach boolean, runway_count long"
STRIPS = "ident string, row_no long, lat1 double, lon1 double, lat2 double, lon2 double"


def many_runways(spark, n):
    ports = spark.createDataFrame([("KSFO", 37.6188, -122.375, 3, True, n), ("KOAK", 37.7213, -122.2214, 2, False, 1)], PORTS)
    strips = [("KSFO", i, i / 1e4, -i / 1e4, 1.5, -2.5) for i in range(n)] + [("KOAK", n, 7.0, 8.0, 9.0, 10.0)]
    nested = A.nest_runways(ports, spark.createDataFrame(strips, STRIPS), most=None)
    shapes = spark.createDataFrame([], K.SHAPE_SCHEMA + ", action string")
    return shapes, P.airport_tiles(nested, zooms={7: 0.0})


def test_airports_of_many_runways_are_written_and_read(spark):
    for n in (255, 256, 70_000):
        shapes, placed = many_runways(spark, n)
        blob = tile_blobs.encode_tiles(shapes, placed).collect()
        assert len(blob) == 1 and blob[0].reason is None and blob[0].payload[4] == (1 if n <= 255 else 2)
        assert blob[0].bytes == len(blob[0].payload) == P.tile_sizes(shapes, placed).first().bytes
        read = tile_blobs.decode_tiles(spark.createDataFrame([("p", blob[0].payload)], "path string, payload binary")).collect()
        sfo, oak = sorted(read, key=lambda r: r.ident, reverse=True)
        assert (sfo.ident, sfo.flags, oak.ident, oak.flags) == ("KSFO", 15, "KOAK", 10)
        assert sfo.lats == [37.6188, *[v for i in range(n) for v in (i / 1e4, 1.5)]] and sfo.lons[-2:] == [-(n - 1) / 1e4, -2.5]
        assert oak.lats == [37.7213, 7.0, 9.0]


def test_merged_tiles_hold_any_number_of_runways(spark):
    tile = P.merge_layers(*many_runways(spark, 300)).select(F.transform("airports", lambda a: F.size(a["runways"])).alias("n")).collect()
    assert [r.n for r in tile] == [[300, 1]]


def test_sections_of_more_items_than_two_bytes_count(spark):
    n = 70_000
    ports = spark.range(n).selectExpr(
        "concat('K', lpad(id, 7, '0')) AS ident", "37.6 AS lat", "-122.4 AS lon", "1 AS tier", "false AS instrument_approach", "0L AS runway_count",
        "cast(array() AS array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>) AS runways",
    )
    shapes = spark.createDataFrame([], K.SHAPE_SCHEMA + ", action string")
    blobs = tile_blobs.encode_tiles(shapes, P.airport_tiles(ports, zooms={7: 0.0}))
    read = tile_blobs.decode_tiles(blobs.withColumn("path", F.lit("")))
    got = read.agg(F.count("ident"), F.max("ident"), F.max("item"), F.count("reason")).head()
    assert tuple(got) == (n, f"K{n - 1:07d}", n - 1, 0)


def test_views_spread_over_cells_are_not_broadcast_by_their_size_before(spark):
    points = spark.range(50).selectExpr("id", "37.0 + id / 100 AS lat", "-122.0 AS lon")
    views = spark.range(40).selectExpr("id AS view_id", "37.2 AS center_lat", "-122.0 AS center_lon", "5.0 AS radius_km")
    box, touches = quadtree.disc_box("center_lat", "center_lon", F.col("radius_km"), 111.0)
    for hot_rows in (None, 5):
        met = quadtree.meet(points, views, box, touches=touches, hot_rows=hot_rows)
        top = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line][0]
        assert "strategy=merge" in top and met.select("id", "view_id").distinct().count() == met.count()


def test_the_nearest_of_a_tile_is_found_without_meeting_all_of_it(spark):
    """Sites at tile borders, whose nearest field lies in the next tile, and a tile without fields."""
    rng = np.random.default_rng(5)
    fields = [(f"K{i:03d}", float(a), float(o), True) for i, (a, o) in enumerate(rng.uniform((36.5, -125.0), (39.4, -120.0), (300, 2)))]
    sites = [(i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform((36.5, -125.0), (39.4, -120.0), (400, 2)))] + [(400, 0.0, 0.0)]
    tile = lambda lat, lon: (np.floor((lon + 180.0) / 2.8125), np.floor((90.0 - lat) / 1.40625))
    far = lambda s, f: np.sqrt(((f[2] - s[2]) * 60 * np.cos(np.radians(s[1]))) ** 2 + ((f[1] - s[1]) * 60) ** 2)
    want = {}
    for s in sites:
        if here := [(far(s, f), f[0]) for f in fields if tile(*f[1:3]) == tile(*s[1:])]:
            want[s[0]] = min(here)[1]
    df = spark.createDataFrame(sites, "site_id int, lat double, lon double")
    ports = spark.createDataFrame(fields, "ident string, lat double, lon double, instrument_approach boolean")
    found = A.nearest_approach_airport(df, ports, same_tile_zoom=7)
    assert {r.site_id: r.icao for r in found.collect()} == want and 400 not in want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "icao_lon" in found.columns and "_x" not in plan  # sites and fields do not meet by tile
