from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import airports as A
from skylattice.operators import nearest, quadtree
from skylattice.operators import surveillance as S
from skylattice.operators import tilepyramid as P
from skylattice.operators import weather as W


def _points(seed, n=600):
    pick = random.Random(seed)
    rows = [(f"P{i}", pick.uniform(-90, 90), pick.uniform(-180, 180)) for i in range(n // 3)]
    rows += [(f"C{i}", pick.uniform(37, 38), pick.uniform(-123, -122)) for i in range(n // 3)]
    rows += [(f"S{i}", 37.5, -122.5) for i in range(n // 3)]
    return [*rows, ("edge", 90.0, 180.0), ("corner", -90.0, -180.0), ("none", None, 3.0), ("zero", 0.0, 0.0)]


def _views(seed, n=60):
    pick = random.Random(seed)
    rows = [(i, pick.uniform(-80, 80), pick.uniform(-170, 170), 10 ** pick.uniform(0, 3.5)) for i in range(n)]
    rows += [(100 + i, pick.uniform(37, 38), pick.uniform(-123, -122), 10 ** pick.uniform(-1, 2)) for i in range(n)]
    return [*rows, (300, 37.5, -122.5, 1e-3), (301, 89.9, 0.0, 50.0), (302, 0.0, 179.9, 500.0), (303, 37.5, -122.5, 30000.0)]


def _km(view, point):
    return math.hypot((point[2] - view[2]) * 111 * math.cos(math.radians(view[1])), (point[1] - view[1]) * 111)


@pytest.mark.parametrize("hot_rows", [None, 1, 20])
def test_discs_meet_all_their_points(spark, hot_rows):
    points, views = _points(1), _views(2)
    airports = spark.createDataFrame(points, "ident string, lat double, lon double")
    discs = spark.createDataFrame(views, "view_id int, center_lat double, center_lon double, radius_km double")
    got = sorted((r.view_id, r.ident) for r in A.airports_near(airports, discs, hot_rows=hot_rows).collect())
    assert got == sorted((v[0], p[0]) for v in views for p in points if p[1] is not None and _km(v, p) <= v[3])


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_boxes_meet_all_their_points(spark, hot_rows):
    points = [p for p in _points(3) if p[1] is not None]
    views = [(v[0], v[1], v[2], v[3] / 20) for v in _views(4) if abs(v[1]) < 85]
    stations = spark.createDataFrame(points, "icao string, lat double, lon double")
    boxes = spark.createDataFrame(views, "view_id int, center_lat double, center_lon double, radius_nm double")
    got = sorted((r.view_id, r.icao) for r in W.stations_in_bbox(stations, boxes, inflate=1.0, hot_rows=hot_rows).collect())
    expected = []
    for v, lat, lon, nm in views:
        up, side = nm / 60, nm / 60 / math.cos(math.radians(lat))
        expected += [(v, p[0]) for p in points if lat - up <= p[1] <= lat + up and lon - side <= p[2] <= lon + side]
    assert got == sorted(expected)


def test_what_meets_is_mostly_kept(spark):
    """Evenly spread tracks, views of many sizes: at most four pairs tested for one that is kept."""
    pick = random.Random(5)
    rows = [(i, pick.uniform(30, 40), pick.uniform(10, 20)) for i in range(20_000)]
    tracks = spark.createDataFrame(rows, "feed_pos int, lat double, lon double")
    views = [(i, pick.uniform(31, 39), pick.uniform(11, 19), 10 ** pick.uniform(1, 2)) for i in range(300)]
    centers = spark.createDataFrame(views, "slot int, lat double, lon double, outer_km double")
    kept = S.tracks_in_radius(tracks, centers, scale=1.0).count()
    placed = centers.withColumnsRenamed({"lat": "center_lat", "lon": "center_lon"})
    box, touches = quadtree.disc_box("center_lat", "center_lon", F.col("outer_km"), 111.0)
    met = quadtree.meet(tracks, placed, box, touches=touches).count()
    assert kept <= met <= 4 * kept


def test_no_views_and_no_points(spark):
    tracks = spark.createDataFrame([(1, 2.0, 3.0)], "feed_pos int, lat double, lon double")
    views = spark.createDataFrame([(1, 2.0, 3.0, 10.0)], "slot int, lat double, lon double, outer_km double")
    assert S.tracks_in_radius(tracks, views.limit(0)).columns == S.tracks_in_radius(tracks, views).columns
    assert S.tracks_in_radius(tracks, views.limit(0)).count() == 0
    assert S.tracks_in_radius(tracks.limit(0), views, hot_rows=1).count() == 0


def _nearest_by_force(sites, points):
    out = {}
    for site, lat, lon in sites:
        out[site] = min((math.hypot((p[1] - lat) * 60, (p[2] - lon) * 60 * math.cos(math.radians(lat))), p[0]) for p in points)
    return out


@pytest.mark.parametrize("crowded", [16, 2])
def test_nearest_in_dense_and_empty_parts(spark, monkeypatch, crowded):
    monkeypatch.setattr(nearest, "CROWDED", crowded)
    pick = random.Random(6)
    points = [(f"D{i:04}", 40.1 + pick.uniform(0, 0.4), 10.1 + pick.uniform(0, 0.4)) for i in range(400)]
    points += [(f"E{i:04}", 40.2, 10.2) for i in range(50)] + [(f"F{i:04}", pick.uniform(-60, 70), pick.uniform(-180, 180)) for i in range(40)]
    sites = [(i, 40 + pick.uniform(0, 0.6), 10 + pick.uniform(0, 0.6)) for i in range(300)]
    sites += [(1000 + i, pick.uniform(-85, 85), pick.uniform(-180, 180)) for i in range(200)] + [(2000, 40.2, 10.2)]
    df = spark.createDataFrame([*sites, (3000, None, 1.0), (3001, float("nan"), 1.0)], "site int, lat double, lon double")
    fields = spark.createDataFrame(points, "id string, lat double, lon double")
    got = {r.site: (r._best.dist_nm, r._best.id) for r in nearest.nearest(df, fields).collect()}
    expected = _nearest_by_force(sites, points)
    assert set(got) == set(expected)
    assert all(got[s][0] == pytest.approx(expected[s][0], abs=1e-9) for s in got)
    assert [s for s in got if got[s][1] != expected[s][1]] == []
    assert nearest.nearest(df, fields.limit(0)).count() == 0


def test_few_points_are_tested_for_each_site(spark):
    pick = random.Random(7)
    points = [(f"D{i}", pick.gauss(40, 3), pick.gauss(10, 3)) for i in range(1500)]
    sites = [(i, pick.uniform(30, 50), pick.uniform(0, 20)) for i in range(2000)]
    lists = nearest.near_lists(
        spark.createDataFrame(sites, "site int, lat double, lon double"), spark.createDataFrame(points, "id string, lat double, lon double")
    )
    tested = lists.agg(F.sum(F.size("near"))).first()[0]
    assert tested <= 0.1 * len(points) * len(sites)


def test_stored_search_index_and_repeated_queries(spark):
    pick = random.Random(8)
    cities = ["Oslo", "Osaka", "", None, "San José"]
    rows = [
        (f"K{i % 97:03}", f"Q{i % 5}", pick.choice(cities), f"Field {i % 31}", 1.0 * i, 2.0, i % 2, i % 4) for i in range(400)
    ]
    index = spark.createDataFrame(rows, "icao string, iata string, city string, name string, lat double, lon double, iap int, tier int")
    asked = ["k0", "K001", "os", "o", "field 1", " san j", "é", "q4", "zzzz", "", "field", "ield 30", "K001"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    stored = A.build_search_index(index)

    def score(q, row):
        codes, names = [(t or "").lower() for t in row[:2]], [(t or "").lower() for t in row[2:4]]
        if q in codes:
            return 1000
        if any(t.startswith(q) for t in codes):
            return 500
        if any(t.startswith(q) for t in names):
            return 200
        return 100 if any(q in t for t in codes) else 50 if any(q in t for t in names) else 0

    for where, limit in ((index, 8), (stored, 8), (stored, 3)):
        got = {}
        for r in A.airport_search(where, queries, limit=limit).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.score, r.tier, r.icao, r.name))
        for k, text in enumerate(asked):
            q = text.strip().lower()
            best = sorted(((-score(q, r), -r[7], r[0], r[3]) for r in rows if q and score(q, r)))[:limit]
            assert sorted(got.get(k, [])) == [(i + 1, -s, -t, icao, name) for i, (s, t, icao, name) in enumerate(best)], text
    with pytest.raises(ValueError, match="8 rows"):
        A.airport_search(stored, queries, limit=9)


def test_hot_tiles_are_cut_by_count(spark):
    line = [(0.1, 0.1), (0.2, 0.2)]
    rows = [(i, "coast", 0, 0, 7, 64 + (i % 10 == 0), 63, line) for i in range(300)]
    shapes = spark.createDataFrame(rows, "feature_id int, layer string, part int, run int, z int, x int, y int, points array<struct<lon:double,lat:double>>")
    views = spark.createDataFrame([(v, 0.5, 1.0 + v, 100.0) for v in range(4)], "view_id int, center_lat double, center_lon double, radius_km double")
    whole, cut = (
        sorted((r.view_id, r.feature_id, r.x) for r in P.map_layers_for_view(views, shapes, hot_rows=n).collect()) for n in (None, 7)
    )
    assert whole and whole == cut
