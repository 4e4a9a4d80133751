"""Stations met within reach of a view, against all pairs."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from skylattice.operators import nearest
from skylattice.operators import weather as W


def _dist(lat, lon, to_lat, to_lon):
    return 60 * math.hypot(to_lat - lat, (to_lon - lon) * math.cos(math.radians(lat)))


def _tables(spark):
    rng = random.Random(7)
    places = [(rng.gauss(40, 0.3), rng.gauss(-100, 0.3)) for _ in range(500)]
    places += [(rng.gauss(72, 2), rng.gauss(15, 4)) for _ in range(300)]
    places += [(rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for _ in range(200)]
    places += [(40.0, -100.0)] * 30 + [(-0.01, 0.0), (None, 3.0), (float("nan"), 3.0)]
    stations = [(f"K{n:04d}", *place) for n, place in enumerate(places)]
    centers = [(rng.gauss(40, 0.5), rng.gauss(-100, 0.5)) for _ in range(60)]
    centers += [(rng.gauss(72, 3), rng.gauss(15, 5)) for _ in range(40)]
    centers += [(rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for _ in range(40)] + [(40.0, -100.0), (89.8, 10.0)]
    views = [(n, *c, rng.choice([0.5, 5.0, 40.0, 300.0])) for n, c in enumerate(centers)] + [(-1, None, 3.0, 40.0)]
    return (
        spark.createDataFrame(stations, "icao string, lat double, lon double"),
        spark.createDataFrame(views, "view_id long, center_lat double, center_lon double, radius_nm double"),
        stations,
        views,
    )


def test_nearest_stations_in_reach_equal_all_pairs(spark):
    stations, views, rows, asked = _tables(spark)
    for k in (1, 5):
        got = W.nearest_k_stations(stations, views, k=k, narrowed=True).select("view_id", "rank", "icao").collect()
        boxed = W.stations_in_bbox(stations, views).select("view_id", "icao", "dist_nm").collect()
        inside: dict = {}
        for view_id, icao, dist in boxed:
            inside.setdefault(view_id, []).append((dist, icao))
        expected = {(v, n + 1, icao) for v, found in inside.items() for n, (_, icao) in enumerate(sorted(found)[:k])}
        assert {tuple(r) for r in got} == expected
        assert len(got) == len(expected)


def test_reach_holds_k_points_and_few_more(spark):
    stations, views, rows, asked = _tables(spark)
    k = 5
    reach = {r.view_id: r._reach for r in nearest.with_reach(views, stations, k, lat="center_lat", lon="center_lon").collect()}
    assert len(reach) == len(asked)
    held = []
    for view_id, lat, lon, _ in asked:
        if lat is None:
            assert reach[view_id] is None
            continue
        near = sum(_dist(lat, lon, *at) <= reach[view_id] for _, *at in rows if at[0] is not None and at[0] == at[0])
        assert near >= k
        held.append(near)
    assert sorted(held)[len(held) // 2] <= 8 * k


def test_views_meet_few_stations_however_dense(spark):
    """In a box of any number of stations a view meets a few times k of them."""
    place = ((F.col("id") * 7907) % 9973 / 9973.0, (F.col("id") * 6151) % 9967 / 9967.0)
    stations = spark.range(20_000).select(F.format_string("K%05d", "id").alias("icao"), place[0].alias("lat"), place[1].alias("lon"))
    views = spark.range(50).select(F.col("id").alias("view_id"), (0.3 + (F.col("id") % 7) * 0.06).alias("center_lat"), (0.3 + (F.col("id") % 5) * 0.09).alias("center_lon"), F.lit(15.0).alias("radius_nm"))
    assert W.stations_in_bbox(stations, views).count() > 50 * 3000
    assert W._in_reach(stations, views, 32, 1.1).count() < 50 * 32 * 4
    near = W.nearest_k_stations(stations, views, k=32, narrowed=True)
    plain = W.nearest_k_stations(stations, views, k=32, narrowed=False)
    assert near.exceptAll(plain).count() == 0 and near.count() == plain.count() == 50 * 32
