from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import tilemath
from skylattice.operators import tilepyramid as P

FEATURE = "feature_id long, layer string, part int, points array<struct<lon:double,lat:double>>"
AIRPORT = "ident string, lat double, lon double, tier int, instrument_approach boolean, runway_count long"


def features(spark, *rows):
    return spark.createDataFrame([(i, layer, 0, points) for i, (layer, points) in enumerate(rows)], FEATURE)


def airports(spark, *rows):
    return spark.createDataFrame([(i, la, lo, 3, False, n) for i, la, lo, n in rows], AIRPORT)


def shapes_by_tile(df):
    out = defaultdict(list)
    for r in df.orderBy("feature_id", "part", "run").collect():
        out[(r.feature_id, r.z, r.x, r.y)].append([(p.lon, p.lat) for p in r.points])
    return dict(out)


def wiggle(seed, n, lon=-122.0, lat=37.0, step=0.4):
    rng = random.Random(seed)
    points = [(lon, lat)]
    for _ in range(n - 1):
        points.append((max(-180.0, min(180.0, points[-1][0] + rng.uniform(-step, step))), max(-90.0, min(90.0, points[-1][1] + rng.uniform(-step, step)))))
    return points


def blob(seed, n, lon, lat, size):
    rng = random.Random(seed)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(lon + size * rng.uniform(0.3, 1) * math.cos(a), lat + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


# --- brute force: one tile and one shape at a time ------------------------------------------


def box_of(z, x, y):
    n = 2**z
    return -180 + x * 360 / n, -180 + (x + 1) * 360 / n, 90 - (y + 1) * 180 / n, 90 - y * 180 / n


def tiles_of_box(points, z):
    n = 2**z

    def at(value, span):
        return max(0, min(n - 1, math.floor(value / span)))

    lons, lats = [p[0] for p in points], [p[1] for p in points]
    for x in range(at(min(lons) + 180, 360 / n), at(min(max(lons), 180 - 1e-9) + 180, 360 / n) + 1):
        for y in range(at(90 - max(lats), 180 / n), at(90 - min(lats), 180 / n) + 1):
            yield x, y


def inside_runs(points, box):
    w, e, s, n = box
    runs, run = [], []
    for lon, lat in [*points, (999, 999)]:
        if w <= lon <= e and s <= lat <= n:
            run.append((lon, lat))
        else:
            runs, run = runs + ([run] if len(run) > 1 else []), []
    return runs


def cut_half(points, axis, limit, sign):
    out = []
    for before, here in zip(points[-1:] + points[:-1], points, strict=True):
        was, now = (before[axis] - limit) * sign >= 0, (here[axis] - limit) * sign >= 0
        if was != now:
            t = (limit - before[axis]) / (here[axis] - before[axis])
            out.append(tuple(b + (h - b) * t for b, h in zip(before, here, strict=True)))
        if now:
            out.append(here)
    return out


def cut_ring(points, box):
    w, e, s, n = box
    ring = points[:-1] if points[0] == points[-1] else points
    for axis, limit, sign in ((0, w, 1), (0, e, -1), (1, s, 1), (1, n, -1)):
        ring = cut_half(ring, axis, limit, sign)
    return ring if len(ring) > 2 else []


def thinned(points, tol):
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    base = math.hypot(bx - ax, by - ay)

    def far(p):
        if base == 0:
            return math.hypot(p[0] - ax, p[1] - ay)
        return abs((by - ay) * p[0] - (bx - ax) * p[1] + bx * ay - by * ax) / base

    top = max(range(1, len(points) - 1), key=lambda i: far(points[i]))
    if far(points[top]) <= tol:
        return [points[0], points[-1]]
    return thinned(points[: top + 1], tol)[:-1] + thinned(points[top:], tol)


def same(got, want):
    assert set(got) == set(want)
    for key in want:
        assert len(got[key]) == len(want[key]), key
        for a, b in zip(got[key], want[key], strict=True):
            assert len(a) == len(b), key
            for p, q in zip(a, b, strict=True):
                assert p == pytest.approx(q, abs=1e-9), key


LINES = [
    *[wiggle(i, 60) for i in range(4)],
    wiggle(9, 400, step=3.0),
    wiggle(5, 50, 179.5, 10.0, 0.5),
    wiggle(6, 50, 0.0, 89.5, 0.5),
    [(0.0, 0.0), (0.0, 1.0), (45.0, 1.0), (45.0, 22.5), (-45.0, 22.5)],
    [(2.8125, 0.3), (2.8125, 0.6), (3.0, 0.6)],
    [(1.0, 1.0)],
    [],
]
RINGS = [
    *[blob(i, 30, -100 + 40 * i, 10 * i - 20, 4.0) for i in range(5)],
    blob(20, 200, 10.0, 45.0, 40.0),
    blob(21, 25, 178.0, -80.0, 1.9),
    [(0.0, 0.0), (2.8125, 0.0), (2.8125, 1.40625), (0.0, 1.40625), (0.0, 0.0)],
    [(1.0, 1.0), (2.0, 1.0)],
]
ZOOMS = {3: 0.02, 5: 0.005, 7: 0.0005}


def test_line_runs_equal_brute_force(spark):
    df = features(spark, *[("coast", line) for line in LINES])
    want = {}
    for i, line in enumerate(LINES):
        for z in ZOOMS if len(line) > 1 else ():
            for x, y in tiles_of_box(line, z):
                if runs := inside_runs(line, box_of(z, x, y)):
                    want[(i, z, x, y)] = runs
    same(shapes_by_tile(P.clip_polylines(df, zooms=ZOOMS)), want)
    coarse = {3: 2.0, 5: 0.5, 7: 0.1}
    thin = {k: [thinned(r, coarse[k[1]]) for r in v] for k, v in want.items()}
    same(shapes_by_tile(P.clip_polylines(df, zooms=coarse, simplified=True)), thin)
    same(shapes_by_tile(P.simplify(P.clip_polylines(df, zooms=coarse), zooms=coarse)), thin)


def test_ring_cuts_equal_brute_force(spark):
    df = features(spark, *[("land", ring) for ring in RINGS])
    want, thin = {}, {}
    coarse = {3: 1.0, 5: 0.5, 7: 0.1}
    for i, ring in enumerate(RINGS):
        for z in ZOOMS if len(ring) > 2 else ():
            for x, y in tiles_of_box(ring, z):
                if piece := cut_ring(ring, box_of(z, x, y)):
                    want[(i, z, x, y)] = [piece]
                    if len(less := thinned(piece, coarse[z])) > 2:
                        thin[(i, z, x, y)] = [less]
    same(shapes_by_tile(P.clip_polygons(df, zooms=ZOOMS)), want)
    same(shapes_by_tile(P.clip_polygons(df, zooms=coarse, simplified=True)), thin)


def test_small_slices_change_nothing(spark, monkeypatch):
    from skylattice.operators import geometry_kernels as K

    rings = K.Rings.from_arrow(__import__("pyarrow").array([[{"lon": a, "lat": b} for a, b in r] for r in RINGS]))
    lines = K.Rings.from_arrow(__import__("pyarrow").array([[{"lon": a, "lat": b} for a, b in r] for r in LINES]))

    def everything():
        out = []
        for cut, shapes in ((K.cut_rings, rings), (K.cut_lines, lines)):
            for item, x, y, run, points in cut(shapes, 5):
                out += zip(item, x, y, run, points.lens, points.per_item(__import__("numpy").add, points.lon), strict=True)
        return sorted(out)

    whole = everything()
    monkeypatch.setattr(K, "_SLICE_VERTICES", 37)
    assert everything() == whole


def test_candidate_tiles_cover_every_cut(spark):
    df = features(spark, *[("land", ring) for ring in RINGS])
    cut = P.clip_polygons(df)
    assert cut.join(P.features_to_tiles(df), ["feature_id", "z", "x", "y"], "left_anti").count() == 0


def test_pieces_stay_in_their_tile(spark):
    df = features(spark, *[("land", ring) for ring in RINGS])
    boxed = P.clip_polygons(df).withColumn("b", tilemath.tile_bounds("z", "x", "y")).select("b", F.explode("points").alias("p"))
    outside = (
        (F.col("p.lon") < F.col("b.min_lon") - 1e-9) | (F.col("p.lon") > F.col("b.max_lon") + 1e-9)
        | (F.col("p.lat") < F.col("b.min_lat") - 1e-9) | (F.col("p.lat") > F.col("b.max_lat") + 1e-9)
    )
    assert boxed.filter(outside).count() == 0


# --- capping --------------------------------------------------------------------------------


def size_of(tile, fixed):
    return 12 + fixed + sum(14 + sum(18 + 8 * len(s) for s in shapes) for shapes in tile.values() if shapes)


def recoarsened(tile, tol):
    out = {}
    for layer, shapes in tile.items():
        kept = []
        for s in shapes:
            if layer == "coast":
                kept.append(thinned(s, tol))
            elif len(closed := thinned([*s, s[0]] if s[0] != s[-1] else s, tol)) > 3:
                kept.append(closed[:-1])
        out[layer] = kept
    return out


def ladder(tile, z):
    """The tile as it is and at every coarser tolerance, each made from the one before."""
    steps = [t for k in range(1, 40) if (t := ZOOMS[z] * 2**k) <= 0.05]
    return list(zip([None, *steps], accumulate(steps, recoarsened, initial=tile), strict=True))


def by_layer(shapes):
    out = defaultdict(list)
    for layer, shape in shapes:
        out[layer].append(shape)
    return out


def same(a, b):
    return all(sorted(a.get(layer, [])) == sorted(b.get(layer, [])) for layer in ("coast", "land", "water"))


def busy_map():
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lon, lat = rng.choice([(-122.0, 37.0), (10.0, 50.0), (100.0, -30.0)])
        at = (lon + rng.uniform(-1, 1), lat + rng.uniform(-1, 1))
        if i % 3 == 0:
            rows.append(("coast", wiggle(i, rng.randrange(5, 120), *at, 0.03)))
        else:
            rows.append(("land" if i % 3 == 1 else "water", blob(i, rng.randrange(4, 90), *at, rng.uniform(0.05, 0.6))))
    return rows


@pytest.mark.parametrize("cap", [600, 1500, 9000])
def test_capping_properties(spark, cap):
    df = features(spark, *busy_map())
    placed = P.airport_tiles(airports(spark, ("KAAA", 37.1, -122.1, 2), ("KBBB", 50.0, 10.2, 60), ("KCCC", -50.0, -50.0, 0)))
    shapes = P.build_shapes(df)
    tiles = defaultdict(lambda: defaultdict(list))
    for r in shapes.orderBy("feature_id", "part", "run").collect():
        tiles[(r.z, r.x, r.y)][r.layer].append([(p.lon, p.lat) for p in r.points])
    fixed = defaultdict(int)
    for r in placed.collect():
        fixed[(r.z, r.x, r.y)] += 18 + 16 * r.runway_count + (0 if fixed[(r.z, r.x, r.y)] else 14)
    stays, actions = P.cap_tile_size(shapes, placed, cap=cap)
    rows = {(r.z, r.x, r.y): (r.action, r.bytes) for r in actions.collect()}
    assert set(rows) == {*tiles, *fixed}
    got = defaultdict(lambda: defaultdict(list))
    for r in stays.collect():
        got[(r.z, r.x, r.y)][r.layer].append([(p.lon, p.lat) for p in r.points])
    for key, (action, size) in rows.items():
        rungs = ladder(tiles[key], key[0])
        fitting = [(tol, tile) for tol, tile in rungs if size_of(tile, fixed[key]) <= cap]
        assert size == size_of(got[key], fixed[key])
        if fitting:  # the least tolerance that fits, and nothing else changed
            tol, tile = fitting[0]
            assert action == ("ok" if tol is None else f"simplify:{tol:.5f}")
            assert same(got[key], tile)
            continue
        # No tolerance fits: the longest beginning of the keep order that fits stays.
        coarsest = rungs[-1][1]
        keep = [(layer, s) for layer in ("land", "coast", "water") for s in reversed(sorted(coarsest.get(layer, []), key=len))]
        n = sum(map(len, got[key].values()))
        assert same(got[key], by_layer(keep[:n]))
        if action == "drop":
            assert size <= cap < size_of(by_layer(keep[: n + 1]), fixed[key])
        else:
            assert (action, n) == ("oversized", 0)
            assert size > cap
    if cap == 1500:
        assert {action.split(":")[0] for action, _ in rows.values()} >= {"ok", "simplify", "drop"}


def test_sizes_quality_and_coarser_zooms(spark):
    df = features(spark, *busy_map())
    shapes = P.build_shapes(df)
    quality = {r.z: r for r in P.pyramid_quality(shapes, canary=(7, 20, 37)).collect()}
    assert set(quality) == {3, 5, 7} and quality[7].canary == 1 and quality[3].canary == 0
    assert quality[3].points < quality[5].points < quality[7].points
    empty = airports(spark, ("KAAA", 0.0, 0.0, 0)).limit(0)
    sizes = P.tile_sizes(shapes, P.airport_tiles(empty))
    assert sizes.count() == sum(q.tiles for q in quality.values())
    assert P.tile_sizes(shapes.limit(0), P.airport_tiles(airports(spark, ("KAAA", 0.0, 0.0, 2)))).first().bytes == 12 + 14 + 18 + 32


def test_overview_tile(spark):
    land, hubs = P.world_overview(features(spark, *[("land", r) for r in RINGS]), airports(spark, *[(f"K{i:03d}", float(i), float(i), 0) for i in range(20)]), n=5)
    assert {(r.z, r.x, r.y) for r in [*land.collect(), *hubs.collect()]} == {(0, 0, 0)}
    assert land.count() > 3
    assert [r.ident for r in hubs.orderBy("ident").collect()] == [f"K{i:03d}" for i in range(5)]


def test_area_filter_and_ring_lines(spark):
    rows = spark.createDataFrame([(1, "land", 0, 0.4, [(0.0, 0.0)]), (2, "land", 0, 0.5, [(0.0, 0.0), (1.0, 1.0)]), (3, "land", 0, 9.0, [(0.0, 0.0)])], "feature_id long, layer string, part int, area double, points array<struct<lon:double,lat:double>>")
    kept = P.filter_by_area(rows)
    assert [r.feature_id for r in kept.orderBy("feature_id").collect()] == [2, 3]
    assert [(r.feature_id, r.layer) for r in P.rings_to_lines(kept).collect()] == [(2, "coast")]
    assert C.MIN_AREA_KM2 == 0.5
