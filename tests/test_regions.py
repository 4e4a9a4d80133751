"""Points and areas of large tables meet by regions: few rows are moved, whatever is crowded."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import quadtree
from skylattice.operators import surveillance as S

_TRACKS, _CENTERS = "feed_pos int, lat double, lon double", "slot int, lat double, lon double, outer_km double"


def _moved(df):
    """Rows written by the exchanges of a plan that has run."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_points_are_moved_once_and_areas_to_few_regions(spark):
    """Views of four sizes, each over dozens of cells."""
    pick = random.Random(11)
    tracks = spark.createDataFrame([(i, pick.uniform(37, 38), pick.uniform(-123, -122)) for i in range(4000)], _TRACKS)
    views = [(i, pick.uniform(37, 38), pick.uniform(-123, -122), (0.2, 0.45, 1.0, 2.25)[i % 4]) for i in range(1000)]
    near = S.tracks_in_radius(tracks, spark.createDataFrame(views, _CENTERS), scale=1.0, hot_rows=100_000)
    kept = len(near.collect())
    assert 1000 < kept
    moved = _moved(near)
    assert 5000 <= moved <= 4000 + 3 * 1000


def _crowd(seed):
    """Spread, clustered and on one spot, points and areas alike; areas of a metre to half the map, so of several tiers."""
    pick = random.Random(seed)
    places = [(pick.uniform(-80, 80), pick.uniform(-170, 170)) for _ in range(100)]
    places += [(pick.uniform(37, 37.2), pick.uniform(-122.2, -122)) for _ in range(200)] + [(37.5, -122.5)] * 100
    places += [(37.0, -122.0), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (3.0, 3824610.0)]
    centers = [(pick.uniform(-75, 75), pick.uniform(-170, 170), 10 ** pick.uniform(-2, 4)) for _ in range(60)]
    centers += [(pick.uniform(37, 37.2), pick.uniform(-122.2, -122), 10 ** pick.uniform(-1, 1)) for _ in range(60)]
    centers += [(37.5, -122.5, 0.5)] * 40 + [(37.5, -122.5, 1e-3), (0.0, 0.0, 9000.0), (3.0, 3824610.0, 1.0)]
    return [(i, *p) for i, p in enumerate(places)], [(i, *c) for i, c in enumerate(centers)]


@pytest.mark.parametrize(("hot_rows", "inline"), [(40, 10_000), (40, 0), (1_000_000, 10_000)])
def test_each_pair_meets_once_in_whatever_region(spark, monkeypatch, hot_rows, inline):
    monkeypatch.setattr(quadtree, "_INLINE_CELLS", inline)
    monkeypatch.setattr(quadtree, "TASK_ROWS", 2000)
    points, centers = _crowd(12)
    tracks, views = spark.createDataFrame([*points, (-1, None, 3.0)], _TRACKS), spark.createDataFrame([*centers, (-1, None, 3.0, 5.0)], _CENTERS)
    got = sorted((r.slot, r.feed_pos) for r in S.tracks_in_radius(tracks, views, scale=1.0, hot_rows=hot_rows).collect())
    far = lambda c, p: math.hypot((p[2] - c[2]) * 111 * math.cos(math.radians(c[1])), (p[1] - c[1]) * 111)
    assert got == sorted((c[0], p[0]) for c in centers for p in points if far(c, p) <= c[3])


def test_crowded_regions_are_cut_on_both_sides(spark):
    points, centers = _crowd(13)
    tracks, views = spark.createDataFrame(points, _TRACKS), spark.createDataFrame(centers, _CENTERS)
    box, _ = quadtree.disc_box("lat", "lon", F.col("outer_km"), 111.0)
    sized = quadtree._sized(views, box, 8)
    tiers = quadtree._tiers(quadtree._levels(sized))
    assert len(tiers) >= 3 and all(own[-1] - own[0] < 6 and own[0] - 3 <= tier <= own[0] for tier, own in tiers.items())
    assert sorted(level for own in tiers.values() for level in own) == quadtree._levels(sized)
    placed = tracks.withColumn("_tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    of_level = F.create_map(*[F.lit(n) for t, own in tiers.items() for level in own for n in (level, t)])
    held = quadtree._held(placed, sized.withColumn("_tier", of_level[F.col("_level")]), box, tiers, "lat", "lon")
    assert held.agg(F.sum("_points")).first()[0] == len(points) * sum(map(len, tiers.values()))
    hot = quadtree._inlined(quadtree._refined(held, tiers, 40))
    assert hot.agg(F.max("_down"), F.min("_down")).first()[0] == 3
    cut = quadtree._crowded(held, hot, tiers, 40).agg(F.max("_parts"), F.max("_shares")).first()
    assert cut[0] >= 3 and cut[1] >= 10
    assert quadtree._inlined(quadtree._refined(held, tiers, 1_000_000)) is None
