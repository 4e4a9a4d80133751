from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, tilemath


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    ("lat", "lon", "expected"),
    [(38.75, -122.45, 0.0), (37.75, -121.45, 90.0), (36.75, -122.45, 180.0), (37.75, -123.45, 270.0)],
)
def test_bearing_to_the_four_winds(spark, lat, lon, expected):
    got = value(spark, geo.bearing_deg(37.75, -122.45, lat, lon))
    assert abs((got - expected + 180) % 360 - 180) < 0.5


@pytest.mark.parametrize(("bearing", "name"), [(0, "N"), (22, "N"), (23, "NE"), (90, "E"), (359, "N"), (-45, "NW"), (405, "NE")])
def test_compass(spark, bearing, name):
    assert value(spark, geo.compass8(float(bearing))) == name


def test_declination_has_the_sign_of_the_pole(spark):
    assert value(spark, geo.magnetic_declination(37.75, -122.45)) > 0
    assert value(spark, geo.magnetic_declination(42.0, -60.0)) < 0
    assert value(spark, geo.magnetic_bearing(10.0, 15.0)) == pytest.approx(355.0)


def test_distance_scales_at_the_first_latitude(spark):
    there = value(spark, geo.distance_nm(0.0, 0.0, 60.0, 1.0))
    back = value(spark, geo.distance_nm(60.0, 1.0, 0.0, 0.0))
    assert there == pytest.approx(math.hypot(3600, 60))
    assert back == pytest.approx(math.hypot(3600, 30))


def test_bbox_inflates_and_stops_widening_at_the_pole(spark):
    box = value(spark, geo.make_bbox(60.0, 10.0, 60.0))
    assert (box.min_lat, box.max_lat) == pytest.approx((58.9, 61.1))
    assert box.max_lon - 10.0 == pytest.approx(2.2)
    assert value(spark, geo.make_bbox(90.0, 0.0, 60.0, 1.0)).max_lon == pytest.approx(1.0)


def test_tile_of_known_points(spark):
    assert tuple(value(spark, tilemath.tile_of(F.lit(7), 37.7552, -122.4528))) == (20, 37)
    assert value(spark, tilemath.tile_of(F.lit(3), 10.0, 181.0)) == value(spark, tilemath.tile_of(F.lit(3), 10.0, -179.0))
    assert value(spark, tilemath.tile_of(F.lit(3), 90.0, 0.0)).y == 0
    assert value(spark, tilemath.tile_of(F.lit(3), -90.0, 0.0)).y == 7
    assert value(spark, tilemath.tile_of(F.lit(0), 12.0, 34.0)) == (0, 0)


def test_points_lie_in_their_tile(spark):
    points = spark.range(500).select(
        (F.rand(1) * 180 - 90).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"), (F.col("id") % 9).cast("int").alias("z")
    )
    placed = points.withColumn("t", tilemath.tile_of("z", "lat", "lon"))
    boxed = placed.withColumn("b", tilemath.tile_bounds("z", F.col("t.x"), F.col("t.y")))
    outside = boxed.filter(~(F.col("lat").between(F.col("b.min_lat"), F.col("b.max_lat")) & F.col("lon").between(F.col("b.min_lon"), F.col("b.max_lon"))))
    assert outside.count() == 0


def test_key_outside_the_pyramid_is_an_error(spark):
    with pytest.raises(Exception, match="outside the pyramid"):
        value(spark, tilemath.tile_bounds(F.lit(3), F.lit(8), F.lit(0)))


def test_disc_across_the_antimeridian(spark):
    columns = value(spark, tilemath.disc_columns(F.lit(3), 0.0, 179.0, 500.0))
    assert set(columns) == {7, 0}
    assert value(spark, tilemath.disc_columns(F.lit(7), 37.7552, -122.4528, 10.0)) == [20]


def test_corner_tiles_are_distinct(spark):
    assert len(value(spark, tilemath.corner_tiles(F.lit(7), 37.0, -121.0, 1.0))) == 1
    assert 1 < len(value(spark, tilemath.corner_tiles(F.lit(7), 36.5625, -120.9375, 50.0))) <= 4


def test_e7_rounds_half_to_even(spark):
    assert value(spark, tilemath.deg_to_e7(F.lit(0.5e-7))) == 0
    assert value(spark, tilemath.deg_to_e7(F.lit(1.5e-7))) == 2
    assert value(spark, tilemath.deg_to_e7(F.lit(-122.375))) == -1223750000


def test_segment_and_disc(spark):
    def cut(*args):
        return value(spark, geo.clip_segment_to_disc(*[float(a) for a in args]))

    assert tuple(cut(-2, 0, 2, 0, 1)) == pytest.approx((-1, 0, 1, 0))
    assert tuple(cut(0, 0, 0.5, 0, 1)) == pytest.approx((0, 0, 0.5, 0))
    assert tuple(cut(0, 0, 3, 0, 1)) == pytest.approx((0, 0, 1, 0))
    assert cut(-2, 2, 2, 2, 1) is None
    assert cut(2, 0, 3, 0, 1) is None
    assert cut(5, 5, 5, 5, 1) is None
    assert value(spark, geo.segment_intersects_disc(-2.0, 0.0, 2.0, 0.0, 1.0))
    assert not value(spark, geo.segment_intersects_disc(2.0, 0.0, 3.0, 0.0, 1.0))


def test_polyline_helpers(spark):
    points = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]])
    assert value(spark, geo.ring_signed_area2(points)) == 4.0
    box = value(spark, geo.polyline_bbox(points))
    assert (box.min_lat, box.min_lon, box.max_lat, box.max_lon) == (0.0, 0.0, 1.0, 2.0)
    touching = F.struct(F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("min_lon"), F.lit(3.0).alias("max_lat"), F.lit(3.0).alias("max_lon"))
    assert value(spark, geo.bboxes_overlap(geo.polyline_bbox(points), touching))


def test_prediction_moves_along_the_track(spark):
    ahead = value(spark, geo.predict_position(0.0, 0.0, 90.0, 600.0))
    assert ahead.lon == pytest.approx(600 * 1.852 / 3600 * 6 / 111)
    assert tuple(value(spark, geo.predict_position(5.0, 6.0, 90.0, 0.0))) == (5.0, 6.0)


def test_grid_bin_centre_and_ring(spark):
    assert tuple(value(spark, geo.grid_bin(10.0, 20.0, 18.52, 10.0, 20.0))) == (120, 120)
    north = value(spark, geo.grid_bin(10.0, 20.0, 18.52, 10.0 + 18.52 / 111, 20.0))
    assert tuple(north) == (120, 13)
