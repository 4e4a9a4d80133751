"""Bad input is skipped element by element, and nothing that a format cannot hold disappears."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skylattice.functions import tracks
from skylattice.operators import feeds, timeline
from skylattice.session import shared_folder
from skylattice.sources import readers, tile_blobs

POINT = "array<struct<lon:double,lat:double>>"


def bodies(spark, *documents):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(documents)], "document_id int, body string")


def test_snapshots_skip_single_elements(spark):
    good = {"hex": "a1", "lat": 1.5, "lon": 2, "alt_baro": "ground"}
    df = bodies(
        spark, {"ac": [good, 5, "x", None, [1], {"hex": "b2", "lat": "bad"}]}, {"aircraft": [good]}, {"ac": {"hex": "no"}}, [good], "{bad", {"ac": []}
    )
    rows = readers.parse_snapshots(df).select("document_id", "feed_pos", "hex", "lat", "alt_baro").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, "a1", 1.5, "ground"), (0, 5, "b2", None, None), (1, 0, "a1", 1.5, "ground")]


def test_metar_needs_an_array_and_keeps_the_kind_of_visibility(spark):
    station = lambda icao, v: {"icaoId": icao, "lat": 1.0, "lon": 2.0, "visib": v, "clouds": [{"cover": "BKN", "base": 900}]}
    df = bodies(spark, [station("KAAA", 2.5), 7, station("KBBB", "2.5"), station("KCCC", "10+"), {"icaoId": "KDDD"}], station("KEEE", 1), "nothing")
    rows = readers.parse_metar(df)
    assert sorted(map(tuple, rows.select("document_id", "icaoId", "visib").collect()), key=str) == [
        (0, "KAAA", "3"), (0, "KBBB", "2.5"), (0, "KCCC", "10+"), (0, "KDDD", None)
    ]


def test_focus_lists(spark):
    home = (1.0, 2.0)
    lists = ['[{"name":"A","lat":5,"lon":6},3,"x"]', '{"name":"X","lat":5,"lon":6}', '[{"lat":"bad","lon":6},{"name":"B","lat":7,"lon":8}]']
    df = spark.createDataFrame([(k, *home, text) for k, text in enumerate(lists)], "device_id int, home_lat double, home_lon double, json string")
    names = {}
    for row in sorted(feeds.load_focus_points(df).collect(), key=lambda r: r.slot):
        names.setdefault(row.device_id, []).append(row.name)
    assert names[0][1:] == ["A"]
    assert names[2][1:] == ["B"]
    assert len(names[1]) == 3
    assert "X" not in names[1]


def test_long_numbers_are_read_whole(spark):
    df = spark.createDataFrame([("1200",), ("12345678901",), (" 7700x",)], "squawk string")
    assert [r[0] for r in df.select(tracks.squawk_code()).collect()] == [1200, 0, 7700]


def test_a_gap_of_exactly_the_limit_ends_a_session(spark):
    start = dt.datetime(2024, 1, 1)
    times = [0, 29, 59, 88, 200]
    df = spark.createDataFrame([("a", start + dt.timedelta(seconds=t)) for t in times], "k string, t timestamp")
    rows = timeline.track_sessions(df, keys=["k"], ts="t", gap_seconds=30).collect()
    assert sorted((r.session_start - start).seconds for r in rows) == [0, 59, 200]


@pytest.fixture
def shapes(spark):
    def make(n, *, x=1):
        line = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct((k / 1e6).alias("lon"), (k / 1e6).alias("lat")))
        return spark.range(1).select(
            F.lit(3).cast("tinyint").alias("z"), F.lit(x).alias("x"), F.lit(2).alias("y"), F.lit("coast").alias("layer"),
            F.lit("ok").alias("action"), F.col("id").alias("feature_id"), F.lit(0).alias("part"), F.lit(0).alias("run"),
            line.cast(POINT).alias("points"),
        )

    return make


def test_tiles_that_the_format_cannot_hold_have_a_reason(spark, shapes):
    airports = spark.createDataFrame(
        [], "z tinyint, x int, y int, ident string, tier int, lat double, lon double, instrument_approach boolean, "
        "runways array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>"
    )
    long_ident = spark.createDataFrame([(3, 5, 5, "KLONGNAME", 1, 1.0, 2.0, False, [])], airports.schema)
    given = shapes(70_000).unionByName(shapes(3, x=4)).unionByName(shapes(3, x=70_000))
    rows = {r.x: r for r in tile_blobs.encode_tiles(given, airports.unionByName(long_ident)).collect()}
    assert set(rows) == {1, 4, 5, 70_000}
    assert {x for x, r in rows.items() if r.payload is None} == {1, 5, 70_000}
    assert "points" in rows[1].reason
    assert "ident" in rows[5].reason
    assert rows[4].reason is None


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
