from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skylattice.functions import weather as Wx
from skylattice.operators import feeds, timeline
from skylattice.operators import weather as W
from skylattice.sources import readers


def rows_of(spark, column, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def metar(spark, *reports):
    docs = spark.createDataFrame([(json.dumps(list(reports)),)], "body string")
    return W.stations(readers.parse_metar(docs))


def test_category_boundaries(spark):
    cases = [(None, 10, "VFR"), (3000, 10, "MVFR"), (3001, 10, "VFR"), (999, 10, "IFR"), (499, 10, "LIFR"),
             (None, 5, "MVFR"), (None, 2, "IFR"), (None, 0, "LIFR"), (5000, 0, "LIFR"), (800, 10, "IFR"), (1000, 3, "MVFR")]
    df = spark.createDataFrame(cases, "c int, v int, want string")
    assert df.filter(Wx.flight_category("c", "v") != F.col("want")).count() == 0


def test_visibility(spark):
    values = ["10+", "15", "-3", "2 1/2", "2.5", "10SM", None, "abc", "NaN"]
    assert rows_of(spark, Wx.parse_visibility("v"), values, "string") == [10, 10, 0, 2, 2, 10, 10, 10, 10]


def test_reports(spark):
    found = metar(
        spark,
        {"icaoId": "KSFO", "lat": 37.6, "lon": -122.4, "visib": "10+", "wdir": "VRB", "wspd": 4},
        {"icaoId": "KOAK", "lat": 37.7, "lon": -122.2, "visib": 3, "wdir": 270, "wspd": 12,
         "clouds": [{"cover": "FEW", "base": 300}, {"cover": "ovc", "base": 2000}, {"cover": "BKN", "base": 900}, {"cover": "VV", "base": None}]},
        {"icaoId": "", "lat": 1.0, "lon": 1.0},
        {"icaoId": "KBAD", "lon": 1.0},
    )
    got = {r.icao: r for r in found.collect()}
    assert set(got) == {"KSFO", "KOAK"}
    assert (got["KSFO"].category, got["KSFO"].ceiling_ft_agl, got["KSFO"].wind_dir_deg, got["KSFO"].wind_speed_kt) == ("VFR", None, 0, 4)
    assert (got["KOAK"].category, got["KOAK"].ceiling_ft_agl, got["KOAK"].wind_dir_deg) == ("IFR", 900, 270)


def test_nearest_32_of_40(spark):
    found = metar(spark, *[{"icaoId": f"K{i:03d}", "lat": 37.75 + (i - 20) * 0.05, "lon": -122.45} for i in range(40)])
    views = spark.createDataFrame([(0, 37.75, -122.45, 120.0)], "view_id int, center_lat double, center_lon double, radius_nm double")
    nearest = W.nearest_k_stations(found, views)
    names = {r.icao for r in nearest.collect()}
    assert len(names) == 32 and "K020" in names and "K000" not in names
    assert nearest.filter("rank = 1").head().icao == "K020"
    wide = W.stations_in_bbox(found, views.withColumn("radius_nm", F.lit(6.0)), inflate=1.0)
    assert wide.count() == 5


def test_hhmm(spark):
    texts = ["7:05", "22:30", " 07:00x", "24:00", "12:60", "x", "", "7", "123:00", "7:5"]
    assert rows_of(spark, Wx.parse_hhmm("v"), texts, "string") == [705, 2230, 700, -1, -1, -1, -1, -1, -1, 705]
    assert rows_of(spark, Wx.format_hhmm("v"), [705, 0, -1, 2400, 1275], "int") == ["07:05", "00:00", "", "", ""]


@pytest.mark.parametrize(
    ("clock", "sleep", "wake", "quiet"),
    [("2024-06-01 14:30", 1400, 1500, True), ("2024-06-01 15:00", 1400, 1500, False), ("2024-06-01 23:59", 2200, 700, True),
     ("2024-06-01 06:59", 2200, 700, True), ("2024-06-01 07:00", 2200, 700, False), ("2024-06-01 22:00", 2200, 2200, False),
     ("2024-06-01 23:00", -1, 700, False), ("2024-06-01 23:00", 2200, -1, False), ("2023-12-31 23:00", 2200, 700, False)],
)
def test_quiet_hours(spark, clock, sleep, wake, quiet):
    df = spark.range(1).select(F.lit(clock).cast("timestamp").alias("t"), F.lit(sleep).alias("s"), F.lit(wake).alias("w"))
    assert df.select(Wx.in_quiet_hours("t", "s", "w")).head()[0] is quiet
    grace = F.lit("2024-06-02 00:00").cast("timestamp")
    assert df.select(Wx.in_quiet_hours("t", "s", "w", wake_until=grace)).head()[0] is False


def test_point_weather(spark):
    docs = [
        ("a", json.dumps({"current": {"temperature_2m": 72.5, "wind_speed_10m": 15, "wind_direction_10m": 270, "pressure_msl": 1013.25}, "utc_offset_seconds": -25200})),
        ("b", json.dumps({"current": {"wind_speed_10m": 15}})),
        ("c", "nonsense"),
        ("d", json.dumps({"current": {"temperature_2m": 50}})),
    ]
    got = {r.site_id: r for r in readers.parse_point_weather(spark.createDataFrame(docs, "site_id string, body string")).collect()}
    assert got["a"].valid and got["a"].baro_inhg == pytest.approx(29.92, abs=0.01) and got["a"].utc_offset_sec == -25200
    assert not got["b"].valid and not got["c"].valid
    assert got["d"].valid and got["d"].wind_kts is None and got["d"].baro_inhg is None
    assert rows_of(spark, Wx.c_to_f(Wx.f_to_c("v")), [72.5], "double")[0] == pytest.approx(72.5)
    assert rows_of(spark, Wx.wind_going_to_deg("v"), [270.0, 90.0], "double") == [90.0, 270.0]


def test_freshness(spark):
    now = F.lit("2024-01-01 00:10:30").cast("timestamp")
    values = [dt.datetime(2024, 1, 1, 0, 8, 31), dt.datetime(2024, 1, 1, 0, 20), None]
    assert rows_of(spark, Wx.freshness_minutes(now, "v"), values, "timestamp") == [1, 0, None]


def history(spark, count=200):
    """One busy key and a few quiet ones, out of order."""
    rows = [("busy" if i % 3 else f"k{i % 5}", i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % count * 11), i if i % 7 == 0 else None) for i in range(count)]
    return rows, spark.createDataFrame(rows, "key string, id int, ts timestamp, v int")


@pytest.mark.parametrize("chunk", [1, 900, 7200, 10_000_000])
def test_history_does_not_depend_on_the_chunk(spark, chunk):
    rows, df = history(spark)
    want, last, before = {}, {}, {}
    for key, i, ts, v in sorted(rows, key=lambda r: (r[2], r[1])):
        last[key] = v if v is not None else last.get(key)
        want[i] = (before.get(key), last[key])
        before[key] = i
    back = timeline.with_previous(df, keys=["key"], order=["ts", "id"], values=["id"], chunk_seconds=chunk)
    known = timeline.with_last_known(back, keys=["key"], order=["ts", "id"], value=F.col("v"), chunk_seconds=chunk)
    got = {r.id: (r.previous.id if r.previous else None, r.last_known) for r in known.collect()}
    assert got == want


def test_sessions_close_after_the_gap(spark):
    seconds = [0, 10, 40, 71, 100, 131]
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for s in seconds]
    got = timeline.track_sessions(spark.createDataFrame(rows, "call string, ts timestamp"), keys=["call"], ts="ts")
    assert sorted((r.session_start.minute * 60 + r.session_start.second, r.sightings) for r in got.collect()) == [(0, 2), (40, 1), (71, 2), (131, 1)]


def test_offset_carries_and_rejected_readings_do_not_set_it(spark):
    rows = [(1, "s", dt.datetime(2024, 1, 1, h), temp, off) for h, temp, off in [(0, 50.0, None), (1, 50.0, 3600), (2, None, 7200), (3, 50.0, None)]]
    df = spark.createDataFrame(rows, "reading_id int, site_id string, fetched_at timestamp, temp_f double, utc_offset_sec int").withColumn("valid", F.col("temp_f").isNotNull())
    got = W.carry_forward_offset(df).orderBy("fetched_at").collect()
    assert [r.offset_sec for r in got] == [0, 3600, 3600, 3600]


def test_staleness(spark):
    rows = [("s", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 9)]
    got = timeline.staleness_flags(spark.createDataFrame(rows, "k string, fetched_at timestamp"), keys=["k"], ttl_seconds=300)
    assert [r.due for r in got.orderBy("fetched_at").collect()] == [True, True, False]


def test_failover_and_superseded(spark):
    first = spark.createDataFrame([(1, False, "a"), (2, True, "a"), (3, False, "a")], "r int, ok boolean, body string")
    second = spark.createDataFrame([(1, True, "b"), (2, True, "b"), (3, False, "b")], "r int, ok boolean, body string")
    got = {r.r: r.body for r in feeds.union_feed_failover([first, second], request_key="r").collect()}
    assert got == {1: "b", 2: "a"}
    results = spark.createDataFrame([("k", 1, "old", True), ("k", 2, "new", True), ("j", 1, "old", True), ("j", 2, None, False)], "key string, gen int, body string, done boolean")
    kept = feeds.discard_superseded(results, keys=["key"], generation="gen", finished="done").collect()
    assert [(r.key, r.body) for r in kept] == [("k", "new")]


def test_focus_lists(spark):
    good = json.dumps([{"name": "A", "lat": 1, "lon": 2, "range_idx": 3}, {"lat": 99, "lon": 0}, {"lat": 5.5, "lon": 6, "range_idx": 999}])
    long = json.dumps([{"name": f"F{i}", "lat": i, "lon": i} for i in range(9)])
    configs = [("good", good), ("long", long), ("bad", "{"), ("object", "{}"), ("empty", "[]"), ("null", None)]
    df = spark.createDataFrame([(d, 10.0, 20.0, j) for d, j in configs], "device_id string, home_lat double, home_lon double, json string")
    got = {}
    for r in feeds.load_focus_points(df).orderBy("device_id", "slot").collect():
        got.setdefault(r.device_id, []).append((r.name, r.lat, r.lon, r.range_idx, r.is_home))
    home = ("Home", 10.0, 20.0, 1, True)
    assert got["good"] == [home, ("A", 1.0, 2.0, 3, False), ("?", 5.5, 6.0, 1, False)]
    assert len(got["long"]) == 7 and got["long"][6][0] == "F5"
    for device in ("bad", "object", "empty", "null"):
        assert [p[0] for p in got[device]] == ["Home", "KSFO", "KOAK"], device


def test_request_limits(spark):
    df = spark.createDataFrame([(0.0,), (250.0,), (250.5,), (None,), (5.0,)], "nm double")
    ok, bad = feeds.split_valid(df, feeds.valid_request_radius("nm"), "radius")
    assert (ok.count(), bad.count()) == (2, 3)
    assert spark.range(1).select(feeds.valid_request_box(0.0, 0.0, 20.0, 40.0), feeds.valid_request_box(0.0, 0.0, 20.1, 1.0)).head() == (True, False)
