from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import tracks as T
from skylattice.operators import surveillance as S
from skylattice.sources import readers


def snapshot(*planes, key="ac"):
    return json.dumps({key: list(planes)})


def raw(spark, *bodies):
    rows = [(i, body) for i, body in enumerate(bodies)]
    return readers.parse_snapshots(spark.createDataFrame(rows, "snapshot_id long, body string"))


def plane(**fields):
    base = {"lat": 37.62, "lon": -122.375, "alt_baro": 5000, "gs": 200, "track": 90, "type": "adsb_icao"}
    return {k: v for k, v in {**base, **fields}.items() if v is not None}


def test_full_row(spark):
    body = snapshot(
        plane(flight="UAL1234 ", alt_baro=18000, gs=420, true_heading=93, baro_rate=-1200, squawk="1200", t="B738")
    )
    row = S.clean_tracks(raw(spark, body)).head()
    assert (row.callsign, row.nose_deg, row.track_deg, row.squawk, row.actype) == ("UAL1234", 93.0, 90.0, 1200, "B738")
    assert (row.alt_ft, row.vs_fpm, row.gs_kt, row.tier) == (18000, -1200.0, 420.0, 3)


def test_callsign_never_falls_back_to_the_address(spark):
    body = snapshot(plane(r="N12345"), plane(hex="abc123"), plane(hex="~abc123"))
    rows = S.clean_tracks(raw(spark, body)).orderBy("feed_pos").collect()
    assert [r.callsign for r in rows] == ["N12345", "", ""]


def test_ground_and_unlocated_rows(spark):
    body = snapshot(plane(alt_baro="ground"), plane(lat=None), plane(lat="x"), plane())
    assert S.clean_tracks(raw(spark, body)).count() == 1
    shown = S.clean_tracks(raw(spark, body), show_ground=True).orderBy("feed_pos").collect()
    assert [(r.alt_ft, r.on_ground) for r in shown] == [(None, True), (5000, False)]


def test_bad_documents_give_no_rows(spark):
    assert raw(spark, "{not json", '{"ac":[]}', '{"now":1}').count() == 0
    assert raw(spark, snapshot(plane(), key="aircraft")).count() == 1


def test_on_ground_rule(spark):
    tracks = S.clean_tracks(
        raw(spark, snapshot(plane(alt_baro=None), plane(alt_baro=99, gs=39), plane(alt_baro=99, gs=40), plane(alt_baro=100, gs=0)))
    )
    assert S.airborne_tracks(tracks).count() == 2


def test_labels(spark):
    rows = spark.createDataFrame([(1550, 600.0), (35049, -600.0), (-120, 0.0), (None, 900.0)], "alt_ft int, vs_fpm double")
    got = [tuple(r) for r in rows.select(T.altitude_label(), T.trend()).collect()]
    assert got == [("016", "climb"), ("350", "descent"), ("0-1", "level"), ("GND", "unknown")]


GHOSTS = [
    ("no identity", [plane(flight="UAL1234"), plane(type="tisb_other", lat=37.621)], ["UAL1234"]),
    ("same callsign", [plane(type="adsr_icao", flight="N9412S", lat=34.0, lon=-118.0), plane(type="mlat", flight="N9412S", lat=34.0002, lon=-118.0002)], ["N9412S"]),
    ("same registration", [plane(flight="UAL9", r="N123AB"), plane(type="adsr_icao", r="N123AB")], ["UAL9"]),
    ("different identities", [plane(type="adsr_icao", flight="B08", r="N445XB"), plane(flight="DAL449", r="N874DN", lat=37.621)], ["B08", "DAL449"]),
    ("same tier", [plane(flight="A1"), plane(flight="A2", lat=37.6205)], ["A1", "A2"]),
    ("far apart", [plane(flight="A1"), plane(flight="A1", type="mlat", lat=37.72)], ["A1", "A1"]),
    ("other altitude", [plane(flight="A1"), plane(flight="A1", type="mlat", alt_baro=6500)], ["A1", "A1"]),
    ("tilde prefix", [plane(flight="N9412S"), plane(flight="~N9412S", type="mlat")], ["N9412S"]),
    ("unknown source", [plane(flight="A1"), plane(type="some_future_source_type")], ["A1"]),
    ("unknown altitude", [plane(flight="A1", alt_baro=None), plane(flight="a1", type="mlat", alt_baro=30000)], ["A1"]),
]


def test_ghost_cases(spark):
    tracks = S.clean_tracks(raw(spark, *[snapshot(*planes) for _, planes, _ in GHOSTS]))
    left = S.ghost_dedup(tracks).groupBy("snapshot_id").agg(F.sort_array(F.collect_list("callsign")).alias("c")).collect()
    got = {r.snapshot_id: r.c for r in left}
    for number, (name, _, expected) in enumerate(GHOSTS):
        assert got[number] == expected, name


# --- brute force ----------------------------------------------------------------------------


def is_edge(low, high):
    mid = math.radians((low["lat"] + high["lat"]) / 2)
    metres = math.hypot((high["lon"] - low["lon"]) * 111320 * math.cos(mid), (high["lat"] - low["lat"]) * 111320)
    if metres > 460:
        return False
    if low["alt"] is not None and high["alt"] is not None and abs(low["alt"] - high["alt"]) > 300:
        return False
    if low["track"] > 0 and high["track"] > 0:
        turn = abs(low["track"] - high["track"])
        if min(turn, 360 - turn) > 30:
            return False
    if low["gs"] > 0 and high["gs"] > 0 and abs(low["gs"] - high["gs"]) / max(low["gs"], high["gs"]) > 0.3:
        return False
    if not low["call"] and not low["reg"]:
        return True
    return bool(low["call"] and low["call"] == high["call"]) or bool(low["reg"] and low["reg"] == high["reg"])


def pairwise(rows):
    """(edges, survivors) of one snapshot by the plain double loop."""
    edges, gone = set(), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["tier"] == b["tier"]:
                continue
            low, high = (a, b) if a["tier"] < b["tier"] else (b, a)
            if is_edge(low, high):
                edges.add((low["pos"], high["pos"]))
                if a["pos"] not in gone and b["pos"] not in gone:
                    gone.add(low["pos"])
    return edges, {r["pos"] for r in rows} - gone


def crowd(seed, lat0, lon0, count=120, spread=0.012):
    rng = random.Random(seed)
    widen = 1 / max(math.cos(math.radians(lat0)), 0.01)
    return [
        {
            "pos": i,
            "lat": max(-90.0, min(90.0, lat0 + rng.uniform(-spread, spread))),
            "lon": lon0 + rng.uniform(-spread, spread) * widen,
            "alt": rng.choice([None, 1000, 1200, 1250, 1600, 90000, -900]),
            "track": float(rng.choice([0, 5, 30, 340, 180])),
            "gs": float(rng.choice([0, 100, 120, 143, 200])),
            "call": rng.choice(["", "", "A1", "B2"]),
            "reg": rng.choice(["", "", "N1"]),
            "tier": rng.randrange(4),
        }
        for i in range(count)
    ]


@pytest.fixture(scope="module")
def crowds():
    places = [(37.6, -122.4), (0.0, 0.0), (-45.0, 10.0), (70.0, 25.0), (85.0, -60.0), (88.99, 120.0), (89.9, 0.0), (-90.0, 5.0), (60.0, 179.99)]
    return {n: crowd(n, *place) for n, place in enumerate(places)}


@pytest.fixture(scope="module")
def crowd_tracks(spark, crowds):
    rows = [
        (n, r["pos"], r["lat"], r["lon"], r["alt"], r["track"], r["gs"], r["call"], r["reg"], r["tier"])
        for n, members in crowds.items()
        for r in members
    ]
    schema = "snapshot_id long, feed_pos long, lat double, lon double, alt_ft int, track_deg double, gs_kt double, callsign string, reg string, tier int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("hot_rows", [20_000, 7])
def test_grid_join_finds_exactly_the_pairs_of_the_double_loop(crowds, crowd_tracks, hot_rows):
    got = [tuple(r) for r in S.ghost_edges(crowd_tracks, hot_rows=hot_rows).select("snapshot_id", "low_pos", "high_pos").collect()]
    want = {(n, *edge) for n, rows in crowds.items() for edge in pairwise(rows)[0]}
    assert len(got) == len(set(got)), "a pair must be found once"
    assert set(got) == want
    assert len(want) > 100


def test_dedup_equals_the_double_loop(crowds, crowd_tracks):
    got = {tuple(r) for r in S.ghost_dedup(crowd_tracks).select("snapshot_id", "feed_pos").collect()}
    assert got == {(n, pos) for n, rows in crowds.items() for pos in pairwise(rows)[1]}


def test_order_matters_for_the_exact_mode(crowd_tracks):
    exact = S.ghost_dedup(crowd_tracks).count()
    free = S.ghost_dedup(crowd_tracks, mode="stratified").count()
    assert exact <= free
    with pytest.raises(ValueError):
        S.ghost_dedup(crowd_tracks, mode="other")


# --- views ----------------------------------------------------------------------------------


def test_budget_excludes_emergencies(spark):
    planes = [plane(flight=f"F{i}", alt_baro=1000 + i) for i in range(30)]
    planes += [plane(squawk="7700", alt_baro=100 + i) for i in range(4)]
    views = spark.createDataFrame([(0, 37.62, -122.375, 3, 46.3, 6)], "slot int, lat double, lon double, range_idx int, outer_km double, tag_budget int")
    ranked = S.tag_ranking(S.range_class(S.tracks_in_radius(S.clean_tracks(raw(spark, snapshot(*planes))), views)))
    rows = ranked.collect()
    assert sum(r.tag_rank == 0 for r in rows) == 4
    assert sorted((r.tag_rank, r.callsign) for r in rows if r.tag_rank) == [(i + 1, f"F{29 - i}") for i in range(6)]


def test_budget_above_the_bound_is_an_error(spark):
    views = spark.createDataFrame([(0, 37.62, -122.375, 3, 46.3, 60)], "slot int, lat double, lon double, range_idx int, outer_km double, tag_budget int")
    near = S.range_class(S.tracks_in_radius(S.clean_tracks(raw(spark, snapshot(plane(flight="A")))), views))
    with pytest.raises(Exception, match="max_budget"):
        S.tag_ranking(near).collect()


def test_radius_and_rim(spark):
    lats = [37.0, 37.0 + 18.0 / 111, 37.0 + 19.0 / 111, 37.0 + 25.0 / 111]
    views = spark.createDataFrame([(0, 37.0, 10.0, 1, 18.52, 15)], "slot int, lat double, lon double, range_idx int, outer_km double, tag_budget int")
    tracks = S.clean_tracks(raw(spark, snapshot(*[plane(lat=lat, lon=10.0) for lat in lats])))
    near = S.range_class(S.tracks_in_radius(tracks, views, hot_rows=1)).orderBy("feed_pos").collect()
    assert [(r.feed_pos, r.range_class) for r in near] == [(0, "inside"), (1, "inside"), (2, "rim")]


def test_tile_transitions_across_chunks(spark):
    rows = [("a", i, f"2024-01-01 {i:02d}:30:00", 0.5, lon) for i, lon in enumerate([1.0, 1.1, 4.0, 4.1, 1.0])]
    points = spark.createDataFrame(rows, "id string, feed_pos int, ts string, lat double, lon double").withColumn("ts", F.col("ts").cast("timestamp"))
    for chunk in (60, 3600, 86_400):
        moved = S.tile_transitions(points, key="id", ts="ts", chunk_seconds=chunk)
        assert [r.feed_pos for r in moved.orderBy("feed_pos").collect()] == [0, 2, 4]
