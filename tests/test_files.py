from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from skylattice.operators import airports as A
from skylattice.operators import tilepyramid as P
from skylattice.plans import jobs
from skylattice.sinks import writers
from skylattice.sources import readers, tile_blobs

FEATURE = "feature_id long, layer string, part int, points array<struct<lon:double,lat:double>>"
NESTED = "ident string, lat double, lon double, tier int, instrument_approach boolean, runway_count long, runways array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>"


def one_tile(spark):
    line = [(-122.5, 37.75), (-122.4, 37.7), (-122.3, 37.65)]
    shapes = P.clip_polylines(spark.createDataFrame([(1, "coast", 0, line)], FEATURE), zooms={7: 0.0}).withColumn("action", F.lit("ok"))
    ports = spark.createDataFrame(
        [("KOAK", 37.7213, -122.2214, 2, False, 0, []), ("KSFO", 37.6188, -122.375, 3, True, 1, [(37.6, -122.4, 37.65, -122.3)])], NESTED
    )
    return shapes, P.airport_tiles(ports, zooms={7: 0.0})


def test_payload_bytes(spark):
    blob = tile_blobs.encode_tiles(*one_tile(spark)).collect()
    assert len(blob) == 1 and blob[0].reason is None
    e7 = lambda *values: struct.pack(f"<{len(values)}i", *[round(v * 1e7) for v in values])
    coast = struct.pack("<HH", 1, 3) + e7(37.65, -122.5, 37.75, -122.3) + e7(37.75, -122.5, 37.7, -122.4, 37.65, -122.3)
    sfo = e7(37.6188, -122.375) + bytes([0b1111]) + b"KSFO\0\0\0\0" + bytes([1]) + e7(37.6, -122.4, 37.65, -122.3)
    oak = e7(37.7213, -122.2214) + bytes([2]) + b"KOAK\0\0\0\0" + bytes([0])
    ports = struct.pack("<H", 2) + sfo + oak
    head = b"PRT1" + struct.pack("<BBHHBB", 1, 7, 20, 37, 2, 0)
    index = struct.pack("<B3xII", 0, 36, len(coast)) + struct.pack("<B3xII", 3, 36 + len(coast), len(ports))
    assert bytes(blob[0].payload) == head + index + coast + ports
    assert blob[0].bytes == P.tile_sizes(*one_tile(spark)).first().bytes


def test_decode_gives_back_what_was_encoded(spark):
    shapes, placed = one_tile(spark)
    blobs = tile_blobs.encode_tiles(shapes, placed).withColumn("path", F.lit("p"))
    rows = tile_blobs.decode_tiles(blobs).collect()
    assert {(r.layer, r.item, r.z, r.x, r.y) for r in rows} == {("coast", 0, 7, 20, 37), ("airports", 0, 7, 20, 37), ("airports", 1, 7, 20, 37)}
    coast = next(r for r in rows if r.layer == "coast")
    assert coast.lons == pytest.approx([-122.5, -122.4, -122.3]) and coast.lats == pytest.approx([37.75, 37.7, 37.65])
    sfo = next(r for r in rows if r.ident == "KSFO")
    assert sfo.flags == 15 and sfo.lats == pytest.approx([37.6188, 37.6, 37.65]) and sfo.lons == pytest.approx([-122.375, -122.4, -122.3])


def test_damaged_payloads_are_refused_with_a_reason(spark):
    good = bytes(tile_blobs.encode_tiles(*one_tile(spark)).first().payload)
    unknown = bytearray(good)
    unknown[12] = 77
    cases = {
        "short": good[:8],
        "magic": b"XXXX" + good[4:],
        "version": good[:4] + b"\x09" + good[5:],
        "beyond": good[:-5],
        "index": good[:20],
        "unknown": bytes(unknown),
        "empty": b"PRT1" + struct.pack("<BBHHBB", 1, 7, 1, 1, 0, 0),
    }
    df = spark.createDataFrame(list(cases.items()), "path string, payload binary")
    got = {}
    for r in tile_blobs.decode_tiles(df).collect():
        got.setdefault(r.path, set()).add(r.reason)
    assert got == {
        "short": {"shorter than the header"}, "magic": {"bad magic"}, "version": {"unsupported version"},
        "beyond": {"section beyond the end"}, "index": {"shorter than the section index"}, "unknown": {None},
    }


def test_too_many_items_are_reported_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(tile_blobs, "MAX_ITEMS", 1)
    rows = tile_blobs.encode_tiles(*one_tile(spark)).collect()
    assert [(r.payload, "more items" in r.reason) for r in rows] == [(None, True)]


def test_too_many_runways_are_an_error(spark):
    ports = spark.createDataFrame([("KSFO", 1.0, 1.0, 3, True, 256)], "ident string, lat double, lon double, tier int, instrument_approach boolean, runway_count long")
    strips = spark.createDataFrame([("KSFO", 0, 1.0, 1.0, 1.0, 1.0)], "ident string, row_no long, lat1 double, lon1 double, lat2 double, lon2 double")
    with pytest.raises(Exception, match="too many runways"):
        A.nest_runways(ports, strips).collect()


GEOJSON = [
    {"type": "LineString", "coordinates": [[0, 1], [2, 3]]},
    {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[4, 5, 99], [6, 7]]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]]},
    {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
    {"type": "Point", "coordinates": [1, 2]},
]


def test_geojson_features(spark, tmp_path):
    lines = [json.dumps({"type": "Feature", "properties": {"area": i}, "geometry": g}) for i, g in enumerate(GEOJSON)]
    (tmp_path / "f.jsonl").write_text("\n".join([*lines, "broken"]))
    rows = readers.read_features(spark, str(tmp_path / "f.jsonl"), "land").collect()
    got = sorted((r.area, r.part, [(p.lon, p.lat) for p in r.points]) for r in rows)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert got == [
        (0.0, 0, [(0.0, 1.0), (2.0, 3.0)]), (1.0, 0, [(0.0, 1.0), (2.0, 3.0)]), (1.0, 1, [(4.0, 5.0), (6.0, 7.0)]),
        (2.0, 0, square), (4.0, 0, square), (4.0, 1, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]),
    ]


def test_track_and_report_files(spark, tmp_path):
    tracks, reports, sites = tmp_path / "tracks", tmp_path / "metar", tmp_path / "sites"
    for folder in (tracks, reports, sites):
        folder.mkdir()
    (tracks / "1.json").write_text(json.dumps({"ac": [{"lat": 1, "lon": 2, "alt_baro": 18000}, {"lat": 1, "lon": 2, "alt_baro": "ground"}]}, indent=1))
    (tracks / "2.json").write_text("{broken")
    (reports / "1.json").write_text(json.dumps([{"icaoId": "KSFO", "lat": 1, "lon": 2, "visib": 3}, {"icaoId": "KOAK", "lat": 1, "lon": 2, "visib": "10+"}]))
    (sites / "home.json").write_text(json.dumps({"current": {"temperature_2m": 50.0}, "utc_offset_seconds": 60}))
    raw = readers.read_track_snapshots(spark, str(tracks)).orderBy("feed_pos").collect()
    assert [(r.feed_pos, r.alt_baro) for r in raw] == [(0, "18000"), (1, "ground")] and raw[0].fetched_at is not None
    assert sorted(r.visib for r in readers.read_metar(spark, str(reports)).collect()) == ["10+", "3"]
    site = readers.read_point_weather(spark, str(sites)).head()
    assert (site.site_id, site.temp_f, site.utc_offset_sec) == ("home", 50.0, 60)


AIRPORTS_CSV = """ident,type,name,latitude_deg,longitude_deg,scheduled_service,iata_code,municipality
KSFO,large_airport,"San Francisco, Intl",37.6188,-122.375,yes,SFO,San Francisco
KHAF,small_airport,Half Moon Bay,37.5134,-122.5011,no,HAF,Half Moon Bay
KPAO,small_airport,Palo Alto,37.4611,-122.115,no,PAO,Palo Alto
"""
RUNWAYS_CSV = """airport_ident,length_ft,lighted,closed,le_ident,le_latitude_deg,le_longitude_deg,he_ident,he_latitude_deg,he_longitude_deg
KSFO,11870,1,0,10L,37.6287,-122.3933,28R,37.6135,-122.3571
KHAF,5000,1,0,12,37.5178,-122.5078,30,37.5090,-122.4944
"""
NAVAIDS_CSV = "associated_airport,type\nKSFO,VOR-DME\n,NDB\n"


def write_csvs(folder):
    folder.mkdir()
    for name, text in (("airports", AIRPORTS_CSV), ("runways", RUNWAYS_CSV), ("navaids", NAVAIDS_CSV)):
        (folder / f"{name}.csv").write_text(text)


def test_bake_end_to_end(spark, tmp_path):
    write_csvs(tmp_path / "csv")
    ring = [(-122.6, 37.4), (-122.2, 37.4), (-122.2, 37.9), (-122.6, 37.9), (-122.6, 37.4)]
    schema = FEATURE.replace("points", "area double, points")
    land = spark.createDataFrame([(1, "land", 0, 50.0, ring), (2, "land", 0, 0.1, ring)], schema)
    water = spark.createDataFrame([(3, "water", 0, 2.0, [(a / 2 - 61.2, b / 2 + 18.8) for a, b in ring])], schema)
    rivers = spark.createDataFrame([(4, "coast", 0, None, [(-122.5, 37.5), (-122.4, 37.6), (-122.3, 37.5)])], schema)
    out = [str(tmp_path / "one"), str(tmp_path / "two")]
    for folder in out:
        actions = jobs.bake(spark, land=land, water=water, rivers=rivers, csv_folder=str(tmp_path / "csv"), out_folder=folder)
        assert [(r.action, r.tiles) for r in actions.collect()] == [("ok", 3)]
    files = [sorted(p.relative_to(folder) for p in __import__("pathlib").Path(folder).rglob("*.bin")) for folder in out]
    assert [str(f) for f in files[0]] == ["tiles/3/1/2.bin", "tiles/5/5/9.bin", "tiles/7/20/37.bin"] and files[0] == files[1]
    for f in files[0]:
        assert (tmp_path / "one" / f).read_bytes() == (tmp_path / "two" / f).read_bytes()
    back = tile_blobs.read_tiles(spark, out[0])
    assert back.filter("reason is not null").count() == 0
    counts = {(r.z, r.layer): r["count"] for r in back.groupBy("z", "layer").count().collect()}
    assert counts[(7, "airports")] == 2 and counts[(7, "coast")] == 2 and counts[(7, "land")] == 1 and counts[(7, "water")] == 1
    table = writers.read_tile_table(spark, out[0] + "/shapes")
    assert table.count() == sum(n for (z, layer), n in counts.items() if layer != "airports")
    index = (tmp_path / "one" / "index").glob("part-*.json")
    names = [json.loads(line)["icao"] for f in sorted(index) for line in f.read_text().splitlines()]
    assert names == ["KSFO"]


def test_nested_tiles_and_quarantine(spark, tmp_path):
    shapes, placed = one_tile(spark)
    tile = P.merge_layers(shapes, placed).collect()
    assert len(tile) == 1 and [a.ident for a in tile[0].airports] == ["KSFO", "KOAK"]
    assert len(tile[0].coast) == 1 and tile[0].land == [] and tile[0].water == []
    rejected = spark.createDataFrame([(1, "bad"), (2, "worse")], "id int, reason string")
    writers.write_quarantine(rejected, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).filter("reason = 'bad'").head().id == 1


def test_area_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "land", 0, 0.1, [(0.0, 0.0)])], FEATURE.replace("points", "area double, points")).write.parquet(str(tmp_path / "f"))
    plan = P.filter_by_area(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(area,0.5)" in plan
