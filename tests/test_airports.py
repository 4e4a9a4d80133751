from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.functions import airports as Af
from skylattice.operators import airports as A

AIRPORT = {"type": "large_airport", "latitude_deg": "37.6", "longitude_deg": "-122.4", "scheduled_service": "no", "iata_code": "", "municipality": "", "name": ""}
RUNWAY = {"lighted": "0", "closed": "0", "le_ident": "10", "he_ident": "28", "length_ft": "9000", "le_latitude_deg": "37.6", "le_longitude_deg": "-122.4", "he_latitude_deg": "37.7", "he_longitude_deg": "-122.3"}


def table(spark, base, key, *rows):
    columns = ["row_no", key, *base]
    data = [tuple([i, row[key], *[row.get(c, base[c]) for c in base]]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{c} {'int' if c == 'row_no' else 'string'}" for c in columns))


def airports(spark, *rows):
    return table(spark, AIRPORT, "ident", *rows)


def runways(spark, *rows):
    return table(spark, RUNWAY, "airport_ident", *rows)


def navaids(spark, *idents):
    return spark.createDataFrame([(i, "VOR") for i in idents], "associated_airport string, type string")


def built(spark, ports, strips=(), nav=()):
    strips = runways(spark, *strips) if strips else runways(spark, {"airport_ident": "ZZZZ"})
    approach = A.approach_idents(strips, navaids(spark, *(nav or [""])))
    return A.build_airports(airports(spark, *ports), strips, approach)


def test_approach_signals(spark):
    strips = runways(
        spark,
        {"airport_ident": " ksfo ", "lighted": "1"},
        {"airport_ident": "KUNL"},
        {"airport_ident": "KCLO", "lighted": "1", "closed": "1"},
        {"airport_ident": "", "lighted": "1"},
    )
    got = {r.ident for r in A.approach_idents(strips, navaids(spark, "kvor", "", None, "KSFO")).collect()}
    assert got == {"KSFO", "KVOR"}


def test_which_airports_stay(spark):
    ports = [
        {"ident": "ksfo"},
        {"ident": "KMED", "type": "medium_airport"},
        {"ident": "KSCH", "type": "small_airport", "scheduled_service": " YES "},
        {"ident": "KSML", "type": "small_airport"},
        {"ident": "KAPP", "type": "small_airport"},
        *[{"ident": i, "type": t} for i, t in [("KHEL", "heliport"), ("KSEA", "seaplane_base"), ("KCLS", "closed"), ("KBAL", "balloonport")]],
        {"ident": "LONG1"},
        {"ident": "K-SF"},
        *[{"ident": i, "longitude_deg": v} for i, v in [("KBD1", "3824610.0"), ("KBD2", ""), ("KBD3", None), ("KBD4", "NaN"), ("KBD5", "x")]],
    ]
    got = {r.ident: r for r in built(spark, ports, nav=["KAPP", "KHEL", "KSEA", "KCLS", "KBAL"]).collect()}
    assert set(got) == {"KSFO", "KMED", "KSCH", "KAPP"}
    assert got["KAPP"].instrument_approach and not got["KSFO"].instrument_approach


def test_runways_attach(spark):
    strips = [
        {"airport_ident": "KSFO", "closed": "1"},
        {"airport_ident": " KSFO "},
        {"airport_ident": "ksfo"},
        {"airport_ident": "KSFO", "le_ident": "H1", "length_ft": "2499"},
        {"airport_ident": "KSFO", "le_ident": "H1", "length_ft": "2500", "le_latitude_deg": "37.9"},
        {"airport_ident": "KSFO", "le_ident": "H1", "he_ident": "h_2", "length_ft": "9000"},
        {"airport_ident": "KSFO", "le_latitude_deg": ""},
    ]
    ports = built(spark, [{"ident": "KSFO"}, {"ident": "KNON"}], strips)
    counts = {r.ident: r.runway_count for r in ports.collect()}
    assert counts == {"KSFO": 3, "KNON": 0}
    usable = A.airport_runways(runways(spark, *strips))
    nested = {r.ident: r.runways for r in A.nest_runways(ports, usable).collect()}
    assert [r.lat1 for r in nested["KSFO"]] == [37.6, 37.6, 37.9] and nested["KNON"] == []
    assert A.airport_runways(runways(spark, *strips), include_closed=False).filter("ident = 'KSFO'").count() == 2


@pytest.mark.parametrize(("text", "yes"), [("H", True), ("H1", True), ("h-2", True), ("H_N", True), ("HX", False), ("H1A", False), ("09", False), ("", False)])
def test_h_designator(spark, text, yes):
    assert spark.createDataFrame([(text,)], "v string").select(Af.is_h_designator("v")).head()[0] is yes


def test_flags(spark):
    row = spark.range(1).select(Af.airport_flags(F.lit(3), F.lit(True), F.lit(True)).alias("f"))
    assert row.select("f", Af.flags_tier("f"), Af.flags_approach("f"), Af.flags_has_runways("f")).head() == (15, 3, True, True)


def test_index_and_hubs(spark):
    ports = airports(
        spark,
        {"ident": "KSFO", "iata_code": "SFO", "municipality": "San Francisco", "name": "SF Intl"},
        {"ident": "KHAF", "type": "small_airport", "scheduled_service": "yes"},
        {"ident": "KPAO", "type": "small_airport"},
        {"ident": "1CA9", "type": "heliport"},
        {"ident": "KBAD", "latitude_deg": "bad"},
        {"ident": "TOOLONG"},
        {"ident": "KMRY", "type": "medium_airport", "latitude_deg": "36.587001"},
    )
    strips = runways(spark, {"airport_ident": "KMRY", "lighted": "1"})
    index = A.airport_index(ports, strips, navaids(spark, ""))
    rows = index.orderBy(F.desc("tier"), "icao").collect()
    assert [(r.icao, r.iap) for r in rows] == [("KSFO", 0), ("KMRY", 1), ("KHAF", 0)]
    assert rows[1].lat == 36.587
    hubs = A.top_hubs(built(spark, [{"ident": f"K{i:03d}"} for i in range(5)] + [{"ident": "KMED", "type": "medium_airport"}]), n=3)
    assert [r.ident for r in hubs.collect()] == ["K000", "K001", "K002"]


def test_search_ranks_and_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["San Jose", "Josephine", "Osan", "Sanford", "Oslo", "", "S", "Ab"]
    rows = [(f"K{i:03d}", rng.choice(["SJC", "OSL", "", "SAN"]), rng.choice(words), rng.choice(words), 0.0, 0.0, 0, rng.choice([1, 2, 3])) for i in range(80)]
    index = spark.createDataFrame(rows, "icao string, iata string, city string, name string, lat double, lon double, iap int, tier int")
    asked = ["san", "OS", " k01", "s", "jose", "osl", "K005", "nothing", "", "  ", "san jose"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")

    def score(row, q):
        codes, names = [row[0].lower(), row[1].lower()], [row[2].lower(), row[3].lower()]
        if q in codes:
            return 1000
        if any(c.startswith(q) for c in codes):
            return 500
        if any(n.startswith(q) for n in names):
            return 200
        return 100 if any(q in c for c in codes) else 50 if any(q in n for n in names) else 0

    want = {}
    for number, text in enumerate(asked):
        q = text.strip().lower()
        hits = [(-score(r, q), -r[7], r[0], r[3]) for r in rows if q and score(r, q)]
        want.update({(number, i + 1): (h[2], -h[0]) for i, h in enumerate(sorted(hits)[:8])})
    got = {(r.query_id, r["rank"]): (r.icao, r.score) for r in A.airport_search(index, queries).collect()}
    assert got == want and len(want) > 30


def test_resolve_points(spark):
    index = spark.createDataFrame([("KSFO", "SFO", "SF", "Intl", 37.6, -122.4, 1, 3)], "icao string, iata string, city string, name string, lat double, lon double, iap int, tier int")
    asked = [(0, "37.6188,-122.375"), (1, "sfo"), (2, "91,0"), (3, "x,1"), (4, ""), (5, "zzzz"), (6, " 1.5abc , 2 ")]
    got = {r.request_id: (r.lat, r.lon, r.label) for r in A.resolve_points(spark.createDataFrame(asked, "request_id int, text string"), index).collect()}
    assert got == {0: (37.6188, -122.375, "37.6188,-122.3750"), 1: (37.6, -122.4, "KSFO"), 6: (1.5, 2.0, "1.5000,2.0000")}


def test_nearest_equals_brute_force_everywhere(spark):
    rng = random.Random(11)
    ports = [(f"A{i:03d}", rng.uniform(-90, 90), rng.uniform(-180, 180), i % 3 != 0) for i in range(60)]
    ports += [(f"B{i:03d}", 37.0 + i * 0.001, -122.0, True) for i in range(40)] + [("TIE1", 10.0, 11.0, True), ("TIE0", 10.0, 9.0, True)]
    sites = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)]
    sites += [(900, 10.0, 10.0), (901, 90.0, 0.0), (902, -90.0, 50.0), (903, 0.0, 180.0), (904, 89.5, -180.0), (905, 37.02, -122.0)]

    def best(lat, lon):
        def far(p):
            return math.hypot((p[1] - lat) * 60, (p[2] - lon) * 60 * math.cos(math.radians(lat)))

        return min(((far(p), p[0]) for p in ports if p[3]), key=lambda t: (round(t[0], 9), t[1]))

    a = spark.createDataFrame(ports, "ident string, lat double, lon double, instrument_approach boolean")
    s = spark.createDataFrame(sites, "site_id int, lat double, lon double")
    got = {r.site_id: (r.dist_nm, r.icao) for r in A.nearest_approach_airport(s, a).collect()}
    assert len(got) == len(sites)
    for site_id, lat, lon in sites:
        dist, icao = best(lat, lon)
        assert got[site_id][0] == pytest.approx(dist, abs=1e-6)
        if abs(lat) < 89.9:
            assert got[site_id][1] == icao


def test_reference_label(spark):
    rows = [(0, 37.62, -122.375, "KSFO", 37.6188, -122.375, 0.07), (1, 38.0, -122.375, "KSFO", 37.6188, -122.375, 22.872)]
    df = spark.createDataFrame(rows, "site_id int, lat double, lon double, icao string, icao_lat double, icao_lon double, dist_nm double")
    assert [r.label for r in A.reference_label(df).orderBy("site_id").collect()] == ["KSFO", "22.9 nm N of KSFO"]


def test_geocode_clean(spark):
    rows = [("main street", i, f"hit {i}", "1.5" if i != 1 else "bad", "2") for i in range(8)] + [("abc", 0, "short", "1", "2")]
    got = A.geocode_clean(spark.createDataFrame(rows, "query string, hit_no int, display_name string, lat string, lon string"))
    assert [r.hit_no for r in got.orderBy("hit_no").collect()] == [0, 2, 3, 4, 5]
