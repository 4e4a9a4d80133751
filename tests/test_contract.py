from __future__ import annotations

import os
import re

import pytest

import __spark_entry__
from drivercheck.compare import normalised, oracle_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")

SAMPLE = (
    "radar_tick", "clean_tracks", "traffic_density", "nearest_k_stations", "quiet_hours", "feed_failover", "focus_points",
    "airport_search", "reference_label", "polyline_runs", "simplified_rings", "tile_payloads",
    "snapshots_parsed", "metar_parsed", "track_sessions", "corner_tiles",
)


def test_every_sql_belongs_to_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    own = {name for name in set(queries) - set(sql) if not re.match(r"op\d+_|pipeline$", name)}
    assert own == set()


def test_entry_gives_labels(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["snapshot_id", "slot", "range_idx", "feed_pos", "callsign", "tag_rank", "score", "dist_km"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    columns, expected = oracle_rows(__spark_entry__.oracle_sql()[name], SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert normalised(df.columns, [tuple(r) for r in df.collect()]) == normalised(columns, expected)
