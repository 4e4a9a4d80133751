from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from drivercheck import tile_queries as Q
from drivercheck.compare import normalised, oracle_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
LINE_QUERIES = (
    "polyline_runs", "simplified_lines", "tile_sizes", "tile_point_counts", "tile_cap_actions", "cap_histogram", "capped_shapes",
    "tile_payloads", "decoded_tiles", "payload_content", "map_layers_for_view", "segments_in_disc",
)


@pytest.mark.parametrize("name", LINE_QUERIES)
def test_query_on_whole_lines_equals_its_sql(spark, name):
    df = Q.QUERIES[name](spark, SF_DIR)
    columns, expected = oracle_rows(Q.ORACLES[name], SF_DIR)
    assert expected
    assert normalised(df.columns, [tuple(r) for r in df.collect()]) == normalised(columns, expected)


def test_coast_lines_are_closed(spark):
    lines = Q._lines(spark, SF_DIR)
    assert lines.count() > 0
    assert lines.filter(F.element_at("points", 1) != F.element_at("points", -1)).count() == 0


def test_all_cap_actions_occur(spark):
    """At the scale of the correctness run."""
    found = {r.action for r in Q.QUERIES["cap_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {"ok", "simplify", "drop", "oversized"}
