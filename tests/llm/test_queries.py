from __future__ import annotations

import os
import re

import pytest

import __spark_entry__
from drivercheck.compare import normalised, oracle_rows
from skylattice.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns, expected = oracle_rows(queries.ORACLES[name], SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert normalised(df.columns, [tuple(r) for r in df.collect()]) == normalised(columns, expected)
