"""Capping tries its tolerances by counts; driver's tables are spread before any work on their rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from drivercheck import views
from skylattice.operators import geometry_kernels as K
from skylattice.operators import tilepyramid as P


def _rings(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lon, lat, r = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0.02, 2)
        corners = [(lon + r * math.cos(a / 7 * math.pi), lat + r * math.sin(a / 7 * math.pi)) for a in range(14)]
        rows.append((i, rng.choice(["land", "water", "coast"]), 0, corners + corners[:1]))
    return rows


FEATURES = "feature_id long, layer string, part int, points array<struct<lon:double,lat:double>>"
AIRPORTS = "ident string, lat double, lon double, tier int, instrument_approach boolean, runway_count long"


def test_tolerances_leave_counts_not_shapes(spark, monkeypatch):
    """The only stored table with points is that of the shapes, each once."""
    stored = []
    plain = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, **more: stored.append(plain(df, **more)) or stored[-1])
    shapes = P.build_shapes(spark.createDataFrame(_rings(120), FEATURES))
    placed = P.airport_tiles(spark.createDataFrame([("KAAA", 1.0, 1.0, 3, True, 2)], AIRPORTS))
    stays, tiles = P.cap_tile_size(shapes, placed, cap=300)
    with_points = [t for t in stored if "points" in t.columns]
    assert len(with_points) == 1 and with_points[0].count() == shapes.count()
    assert {r.action.split(":")[0] for r in tiles.select("action").distinct().collect()} >= {"ok", "drop"}
    sizes = P.tile_sizes(stays, placed).join(tiles.withColumnRenamed("bytes", "told"), P.TILE)
    assert sizes.filter("action <> 'oversized' AND bytes <> told").count() == 0
    assert sizes.filter("action <> 'oversized' AND bytes > 300").count() == 0


def test_classes_count_the_shapes_of_every_round():
    rows = _rings(60)
    points = pa.array([[{"lon": x, "lat": y} for x, y in r[3]] for r in rows], pa.list_(K._POINT))
    features = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([0] * len(rows), pa.int32()), points], names=["feature_id", "layer", "part", "points"]
    )
    rounds = P.simplify_rounds()
    cut = list(K.cutter(K.cut_rings, {3: 0.02, 5: 0.005}, 3, True)(iter([features])))
    counts: dict = {}
    for batch in K.classifier(rounds)(iter(cut)):
        for row in batch.to_pylist():
            key = tuple(row[c] for c in K._CLASS)
            counts[key] = counts.get(key, 0) + row["n"]
    expected: dict = {}
    for batch in cut:
        for number in (1, 2, 3):
            known = np.array([number <= len(rounds[z]) for z in batch.column("z").to_pylist()], bool)
            asked = batch.filter(pa.array(known)).append_column("round", pa.array(np.full(known.sum(), number, np.int32)))
            asked = asked.append_column("_least", pa.array(np.zeros(known.sum(), np.int32)))
            for made in K.coarsener(rounds)(iter([asked])):
                for row in made.to_pylist():
                    key = (row["layer"], row["z"], row["x"], row["y"], row["round"], len(row["points"]))
                    expected[key] = expected.get(key, 0) + 1
    assert counts == expected and len(counts) > 100


def test_work_on_rows_starts_after_the_spreading(spark):
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")):
        rows = views.table(spark, "/root/testdata/sf0.01", name)
        worked = rows.filter(F.concat(F.lit("K"), (F.col(key) % 36).cast("string")) != "K7")
        plan = worked._jdf.queryExecution().executedPlan().toString()
        assert "concat" not in plan[plan.index("Exchange") :], name
        assert worked.count() == spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").filter(F.col(key) % 36 != 7).count()
