from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skylattice.functions import tilemath
from skylattice.operators import timeline
from skylattice.operators import tilepyramid as P
from skylattice.plans import jobs
from skylattice.sinks import writers
from skylattice.sources import readers

BLOB = "z int, x int, y int, payload binary"


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names if f.endswith(".bin")}


def test_tile_files_appear_together_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "out")
    blobs = spark.createDataFrame([(3, 1, 2, b"a"), (3, 1, 3, b"bc"), (5, 9, 9, b"d"), (5, 9, 1, None)], BLOB)
    counts = writers.write_tile_blobs(blobs, folder)
    assert sorted(tuple(r) for r in counts.collect()) == [(3, 2, 3), (5, 1, 1)]
    first = {"tiles/3/1/2.bin": b"a", "tiles/3/1/3.bin": b"bc", "tiles/5/9/9.bin": b"d"}
    assert files_of(folder) == first
    # One task fails after others have written: the old files stay, and nothing of the new.
    rows = [(7, x, y, b"new") for x in range(40) for y in range(3)]
    lost = spark.createDataFrame(rows, BLOB).withColumn("payload", F.when(F.col("x") == 39, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("payload")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            writers.write_tile_blobs(lost, folder, mode=mode)
        assert files_of(folder) == first
        assert not os.path.exists(f"{folder}/_staging") or os.listdir(f"{folder}/_staging") == []
    # Later tiles join the columns that are there; an overwrite replaces all.
    writers.write_tile_blobs(spark.createDataFrame([(3, 1, 2, b"A"), (3, 1, 7, b"e"), (3, 2, 2, b"f")], BLOB), folder)
    assert files_of(folder) == {**first, "tiles/3/1/2.bin": b"A", "tiles/3/1/7.bin": b"e", "tiles/3/2/2.bin": b"f"}
    writers.write_tile_blobs(spark.createDataFrame([(0, 0, 0, b"g")], BLOB), folder, mode="overwrite")
    assert files_of(folder) == {"tiles/0/0/0.bin": b"g"}


def csv(folder, name, parts, header="ident,name"):
    os.makedirs(f"{folder}/{name}.csv", exist_ok=True)
    for k, lines in enumerate(parts):
        with open(f"{folder}/{name}.csv/part-{k}.csv", "w") as out:
            out.write("\n".join([header, *lines]) + "\n")


def test_csv_rows_keep_their_order_over_files_and_bad_records_are_kept_apart(spark, tmp_path):
    folder = str(tmp_path)
    parts = [[f"A{i},first" for i in range(30)], ['B0,"two\nlines"', "B1", "B2,x,too many", "B3,fine"], [f"C{i},last" for i in range(2000)]]
    csv(folder, "airports", parts)
    csv(folder, "runways", [["r,1"]])
    csv(folder, "navaids", [[]])
    tables = readers.read_airport_csvs(spark, folder)
    good, bad = readers.split_corrupt(tables["airports"])
    idents = [r.ident for r in good.orderBy("row_no").collect()]
    assert idents == [f"A{i}" for i in range(30)] + ["B0", "B3"] + [f"C{i}" for i in range(2000)]
    assert sorted((r.row_no, r.record, r.reason) for r in bad.collect()) == [(31, "B1", "fields do not fit the header"), (32, "B2,x,too many", "fields do not fit the header")]
    assert good.filter("ident = 'B0'").first()["name"] == "two\nlines"
    assert good.agg(F.min("row_no"), F.max("row_no")).first() == (0, 2033)
    assert tables["navaids"].count() == 0


SHAPE = "feature_id long, layer string, part int, run int, z tinyint, x int, y int, points array<struct<lon:double,lat:double>>"


def test_a_view_reads_few_row_groups_of_the_tile_table(spark, tmp_path):
    pick = random.Random(3)
    rows = [(i, "land", 0, 0, 7, pick.randrange(128), pick.randrange(128), [(pick.random(), pick.random()) for _ in range(30)]) for i in range(20_000)]
    shapes = spark.createDataFrame(rows, SHAPE)
    folder = str(tmp_path / "shapes")
    writers.write_tile_table(shapes, folder, row_group_bytes=1 << 15)
    back = writers.read_tile_table(spark, folder)
    assert sorted((r.feature_id, r.z, r.x, r.y) for r in back.collect()) == sorted((r[0], 7, r[5], r[6]) for r in rows)
    groups = []
    for d, _, names in os.walk(folder):
        for name in (n for n in names if n.endswith(".parquet")):
            meta = pq.read_metadata(os.path.join(d, name))
            for g in range(meta.num_row_groups):
                stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                groups.append((meta.row_group(g).num_rows, *((stats[a].min, stats[a].max) for a in ("x", "y"))))
    assert len(groups) >= 100

    def read(x0, x1, y0, y1):
        return sum(n for n, (a, b), (c, d) in groups if a <= x1 and b >= x0 and c <= y1 and d >= y0)

    views = [(x, x + 7, y, y + 7) for x in range(0, 120, 13) for y in range(0, 120, 13)]
    along_the_curve = sum(read(*v) for v in views)
    # The same rows in as many groups, in order of columns and rows.
    places, size = sorted((r[5], r[6]) for r in rows), -(-len(rows) // len(groups))
    groups = [
        (len(part), (min(x for x, _ in part), max(x for x, _ in part)), (min(y for _, y in part), max(y for _, y in part)))
        for part in (places[k : k + size] for k in range(0, len(places), size))
    ]
    assert along_the_curve < 0.8 * sum(read(*v) for v in views)


def test_place_on_curve(spark):
    df = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)] + [(2**20 + 1, 2**21)], "x int, y int")
    def curve(x, y):
        return sum(((x >> k) & 1) << (2 * k) | ((y >> k) & 1) << (2 * k + 1) for k in range(24))
    assert all(r.p == curve(r.x, r.y) for r in df.select("x", "y", tilemath.place_on_curve("x", "y").alias("p")).collect())


def test_a_poor_pyramid_fails(spark):
    line = [(0.0, 0.0), (1.0, 1.0)]
    rows = [(1, "land", 0, 0, z, 0, 0, line * n) for z, n in ((3, 1), (5, 2), (7, 3))]
    shapes, seen = P.watched(spark.createDataFrame(rows, SHAPE))
    shapes.write.format("noop").mode("overwrite").save()
    zooms = {3: 0.1, 5: 0.1, 7: 0.1}
    P.require_whole(seen.get, 3, zooms, 3)
    with pytest.raises(P.PyramidFailed, match="^enough tiles$"):
        P.require_whole(seen.get, 3, zooms, 4)
    flat, seen = P.watched(spark.createDataFrame([(1, "land", 0, 0, z, 0, 0, line) for z in (3, 7)], SHAPE))
    flat.write.format("noop").mode("overwrite").save()
    with pytest.raises(P.PyramidFailed, match="all zooms, coarser is smaller"):
        P.require_whole(seen.get, 3, zooms, 1)
    verdicts = P.pyramid_verdicts(P.pyramid_quality(flat), zooms=zooms, least_tiles=2)
    assert {r.verdict: r.passed for r in verdicts.collect()} == {"enough tiles": True, "all zooms": False, "coarser is smaller": False}
    none = P.pyramid_verdicts(P.pyramid_quality(flat.limit(0)))
    assert {r.passed for r in none.collect()} == {False}


def test_rows_without_a_key_or_a_time_stay(spark):
    rows = [(1, "s", "2024-01-01 00:00:00", 5), (2, None, "2024-01-01 00:00:10", None), (3, "s", None, 7), (4, None, "2024-01-02 00:00:00", 8), (5, "s", "2024-01-01 00:10:00", None)]
    df = spark.createDataFrame(rows, "id int, site string, at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    known = timeline.with_last_known(df, keys=["site"], order=["at", "id"], value=F.col("v"), ts="at", chunk_seconds=60)
    assert {r.id: r.last_known for r in known.collect()} == {1: 5, 2: None, 3: 7, 4: 8, 5: 5}
    before = timeline.with_previous(df, keys=["site"], order=["at", "id"], values=["id"], ts="at", chunk_seconds=60)
    assert {r.id: r.previous and r.previous.id for r in before.collect()} == {1: 3, 2: None, 3: None, 4: 2, 5: 1}


def test_of_two_reports_of_one_poll_the_last_counts(spark):
    fields = "icaoId string, lat double, lon double, visib string, wdir string, wspd string, clouds array<struct<cover:string,base:double>>, fetched_at timestamp, document_id long, feed_pos int"
    clouds = lambda base: [("OVC", base)]
    rows = [("K1", 37.0, -122.0, "9", "0", "0", clouds(float(100 * p)), None, 5, p) for p in range(1, 9)]
    raw = spark.createDataFrame(rows, fields).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    views = spark.createDataFrame([(0, 37.0, -122.0, 10.0)], "view_id int, center_lat double, center_lon double, radius_nm double")
    for parts in (1, 4):
        (row,) = jobs.weather_board(raw.repartition(parts), views).collect()
        assert row.ceiling_ft_agl == 800


def test_entry_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "copy")
    os.makedirs(copy)
    for name in ("__spark_entry__.py", "skylattice", "drivercheck"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, os.path.join(copy, name), ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, copy)
    say = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"
    for extra in ([], ["corpus_pipeline.py"]):  # the pipeline may be left behind
        for name in extra:
            if os.path.exists(os.path.join(root, name)):
                shutil.copy(os.path.join(root, name), copy)
        out = subprocess.run([sys.executable, "-c", say], cwd=copy, capture_output=True, text=True, timeout=300)
        assert out.returncode == 0, out.stderr[-2000:]
        number, unknown = out.stdout.split(" ", 1)
        assert int(number) > 80 and unknown.strip() == "[]"
