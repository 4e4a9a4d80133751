"""What the sinks write, read back, and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drivercheck import airport_queries, tile_queries, weather_queries
from drivercheck.track_queries import r6
from drivercheck.views import cte, view
from skylattice.session import shared_folder
from skylattice.sinks import writers
from skylattice.sources import readers, tile_blobs


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def q_csv_rows_read_back(spark, sf_dir):
    """Airports as CSV in four files, read back with the number of every row over all files."""
    folder = _folder(spark)
    names = {"airports": "row_no", "runways": "row_no", "navaids": "n_nationkey"}
    for name, key in names.items():
        rows = view(spark, sf_dir, name)
        texts = rows.select(key, *[F.col(c).cast("string").alias(c) for c in rows.columns if c != key])
        sorted_rows = texts.repartitionByRange(4, key).sortWithinPartitions(key).withColumnRenamed(key, "key")
        sorted_rows.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    tables = readers.read_airport_csvs(spark, folder)
    good, _ = readers.split_corrupt(tables["airports"])
    return good.select("row_no", F.col("key").cast("long").alias("key"), "ident", "municipality", "latitude_deg")


def q_airport_index_read_back(spark, sf_dir):
    folder = _folder(spark)
    index = airport_queries._index(spark, sf_dir)
    writers.write_airport_index(index, f"{folder}/full")
    writers.write_airport_index(index, f"{folder}/trimmed", trimmed=True)
    full = spark.read.schema("icao string, iata string, city string, name string, lat double, lon double, iap int").json(f"{folder}/full")
    trimmed = spark.read.schema("icao string, iata string, city string, name string, lat double, lon double, iap int").json(f"{folder}/trimmed")
    rows = full.withColumn("kind", F.lit("full")).unionByName(trimmed.withColumn("kind", F.lit("trimmed")))
    return rows.select("kind", "icao", "iata", "city", "name", r6("lat"), r6("lon"), "iap")


def q_quarantine_read_back(spark, sf_dir):
    folder = _folder(spark)
    writers.write_quarantine(weather_queries.QUERIES["quarantined_requests"](spark, sf_dir), folder)
    return spark.read.parquet(folder).select("request_id", "reason")


def q_tile_table_read_back(spark, sf_dir):
    """Capped shapes, stored along the curve."""
    folder = _folder(spark)
    shapes, _ = tile_queries._capped(spark, sf_dir)
    writers.write_tile_table(shapes, folder)
    return tile_queries._summary(writers.read_tile_table(spark, folder)).drop("run")


def q_tile_files_read_back(spark, sf_dir):
    """Payloads as files, read back: the same sums as of the payloads themselves."""
    folder = _folder(spark)
    writers.write_tile_blobs(tile_queries._payloads(spark, sf_dir), folder, mode="overwrite")
    return tile_queries.content(tile_blobs.read_tiles(spark, folder))


QUERIES = {
    "csv_rows_read_back": q_csv_rows_read_back,
    "airport_index_read_back": q_airport_index_read_back,
    "quarantine_read_back": q_quarantine_read_back,
    "tile_table_read_back": q_tile_table_read_back,
    "tile_files_read_back": q_tile_files_read_back,
}

ORACLES = {
    "csv_rows_read_back": f"""WITH {cte("airports")}
SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, row_no AS key, ident, municipality, latitude_deg FROM airports""",
    "airport_index_read_back": f"""WITH {airport_queries.AIRPORT_CTE}
SELECT 'full' AS kind, icao, iata, city, name, round(lat, 6)+0e0 AS lat, round(lon, 6)+0e0 AS lon, iap FROM idx
UNION ALL SELECT 'trimmed', icao, iata, city, NULL, round(lat, 6)+0e0, round(lon, 6)+0e0, NULL FROM idx""",
    "quarantine_read_back": weather_queries.ORACLES["quarantined_requests"],
    "tile_table_read_back": tile_queries.ORACLES["capped_shapes"],
    "tile_files_read_back": tile_queries.ORACLES["payload_content"],
}
