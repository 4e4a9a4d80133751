"""Tables and files out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import tilemath
from skylattice.operators.airports import airport_order
from skylattice.session import ship_package
from skylattice.sinks.tile_files import MANIFEST, TileFiles, store_of


def write_tile_table(shapes: DataFrame, folder: str, *, mode: str = "overwrite", row_group_bytes: int = 8 << 20) -> None:
    """The pyramid as Parquet partitioned by zoom, along a space-filling curve over the tiles.

    A view covers a block of tiles, which lies in few pieces of the curve, so the bounds of x and y tell
    most row groups apart. Ranges go down to the shape, so a tile with a large share of the rows spreads
    over several files.
    """
    order = ["z", "_place", "layer", "feature_id", "part", "run"]
    placed = shapes.withColumn("_place", tilemath.place_on_curve("x", "y"))
    sorted_shapes = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
    sorted_shapes.write.mode(mode).option("parquet.block.size", row_group_bytes).partitionBy("z").parquet(folder)


def read_tile_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def tile_path(z, x, y) -> str:
    return f"tiles/{z}/{x}/{y}.bin"


def write_tile_blobs(blobs: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Write ``tiles/{z}/{x}/{y}.bin`` under a folder all executors share; returns counts and bytes per zoom.

    The files appear together when all tasks have ended (:mod:`tile_files`). With mode "overwrite" they replace
    the tiles that are there, else they join them. The folder may be any URI that pyarrow's file
    systems know. The counts come from the same single pass that writes.
    """
    spark = blobs.sparkSession
    ship_package(spark)
    spark.dataSource.register(TileFiles)
    wanted = blobs.filter(F.col("payload").isNotNull()).select(F.col("z").cast("int").alias("z"), "x", "y", "payload")
    wanted.repartition("z", "x").write.format("tile_files").mode(mode).option("path", folder).save()
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}") as manifest:
        counts = json.loads(manifest.read())
    return spark.createDataFrame([tuple(row) for row in counts], "z int, tiles long, bytes long")


def write_airport_index(index: DataFrame, folder: str, *, mode: str = "overwrite", trimmed: bool = False) -> None:
    """The search index in its order (tier, icao) as JSON lines; ``trimmed`` drops name and approach flag."""
    ordered = index.withColumnRenamed("icao", "ident").orderBy(*airport_order()).withColumnRenamed("ident", "icao")
    columns = ["icao", "iata", "city", "lat", "lon"] if trimmed else ["icao", "iata", "city", "name", "lat", "lon", "iap"]
    ordered.select(*columns).write.mode(mode).json(folder)


def write_quarantine(rejected: DataFrame, folder: str, *, mode: str = "append") -> None:
    """Rejected rows with their ``reason``, one folder per reason."""
    rejected.write.mode(mode).partitionBy("reason").parquet(folder)
