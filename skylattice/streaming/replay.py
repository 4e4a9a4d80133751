"""Replays: a table as a stream of files in order, run until it is used up, with what the watermark dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylattice.session import materialize


#: Slices of fewer rows than this are one file.
ROWS_PER_FILE = 100_000


def write_slices(
    rows: DataFrame, slice_no: Column, folder: str, *, most_files: int = 1, rows_per_file: int = ROWS_PER_FILE, row_group_bytes: int = 4 << 20
) -> int:
    """Write the rows of each slice after those of the one before; returns the number of files that every slice has.

    A file stream takes files by their time, so slices that are written one after the other arrive so. Large
    slices are up to ``most_files`` files, and files are of small row groups, or one task would write a slice and
    read all of its micro-batch.
    """
    numbered = materialize(rows.withColumn("_slice", slice_no))
    found = sorted(tuple(r) for r in numbered.groupBy("_slice").count().collect())
    parts = numbered.rdd.getNumPartitions()
    # Rows are dealt in turn, so from this many on no file stays empty and all slices have equally many.
    files = max(1, min([most_files, *(n // max(rows_per_file, parts) for _, n in found)]))
    for number, _ in found:
        one = numbered.filter(F.col("_slice") == number).drop("_slice")
        spread = one.coalesce(1) if files == 1 else one.repartition(files)
        spread.write.mode("append").option("parquet.block.size", row_group_bytes).parquet(folder)
    return files


def stream_of(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """The slices as a stream, one in each micro-batch: as many files as :func:`write_slices` says."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def run_through(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write the stream's rows as Parquet until the slices are used up."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that came too late for the query's stateful operators, as its progress reports count them."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
