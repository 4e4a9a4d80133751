"""Large slices are several files, and still one micro-batch each."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.streaming import replay


def test_large_slices_are_several_files_and_one_batch(spark, tmp_path):
    rows = spark.range(0, 6000, numPartitions=5).withColumn("k", F.col("id") % 3)
    files = replay.write_slices(rows, F.col("k"), f"{tmp_path}/in", most_files=4, rows_per_file=100, row_group_bytes=4096)
    assert files == 4
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) == 3 * files
    seen = {}

    def step(batch, number):
        seen[number] = sorted(r[0] for r in batch.select("k").distinct().collect()), batch.count()

    stream = replay.stream_of(spark, f"{tmp_path}/in", rows, files)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == {0: ([0], 2000), 1: ([1], 2000), 2: ([2], 2000)}


def test_a_small_slice_keeps_all_slices_in_one_file(spark, tmp_path):
    rows = spark.range(0, 6000, numPartitions=5).withColumn("k", F.when(F.col("id") == 7, 1).otherwise(0))
    assert replay.write_slices(rows, F.col("k"), f"{tmp_path}/in", most_files=4, rows_per_file=100) == 1
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) == 2
