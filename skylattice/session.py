"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "skylattice", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Call sites are recorded for every Column otherwise, which costs more than small queries take.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without one, a session on several machines is refused: each executor would write to its own
    disk and the table would come back incomplete. A single-machine session gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="skylattice-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there afterwards.

    This cuts the lineage, survives lost executors, and gives the planner real sizes to choose join
    strategies by.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    if (paths := _temporary.get()) is not None:
        paths.append(path)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Of each thread its own: streams run their batches side by side.
_temporary: ContextVar[list[str] | None] = ContextVar("temporary_tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside are deleted at the end; their results must have been written by then."""
    paths: list[str] = []
    outer = _temporary.set(paths)
    try:
        yield
    finally:
        _temporary.reset(outer)
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; kernels import it there.

    The archive only passes through the driver's file server; single-machine sessions get it too,
    so that a session started in another working directory works.
    """
    context = spark.sparkContext
    if getattr(context, "_skylattice_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="skylattice-ship-"), "skylattice.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._skylattice_shipped = True
