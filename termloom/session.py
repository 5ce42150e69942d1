"""Session helpers: the shared folder for intermediate tables, and materialisation."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shipped: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; every executor can read it.

    Where the setting is absent (tests, a local shell) a temporary folder is made
    and set as the checkpoint folder. On a cluster the setting is required: a
    folder of one machine would lose data with that machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written.

    Cuts lineage: what follows reads files that outlive any executor, and reads
    only the columns it needs. The files go away when the interpreter ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the materialised tables."""
    path = f"{shared_folder(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def discarding() -> Iterator[None]:
    """Delete what is materialised within the block when it ends; results must have been read or written by then."""
    before = len(_written)
    try:
        yield
    finally:
        forget_materialised(before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than there are.

    For work that costs far more per row than moving the row does, on tables of a
    few files; a table of many splits is left as it is, and so is what a shuffle
    has dealt already: asking for its partitions would run that shuffle.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def forget_materialised(keep: int = 0) -> None:
    """Delete the tables that ``materialise`` has written and not yet deleted, but for the first ``keep``."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            context = spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session has ended; the folder's owner cleans up
            pass


atexit.register(forget_materialised)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, wherever it is installed.

    Sends the package's sources once per application.
    """
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        package = pathlib.Path(__file__).resolve().parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="termloom-")) / "termloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent).as_posix())
        spark.sparkContext.addPyFile(str(archive))
        _shipped = spark.sparkContext.applicationId
    return spark
