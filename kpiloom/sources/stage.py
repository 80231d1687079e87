"""Reading tables and staging intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table (``catalog.schema.table``) or, given a path, a Parquet folder."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def stage_view(df: DataFrame, name: str) -> DataFrame:
    """Name a result for SQL. Session-scoped and lazy: nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df


def stage_table(df: DataFrame, path: str) -> DataFrame:
    """Store a costly result that several queries read, and return the stored table.

    For shared storage only: the executors write there and must be able to read it back.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Take a stored table away, wherever Spark wrote it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, as configured for the cluster.

    A temporary folder stands in only in local mode, where driver and executors are one
    process on one machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="kpiloom-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def reliable_copy(df: DataFrame) -> DataFrame:
    """Write the rows below the checkpoint folder and read them back.

    Cuts the lineage: a lost executor cannot make the rows, or the partition they were in,
    come out differently a second time.
    """
    return stage_table(df, new_path(df.sparkSession))


def discard(copy: DataFrame) -> None:
    """Take a reliable copy away that nothing still to run reads, so that the copies of a long job don't add up."""
    files = copy.inputFiles()
    if files:
        remove(copy.sparkSession, files[0].rsplit("/", 1)[0])


def new_path(spark: SparkSession) -> str:
    """An unused path below the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/kpiloom-{uuid.uuid4()}"
