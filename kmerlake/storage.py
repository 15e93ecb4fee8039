"""Folders that driver and executors share, for the tables and files of one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def new_folder(spark: SparkSession, what: str) -> str:
    """A path below spark.checkpoint.dir where nothing is yet; it goes when the application ends.

    Without that setting a temporary folder serves a session whose tasks run on this
    machine; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="kmerlake-"))
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and returns the table read back, without lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder; for loops whose plans would grow."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(new_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def file_system(uri: str):
    """pyarrow's file system and path for a URI, on whatever machine this runs."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
