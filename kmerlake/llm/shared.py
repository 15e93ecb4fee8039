"""Tables and files in the folder that driver and executors share.

The folder is the session's spark.checkpoint.dir. Only where that is unset and all tasks
run on this machine, as in tests, a temporary folder is made and set; elsewhere it is an
error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="kmerlake-")
            spark.sparkContext.setCheckpointDir(_own[key])
        root = _own[key]
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path for one run's files; nothing is there yet. What is left there goes when the application ends."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: For rows of megabytes: row groups and pages are looked at after each row, not after a hundred.
BULKY = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def written(df: DataFrame, path: str, bulky: bool = False) -> DataFrame:
    """Writes df as Parquet and returns the table read back, without lineage."""
    df.write.mode("overwrite").option("compression", "zstd").options(**(BULKY if bulky else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def settled(df: DataFrame, *folders: str) -> DataFrame:
    """df written to a folder of its own, the folders that it was made from being removed.

    What is returned can be read as long as the application runs.
    """
    out = written(df, new_folder(df.sparkSession, "result"))
    remove(df.sparkSession, *folders)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: it is there whole or not at all once this returns."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """The small files of a folder by name; nothing if there is no folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return {}
    found = {}
    for status in system.listStatus(where):
        file = system.open(status.getPath())
        try:
            found[status.getPath().getName()] = bytes(file.readAllBytes()).decode()
        finally:
            file.close()
    return found


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder in one step; false if the target is there already."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(b.getParent())
    return not system.exists(b) and system.rename(a, b)


def file_system(uri: str):
    """pyarrow's file system and path for a URI, on whatever machine this runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))
