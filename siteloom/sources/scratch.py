"""Tables that a plan of several steps writes to the shared folder, so that later jobs start from files.

They survive lost executors, and a plan that uses one of them twice does not compute it twice.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, local mode (tests) has one of our own,
    removed when Python ends; on several machines there is none to guess, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        own = tempfile.mkdtemp(prefix="siteloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_FOLDERS[context.applicationId] = f"file://{own}"
    return _OWN_FOLDERS[context.applicationId]


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/siteloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application's operators wrote to the shared folder; call it after results are written,
    as results read those tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back, so later jobs start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows_per_task: int = 4000) -> DataFrame:
    """`df` dealt by `key` over tasks of about `rows_per_task` rows: a small file is one task, however much each row costs.

    `df` is counted first, so it should be a file. The number is given, as adaptive execution would merge small rows again.
    """
    return df.repartition(max(1, -(-df.count() // rows_per_task)), key)
