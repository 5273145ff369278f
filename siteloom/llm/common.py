"""What several corpus operators share: tables written to the shared folder, and joins that spread a hot key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.sources.scratch import clear_scratch, saved, scratch_path, shared_folder

__all__ = ["bounded_batches", "clear_scratch", "forget", "kept", "placed", "salt_of", "saved", "scratch_path", "shared_folder", "spread_join"]


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Hand Python workers Arrow batches of at most `most` bytes, whatever the length of the texts in them.

    The setting is the session's and stays: results are lazy, and it must hold when they are computed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def salt_of(key: str, salts: int, run: int = 1024):
    """A salt that is the same for `run` neighbouring ids, so that local combining still meets most copies."""
    return F.coalesce(F.pmod(F.xxhash64(F.floor(F.col(key) / run)), F.lit(salts)).cast("int"), F.lit(0))


def spread_join(
    rows: DataFrame, facts: DataFrame, on: list[str], salt: str, how: str = "inner", homes: DataFrame | None = None
) -> DataFrame:
    """Join `facts` (one row for each key) to `rows` when one key may hold a third of `rows`; `how` is inner or left.

    `rows` carries a salt column. The distinct (key, salt) pairs, at most the number of salts for each key, fetch the
    facts first; the wide join then runs on (key, salt), so a hot key is dealt over as many tasks as it has salts.
    `homes` may give a cheaper table with those pairs than `rows`.
    """
    homes = (rows if homes is None else homes).select(*on, salt).distinct()
    return rows.join(homes.join(facts, on, how), [*on, salt])


def placed(df: DataFrame, name: str) -> DataFrame:
    """`df` with a last column `name` that ascends in the order of its rows: of its partitions, or of files just read.

    Scans take files by size, not in the order in which a writer's tasks numbered them. So rows of a table that was just
    read are placed by file name and row; the list of files is the one that the driver plans the scan from.
    """
    read = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not read or not (files := sorted({f.rsplit("/", 1)[-1] for f in df.inputFiles()})):
        return df.withColumn(name, F.monotonically_increasing_id())
    at = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _at long")
    rows = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = (F.col("_at") * (1 << 40) + F.col("_row")).alias(name)
    return rows.join(F.broadcast(at), "_file").select(*df.columns, place)


#: What a Python worker keeps from one task to the next.
_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, made once in a worker process and kept for its next tasks; one thing at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what tasks of other operators left in this worker process: workers are reused and would hold it beside ours."""
    _KEPT.clear()
