"""Progress events as a stream: one row for each log line and result of a site, framed for server-sent delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON event files: site, at, type (log, json, done), level, msg, content."""
    schema = "site string, at timestamp, type string, level string, msg string, content string"
    return spark.readStream.schema(schema).json(path)


def frames(events: DataFrame) -> DataFrame:
    """Events as frames `data: {...}` with the level INFO where none is given."""
    level = F.when(F.col("type") == "log", F.coalesce("level", F.lit("INFO")))
    body = F.to_json(F.struct("type", level.alias("level"), "msg", "content"))
    return events.select("site", "at", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))

