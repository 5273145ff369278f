"""Exact deduplication by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import salt_of, saved, spread_join


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 64,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per input row: its id, `keep_id` (largest id of its equal texts), `group_size`, `kept`, `text_sha256`.

    Copies are combined in three steps, each grouping by the digest *and the full text*: inside a task (the partial
    aggregate), over salted groups of a digest, then over the winners of the salts. A group of copies of any size sends
    at most one row per task and salt. The winners of the digests, without texts, are written to the shared folder, and a
    row finds its group there by digest; only if two different texts share a digest (none are known for SHA-256) are the
    rows of such digests matched by full text as well.

    Null texts count as empty; null ids never win over other ids. Rows repeated with the same id are all reported and
    carry the same `kept`. Other columns of `docs` are ignored, so their names cannot clash. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256)).withColumn("_salt", salt_of("_id", salts))
    rows = rows.withColumn("_digest", digest(F.col("_text")) if digest else F.unhex("_sha"))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = salted.groupBy("_digest", "_text").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    winners = saved(
        groups.groupBy("_digest").agg(
            F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")
        ),
        "exact-winners",
    )
    alone = winners.where("_texts = 1").drop("_texts")
    found = spread_join(rows.select("_id", "_sha", "_digest", "_salt"), alone, ["_digest"], "_salt")
    result = ["_id", "_keep", "_n", "_sha"]
    found = found.select(*result)
    if not (clashing := winners.where("_texts > 1").select("_digest")).isEmpty():
        shared = groups.join(clashing, "_digest", "left_semi")
        found = found.union(rows.join(shared, ["_digest", "_text"]).select(*result))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
