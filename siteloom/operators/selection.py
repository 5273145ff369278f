"""Choosing pages: by score, in adaptive batches, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.urls import url_score


def scored(urls: DataFrame) -> DataFrame:
    """`urls` (site, url, start_url) with score and category."""
    return urls.withColumn("_s", url_score(F.col("url"), F.col("start_url"))).select("*", "_s.score", "_s.category").drop("_s")


def ranked(urls: DataFrame) -> DataFrame:
    """Scored URLs with their rank in the site: by score, then by URL."""
    order = Window.partitionBy("site").orderBy(F.desc("score"), "url")
    return urls.withColumn("rank", F.row_number().over(order))


def selected(urls: DataFrame, most: int) -> DataFrame:
    """At most `most` of a site's distinct pages: its best homepage, then pages that score 3 or more, then the best of the rest.

    The homepage is an aggregate with partial sums; the window's limit is applied in each task before the shuffle, so a
    site with very many URLs sends few.
    """
    is_home = (F.col("category") == "homepage") & (F.col("score") >= 10)
    home = urls.where(is_home).groupBy("site").agg(F.min(F.struct((-F.col("score")).alias("_s"), "url"))["url"].alias("_home"))
    rows = urls.join(home, "site", "left")
    tier = F.when(F.col("url") == F.col("_home"), 0).when(F.col("score") >= 3, 1).otherwise(2)
    order = Window.partitionBy("site").orderBy("tier", F.desc("score"), "url")
    return rows.withColumn("tier", tier).drop("_home").withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= most)


def sufficient_batches(pages: DataFrame, batch_pages: int, most_pages: int = 100) -> DataFrame:
    """`pages` (site, rank, has_name, has_other) with `batch`, up to the first batch after which a site is known well enough.

    Enough is a name and one other field over all batches so far.
    """
    rows = pages.where(F.col("rank") <= most_pages).withColumn("batch", F.floor((F.col("rank") - 1) / batch_pages))
    by_batch = rows.groupBy("site", "batch").agg(F.max("has_name").alias("_name"), F.max("has_other").alias("_other"))
    so_far = Window.partitionBy("site").orderBy("batch")
    enough = F.max("_name").over(so_far) & F.max("_other").over(so_far)
    last = by_batch.withColumn("_enough", enough).where("_enough").groupBy("site").agg(F.min("batch").alias("_last"))
    rows = rows.join(last, "site", "left")
    return rows.where(F.col("_last").isNull() | (F.col("batch") <= F.col("_last"))).drop("_last")
