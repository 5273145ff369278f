"""Saved registry responses as a source: one table of raw answers, read by endpoint and key, typed by the endpoint's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an endpoint's answer holds: the schema of its body, and the field with its items if it is a list.
ENDPOINTS = {
    "search": (
        "items array<struct<company_number:string,title:string,company_status:string,address:struct<address_line_1:string,address_line_2:string,"
        "locality:string,region:string,postal_code:string,country:string>>>", "items",
    ),
    "profile": (
        "company_name string, company_status string, type string, jurisdiction string, date_of_creation string, sic_codes array<string>, "
        "registered_office_address struct<address_line_1:string,address_line_2:string,locality:string,region:string,postal_code:string,country:string>", None,
    ),
    "officers": ("items array<struct<name:string,officer_role:string,resigned_on:string>>", "items"),
    "psc": ("items array<struct<name:string,kind:string,natures_of_control:array<string>,nationality:string,country_of_residence:string>>", "items"),
    "filing-history": ("items array<struct<date:string,type:string,description:string,category:string>>", "items"),
    "charges": ("items array<struct<charge:string>>", "items"),
    "insolvency": ("insolvency string", None),
}


def write_responses(responses: DataFrame, path: str, buckets: int = 64) -> None:
    """Write raw responses (endpoint, key, status, body) so that a few keys can be read without the others.

    Files are by endpoint and by a hash of the key, and sorted by key inside, so that a reader prunes folders first and
    then parts of files by their statistics. All rows of a bucket need not fit a task: equal keys are sorted, not gathered.
    """
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = responses.select("endpoint", "key", "status", "body").withColumn("bucket", bucket)
    rows = rows.repartition("endpoint", "bucket").sortWithinPartitions("endpoint", "bucket", "key")
    rows.write.mode("overwrite").partitionBy("endpoint", "bucket").parquet(path)


def read_raw(spark: SparkSession, path: str, endpoint: str, keys: DataFrame | list[str] | None = None, buckets: int = 64, few: int = 1000) -> DataFrame:
    """(key, status, body) of an endpoint, of all keys or of the asked ones: a list, or a table (key).

    Folders are pruned by the buckets of the keys, at most `buckets` numbers that are collected. A list of at most `few`
    keys is also pushed into the scan; more of them, and tables, are a semi-join.
    """
    rows = spark.read.schema("key string, status int, body string, endpoint string, bucket int").parquet(path).where(F.col("endpoint") == endpoint)
    if keys is None:
        return rows.select("key", "status", "body")
    asked = spark.createDataFrame([(k,) for k in keys], "key string") if isinstance(keys, list) else keys.select("key")
    numbers = [r[0] for r in asked.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).distinct().collect()]
    rows = rows.where(F.col("bucket").isin(numbers)).select("key", "status", "body")
    if isinstance(keys, list) and len(keys) <= few:
        return rows.where(F.col("key").isin(keys))
    return rows.join(asked.distinct(), "key", "left_semi")


def read_responses(spark: SparkSession, path: str, endpoint: str, keys: DataFrame | list[str] | None = None, **options) -> DataFrame:
    """(key, ord, fields of the endpoint) of the answers that succeeded, one row for each item of a list.

    An answer with another status than 200, or whose body is no JSON object of the endpoint, is an empty relation: its key
    has no row, and joins with it leave null. Of repeated answers of a key each counts.
    """
    schema, items = ENDPOINTS[endpoint]
    raw = read_raw(spark, path, endpoint, keys, **options).where("status = 200 AND body IS NOT NULL")
    rows = raw.select("key", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("b"))
    if items is None:
        one = [f.name for f in rows.schema["b"].dataType.fields]
        whole = F.coalesce(*(F.col(f"b.{n}").cast("string") for n in one)).isNotNull()
        return rows.where(whole).select("key", F.lit(0).alias("ord"), "b.*")
    return rows.select("key", F.posexplode(f"b.{items}").alias("ord", "x")).select("key", "ord", "x.*")


def unavailable(spark: SparkSession, path: str, endpoint: str) -> bool:
    """Whether an endpoint never answered: no response at all, or every one refused or failed before the registry looked."""
    answered = read_raw(spark, path, endpoint).where("status IN (200, 404)")
    return answered.isEmpty()


def uk_registry(spark: SparkSession, path: str, numbers: DataFrame | list[str] | None = None) -> tuple[DataFrame, ...] | None:
    """(profiles, officers, owners, filings, charges, insolvency) of companies, as `registry.uk_profiles` takes them, or None
    if the registry is unavailable, which leaves its companies so."""
    if unavailable(spark, path, "profile"):
        return None
    of = lambda endpoint: read_responses(spark, path, endpoint, numbers).withColumnRenamed("key", "company_number")
    profiles = of("profile").drop("ord")
    return profiles, of("officers"), of("psc"), of("filing-history"), of("charges"), of("insolvency")
