"""Counters, history and views over pages and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions.text import filled

#: Columns that come from registries only and are left out of the view of what a site itself says.
REGISTRY_ONLY = [
    "officers", "psc", "filing_history", "charges", "insolvency", "stock_info", "entity_info", "address_records", "sic_codes",
    "registered_agent", "chairman", "dos_id", "company_number", "incorporation_date", "company_type", "company_status", "county",
]


#: Fixed values. Fields of the evidence table, in order.
EVIDENCE_FIELDS = [
    "company_name", "legal_name", "brand_name", "registration_number", "vat_tax_number", "country", "city", "full_address", "phone",
    "email", "industry", "parent_company",
]


def page_sizes(parsed: DataFrame) -> DataFrame:
    """Per page of `parsed` (url, n_html, parsed columns): its length and the sizes of what was found."""
    return parsed.select(
        "url", "n_html", F.length("clean_text").cast("long").alias("n_text"), F.size("json_ld").cast("long").alias("n_json_ld"),
        F.size("headings").cast("long").alias("n_headings"), F.size("tables_kv").cast("long").alias("n_tables"),
    )


def latest_by_site(history: DataFrame, most: int = 20) -> DataFrame:
    """The newest entry of each site of `history` (site, at, ...), and of those the `most` newest."""
    newest = Window.partitionBy("site").orderBy(F.desc("at"), F.desc("entry"))
    rows = history.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return rows.orderBy(F.desc("at"), "site").limit(most)


def merged_history(history: DataFrame | None, arrivals: DataFrame, most: int = 20) -> DataFrame:
    """(owner, place, site, entry): each owner's list of results after `arrivals` (owner, ord, site, entry) came in order.

    An update of a site on the list keeps its place, a new site goes first, and the last of more than `most` leaves. An
    owner's list and then its arrivals pass one task in order, sorted by Spark; Python holds a batch and the list of `most`
    entries. Rows without a site are left out.
    """
    owner = arrivals.schema["owner"].dataType.simpleString()
    kinds = f"owner {owner}, place int, site string, entry string"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, now, begun, schema = [], None, False, None

        def rows() -> pa.RecordBatch:
            columns = [[now] * len(listed), list(range(len(listed))), *([x[k] for x in listed] for k in (0, 1))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema)], ["owner", "place", "site", "entry"])

        for batch in batches:
            schema = schema or [batch.column(0).type, pa.int32(), pa.string(), pa.string()]
            for whose, old, site, entry in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not begun or whose != now:
                    if begun:
                        yield rows()
                    listed, now, begun = [], whose, True
                at = None if old else next((k for k, (s, _) in enumerate(listed) if s == site), None)
                if at is not None:
                    listed[at] = (site, entry)
                elif old:
                    listed.append((site, entry))
                else:
                    listed = [(site, entry), *listed][:most]
        if begun:
            yield rows()

    came = arrivals.where("site IS NOT NULL").select(
        "owner", F.lit(False).alias("old"), F.col("site").cast("string").alias("site"), F.col("entry").cast("string").alias("entry"),
        F.lit(None).cast("int").alias("place"), "ord",
    )
    if history is not None:
        before = history.select("owner", F.lit(True).alias("old"), "site", "entry", "place", F.lit(None).cast(came.schema["ord"].dataType).alias("ord"))
        came = before.union(came)
    rows = came.repartition("owner").sortWithinPartitions("owner", F.desc("old"), "place", F.asc_nulls_last("ord"))
    return rows.select("owner", "old", "site", "entry").mapInArrow(merge, kinds)


def write_history(spark: SparkSession, path: str, arrivals: DataFrame, most: int = 20) -> int:
    """Merge `arrivals` into the newest version of the history in a folder and write the next one; returns its number.

    A version is whole once Spark has committed it, which is when its marker appears, so a reader sees the old list or the new one.
    """
    version = newest_version(spark, path)
    before = read_history(spark, path) if version else None
    merged_history(before, arrivals, most).write.mode("overwrite").parquet(f"{path}/version-{version + 1:010d}")
    return version + 1


def newest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest committed version in a folder, 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version-*/_SUCCESS")) or []
    return max((int(f.getPath().getParent().getName().split("-")[1]) for f in found), default=0)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version (owner, place, site, entry) of the history in a folder."""
    return spark.read.parquet(f"{path}/version-{newest_version(spark, path):010d}")


def evidence_table(profiles: DataFrame) -> DataFrame:
    """(site, ord, field, value, confidence, method) of the twelve main fields of each profile, also of those it has not: these
    show [NULL], a confidence of 0 and the method null. Values are shown by their first 28 characters."""
    columns = [F.col(f) if f in profiles.columns else F.lit(None) for f in EVIDENCE_FIELDS]
    fields = F.array(*(F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in zip(EVIDENCE_FIELDS, columns)))
    rows = profiles.select("site", "evidence", F.posexplode(fields).alias("ord", "x"))
    said = F.try_element_at("evidence", F.col("x.field"))
    return rows.select(
        "site", (F.col("ord") + 1).alias("ord"), "x.field", F.coalesce(F.left(filled(F.col("x.value")), F.lit(28)), F.lit("[NULL]")).alias("value"),
        F.coalesce(said["confidence"], F.lit("0").cast("decimal(4,2)")).alias("confidence"), F.coalesce(said["method"], F.lit("null")).alias("method"),
    )


def scraped_view(profiles: DataFrame) -> DataFrame:
    return profiles.drop(*REGISTRY_ONLY)


def cards(profiles: DataFrame) -> DataFrame:
    """One line for each profile: name, place, contacts, and a badge for completeness."""
    pct = (F.col("data_completeness") * 100).cast("int")
    line = lambda sep, *names: F.concat_ws(sep, *(filled(F.col(n)) for n in names))
    return profiles.select(
        "site", F.coalesce(filled(F.col("legal_name")), filled(F.col("company_name")), F.lit("Unknown")).alias("name"),
        line(", ", "city", "state_province", "country").alias("place"), line(" | ", "email", "phone").alias("contact"),
        line(" / ", "registration_number", "vat_tax_number").alias("numbers"), pct.alias("pct"),
        F.when(pct >= 80, "high").when(pct >= 50, "medium").otherwise("low").alias("badge"),
    )


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Append profiles as JSON, a folder for each site."""
    profiles.write.mode("append").partitionBy("site").json(path)
