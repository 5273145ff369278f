"""One company asked for by hand: resolved with what is given, then its official records by point look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.matching import resolve_uk
from siteloom.operators.registry import uk_profiles

_ASKED = ["company_name", "legal_name", "registration_number", "domain", "postal_code", "city", "full_address"]


def register_company(spark: SparkSession, name: str, **views: str) -> None:
    """Register `name(number)` as a table function of SQL over registered views of registry tables with `company_number`:
    (source, ord, record) of one company, a record being a row as JSON.

    The number reaches each view as a filter of its scan, so a call with a literal reads one key of each table.
    """
    parts = []
    for source, view in views.items():
        columns = spark.table(view).columns
        order = "ord" if "ord" in columns else "0"
        kept = ", ".join(f"'{c}', `{c}`" for c in columns if c not in ("company_number", "ord"))
        parts.append(
            f"SELECT '{source}' AS source, CAST({order} AS BIGINT) AS ord, to_json(named_struct({kept})) AS record "
            f"FROM {view} WHERE company_number = {name}.number"
        )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(number STRING) RETURNS TABLE (source STRING, ord BIGINT, record STRING) RETURN " + " UNION ALL ".join(parts)
    )


def enriched(
    spark: SparkSession, search: DataFrame, uk: tuple[DataFrame, ...], name: str | None = None, number: str | None = None,
    domain: str | None = None, postcode: str | None = None, city: str | None = None, address: str | None = None,
) -> DataFrame:
    """One row of what the UK registry says of the company described: `status`, `resolution` (number, method, confidence, score,
    gap, candidates) and, if it is matched, its `legal_name` and the nested `normalized` profile.

    `uk` is (profiles, officers, owners, filings, charges, insolvency), keyed by company_number. The description is a table
    of one row; its resolution is the one row that is collected, and its number a filter on each table's scan.
    """
    given = dict(zip(_ASKED, (name, name, number, domain, postcode, city, address)))
    one = spark.createDataFrame([("asked", *given.values())], ", ".join(f"{c} string" for c in ("key", *given)))
    found = resolve_uk(one, search.where(F.col("query") == F.lit(name)), uk[0])
    parts = ["company_number", "method", "confidence", "score", "gap", "candidates"]
    answer = found.select("status", F.struct(*parts).alias("resolution"))
    row = found.select("status", "company_number").first()
    matched = row["company_number"] if row["status"] in ("resolved", "resolved_direct") else None
    mine = uk_profiles(*(t.where(F.col("company_number") == F.lit(matched)) for t in uk))
    mine = mine.select(F.col("legal_name"), F.struct(*mine.columns).alias("normalized"))
    return answer.join(mine, F.lit(True), "left")
