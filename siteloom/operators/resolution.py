"""From profiles to registries: each company goes to the registry of its jurisdiction, and comes back as one report row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.jurisdiction import jurisdictions, registry_route
from siteloom.operators.matching import resolve_ny, resolve_uk
from siteloom.operators.registry import ny_profiles, uk_profiles, verified_articles
from siteloom.sources.scratch import saved

#: What the registries are asked with.
_ASKED = ["domain", "company_name", "legal_name", "registration_number", "postal_code", "full_address", "city"]
_FOUND = (
    "registry_type string, registry_status string, matched boolean, company_number string, matched_name string, "
    "confidence decimal(6,4)"
)
#: Fixed values. Registry and status of routes that no registry answers.
_NO_REGISTRY = {"no_jurisdiction": "no_jurisdiction", "state_required": "unsupported", "unsupported": "unsupported"}


def _shaped(rows: DataFrame, registry: str, **columns) -> DataFrame:
    given = {"registry_type": F.lit(registry)} | columns
    kinds = dict(x.split(" ") for x in _FOUND.split(", "))
    return rows.select("key", *(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def resolved_companies(
    companies: DataFrame, found: DataFrame, uk: tuple[DataFrame, DataFrame] | None, ny: DataFrame | None
) -> DataFrame:
    """One row for each of `companies` (key and website fields): what the registry of its jurisdiction says of it.

    `found` has key, country and state_abbr. `uk` is a pair of search hits and company profiles, `ny` a table of entities;
    a registry that is not there leaves its companies `unavailable`. The plan splits by route and joins again by key, so
    that each registry sees only companies of its own jurisdiction.
    """
    route = registry_route(F.col("country"), F.col("state_abbr"))
    routed = found.select("key", "country", "state_abbr", route.alias("route"))
    companies = companies.select("key", *_ASKED)
    of = lambda r: companies.join(routed.where(F.col("route") == r).select("key"), "key", "left_semi")
    parts = []
    if uk is None:
        parts.append(_shaped(of("uk"), "companies_house", registry_status=F.lit("unavailable"), matched=F.lit(False)))
    else:
        search, profiles = uk
        answer = resolve_uk(of("uk"), search, profiles)
        names = profiles.select("company_number", F.col("company_name").alias("_official")).dropDuplicates(["company_number"])
        answer = answer.join(names, "company_number", "left")
        matched = F.col("status").isin("resolved", "resolved_direct")
        parts.append(
            _shaped(
                answer, "companies_house", registry_status=F.col("status"), matched=matched, company_number=F.col("company_number"),
                matched_name=F.when(matched, F.col("_official")), confidence=F.col("confidence"),
            )
        )
    if ny is None:
        parts.append(_shaped(of("ny"), "ny_dos", registry_status=F.lit("unavailable"), matched=F.lit(False)))
    else:
        answer = resolve_ny(of("ny"), ny)
        parts.append(
            _shaped(
                answer, "ny_dos", registry_status=F.col("status"), matched=F.col("matched"), company_number=F.col("dos_id"),
                matched_name=F.col("matched_name"), confidence=F.col("confidence"),
            )
        )
    names = F.create_map(*(F.lit(x) for p in _NO_REGISTRY.items() for x in p))
    rest = routed.where(~F.col("route").isin("uk", "ny"))
    rest = _shaped(rest, "", registry_type=F.element_at(names, F.col("route")), registry_status=F.col("route"), matched=F.lit(False))
    answers = parts[0].unionByName(parts[1]).unionByName(rest)
    return routed.drop("route").join(answers, "key")


def company_reports(profiles: DataFrame, uk: tuple[DataFrame, DataFrame] | None, ny: DataFrame | None) -> DataFrame:
    """One row for each of `profiles` (site, domain and fields): the view of the company by name, its jurisdiction, and what
    the registry says. The official name of a matched UK company takes the place of its legal name."""
    rows = saved(profiles.withColumnRenamed("site", "key"), "profiles")
    found = jurisdictions(rows, "key").select("key", "country", "state_abbr", F.col("confidence").alias("jurisdiction_confidence"))
    found = saved(found, "jurisdictions")
    answers = resolved_companies(rows, found, uk, ny).drop("country")
    view = rows.select(
        "key", F.col("company_name").alias("name"), "legal_name", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("website"),
        "country", F.col("full_address").alias("address"), "email", "phone",
    )
    official = F.when((F.col("registry_type") == "companies_house") & F.col("matched"), F.col("matched_name"))
    out = view.join(answers, "key").join(found.select("key", "jurisdiction_confidence"), "key")
    return out.withColumn("legal_name", F.coalesce(official, "legal_name")).withColumnRenamed("key", "site")


def with_official_profiles(reports: DataFrame, uk: tuple[DataFrame, ...] | None, ny: tuple[DataFrame, ...] | None) -> DataFrame:
    """`reports` with `official_uk` and `official_ny`: the nested registry profile of a matched UK company, and of a New York
    company that is matched or one of several close ones; null elsewhere.

    `uk` is (profiles, officers, owners, filings, charges, insolvency), `ny` (corporations, filings, addresses, stock,
    entities), as `uk_profiles` and `ny_profiles` take them. Details are reduced to the companies in question first, so
    that only their records are shuffled and nested.
    """

    def only(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
        return table.join(ids.select(F.col("company_number").alias(key)).distinct(), key, "left_semi")

    out = reports
    if uk is not None:
        ids = saved(reports.where("registry_type = 'companies_house' AND matched").select("company_number"), "uk-ids")
        profile = uk_profiles(*(only(t, "company_number", ids) for t in uk))
        nested = profile.select(F.lit("companies_house").alias("registry_type"), "company_number", F.struct(*profile.columns).alias("official_uk"))
        out = out.join(nested, ["registry_type", "company_number"], "left")
    if ny is not None:
        shown = reports.where("registry_type = 'ny_dos' AND registry_status IN ('resolved', 'ambiguous')")
        shown = saved(shown.select("site", "registry_status", "matched", "company_number", "confidence", "name"), "ny-ids")
        asked = shown.select(F.col("site").alias("key"), F.col("registry_status").alias("status"), "matched", F.col("company_number").alias("dos_id"), "confidence", F.col("name").alias("search_name"))
        corps, *more = ny
        profile = ny_profiles(asked, only(corps, "dos_id", shown), *(only(t, "corpid_num", shown) for t in more))
        kept = [c for c in profile.columns if c not in ("key", "search_name")]
        out = out.join(profile.select(F.col("key").alias("site"), F.struct(*kept).alias("official_ny")), "site", "left")
    return out


def with_articles(reports: DataFrame, hits: DataFrame, articles: DataFrame, outside: DataFrame) -> DataFrame:
    """`reports` with `article`: the encyclopedia's fields of a company whose article is verified by its domain, null else.

    Companies are looked up by their legal name, else their name.
    """
    asked = reports.select("site", F.coalesce("legal_name", "name").alias("brand"), F.col("site").alias("domain"))
    found = verified_articles(asked.drop("site"), hits, articles, outside).where("domain_match")
    fields = [c for c in found.columns if c not in ("brand", "domain", "domain_match")]
    found = found.groupBy("brand", "domain").agg(F.first(F.struct(*fields)).alias("article"))
    return reports.join(asked, "site").join(found, ["brand", "domain"], "left").drop("brand", "domain")
