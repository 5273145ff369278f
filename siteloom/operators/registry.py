"""Registry records joined to resolved companies and shaped into nested profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import fixed
from siteloom.functions.text import filled
from siteloom.functions.urls import base_domain


def latest(records: DataFrame, key: str, newest: list, most: int) -> DataFrame:
    """At most `most` records of each key, those that come first by `newest`."""
    order = Window.partitionBy(key).orderBy(*newest)
    return records.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)


def nested(records: DataFrame, key: str, fields: dict[str, Column], name: str) -> DataFrame:
    """(key, name): the records of each key in order `_n` as an array of structs of `fields`."""
    item = F.struct(*(c.alias(k) for k, c in fields.items()))
    lists = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", item.alias("x")))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda r: r["x"]).alias(name))


def _attached(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    for part in parts:
        base = base.join(part, key, "left")
    return base


def uk_profiles(
    profiles: DataFrame, officers: DataFrame, owners: DataFrame, filings: DataFrame, charges: DataFrame, insolvency: DataFrame
) -> DataFrame:
    """One nested row for each UK company: identity, address, active officers, owners, ten filings, charges, insolvency.

    The 1:N tables have `company_number` and `ord`; officers who resigned or have no name are left out.
    """
    key = "company_number"
    a = lambda k: F.col(f"registered_office_address.{k}")
    land = F.coalesce(filled(a("country")), F.lit(fixed.UK))
    lines = ["address_line_1", "address_line_2", "locality", "region", "postal_code", "country"]
    base = profiles.select(
        key, "company_name", F.col("company_name").alias("legal_name"), F.col(key).alias("registration_number"), "company_status",
        F.col("type").alias("company_type"), "jurisdiction", F.col("date_of_creation").alias("incorporation_date"),
        F.struct(
            a("address_line_1").alias("address_line_1"), a("address_line_2").alias("address_line_2"), a("locality").alias("city"),
            a("region").alias("region"), a("postal_code").alias("postal_code"), land.alias("country"),
        ).alias("registered_address"),
        F.concat_ws(", ", *(filled(a(x)) for x in lines)).alias("full_registered_address"),
        F.coalesce("sic_codes", F.array().cast("array<string>")).alias("sic_codes"), F.array_join("sic_codes", ", ").alias("industry"),
    )
    role = F.lower(F.coalesce("officer_role", F.lit("")))
    here = officers.where(filled(F.col("resigned_on")).isNull() & filled(F.col("name")).isNotNull())
    group = F.when(F.contains(role, F.lit("director")), "directors").when(role.rlike("secretary|manager"), "management")
    people = here.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ord", group.alias("g"), "name"))).alias("_p")
    )
    names = lambda g: F.transform(F.filter("_p", lambda p: p["g"] == g), lambda p: p["name"]).alias(g)
    people = people.select(key, F.struct(names("directors"), names("management")).alias("officers"))
    col = lambda *names: {n: F.col(n) for n in names}
    parts = [
        people,
        nested(latest(owners, key, ["ord"], 1 << 30), key, col("name", "kind", "natures_of_control", "nationality", "country_of_residence"), "psc"),
        nested(latest(filings, key, ["ord"], 10), key, col("date", "type", "description", "category"), "filing_history"),
        nested(latest(charges, key, ["ord"], 1 << 30), key, col("charge"), "charges"),
        insolvency.select(key, "insolvency"),
    ]
    return _attached(base, key, parts)


def best_address(addresses: DataFrame, key: str = "corpid_num") -> DataFrame:
    """The most useful address of each company: principal office, else agent, else any; newest first; street and city given."""
    rank = F.when(F.col("addr_type") == "3", 0).when(F.col("addr_type") == "1", 1).otherwise(2)
    good = addresses.where(filled(F.col("addr1")).isNotNull() & filled(F.col("city")).isNotNull())
    order = Window.partitionBy(key).orderBy(rank, F.desc(F.coalesce("date_filed", F.lit(""))), "ord")
    label = F.when(F.col("addr_type") == "3", "Principal Office").when(F.col("addr_type") == "1", "Registered Agent")
    picked = good.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return picked.select(
        key, F.col("addr1").alias("address_line_1"), F.col("addr2").alias("address_line_2"), "city", "state",
        F.col("zip5").alias("zip"), F.coalesce(filled(F.col("country")), F.lit(fixed.US)).alias("country"), "name", "addr_type",
        F.coalesce(label, F.concat(F.lit("Type "), "addr_type")).alias("addr_type_label"),
    )


def first_status(entities: DataFrame, key: str = "corpid_num") -> DataFrame:
    """The first status of each company that is not empty, in the order of its records."""
    given = entities.where(filled(F.col("status")).isNotNull())
    return given.groupBy(key).agg(F.min_by("status", "ord").alias("company_status"))


def ny_profiles(
    resolved: DataFrame, corps: DataFrame, filings: DataFrame, addresses: DataFrame, stock: DataFrame, entities: DataFrame
) -> DataFrame:
    """One nested row for each resolved or ambiguous company (key, status, matched, dos_id, confidence, search_name)."""
    key = "dos_id"
    lines = ["dos_process_address_1", "dos_process_address_2", "dos_process_city", "dos_process_state", "dos_process_zip"]
    names = ["address_line_1", "address_line_2", "city", "state", "zip"]
    own = F.struct(
        *(F.col(c).alias(n) if n != "state" else F.coalesce(filled(F.col(c)), F.lit("NY")).alias(n) for c, n in zip(lines, names)),
        F.lit(fixed.US).alias("country"),
    )
    chair = {"name": "name", "address": "address_1", "city": "city", "state": "state", "zip": "zip"}
    chairman = F.when(
        filled(F.col("chairman_name")).isNotNull(), F.struct(*(F.col(f"chairman_{c}").alias(n) for n, c in chair.items()))
    )
    base = corps.select(
        key, F.col("current_entity_name").alias("company_name"), "entity_type", "jurisdiction", "county",
        F.col("initial_dos_filing_date").alias("filing_date"), F.col("dos_process_name").alias("registered_agent"),
        F.col("registered_agent_name").alias("registered_agent_status"), chairman.alias("chairman"), own.alias("_own"),
        F.concat_ws(", ", *(filled(F.col(c)) for c in lines)).alias("full_registered_address"),
    )
    of = lambda df: df.withColumnRenamed("corpid_num", key)
    col = lambda *names: {n: F.col(n) for n in names}
    newest = [F.desc_nulls_last("date_filed"), "ord"]
    filing = col("film_num", "corp_name", "date_filed", "approved_date") | {
        "effective_date": F.col("eff_date"), "expiry_date": F.col("dura_date"), "dissolved_date": F.col("dis_eff_date"),
        "document_type": F.col("documenttype"), "entity_type": F.col("entitytype"), "cert_code": F.col("mod_certcode"), "law": F.col("law"),
        "county": F.col("cnty_prin_ofc"), "jurisdiction": F.col("juris"),
        "name_amended": F.coalesce(F.col("amd_corp_name_flag") == "X", F.lit(False)),
    }
    label = F.when(F.col("addr_type") == "1", "Registered Agent").when(filled(F.col("addr_type")).isNotNull(), F.concat(F.lit("Type "), "addr_type"))
    address = col("film_num", "date_filed", "addr_type") | {"addr_type_label": label} | col("name", "addr1", "city", "state") | {
        "zip": F.col("zip5"), "country": F.col("country")
    }
    picked = best_address(of(addresses), key)
    place = [*names, "country"]
    parts = [
        nested(latest(of(filings), key, newest, 20), key, filing, "filing_history"),
        nested(latest(of(stock), key, newest, 10), key, {"film_num": F.col("film_num"), "date_filed": F.col("date_filed"), "stock_type": F.col("stock_type"), "shares": F.col("stock_num_shrs"), "value_per_share": F.col("stock_val_shr")}, "stock_info"),
        nested(latest(of(entities), key, newest, 10), key, col("film_num", "date_filed") | {"cert_code": F.col("mod_cert_code"), "status": F.col("status")}, "entity_info"),
        nested(latest(of(addresses), key, newest, 10), key, address, "address_records"),
        first_status(latest(of(entities), key, newest, 10).drop("ord").withColumnRenamed("_n", "ord"), key),
        picked.select(key, F.struct(*(F.col(n) for n in place)).alias("_best")),
    ]
    shown = resolved.where(F.col("status").isin("resolved", "ambiguous") & F.col(key).isNotNull())
    rows = _attached(shown.join(base, key), key, parts)
    return rows.withColumn("registered_address", F.coalesce("_best", "_own")).drop("_best", "_own")


def infobox_fields(wikitext: DataFrame) -> DataFrame:
    """(title, field, value) of the first company infobox of each article (title, wikitext); later lines win."""
    block = F.regexp_extract("wikitext", r"(?is)\{\{\s*Infobox\s+(?:company|organi[sz]ation)\b(.*)", 1)
    lines = wikitext.select("title", F.posexplode(F.split(block, "\n")).alias("ord", "line"))
    key = F.lower(F.regexp_replace(F.trim(F.regexp_extract("line", r"^\s*\|?\s*([A-Za-z_ ]+?)\s*=", 1)), r"\s+", "_"))
    value = F.regexp_extract("line", r"^\s*\|?\s*[A-Za-z_ ]+?\s*=\s*(.*?)\s*$", 1)
    names = F.create_map(*(F.lit(x) for p in fixed.INFOBOX_FIELDS.items() for x in p))
    rows = lines.select("title", "ord", F.try_element_at(names, key).alias("field"), value.alias("raw")).where("field IS NOT NULL AND raw <> ''")
    shown = F.when(F.col("field") == "website", website_of(F.col("raw"))).otherwise(clean_markup(F.col("raw")))
    rows = rows.withColumn("value", filled(shown)).where("value IS NOT NULL")
    return rows.groupBy("title", "field").agg(F.max_by("value", "ord").alias("value"))


def clean_markup(c: Column) -> Column:
    """Wiki text without references, links, emphasis, templates and tags."""
    for pattern, to in (
        (r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), (r"'{2,}", ""),
        (r"\{\{[^{}]*\}\}", ""), (r"<[^>]+>", " "), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def website_of(c: Column) -> Column:
    """The website in a value: of a URL template, else of a link, else a bare URL, else a domain."""
    tries = [
        r"(?i)\{\{\s*(?:URL|official website)\s*\|\s*(?:1=)?([^|}\s]+)", r"\[(https?://[^\s\]]+)", r"(https?://[^\s\]|}<]+)",
        r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b",
    ]
    return F.coalesce(*(filled(F.regexp_extract(c, t, 1)) for t in tries))


def by_id(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records with one of `ids` (id): a point look-up for one id, a join for many."""
    return records.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def verified_articles(brands: DataFrame, hits: DataFrame, articles: DataFrame, outside: DataFrame) -> DataFrame:
    """One row for each of `brands` (brand, domain) whose article has an infobox: its fields, and `domain_match`.

    An article belongs to the company if the website in its infobox is on the company's domain, or else if one of its links
    (`outside`: title, link) is; a company found by its links gets its own domain as the website that is missing. Domains
    are compared as keys, so both checks are equi-joins.
    """
    found = brands.join(article_of(hits), F.col("brand") == F.col("query")).drop("query")
    fields = infobox_fields(articles).groupBy("title").pivot("field", sorted(set(fixed.INFOBOX_FIELDS.values()))).agg(F.first("value"))
    rows = found.join(fields, "title")
    own = base_domain(F.concat(F.lit("https://"), F.regexp_replace(F.lower("domain"), "^https?://", "")))
    site = base_domain(F.concat(F.lit("https://"), F.regexp_replace(F.lower("website"), "^https?://", "")))
    rows = rows.withColumn("_own", own)
    linked = outside.select("title", base_domain(F.col("link")).alias("_own"), F.lit(True).alias("_linked")).distinct()
    rows = rows.join(linked, ["title", "_own"], "left")
    by_site = F.coalesce((site == F.col("_own")) & (site != ""), F.lit(False))
    by_link = F.coalesce("_linked", F.lit(False))
    website = F.coalesce("website", F.when(by_link, F.col("domain")))
    return rows.withColumn("website", website).withColumn("domain_match", by_site | by_link).drop("_own", "_linked")


def article_of(hits: DataFrame) -> DataFrame:
    """One article for each query (query, hit_ord, title, snippet): of the first three, the first that is no disambiguation."""
    aside = F.contains(F.lower(F.coalesce("snippet", F.lit(""))), F.lit("disambiguation"))
    rows = hits.withColumn("_aside", aside)
    order = Window.partitionBy("query").orderBy("hit_ord")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    return rows.groupBy("query").agg(F.min_by("title", F.struct("_aside", "_n")).alias("title"))
