"""Jurisdiction of companies by weighted votes of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import fixed
from siteloom.functions.text import country, country_in_text, country_of_host, filled, ny_phone, state_in_text, strip, uk_postcode
from siteloom.sources.scratch import saved

#: Fixed values. City, state and ZIP in an address, and a ZIP alone.
_CITY_STATE_ZIP = r"\b([A-Za-z][A-Za-z\s]{1,25}),\s*([A-Z]{2})\s+(\d{5})\b"
_ZIP = r"^\d{5}(?:-\d{4})?\z"
_VOTE = "array<struct<signal:string,value:string,kind:string,key:string,weight:decimal(10,2)>>"
#: Columns of the input that are read; those that are missing count as null.
FIELDS = [
    "domain", "country", "state_province", "registration_number", "postal_code", "full_address", "city", "vat_tax_number", "phone",
]


def _vote(signal: str, value: Column, kind: str, key: Column, weight: str | Column) -> Column:
    w = F.lit(weight) if isinstance(weight, str) else weight
    return F.struct(
        F.lit(signal).alias("signal"), value.alias("value"), F.lit(kind).alias("kind"), key.alias("key"),
        w.cast("decimal(10,2)").alias("weight"),
    )


def _places(text: Column) -> tuple[Column, Column]:
    """(state of a city-state-ZIP pattern or null, whether the pattern is there at all)."""
    short = filled(F.regexp_extract(text, _CITY_STATE_ZIP, 2))
    return F.when(short.isin(list(fixed.US_STATES.values())), short), F.coalesce(short.isNotNull(), F.lit(False))


def _us(signal: str, state: Column, state_weight: str, country_weight: str) -> list[Column]:
    return [
        _vote(signal, state, "state", state, state_weight),
        _vote(signal, state, "country", F.when(state.isNotNull(), fixed.US), country_weight),
    ]


def signals(companies: DataFrame, key: str = "site") -> DataFrame:
    """(key, ord, signal, value, kind, vote, weight) rows: what each company's fields say about its country and state."""
    have = set(companies.columns)
    c = {f: filled(F.col(f)) if f in have else F.lit(None).cast("string") for f in FIELDS}
    evidence = {f: filled(F.col(f"evidence_{f}")) if f"evidence_{f}" in have else F.lit(None).cast("string") for f in FIELDS}
    address = filled(strip(F.concat_ws(" ", c["full_address"], c["city"], c["postal_code"])))
    if "website_address" in have:
        parts = ("full_address", "city", "state_province", "postal_code", "country")
        address = filled(strip(F.concat_ws(" ", address, *(filled(F.col(f"website_address.{p}")) for p in parts))))
    # what several votes read is a column of its own: each use would be worked out anew, and the plan would be far too large
    companies = companies.withColumn("_address", address)
    texts = {"address": F.col("_address")} | {f: evidence[f] for f in ("full_address", "city", "country", "postal_code", "state_province")}
    once = {"_country": country(c["country"]), "_state": state_in_text(c["state_province"]), "_host_country": country_of_host(c["domain"])}
    for name, value in texts.items():
        state, there = _places(value)
        once |= {f"_{name}_state": state, f"_{name}_there": there, f"_{name}_country": country_in_text(value)}
        once[f"_{name}_said"] = F.when(~there, state_in_text(value))
    companies = companies.withColumns(once)
    col = F.col
    votes = [_vote("extracted_country_field", col("_country"), "country", col("_country"), "0.70")]
    votes += _us("extracted_state_province_field", col("_state"), "0.65", "0.50")
    number = F.upper(strip(c["registration_number"]))
    prefixed = F.regexp_extract(number, "^([A-Z]{2})", 1).isin(fixed.UK_PREFIXES)
    plain = number.rlike("^[0-9]{7,8}$")
    votes += [
        _vote("uk_registration_number_prefix", number, "country", F.when(prefixed, fixed.UK), "0.80"),
        _vote("uk_registration_number_numeric", number, "country", F.when(~prefixed & plain, fixed.UK), "0.55"),
    ]
    postcode = uk_postcode(F.coalesce(c["postal_code"], c["full_address"]))
    votes += [
        _vote("uk_postcode", F.coalesce(c["postal_code"], F.lit("(in address)")), "country", F.when(postcode.isNotNull(), fixed.UK), "0.70"),
        _vote("us_zip_code_field", c["postal_code"], "country", F.when(strip(c["postal_code"]).rlike(_ZIP), fixed.US), "0.65"),
        _vote("domain_cctld", c["domain"], "country", col("_host_country"), "0.55"),
    ]
    votes.append(_vote("country_in_address", col("_address_country"), "country", col("_address_country"), "0.55"))
    votes += _us("city_state_zip_pattern", col("_address_state"), "0.80", "0.65")
    votes += _us("state_in_address", col("_address_said"), "0.55", "0.40")
    vat = F.upper(strip(c["vat_tax_number"]))
    of_vat = F.coalesce(*(F.when(F.startswith(vat, F.lit(p)), n) for p, n in fixed.VAT_COUNTRIES.items()))
    votes.append(_vote("vat_number_country_prefix", vat, "country", of_vat, "0.60"))
    for f in list(texts)[1:]:
        value = evidence[f]
        votes += _us(f"field_evidence_{f}_city_state_zip", col(f"_{f}_state"), "0.70", "0.55")
        code = F.when(~col(f"_{f}_there") & strip(value).rlike(_ZIP), fixed.US)
        votes.append(_vote(f"field_evidence_{f}_zip", value, "country", code, "0.50"))
        votes.append(_vote(f"field_evidence_{f}_country", col(f"_{f}_country"), "country", col(f"_{f}_country"), "0.45"))
        votes += _us(f"field_evidence_{f}_state", col(f"_{f}_said"), "0.45", "0.35")
    votes = F.filter(F.array(*votes).cast(_VOTE), lambda v: v["key"].isNotNull())
    companies = companies.select(key, c["phone"].alias("_phone"), votes.alias("_given"))
    given, called = F.col("_given"), F.col("_phone")
    us = F.exists(given, lambda v: v["key"] == fixed.US)
    phone = _vote("phone_ny_area_code_supporting", called, "state", F.when(ny_phone(called), "NY"), F.when(us, "0.15").otherwise("0.05"))
    every = F.filter(F.concat(given, F.array(phone).cast(_VOTE)), lambda v: v["key"].isNotNull())
    # a column first, and unnested outer, as candidates are
    rows = companies.select(key, every.alias("_every")).select(key, F.posexplode_outer("_every").alias("ord", "v")).where("ord IS NOT NULL")
    return rows.select(key, "ord", "v.signal", "v.value", "v.kind", F.col("v.key").alias("vote"), "v.weight")


def winners(votes: DataFrame, key: str = "site") -> DataFrame:
    """(key, kind, vote, score, total): the vote with the greatest sum, the earliest of equals, and the sum of all."""
    sums = votes.groupBy(key, "kind", "vote").agg(F.sum("weight").alias("score"), F.min("ord").alias("_ord"))
    return sums.groupBy(key, "kind").agg(
        F.max_by("vote", F.struct("score", -F.col("_ord"))).alias("vote"), F.max("score").alias("score"), F.sum("score").alias("total")
    )


def jurisdictions(companies: DataFrame, key: str = "site") -> DataFrame:
    """One row for each company: country, state, state_abbr, city, confidence and its signals in order."""
    # written, as three aggregates read the votes
    votes = saved(signals(companies, key), "votes")
    best = winners(votes, key)
    of = lambda kind: best.where(F.col("kind") == kind).select(
        key, F.col("vote").alias(f"_{kind}"), F.col("score").alias(f"_{kind}_score"), F.col("total").alias(f"_{kind}_total")
    )
    said = votes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "signal", "value", "weight"))).alias("signals"))
    rows = companies.select(key, *(["city"] if "city" in companies.columns else [F.lit(None).cast("string").alias("city")]))
    rows = rows.join(of("country"), key, "left").join(of("state"), key, "left").join(said, key, "left")
    one = F.lit("1").cast("decimal(10,2)")
    share = F.col("_country_score") / F.greatest(F.col("_country_total"), one) + F.col("_country_score") * F.lit("0.3").cast("decimal(2,1)")
    base = F.round(F.least(share.cast("decimal(18,9)"), one), 3)
    state = F.when((F.col("_country") == fixed.US) & (F.col("_state_score") >= 0.20), F.col("_state"))
    names = F.create_map(*(F.lit(x) for n, s in fixed.US_STATES.items() for x in (s, n)))
    confidence = F.when(state.isNotNull(), F.least(base + F.lit("0.10").cast("decimal(3,2)"), one)).otherwise(base)
    return rows.select(
        key, F.col("_country").alias("country"), F.try_element_at(names, state).alias("state"), state.alias("state_abbr"),
        filled(F.col("city")).alias("city"), F.when(F.col("_country").isNull(), 0).otherwise(confidence).cast("decimal(6,3)").alias("confidence"), "signals",
    )


def registry_route(c: Column, state: Column) -> Column:
    """Which registry answers for a jurisdiction."""
    return (
        F.when(c.isNull(), "no_jurisdiction").when(c == fixed.UK, "uk").when((c == fixed.US) & state.isNull(), "state_required")
        .when((c == fixed.US) & (state == "NY"), "ny").otherwise("unsupported")
    )
