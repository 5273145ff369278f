"""Candidates: what each page says about a company, one row for each (field, value), and their ranking into profiles."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import fixed
from siteloom.functions.text import (
    clean_address, clean_text, filled, matched, strip, uk_postcode, valid_address, valid_email, valid_phone,
    valid_registration, valid_vat, without_suffixes,
)
from siteloom.functions.urls import let
from siteloom.sources.pages import json_ld_nodes
from siteloom.sources.scratch import saved

#: Stages in the order in which ties between candidates are decided.
STAGES = ("json_ld", "labels", "text", "address", "names")
_KIND = "array<struct<field:string,value:string,method:string,evidence:string,confidence:decimal(4,2)>>"
_SUFFIXES = "|".join(re.escape(s) for s in fixed.CORPORATE_SUFFIXES)
#: Fixed value. City, state and ZIP in an address.
_CITY_STATE_ZIP = r"\b([A-Za-z][A-Za-z\s]{1,25}),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\b"


def _c(field: str, value: Column, method: str, evidence: Column | str, confidence: Column | str) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    said = F.lit(evidence) if isinstance(evidence, str) else evidence
    return F.struct(
        F.lit(field).alias("field"), clean_text(value.cast("string")).alias("value"), F.lit(method).alias("method"),
        clean_text(F.substring(said, 1, 300)).alias("evidence"), conf.cast("decimal(4,2)").alias("confidence"),
    )


def _said(label: str, value: Column, most: int | None = None) -> Column:
    return F.concat(F.lit(label), value if most is None else F.substring(value, 1, most))


def unnested(rows: DataFrame, at: str, item: str) -> DataFrame:
    """`rows` for each element of their column `_list`, with its place. The list is a column first, as Spark works out once what
    expressions of a column share, but not those of a generator; unnested outer, so that no filter on it is moved below."""
    return rows.select(*(c for c in rows.columns if c != "_list"), F.posexplode_outer("_list").alias(at, item)).where(F.col(at).isNotNull())


def _rows(pages: DataFrame, stage: str, category: Column, found: Column) -> DataFrame:
    """`found`, an array of candidates of each page in order, as rows; empty values are no candidates."""
    rows = unnested(pages.select("site", "batch", "page_ord", "url", category.alias("category"), found.cast(_KIND).alias("_list")), "seq", "c")
    seq = F.col("seq").cast("long").alias("seq")
    rows = rows.select("site", "batch", F.lit(STAGES.index(stage)).alias("stage"), "page_ord", seq, "url", "category", "c.*")
    return rows.where("value IS NOT NULL")


def _any(url: Column, words: list[str]) -> Column:
    return F.when(url.rlike("|".join(re.escape(w) for w in words)), "legal").otherwise("general")


def from_json_ld(pages: DataFrame) -> DataFrame:
    """Candidates of organizations in JSON-LD."""
    nodes = json_ld_nodes(pages.select("site", "batch", "page_ord", "url", "json_ld"))
    get = lambda path: filled(F.try_variant_get("node", path, "string"))
    kinds = F.coalesce(F.try_variant_get("node", '$["@type"]', "variant").cast("string"), F.lit(""))
    listed = F.when(F.startswith(kinds, F.lit("[")), F.from_json(kinds, "array<string>")).otherwise(F.array(kinds))
    org = F.arrays_overlap(listed, F.array(*(F.lit(x) for x in fixed.ORGANIZATION_TYPES)))
    name, legal, text = get("$.name"), get("$.legalName"), clean_text(get("$.description"))
    country = F.coalesce(get("$.address.addressCountry.name"), get("$.address.addressCountry"))
    city, region, code, street = (get(f"$.address.{k}") for k in ("addressLocality", "addressRegion", "postalCode", "streetAddress"))
    whole = F.when(street.isNotNull(), valid_address(F.concat_ws(", ", street, city, region, code, country)))
    parent = F.coalesce(get("$.parentOrganization.name"), get("$.parentOrganization"))
    subs = F.try_variant_get("node", "$.subOrganization", "variant")
    many = F.when(F.startswith(F.schema_of_variant(subs), F.lit("ARRAY")), subs.cast("array<variant>")).when(subs.isNotNull(), F.array(subs))
    names = F.transform(many, lambda s: F.coalesce(F.try_variant_get(s, "$.name", "string"), F.try_variant_get(s, "$", "string")))
    at = "JSON-LD "
    found = F.array(
        _c("company_name", name, "json_ld_org_name", _said(at + "Organization.name: ", name), "0.95"),
        _c("brand_name", name, "json_ld_org_name", _said(at + "Organization.name: ", name), "0.90"),
        _c("legal_name", legal, "json_ld_legal_name", _said(at + "Organization.legalName: ", legal), "0.98"),
        *(
            _c("vat_tax_number", valid_vat(get(f"$.{k}")), m, _said(f"{at}{k}: ", get(f"$.{k}")), "0.98")
            for k, m in (("vatID", "json_ld_vat"), ("taxID", "json_ld_tax"))
        ),
        _c("phone", valid_phone(get("$.telephone")), "json_ld_phone", _said(at + "telephone: ", get("$.telephone")), "0.95"),
        _c("email", valid_email(get("$.email")), "json_ld_email", _said(at + "email: ", get("$.email")), "0.95"),
        _c("business_description", F.when(F.length(text) > 20, F.substring(text, 1, 500)), "json_ld_desc", _said(at + "description: ", text, 100), "0.90"),
        _c("country", country, "json_ld_address", _said(at + "addressCountry: ", country), "0.95"),
        _c("city", city, "json_ld_address", _said(at + "addressLocality: ", city), "0.95"),
        _c("state_province", region, "json_ld_address", _said(at + "addressRegion: ", region), "0.95"),
        _c("postal_code", F.coalesce(uk_postcode(code), code), "json_ld_address", _said(at + "postalCode: ", code), "0.95"),
        _c("full_address", whole, "json_ld_full_address", _said(at + "full address: ", whole), "0.98"),
        _c("parent_company", parent, "json_ld_parent", _said(at + "parentOrganization: ", parent), "0.95"),
    ).cast(_KIND)
    below = F.transform(
        F.coalesce(names, F.array().cast("array<string>")),
        lambda s: _c("subsidiaries", s, "json_ld_subsidiary", F.concat(F.lit(at + "subOrganization: "), s), "0.95"),
    ).cast(_KIND)
    rows = nodes.where(org).select("site", "batch", "page_ord", "url", "path", F.concat(found, below).alias("_list"))
    rows = unnested(rows, "_at", "c").where("c.value IS NOT NULL")
    # a place in the page's order, as that is all a seq is for: numbering without gaps would sort all candidates
    place = F.shiftleft(F.col("path").cast("long"), 32) + F.col("_at")
    return rows.select(
        "site", "batch", F.lit(0).alias("stage"), "page_ord", place.alias("seq"), "url",
        F.lit("general").alias("category"), "c.*",
    )


def from_labels(pages: DataFrame) -> DataFrame:
    """Candidates of key-value pairs whose label names a field; a label may name several."""
    category = _any(F.col("url"), ["legal", "imprint", "impressum", "company-information"])
    maps = F.concat("tables_kv", "div_kv")
    pairs = F.flatten(F.transform(maps, lambda m: F.map_entries(m)))
    conf = F.when(category == "legal", "0.95").otherwise("0.85")
    checks = {"registration_number": valid_registration, "vat_tax_number": valid_vat, "phone": valid_phone}

    def of(pair: Column) -> Column:
        return let(F.struct(F.lower(strip(pair["key"])).alias("l"), pair["key"].alias("k"), clean_text(pair["value"]).alias("v")), fields)

    def fields(pair: Column) -> Column:
        label, value = pair["l"], pair["v"]
        out = []
        for field, aliases in fixed.LABEL_ALIASES.items():
            good = valid_email(value, label) if field == "email" else checks.get(field, lambda v: v)(value)
            named = label.rlike("|".join(re.escape(a) for a in aliases))
            said = F.concat(F.lit("Table ["), pair["k"], F.lit("]: "), value)
            out.append(F.when(named, _c(field, good, "html_table_kv", said, conf)))
        return F.array(*out)

    return _rows(pages, "labels", category, F.flatten(F.transform(pairs, of)))


def _has(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text: what a pattern needs to match, found far sooner than by its alternatives."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


#: Fixed values. Patterns of registration and VAT numbers, and of legal names, in text.
_REGISTRATION = [
    r"(?:Company\s+(?:Registration|Reg)?\s*(?:No\.?|Number|#)|Registration\s+Number|Handelsregister(?:nummer)?|HRB|HRA|SIREN|SIRET|"
    r"Chamber\s+of\s+Commerce\s+No|CR\s+No|Commercial\s+Register\s+No|Business\s+Registration\s+Number)[:\s]+([A-Z0-9\-\.\/]{4,20})",
    r"(?:Registered\s+in\s+[A-Za-z\s]+(?:under|with)?\s+(?:No\.?|number|#)?)[:\s]*([0-9A-Z\-]{5,15})",
    r"(?:Company\s+No\.?|Company\s+Number)[:\s]*([A-Z]{0,2}[0-9]{6,8})",
]
_VAT = [
    r"(?:VAT\s*(?:Reg(?:istration)?\.?\s*)?(?:No\.?|Number|#)|USt-IdNr\.?|TVA|Tax\s+ID|GSTIN|EIN)[:\s]+([A-Z0-9\s\-\.]{6,25})",
    r"\b(GB\s?[0-9]{3}\s?[0-9]{4}\s?[0-9]{2}|GB\s?[0-9]{9}|DE\s?[0-9]{9}|FR\s?[0-9A-Z]{2}\s?[0-9]{9}|NL\s?[0-9]{9}B[0-9]{2}|"
    r"CHE\-[0-9]{3}\.[0-9]{3}\.[0-9]{3})\b",
]
_NAME = rf"([A-Z0-9][A-Za-z0-9\s,\.\-&]{{2,40}}?\b(?:{_SUFFIXES})\b)"
_LEGAL = [
    r"(?i)(?:owned\s+(?:and\s+produced\s+)?by|operated\s+by|administrators\s+of|registered\s+name\s*[:\-]?|trading\s+as|"
    rf"licensed\s+(?:in\s+the\s+uk\s+)?by)\s+{_NAME}",
    rf"(?:Company\s+Information|About\s+Us)\s*\n+{_NAME}",
    r"(?:©|Copyright|\(c\)|&copy;)\s*(?:Copyright\s*)?(?:[0-9]{4}(?:\s*[-–]\s*[0-9]{4})?)?[,\s;]+"
    rf"(?:all\s+rights\s+reserved[,\s;]+)?(?:by\s+)?{_NAME}",
    rf"\b([A-Z][A-Za-z0-9\s&]{{2,35}}\b(?:{_SUFFIXES})\b)",
]
#: Fixed values. What a text has, in lower case or as it is, where patterns above match: each pattern needs one of its words.
_NUMBER_WORDS = ["company", "registration", "registered", "handelsregister", "hrb", "hra", "siren", "siret", "chamber", "commercial"]
_OWNER_WORDS = ["owned", "operated", "administrators", "registered", "trading", "licensed"]
_SUFFIX_ROOTS = [s for s in fixed.CORPORATE_SUFFIXES if not any(r in s for r in fixed.CORPORATE_SUFFIXES if r != s)]
#: Fixed value. An address in text.
_LOCAL = r"[A-Za-z0-9._%+-]+"
_MAIL = rf"{_LOCAL}@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"


def us_address(address: Column) -> Column:
    """Candidates of an American address: city, state and ZIP together, else a ZIP beside letters."""
    city, short, code = (F.regexp_extract(address, _CITY_STATE_ZIP, k) for k in (1, 2, 3))
    names = F.create_map(*(F.lit(x) for n, s in fixed.US_STATES.items() for x in (s, n)))
    state = F.try_element_at(names, short)
    bare = matched(address, r"\b(\d{5})(?:-\d{4})?\b")
    near = matched(address, r"(?s)(.{0,30}\b\d{5}(?:-\d{4})?\b.{0,10})").rlike("[A-Za-z]{3}")
    whole = [
        _c("country", F.lit(fixed.US), "us_address_parser", _said("US address pattern: ", F.regexp_extract(address, _CITY_STATE_ZIP, 0)), "0.90"),
        _c("state_province", state, "us_address_parser", _said("US state: ", short), "0.90"),
        _c("city", city, "us_address_parser", _said("US city: ", city), "0.88"),
        _c("postal_code", code, "us_address_parser", _said("US ZIP: ", code), "0.90"),
    ]
    weak = [
        _c("postal_code", bare, "us_zip_regex", _said("US ZIP in address: ", bare), "0.70"),
        _c("country", F.lit(fixed.US), "us_zip_regex", _said("5-digit ZIP suggests US: ", bare), "0.55"),
    ]
    return F.when(state.isNotNull(), F.array(*whole).cast(_KIND)).when(bare.isNotNull() & near, F.array(*weak).cast(_KIND)).otherwise(
        F.array().cast(_KIND)
    )


def title_names(title: Column) -> Column:
    """Names in a title, with the confidence of each: parts between bars, or else hyphens, that are not generic."""
    parts = F.when(F.contains(title, F.lit("|")), F.split(title, r"\|")).otherwise(F.split(title, "-"))
    parts = F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")

    def named(parts: Column) -> Column:
        def of(p: Column) -> Column:
            name = strip(F.regexp_replace(p, fixed.TITLE_OPENINGS, ""))
            conf = F.when(p == parts[0], "0.65").otherwise("0.80").alias("conf")
            return let(name, lambda n: F.struct(F.when(~F.lower(n).isin(fixed.GENERIC_TITLES) & F.length(n).between(2, 59), n).alias("name"), conf))

        return F.transform(parts, of)

    return F.filter(let(parts, named), lambda x: x["name"].isNotNull())


def plain_mails(text: Column) -> Column:
    """Mail addresses in a text. One with a cue for an example within 60 characters on either side is none.

    Cues are looked for around addresses only: looking back from every character takes some fifty times as long.
    """
    before = "|".join(rf"{re.escape(c)}.{{0,{60 - len(c)}}}" for c in fixed.EMAIL_EXAMPLE_CUES)
    after = "|".join(rf".{{0,{60 - len(c)}}}{re.escape(c)}" for c in fixed.EMAIL_EXAMPLE_CUES)
    found = F.regexp_extract_all(text, F.lit(rf"(?is)\b(?={_LOCAL}+@)(?<!(?:{before}))(?>{_MAIL}\b)(?!{after})"), F.lit(0))
    return F.filter(F.when(F.contains(text, F.lit("@")), found), lambda e: ~F.lower(e).rlike("|".join(re.escape(c) for c in fixed.EMAIL_EXAMPLE_CUES)))


def from_text(pages: DataFrame) -> DataFrame:
    """Candidates of titles, meta tags and labelled patterns in the page's text and its footers."""
    category = _any(F.lower("url"), ["legal", "imprint", "impressum", "terms", "company-information"])
    pages = pages.withColumn("_text", F.concat_ws("\n", "clean_text", "footer_texts"))
    # what patterns need to match is looked for first, in columns of their own, as most texts lack it; numbers need a digit
    pages = pages.withColumns({"_low": F.lower("_text"), "_digit": F.col("_text").rlike("[0-9]")})
    numbered = F.col("_digit") & (_has(F.col("_low"), _NUMBER_WORDS) | F.col("_low").rlike(r"cr\s+no"))
    pages = pages.withColumns({"_numbered": numbered, "_owned": _has(F.col("_low"), _OWNER_WORDS), "_suffix": _has(F.col("_text"), _SUFFIX_ROOTS)})
    ahead = {p: F.col("_numbered") for p in _REGISTRATION} | {_VAT[0]: F.col("_digit"), _VAT[1]: F.col("_text").rlike("[0-9]{3}")}
    ahead |= {p: F.col("_suffix") for p in _LEGAL} | {_LEGAL[0]: F.col("_owned")}
    text, page = F.col("_text"), F.col("clean_text")
    conf = F.when(category == "legal", "0.95").otherwise("0.85")
    none = F.array().cast(_KIND)
    site, about = F.col("og_site_name"), F.col("meta_description")
    found = [
        F.array(
            _c("company_name", site, "meta_og_site_name", _said("og:site_name: ", site), "0.75"),
            _c("brand_name", site, "meta_og_site_name", _said("og:site_name: ", site), "0.75"),
        ),
        F.transform(
            title_names(F.col("title")), lambda x: _c("company_name", x["name"], "page_title", _said("Title: ", F.col("title")), x["conf"])
        ),
        F.array(_c("business_description", F.when(F.length(about) >= 30, about), "meta_description", _said("meta description: ", about, 100), "0.75")),
    ]
    for field, patterns, check in (("registration_number", _REGISTRATION, valid_registration), ("vat_tax_number", _VAT, valid_vat)):
        for p in patterns:
            hit = "(?i)" + p
            said = _said("Matched text: ", F.regexp_extract(text, hit, 0), 150)
            found.append(F.when(ahead[p] & text.rlike(hit), F.array(_c(field, check(matched(text, hit)), "regex_labeled", said, conf)).cast(_KIND)))
    for p in _LEGAL:
        hit = p + r"([^\n]*)"
        names, tails = F.regexp_extract_all(text, F.lit(hit), F.lit(1)), F.regexp_extract_all(text, F.lit(hit), F.lit(2))
        both = F.filter(F.arrays_zip(names.alias("n"), tails.alias("t")), lambda x: F.length(clean_text(x["n"])) < 60)
        first = F.when(ahead[p] & text.rlike(p), F.slice(both, 1, 1))

        def of(x: Column) -> Column:
            rest = strip(x["t"])
            code, place = uk_postcode(rest), valid_address(rest)
            more = F.concat(
                us_address(rest),
                F.array(
                    _c("postal_code", code, "copyright_line_postcode", _said("Postcode in copyright line: ", code), "0.90"),
                    _c("country", F.when(code.isNotNull(), fixed.UK), "copyright_line_postcode", "Derived from UK postcode in copyright line", "0.90"),
                    _c("full_address", place, "copyright_line_address", _said("Address in copyright line: ", rest, 100), "0.85"),
                ).cast(_KIND),
            )
            own = F.array(_c("legal_name", x["n"], "legal_text_regex", _said("Matched text: ", x["n"], 150), conf)).cast(_KIND)
            return F.when(F.length(rest) > 8, F.concat(own, more)).otherwise(own)

        found.append(F.flatten(F.transform(first, of)))
    mail = lambda m, label, c: lambda e: _c("email", valid_email(e), m, _said(label, valid_email(e)), c)
    labelled = F.regexp_extract_all(text, F.lit(rf"(?i)(?:Email|E-mail|Contact\s+Email|Mail)[:\s]+({_MAIL})"), F.lit(1))
    labelled = F.when(F.contains(text, F.lit("@")), labelled)
    called = F.regexp_extract_all(page, F.lit(r"(?i)(?:Tel(?:ephone)?|Phone|Call|Contact|Office)[:\s]+(\+?[0-9\s\-\(\)\.]{8,20})"), F.lit(1))
    plain = plain_mails(page)
    found += [
        F.transform("mailto", mail("mailto_link", "Mailto/Deobfuscated link: ", "0.95")),
        F.transform(labelled, mail("labeled_email", "Labeled email: ", "0.90")),
        F.transform(plain, mail("regex_email", "Email found in text: ", "0.70")),
        F.transform(
            F.when(F.col("_digit"), called),
            lambda p: _c("phone", valid_phone(p), "regex_phone", _said("Phone found: ", valid_phone(p)), "0.80"),
        ),
    ]
    return _rows(pages, "text", category, reduce(F.concat, (F.coalesce(x.cast(_KIND), none) for x in found)))


#: Fixed values. Labels that open an address block.
_ADDRESS_LABEL = (
    r"(?:head\s*office|headquarters|hq|corporate\s+office|registered\s+office\s+(?:in\s+[a-z]+)?\s*at|registered\s+office|"
    r"registered\s+address|principal\s+office|main\s+office|our\s+address|office\s+address|company\s+address|visiting\s+address|"
    r"postal\s+address|physical\s+address|mailing\s+address|business\s+address|corporate\s+address|address)\s*[:\-]?\s*"
)
#: Fixed values. Words of which each label has one.
_ADDRESS_WORDS = ["office", "headquarters", "hq", "address"]


def address_block(after: Column) -> Column:
    """The address that begins a text: up to six lines, ended by an empty or long line or by what belongs to something else."""
    stops = "(?iu)" + "|".join(rf"\b{p}\b" for p in fixed.ADDRESS_STOPS)
    edge = " \t\r|,;"

    def step(a: Column, raw: Column) -> Column:
        line = strip(raw, edge)
        cut = strip(F.get(F.split(line, stops, 2), F.lit(0)), edge)
        stopped = line.rlike(stops)
        blank = line == ""
        kept = F.when(~a["over"] & (cut != ""), F.array_append(a["lines"], cut)).otherwise(a["lines"])
        over = a["over"] | (blank & (F.size(a["lines"]) > 0)) | (~blank & (stopped | (F.length(cut) > 120) | (F.size(kept) >= 6)))
        return F.struct(over.alias("over"), kept.alias("lines"))

    zero = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("lines"))
    lines = F.aggregate(F.split(F.substring(after, 1, 350), "\n"), zero, step)["lines"]
    return filled(clean_address(clean_text(F.array_join(lines, ", "))))


def from_addresses(pages: DataFrame) -> DataFrame:
    """Candidates of labelled address blocks in the page's text and its footers."""
    category = _any(F.col("url"), ["imprint", "legal", "contact", "company-information", "about", "help"])
    blobs = F.concat(F.array(F.coalesce("clean_text", F.lit(""))), "footer_texts")
    rows = pages.select("site", "batch", "page_ord", "url", category.alias("category"), F.posexplode(blobs).alias("_blob", "_text"))
    rows = rows.where(_has(F.lower("_text"), _ADDRESS_WORDS))
    ahead = F.regexp_extract_all("_text", F.lit(rf"(?is){_ADDRESS_LABEL}(?=(.{{0,350}}))"), F.lit(1))
    rows = unnested(rows.withColumn("_list", ahead), "_hit", "_after")
    # unnested from a list, so that a block is cut out once and not again for each use of it
    rows = rows.select("*", F.explode(F.array_compact(F.array(address_block(F.col("_after"))))).alias("_block"))
    rows = rows.select("*", F.explode(F.array(uk_postcode(F.col("_block")))).alias("_code"))
    spaced = F.concat(F.lit(r"(?is)^(.*?\b\Q"), F.col("_code"), F.lit(r"\E\b)"))
    cut = F.when(F.col("_code").isNotNull(), strip(filled(F.call_function("regexp_extract", F.col("_block"), spaced, F.lit(1))), " ,;"))
    rows = rows.withColumn("_block", F.coalesce(cut, "_block"))
    block, code = F.col("_block"), F.col("_code")
    parts = F.filter(F.transform(F.split(block, ","), lambda x: strip(x)), lambda x: x != "")
    n = F.size(parts)
    city = F.when(n >= 4, F.try_element_at(parts, F.lit(-3))).when(n == 3, F.try_element_at(parts, F.lit(-2)))
    city = strip(F.regexp_replace(city, r"[0-9A-Z]{2,4}\s*[0-9A-Z]{3}", ""))
    city = F.when(~block.rlike(_CITY_STATE_ZIP) & (F.length(city) < 30) & ~city.rlike("[0-9]"), city)
    place = valid_address(block)
    conf = F.when((F.col("category") == "legal") | F.contains("url", F.lit("contact")), "0.95").otherwise("0.80")
    found = F.concat(
        F.array(
            _c("postal_code", code, "address_parser", _said("Postcode in address: ", code), "0.95"),
            _c("country", F.when(code.isNotNull(), fixed.UK), "address_parser", "Derived from UK Postcode", "0.95"),
        ).cast(_KIND),
        us_address(block),
        F.array(
            _c("city", city, "address_parser", _said("City in address: ", city), "0.85"),
            _c("full_address", place, "address_block_parser", _said("Address block: ", place), conf),
        ).cast(_KIND),
    )
    rows = rows.select("site", "batch", "page_ord", "url", "category", "_blob", "_hit", found.alias("_list"))
    rows = unnested(rows, "_at", "c").where("c.value IS NOT NULL")
    # each block has eight candidates at most, and a text of 2 GB less than 2 ** 31 labels
    place = F.shiftleft(F.col("_blob").cast("long"), 35) + F.shiftleft(F.col("_hit").cast("long"), 4) + F.col("_at")
    return rows.select(
        "site", "batch", F.lit(STAGES.index("address")).alias("stage"), "page_ord", place.alias("seq"),
        "url", "category", "c.*",
    )


def capital_names(text: Column) -> Column:
    """Runs of two to four capitalised words, the stand-in for a named-entity model, which can be plugged in instead."""
    return F.regexp_extract_all(text, F.lit(r"\b((?:[A-Z][A-Za-z&]+[ \t]+){1,3}[A-Z][A-Za-z&]+)\b"), F.lit(1))


def from_names(pages: DataFrame, named: DataFrame, names=capital_names) -> DataFrame:
    """Up to three names of each page of sites that have no company name so far (`named` has the sites that do)."""
    pages = pages.join(named.select("site").distinct(), "site", "left_anti")
    found = F.slice(F.array_distinct(names(F.substring("clean_text", 1, 20000))), 1, 3)
    rows = F.transform(found, lambda x: _c("company_name", x, "name_fallback", _said("Name in text: ", x), "0.30"))
    return _rows(pages, "names", F.lit("general"), rows)


def all_candidates(pages: DataFrame, before: DataFrame | None = None, names=capital_names) -> DataFrame:
    """Candidates of all branches over parsed `pages` (site, batch, page_ord, url and the parsed columns), and those `before`,
    of earlier batches: names are looked for in running text of sites that have none from either."""
    branches = [from_json_ld(pages), from_labels(pages), from_text(pages), from_addresses(pages)]
    # written, as the names ask the same branches which sites have one
    found = saved(reduce(DataFrame.unionByName, branches), "branch-candidates")
    if before is not None:
        found = found.unionByName(before)
    return found.unionByName(from_names(pages, found.where("field = 'company_name'"), names))


def kept_candidates(found: DataFrame) -> DataFrame:
    """What later candidates can still be compared with: the best row of each site and field, and of each subsidiary."""
    order = F.struct(F.col("confidence"), *(-F.col(c).cast("long") for c in ("batch", "stage", "page_ord", "seq")))
    one = F.when(F.col("field") == "subsidiaries", F.col("value")).otherwise("")
    best = found.groupBy("site", "field", one.alias("_one")).agg(F.max_by(F.struct(*(c for c in found.columns if c not in ("site", "field"))), order).alias("b"))
    return best.select("site", "field", "b.*").select(found.columns)


def best_candidates(found: DataFrame) -> DataFrame:
    """One row for each (site, field): highest confidence, then earliest by batch, stage, page and place.

    A partial aggregate keeps one row for each task and field; no site's candidates are sorted as a whole.
    """
    order = [F.col("confidence"), *(-F.col(c).cast("long") for c in ("batch", "stage", "page_ord", "seq"))]
    best = F.max_by(F.struct("value", "url", "category", "method", "evidence", "confidence"), F.struct(*order))
    return found.groupBy("site", "field").agg(best.alias("best")).select("site", "field", "best.*")


def profiles(found: DataFrame, sites: DataFrame, kept: bool = False) -> DataFrame:
    """One row for each of `sites` (site, domain): its best values, evidence, completeness and source pages.

    Of candidates that are `kept` (see `kept_candidates`) each is the best of its field, and they are not compared again.
    """
    fields = [
        "company_name", "brand_name", "legal_name", "registration_number", "vat_tax_number", "phone", "email",
        "business_description", "country", "city", "state_province", "postal_code", "full_address", "parent_company",
    ]
    best = found if kept else best_candidates(found)
    single = best.where("field <> 'subsidiaries'").groupBy("site").agg(
        *(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("field", F.struct("value", "url", "category", "method", "evidence", "confidence"))))
        ).alias("evidence"),
        F.collect_set("url").alias("_pages"),
    )
    said = F.struct("value", "url", "category", "method", "evidence", "confidence")
    firsts = found.where("field = 'subsidiaries'").groupBy("site", "value").agg(
        F.min(F.struct(-F.col("confidence"), "batch", "stage", "page_ord", "seq", "url", said.alias("said"))).alias("_first")
    )
    subs = firsts.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("_first", "value"))).alias("_subs")
    ).select(
        "site", F.transform("_subs", lambda x: x["value"]).alias("subsidiaries"),
        F.transform("_subs", lambda x: x["_first"]["url"]).alias("_sub_pages"),
        F.get("_subs", F.lit(0))["_first"]["said"].alias("_sub_said"),
    )
    rows = sites.select("site", "domain").distinct().join(single, "site", "left").join(subs, "site", "left")
    derived = without_suffixes(F.col("legal_name"))
    name = F.coalesce("company_name", derived, "domain")
    method = F.when(F.col("company_name").isNotNull(), "candidate").when(F.col("legal_name").isNotNull(), "legal_name_suffix_strip").otherwise("domain_fallback")
    # what stands behind a derived name, and behind the list of subsidiaries
    kind = "struct<value:string,url:string,category:string,method:string,evidence:string,confidence:decimal(4,2)>"
    from_legal = F.struct(
        name.alias("value"), F.element_at("evidence", F.lit("legal_name"))["url"].alias("url"), F.lit("derived").alias("category"),
        method.alias("method"), F.concat(F.lit("Derived from legal_name: "), "legal_name").alias("evidence"), F.lit("0.70").alias("confidence"),
    ).cast(kind)
    home = F.concat(F.lit("https://"), "domain", F.lit("/"))
    from_domain = F.struct(
        name.alias("value"), home.alias("url"), F.lit("fallback").alias("category"), method.alias("method"),
        F.concat(F.lit("Domain fallback: "), "domain").alias("evidence"), F.lit("0.30").alias("confidence"),
    ).cast(kind)
    derived_said = F.when(method == "legal_name_suffix_strip", from_legal).when(method == "domain_fallback", from_domain)
    listed = F.struct(F.array_join("subsidiaries", ", ").alias("value"), *(F.col("_sub_said")[k].alias(k) for k in ("url", "category", "method", "evidence", "confidence")))
    more = F.array(
        F.when(derived_said.isNotNull(), F.struct(F.lit("company_name").alias("key"), derived_said.alias("value"))),
        F.when(F.col("_sub_said").isNotNull(), F.struct(F.lit("subsidiaries").alias("key"), listed.cast(kind).alias("value"))),
    )
    given = F.coalesce(F.col("evidence"), F.create_map().cast(f"map<string,{kind}>"))
    every = F.map_concat(given, F.map_from_entries(F.filter(more, lambda x: x.isNotNull())))
    rows = rows.withColumn("evidence", every).withColumn("name_method", method).withColumn("company_name", name)
    place = ["full_address", "city", "state_province", "postal_code", "country"]
    some = F.coalesce("full_address", "postal_code", "city", "country").isNotNull()
    count = sum((F.col(f).isNotNull().cast("int") for f in fixed.IMPORTANT_FIELDS[1:]), F.col(fixed.IMPORTANT_FIELDS[0]).isNotNull().cast("int"))
    other = F.coalesce("registration_number", "vat_tax_number", "full_address", "email", "phone").isNotNull()
    known = F.col("legal_name").isNotNull() | (F.col("company_name") != F.col("domain"))
    none = F.array().cast("array<string>")
    return rows.select(
        "site", "domain", *fields, "name_method", F.coalesce("subsidiaries", none).alias("subsidiaries"), "evidence",
        F.when(some, F.struct(*place)).alias("website_address"),
        F.bround(count.cast("decimal(4,3)") / 8, 2).cast("decimal(4,2)").alias("data_completeness"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("_pages", none), F.coalesce("_sub_pages", none)))).alias("source_pages"),
        (known & other).alias("sufficient"),
    )
