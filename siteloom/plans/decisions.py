"""Queries that take every branch of a decision: companies made from customers, one case of it for each remainder of the key.

Both engines derive the cases from `customer`, so the rows grow with the table; what the cases come to is stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import text
from siteloom.operators import jurisdiction, links, matching, registry
from siteloom.sources.scratch import spread

#: Customers by key, with a word of letters that no other has; n is the length of the word.
_KEYED = """
    SELECT c_custkey AS k, translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS l, length(CAST(c_custkey AS STRING)) AS n
    FROM customer
"""
_FIELDS = ["domain", "company_name", "legal_name", "registration_number", "vat_tax_number", "country", "city", "full_address", "postal_code", "phone"]


def _cases(spark: SparkSession, sf_dir: str, cases: int, **columns: dict[int, str]) -> DataFrame:
    """Keyed customers with `s`, their case, and for each named column an SQL expression by case, null in other cases."""
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    rows = spark.sql(_KEYED.replace("FROM customer", "FROM {customers}"), customers=customers).withColumn("s", F.col("k") % cases)

    def of(by: dict[int, str]):
        out = F.lit(None).cast("string")
        for s, value in by.items():
            out = F.when(F.col("s") == s, F.expr(value).cast("string")).otherwise(out)
        return out

    return rows.select("k", "l", "n", "s", F.concat(F.lit("C"), "k").alias("key"), *(of(by).alias(name) for name, by in columns.items()))


def _websites(spark: SparkSession, sf_dir: str, cases: int, **columns: dict[int, str]) -> DataFrame:
    return _cases(spark, sf_dir, cases, **{f: columns.get(f, {}) for f in _FIELDS})


_STRINGS = [
    "'AB' || (10 + k % 80) || ' ' || k % 10 || 'BX, UK'", "'ab' || (10 + k % 80) || k % 10 || 'bx'", "'G' || k % 10 || ' ' || (k % 7) || 'BP'", "CAST(90000 + k % 1000 AS STRING)",
    "'contact us on day ' || l", "'in England or ' || l", "'Albany, NY ' || (10000 + k % 1000)", "'Fresno, CA ' || (93000 + k % 1000)", "'West Virginia ' || l",
    "'+1 ' || (200 + k % 20) || ' 555 0100'", "'0044 20 7946 ' || lpad(CAST(k % 10000 AS STRING), 4, '0')", "'nordvik' || l || '.co.uk'", "l || '.de/y'",
    "'Nordvik ' || l || ' Holdings, Inc.'", "'Nordvik  ' || l || ' Limited ,;'", "'SC' || (10000 + k % 1000)", "CAST(1000 + k % 9000 AS STRING)",
    "(1 + k % 90) || ' Orchard Street, London'", "'all rights reserved ' || (2000 + k % 30)", "'plain words ' || l",
]
_STRING_SQL = "CASE k % 20 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_STRINGS)) + " END"


def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar function over strings of twenty kinds."""
    s = F.col("s")
    rows = _cases(spark, sf_dir, 20).select("k", F.expr(_STRING_SQL).alias("s"))
    return rows.select(
        "k", "s", text.uk_postcode(s).alias("postcode"), text.country_in_text(s).alias("country"), text.ny_phone(s).alias("ny_phone"),
        text.country_of_host(s).alias("host_country"), text.clean_text(s).alias("clean"), text.company_number(s).alias("number"),
        text.valid_address(s).alias("address"), text.comparable_name(s, [(r"\bLIMITED\b", "LTD")]).alias("comparable"),
    )


def jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, confidence and route of companies of which ever other fields are known."""
    rows = _websites(
        spark, sf_dir, 13, company_name={0: "'Nordvik ' || l", 2: "'Nordvik ' || l"}, registration_number={0: "'SC' || (300000 + k % 1000)", 1: "CAST(10000000 + k AS STRING)"},
        domain={0: "'nordvik' || l || '.com'", 2: "'nordvik' || l || '.co.uk'", 5: "'nordvik' || l || '.de'"}, postal_code={2: "'SW1A 1AA'", 3: "'M1 1AA'", 6: "'10118'", 7: "'10004'"},
        city={2: "'London'", 6: "'New York'", 7: "'New York'"}, company_number={}, country={8: "'United States'", 9: "'United States'", 10: "'usa'"},
        full_address={6: "'9 Elm Avenue, New York, NY 10118'", 8: "'9 Elm Avenue, New York, NY 10118'", 9: "'1 Palm Blvd, Los Angeles, CA 90028'"},
        phone={11: "'+1 212 555 0100'"}, vat_tax_number={12: "'GB 123 4567 89'"},
    )
    found = jurisdiction.jurisdictions(rows.select("key", *_FIELDS), "key")
    route = jurisdiction.registry_route(F.col("country"), F.col("state_abbr"))
    return found.select("key", "country", "state_abbr", F.col("confidence").cast("double").alias("confidence"), route.alias("route"))


_ADDRESS = "struct<address_line_1:string,address_line_2:string,locality:string,region:string,postal_code:string,country:string>"
_TWO = "'Ard' || l || ' and Bex' || l || ' Limited'"


def uk_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way to resolve a UK company: by number, by exact name, by score, and not."""
    named = "'Nordvik ' || l || ' Limited'"
    sites = _websites(
        spark, sf_dir, 9, registration_number={0: "CAST(k AS STRING)", 1: "CAST(k AS STRING)"},
        company_name={0: named, 1: named, 2: named, 3: named, 4: _TWO, 5: _TWO, 6: named, 8: named},
        domain={2: "'nordvik.co.uk'", 3: "'nordvik.co.uk'", 5: "'bex' || l || '.co.uk'"}, postal_code={2: "'SW1A 1AA'", 3: "'M1 1AA'", 5: "'EX1 1AA'"},
        city={2: "'London'", 5: "'Exeter'"}, full_address={8: "'Unit 4, Leeds LS1 4AB'"},
    )

    def hit(s: int, ord_: int, number: str, title: str, status: str, town: str | None = None, code: str | None = None) -> DataFrame:
        at = F.struct(F.lit(None), F.lit(None), F.lit(town), F.lit(None), F.lit(code), F.lit(None)).cast(_ADDRESS)
        return sites.where(F.col("s") == s).select(
            F.col("company_name").alias("query"), F.lit(ord_).alias("hit_ord"), F.expr(number).alias("company_number"), F.upper(F.expr(title)).alias("title"),
            F.lit(status).alias("company_status"), at.alias("address"),
        )

    pair = "'Ard' || l || ' Bex' || l || ' Limited'"
    hits = [
        hit(2, 0, "'A' || k", named, "active", "London", "SW1A 1AA"), hit(2, 1, "'B' || k", "'Nordvik ' || l || ' Limited North'", "dissolved"),
        hit(3, 0, "'A' || k", named, "active", None, "M1 1AB"), hit(3, 1, "'B' || k", named, "active", None, "M1 1AC"),
        hit(4, 0, "'A' || k", pair, "dissolved"), hit(5, 0, "'A' || k", pair, "dissolved", "Exeter", "EX1 1AA"),
        hit(8, 0, "'A' || k", named, "in administration", "Leeds", "LS1 4ZZ"),
    ]
    search = hits[0]
    for more in hits[1:]:
        search = search.union(more)
    profiles = sites.where("s = 0").select(F.lpad(F.col("k").cast("string"), 8, "0").alias("company_number"), F.upper("company_name").alias("company_name"))
    found = matching.resolve_uk(sites.select("key", *_FIELDS), search, profiles)
    parts = F.array_join(
        F.transform("candidates", lambda c: F.concat_ws(":", c["company_number"], *(c["detail"][p].cast("string") for p in ("postcode", "address", "domain", "active")))), " "
    )
    return found.select(
        "key", "status", "company_number", "method", *(F.col(c).cast("double").alias(c) for c in ("confidence", "score", "gap")), F.coalesce(parts, F.lit("")).alias("parts")
    )


def ny_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way to resolve a New York company: alone, among equals, by the only ZIP, by borough, and not."""
    named = "'Kes' || l || ' Inc'"
    sites = _websites(
        spark, sf_dir, 7, company_name={s: named for s in (0, 1, 2, 3, 4, 6)}, city={0: "'New York'", 1: "'New York'", 2: "'New York'", 6: "'Brooklyn'"},
        postal_code={0: "'10118'", 1: "'10004'", 2: "'10118'", 6: "'11201'"},
    )

    def entity(s: int, number: str, name: str, city: str | None, code: str | None, county: str | None, kind: str | None = "CORPORATION") -> DataFrame:
        values = {"entity_type": kind, "county": county, "dos_process_city": city, "dos_process_zip": code}
        return sites.where(F.col("s") == s).select(
            F.expr(number).alias("dos_id"), F.upper(F.expr(name)).alias("current_entity_name"), *(F.lit(v).cast("string").alias(n) for n, v in values.items())
        )

    rows = [
        entity(0, "'A' || k", named, "New York", "10118", "New York"), entity(1, "'A' || k", named, "New York", "10004", "New York"),
        entity(1, "'B' || k", named, "New York", "10004", "New York"), entity(2, "'A' || k", named, "New York", "10199", "New York"),
        entity(2, "'B' || k", f"{named} || ' West'", "Albany", "10118", "Albany"), entity(3, "'A' || k", f"{named} || ' of Many Other Words'", None, None, None, None),
        entity(6, "'A' || k", named, "Brooklyn Heights", "11299", "Kings"),
    ]
    entities = rows[0]
    for more in rows[1:]:
        entities = entities.union(more)
    found = matching.resolve_ny(sites.select("key", *_FIELDS), entities)
    ids = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["dos_id"], c["score"].cast("string"))), " ")
    return found.select("key", "status", "matched", "dos_id", *(F.col(c).cast("double").alias(c) for c in ("confidence", "score", "gap")), F.coalesce(ids, F.lit("")).alias("candidates"))


def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names whose likeness lies between none and all."""
    rows = _cases(
        spark, sf_dir, 4, a={0: "upper('Ard' || l || ' and Bex' || l || ' Ltd')", 1: "upper(l)", 2: "'abcd'", 3: "''"},
        b={0: "upper('Ard' || l || ' Bex' || l || ' Ltd')", 1: "upper(l)", 2: "'bcde' || CAST(k AS STRING)", 3: "l"},
    )
    return rows.select("k", "a", "b", F.round(matching.similarity(F.col("a"), F.col("b")), 4).alias("ratio"))


def name_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness by words of the names of parts and of those that stand for their suppliers, wherever lines name both."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    parts = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat_ws(" ", F.lower("p_type"), F.lit("of"), "p_name").alias("b"))
    pairs = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    pairs = pairs.join(parts.select(F.col("p_partkey").alias("l_partkey"), "a"), "l_partkey").join(parts.select(F.col("p_partkey").alias("l_suppkey"), "b"), "l_suppkey")
    # names repeat, so each pair of them is compared once
    pairs = pairs.groupBy("a", "b").agg(F.sum("n_lines").alias("n_lines"))
    return pairs.select("a", "b", "n_lines", matching.token_set_ratio(F.col("a"), F.col("b")).alias("ratio"))


def wiki_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of articles with markup, links, templates and keys that overwrite others, or without an infobox."""
    body = (
        "'{{short description|x}}\\n{{Infobox company\\n| name = ''''''Nordvik''''''  ' || l || '<ref>a b</ref>\\n| type = [[Public company|Public]]\\n"
        "| industry = [[Tools ' || l || ']]\\n| location = London\\n| headquarters = {{flag|UK}} Leeds\\n| website = {{URL|https://' || l || '.example}}\\n}}'"
    )
    rows = _cases(spark, sf_dir, 3).select(F.concat(F.lit("Nordvik "), "l").alias("title"), F.when(F.col("s") < 2, F.expr(body.replace("''''''", "\\'\\'\\'"))).otherwise("no infobox of note").alias("wikitext"))
    return registry.infobox_fields(rows)


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each company's host that its robots file allows; a host in four has none."""
    rows = _cases(spark, sf_dir, 4).select("s", F.concat("l", F.lit(".example")).alias("host"))
    whole = "# all\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # x\nAllow: /private/open\nSitemap: https://h.example/map.xml"
    first = "User-agent: *\nAllow: /private/open\nDisallow: /private\n"
    robots = rows.where("s > 0").select("host", F.when(F.col("s") == 1, whole).when(F.col("s") == 2, first).otherwise("User-agent: other\nDisallow: /").alias("body"))
    paths = F.explode(F.array(*map(F.lit, ("/", "/private/x", "/private/open/y", "/public"))))
    urls = rows.select("host", paths.alias("path")).select(F.concat(F.lit("https://"), "host", "path").alias("url"))
    return links.allowed(urls, links.robots_rules(robots))


QUERIES = {
    f.__name__: f for f in (scalar_vectors, jurisdictions, uk_resolution, ny_resolution, sequence_similarity, name_likeness, wiki_infobox, robots_allowed)
}

_UK_PC = r"regexp_extract(upper(regexp_replace(trim(s), '\s+', ' ', 'g')), '\b([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b', 1)"
_ALIASES = " ".join(
    rf"WHEN regexp_matches(lower(s), '\b{alias.replace('.', chr(92) + '.')}\b') THEN '{name}'" for alias, name in text.fixed.COUNTRY_ALIASES.items()
)
_ENDINGS = " ".join(f"WHEN h LIKE '%{e}' THEN '{n}'" for e, n in text.fixed.COUNTRY_ENDINGS.items())
_RATIO = "(2 * (11 + 2 * n)) / (26.0 + 4 * n)"

ORACLE_SQL = {
    "scalar_vectors": rf"""
        WITH v AS (SELECT *, lower(s) AS l, split_part(split_part(lower(s), '/', 1), '?', 1) AS h, regexp_replace(s, '[^0-9]', '', 'g') AS d,
                          trim(regexp_replace(trim(s, ' ,;-'), '\s+', ' ', 'g')) AS a, upper(regexp_replace(s, '\s+', '', 'g')) AS num,
                          replace({_UK_PC}, ' ', '') AS pc FROM (SELECT k, {_STRING_SQL} AS s FROM ({_KEYED})))
        SELECT k, s, CASE WHEN pc <> '' THEN pc[:-4] || ' ' || pc[-3:] END AS postcode,
               CASE {_ALIASES} WHEN contains(l, 'united kingdom') THEN 'United Kingdom' WHEN contains(l, 'united states') THEN 'United States' END AS country,
               coalesce(CASE WHEN d LIKE '1%' AND length(d) >= 4 THEN d[2:4] WHEN length(d) >= 3 THEN d[1:3] END
                        IN ({", ".join(f"'{c}'" for c in text.fixed.NY_AREA_CODES)}), FALSE) AS ny_phone,
               CASE {_ENDINGS} END AS host_country, nullif(trim(regexp_replace(s, '\s+', ' ', 'g'), ' ,;'), '') AS clean,
               CASE WHEN regexp_matches(num, '^(SC|NI|OC|LP|SO|IP|SL|NC|NL|NZ)[0-9]+$') THEN num[1:2] || CASE WHEN length(num) >= 8 THEN num[3:] ELSE lpad(num[3:], 6, '0') END
                    WHEN regexp_matches(num, '^[0-9]+$') THEN CASE WHEN length(num) >= 8 THEN num ELSE lpad(num, 8, '0') END ELSE num END AS number,
               CASE WHEN length(a) BETWEEN 10 AND 300 AND (regexp_matches(a, '[0-9]') OR regexp_matches(a, '(?i)\b({text.fixed.STREET_WORDS})\b'))
                     AND NOT regexp_matches(a, '(?i)\b({text.fixed.ADDRESS_BOILERPLATE})\b') THEN a END AS address,
               trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(s)), '[^\w\s]', ' ', 'g'), '\bLIMITED\b', 'LTD', 'g'), '\s+', ' ', 'g')) AS comparable
        FROM v""",
    "jurisdictions": f"""
        SELECT 'C' || k AS key, country, state_abbr, CAST(confidence AS DOUBLE) AS confidence, route
        FROM ({_KEYED}) JOIN (VALUES
            (0, 'United Kingdom', NULL, 1.0, 'uk'), (1, 'United Kingdom', NULL, 0.715, 'uk'), (2, 'United Kingdom', NULL, 1.0, 'uk'),
            (3, 'United Kingdom', NULL, 0.91, 'uk'), (4, NULL, NULL, 0.0, 'no_jurisdiction'), (5, 'Germany', NULL, 0.715, 'unsupported'),
            (6, 'United States', 'NY', 1.0, 'ny'), (7, 'United States', 'NY', 1.0, 'ny'), (8, 'United States', 'NY', 1.0, 'ny'),
            (9, 'United States', 'CA', 1.0, 'unsupported'), (10, 'United States', NULL, 0.91, 'state_required'),
            (11, NULL, NULL, 0.0, 'no_jurisdiction'), (12, 'United Kingdom', NULL, 0.78, 'uk')
        ) t(s, country, state_abbr, confidence, route) ON s = k % 13""",
    "uk_resolution": f"""
        SELECT 'C' || k AS key,
               CASE k % 9 WHEN 0 THEN 'resolved_direct' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'unresolved' WHEN 7 THEN 'skipped'
                    WHEN 1 THEN 'not_found' WHEN 6 THEN 'not_found' ELSE 'resolved' END AS status,
               CASE WHEN k % 9 IN (0, 1) THEN lpad(CAST(k AS VARCHAR), 8, '0') WHEN k % 9 IN (2, 5, 8) THEN 'A' || k END AS company_number,
               CASE k % 9 WHEN 0 THEN 'registration_number' WHEN 2 THEN 'exact_name_verified' WHEN 5 THEN 'name_search_scored' WHEN 8 THEN 'exact_name_verified' END AS method,
               CASE k % 9 WHEN 0 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.7 WHEN 4 THEN round(round(40 * {_RATIO}, 2) / 100, 4)
                    WHEN 5 THEN round(round(40 * {_RATIO} + 50, 2) / 100, 4) WHEN 8 THEN 0.95 END AS confidence,
               CASE k % 9 WHEN 2 THEN 100.0 WHEN 3 THEN 70.0 WHEN 4 THEN round(40 * {_RATIO}, 2) WHEN 5 THEN round(40 * {_RATIO} + 50, 2) WHEN 8 THEN 68.0 END AS score,
               CASE k % 9 WHEN 2 THEN 50.0 WHEN 3 THEN 0.0 WHEN 4 THEN round(40 * {_RATIO}, 2) WHEN 5 THEN round(40 * {_RATIO} + 50, 2) WHEN 8 THEN 68.0 END AS gap,
               CASE k % 9 WHEN 2 THEN 'A' || k || ':25.00:15.00:10.00:10.00 B' || k || ':0.00:0.00:10.00:0.00'
                    WHEN 3 THEN 'A' || k || ':10.00:0.00:10.00:10.00 B' || k || ':10.00:0.00:10.00:10.00' WHEN 4 THEN 'A' || k || ':0.00:0.00:0.00:0.00'
                    WHEN 5 THEN 'A' || k || ':25.00:15.00:10.00:0.00' WHEN 8 THEN 'A' || k || ':10.00:8.00:0.00:10.00' ELSE '' END AS parts
        FROM ({_KEYED})""",
    "ny_resolution": f"""
        SELECT 'C' || k AS key, status, status = 'resolved' AS matched, CASE WHEN status IN ('resolved', 'ambiguous') THEN pick || k END AS dos_id,
               CAST(confidence AS DOUBLE) AS confidence, CAST(score AS DOUBLE) AS score, CAST(gap AS DOUBLE) AS gap, replace(listed, '#', CAST(k AS VARCHAR)) AS candidates
        FROM ({_KEYED}) JOIN (VALUES
            (0, 'resolved', 'A', 1.0, 100, 100, 'A#:100.00'), (1, 'ambiguous', 'A', 1.0, 100, 0, 'A#:100.00 B#:100.00'), (2, 'resolved', 'B', 0.8, 70, 15, 'A#:83.00 B#:70.00'),
            (3, 'unresolved', NULL, 0.35, 35, 35, 'A#:35.00'), (4, 'not_found', NULL, NULL, NULL, NULL, ''), (5, 'skipped', NULL, NULL, NULL, NULL, ''),
            (6, 'resolved', 'A', 0.88, 78, 78, 'A#:78.00')
        ) t(s, status, pick, confidence, score, gap, listed) ON s = k % 7""",
    "sequence_similarity": f"""
        SELECT k, CASE k % 4 WHEN 0 THEN upper('Ard' || l || ' and Bex' || l || ' Ltd') WHEN 1 THEN upper(l) WHEN 2 THEN 'abcd' ELSE '' END AS a,
               CASE k % 4 WHEN 0 THEN upper('Ard' || l || ' Bex' || l || ' Ltd') WHEN 1 THEN upper(l) WHEN 2 THEN 'bcde' || k ELSE l END AS b,
               CASE k % 4 WHEN 0 THEN round({_RATIO}, 4) WHEN 1 THEN 1.0 WHEN 2 THEN round(6 / (8.0 + n), 4) ELSE 0.0 END AS ratio
        FROM ({_KEYED})""",
    "name_likeness": """
        WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS a, lower(p_type) || ' of ' || p_name AS b FROM part),
        pairs AS (SELECT x.a, y.b, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem JOIN p AS x ON l_partkey = x.p_partkey JOIN p AS y ON l_suppkey = y.p_partkey GROUP BY ALL),
        w AS (SELECT *, list_sort(list_distinct(string_split(lower(a), ' '))) AS l, list_sort(list_distinct(string_split(lower(b), ' '))) AS r FROM pairs),
        s AS (SELECT *, array_to_string(list_filter(l, lambda t: list_contains(r, t)), ' ') AS common,
                     array_to_string(list_filter(l, lambda t: NOT list_contains(r, t)), ' ') AS x, array_to_string(list_filter(r, lambda t: NOT list_contains(l, t)), ' ') AS y FROM w),
        -- longest common subsequence by rows of the usual table; the first entry of a step is the character's code
        d AS (SELECT *, length(x) + length(y) - 2 * CASE WHEN x = '' OR y = '' THEN 0 ELSE list_reduce(
                  list_prepend(list_transform(range(length(y) + 1), lambda i: CAST(0 AS BIGINT)), list_transform(string_split(x, ''), lambda c: [CAST(ord(c) AS BIGINT)])),
                  lambda prev, c: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(y) + 1), lambda j: [j])),
                      lambda row, j: list_append(row, greatest(row[len(row)], prev[j[1] + 1], CASE WHEN ord(y[j[1]]) = c[1] THEN prev[j[1]] + 1 ELSE 0 END))))[-1] END AS dist
              FROM s),
        g AS (SELECT *, length(common) AS n, CASE WHEN common <> '' THEN 1 ELSE 0 END AS gap FROM d)
        SELECT a, b, n_lines, CAST(CASE WHEN n > 0 AND (x = '' OR y = '') THEN 100
                   WHEN n > 0 THEN round_even(greatest(100.0 - 100.0 * dist / (2 * (n + gap) + length(x) + length(y)),
                        100.0 - 100.0 * (gap + length(x)) / (2 * n + gap + length(x)), 100.0 - 100.0 * (gap + length(y)) / (2 * n + gap + length(y))), 0)
                   ELSE round_even(100.0 - 100.0 * dist / (length(x) + length(y)), 0) END AS INT) AS ratio
        FROM g""",
    "wiki_infobox": f"""
        SELECT 'Nordvik ' || l AS title, field, replace(value, '#', l) AS value FROM ({_KEYED}) CROSS JOIN (VALUES
            ('legal_name', 'Nordvik #'), ('company_type', 'Public'), ('industry', 'Tools #'), ('full_address', 'Leeds'), ('website', 'https://#.example')) t(field, value)
        WHERE k % 3 < 2""",
    "robots_allowed": f"""
        SELECT 'https://' || l || '.example' || path AS url FROM ({_KEYED}) CROSS JOIN (VALUES ('/'), ('/private/x'), ('/private/open/y'), ('/public')) t(path)
        WHERE k % 4 IN (0, 3) OR path NOT LIKE '/private%' OR (k % 4 = 2 AND path LIKE '/private/open%')""",
}
