"""Queries over company data: validated values, votes, registry matching, and reports; the tables stand in for registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import text
from siteloom.functions.urls import host_of
from siteloom.operators import candidates, jurisdiction, matching, registry, reports
from siteloom.sources.pages import parse_pages, read_pages
from siteloom.sources.scratch import saved

_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("raw"))
    return found.select("doc_id", text.valid_email(F.col("raw")).alias("email")).where("email IS NOT NULL").groupBy("doc_id", "email").agg(
        F.count(F.lit(1)).alias("n")
    )


def numbers_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones, registration and VAT numbers among the runs of digits of documents."""
    runs = F.regexp_extract_all("text", F.lit(r"\+?[0-9][0-9 .-]{5,20}[0-9]"), F.lit(0))
    found = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(runs).alias("ord", "raw"))
    raw = F.col("raw")
    return found.select(
        "doc_id", "ord", text.valid_phone(raw).alias("phone"), text.valid_registration(raw).alias("registration"), text.valid_vat(raw).alias("vat")
    )


def site_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of all sites from all candidate branches, as cards."""
    pages = parse_pages(read_pages(spark, sf_dir))
    # five branches read the parsed pages; parsing is the only Python step
    pages = saved(pages.withColumns({"site": host_of(F.col("url")), "batch": F.lit(0), "page_ord": F.col("page_id")}), "pages")
    found = saved(candidates.all_candidates(pages), "candidates")
    sites = pages.select("site", F.col("site").alias("domain")).distinct()
    return reports.cards(candidates.profiles(found, sites))


def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies, customers' market segments and names as registry: the 25 first names that contain the searched one."""
    customers = _table(spark, sf_dir, "customer")
    registry_names = customers.select(F.col("c_custkey").cast("string").alias("entity"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    wanted = customers.select(F.col("c_mktsegment").alias("key"), F.left("c_mktsegment", F.lit(4)).alias("search_name")).distinct()
    return matching.name_search(wanted, registry_names).select("key", "entity", "name", "hit_ord")


def registry_top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and second customer of each nation by balance, with the gap between them."""
    rows = _table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("hit_ord"), F.col("c_acctbal").cast("decimal(8,2)").alias("score")
    )
    best = matching.best_and_gap(rows)
    return best.select("key", F.col("hit_ord").alias("best"), "score", "gap", F.size("candidates").cast("long").alias("n_candidates"))


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    rows = registry.latest(orders, "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 3)
    return rows.select("o_custkey", "o_orderkey", F.col("_n").cast("long").alias("n"))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their newest orders as one nested column, reduced to what SQL can compare."""
    orders = registry.latest(_table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 20)
    lists = registry.nested(orders, "o_custkey", {"k": F.col("o_orderkey"), "status": F.col("o_orderstatus")}, "orders")
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    rows = customers.join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce(F.array_join(F.transform("orders", lambda o: o["k"].cast("string")), ","), F.lit("")).alias("order_keys"))


def best_record_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best address of each customer, orders standing in for addresses: type by priority, then the newest."""
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("corpid_num"), F.left("o_orderpriority", F.lit(1)).alias("addr_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"),
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("addr1"), F.lit(None).cast("string").alias("addr2"),
        F.col("o_orderstatus").alias("city"), F.lit("NY").alias("state"), F.lit("1").alias("zip5"), F.lit("").alias("country"), F.lit("n").alias("name"),
    )
    return registry.best_address(orders).select("corpid_num", "address_line_1", "addr_type_label", "country")


def first_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("corpid_num"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status")
    )
    return registry.first_status(rows)


def vote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted votes of event types by user, as signals of a jurisdiction."""
    votes = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("site"), F.col("event_id").alias("ord"), F.lit("country").alias("kind"), F.col("event_type").alias("vote"),
        (F.col("event_id") % 7 / 10).cast("decimal(10,2)").alias("weight"),
    )
    return jurisdiction.winners(votes).select("site", "vote", F.col("score").cast("decimal(20,2)").alias("score"), F.col("total").cast("decimal(20,2)").alias("total"))


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("entry"))
    return reports.latest_by_site(events)


QUERIES = {
    f.__name__: f
    for f in (
        emails_validated, numbers_validated, site_completeness, registry_search, registry_top_gap, latest_records, nested_records,
        best_record_priority, first_status, vote_argmax, history_latest,
    )
}

_REJECTS = "|".join(p.replace(r"\z", "$") for p in text.fixed.EMAIL_REJECTS)

ORACLE_SQL = {
    "emails_validated": rf"""
        SELECT doc_id, email, count(*) AS n
        FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS email FROM documents)
        WHERE regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') AND NOT regexp_matches(email, '{_REJECTS}')
        GROUP BY ALL""",
    "numbers_validated": r"""
        WITH runs AS (SELECT doc_id, regexp_extract_all(text, '\+?[0-9][0-9 .-]{5,20}[0-9]') AS l FROM documents),
        r AS (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS raw FROM runs),
        v AS (SELECT *, regexp_replace(trim(raw), '\s+', ' ', 'g') AS p, trim(raw, ' :.-,#/') AS c FROM r),
        w AS (SELECT *, length(regexp_replace(p, '[^0-9]', '', 'g')) AS n,
                     upper(regexp_extract(c, '(?i)^([A-Z]{0,2}[0-9]{5,8}|[A-Z0-9\-]{4,15})', 1)) AS reg,
                     trim(regexp_extract(c, '(?i)^([A-Z]{0,2}\s*[0-9\s.\-]{6,16})', 1)) AS raw_vat FROM v)
        SELECT doc_id, CAST(ord AS INTEGER) AS ord, CASE WHEN n BETWEEN 7 AND 15 AND length(p) >= 7 THEN p END AS phone,
               CASE WHEN regexp_matches(reg, '[0-9]') THEN reg END AS registration,
               CASE WHEN length(regexp_replace(raw_vat, '[^0-9]', '', 'g')) BETWEEN 6 AND 15
                    THEN trim(upper(regexp_replace(raw_vat, '\s+', ' ', 'g')), ' ,.-') END AS vat
        FROM w""",
    "registry_search": """
        WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, c_mktsegment || ' ' || c_name AS name FROM customer),
        w AS (SELECT DISTINCT c_mktsegment AS key, left(c_mktsegment, 4) AS q FROM customer)
        SELECT key, entity, name, CAST(n AS INTEGER) AS hit_ord FROM (
            SELECT key, entity, name, row_number() OVER (PARTITION BY key ORDER BY name, entity) AS n
            FROM w JOIN r ON contains(upper(name), upper(q))) WHERE n <= 25""",
    "registry_top_gap": """
        WITH r AS (SELECT c_nationkey AS key, c_custkey, CAST(c_acctbal AS DECIMAL(8, 2)) AS score FROM customer),
        n AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next, count(*) OVER (PARTITION BY key) AS c FROM r
              WINDOW w AS (PARTITION BY key ORDER BY score DESC, c_custkey))
        SELECT key, c_custkey AS best, score, CAST(score - coalesce(next, 0) AS DECIMAL(8, 2)) AS gap, least(c, 10) AS n_candidates FROM n WHERE n = 1""",
    "latest_records": """
        SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
        WHERE n <= 3""",
    "nested_records": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
        SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n), '') AS order_keys
        FROM customer LEFT JOIN (SELECT * FROM n WHERE n <= 20) ON c_custkey = o_custkey GROUP BY c_custkey""",
    "best_record_priority": """
        WITH o AS (SELECT o_custkey AS corpid_num, o_orderkey, left(o_orderpriority, 1) AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY corpid_num ORDER BY CASE t WHEN '3' THEN 0 WHEN '1' THEN 1 ELSE 2 END, d DESC, o_orderkey) AS n FROM o)
        SELECT corpid_num, CAST(o_orderkey AS VARCHAR) AS address_line_1,
               CASE t WHEN '3' THEN 'Principal Office' WHEN '1' THEN 'Registered Agent' ELSE 'Type ' || t END AS addr_type_label,
               'United States' AS country FROM n WHERE n = 1""",
    "first_status": """
        SELECT o_custkey AS corpid_num, arg_min(o_orderstatus, o_orderkey) AS company_status FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1""",
    "vote_argmax": """
        WITH v AS (SELECT user_id AS site, event_type AS vote, CAST(event_id % 7 / 10.0 AS DECIMAL(10, 2)) AS w, event_id FROM events),
        s AS (SELECT site, vote, sum(w) AS score, min(event_id) AS first FROM v GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, first) AS n, sum(score) OVER (PARTITION BY site) AS total FROM s)
        SELECT site, vote, CAST(score AS DECIMAL(20, 2)) AS score, CAST(total AS DECIMAL(20, 2)) AS total FROM n WHERE n = 1""",
    "history_latest": """
        SELECT user_id AS site, ts AS at, event_id AS entry FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, user_id LIMIT 20""",
}
