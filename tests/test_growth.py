"""Steps whose cost must not gather in one task or grow faster than the tables."""

import random
import re
import time

from pyspark.sql import functions as F

from siteloom.functions import fixed, text
from siteloom.functions.urls import url_score
from siteloom.operators import candidates, jurisdiction, matching
from siteloom.plans import decisions, whole_runs
from siteloom.sources.pages import parse_pages


def customers(spark, path, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{path}/customer.parquet")


def test_customers_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    customers(spark, tmp_path, 20_000)
    assert decisions._cases(spark, str(tmp_path), 3).rdd.getNumPartitions() == 5
    assert whole_runs._companies(spark, str(tmp_path)).rdd.getNumPartitions() == 5
    assert decisions._cases(spark, str(tmp_path), 3).select("k").distinct().count() == 20_000


def test_names_are_searched_by_long_parts(spark, monkeypatch):
    sizes, cut = [], matching._grams
    monkeypatch.setattr(matching, "_grams", lambda text, size: sizes.append(size) or cut(text, size))
    words = ["kesab inc", "kes", "esab", "zz kesab incorporated", "a", "ab inc", "kesab in"]
    registry = spark.createDataFrame([(f"e{i}", f"X {w} {w[::-1]}") for i, w in enumerate(words * 3)], "entity string, name string")
    asked = spark.createDataFrame([(w, w) for w in words], "key string, search_name string")
    got = {(r.key, r.entity) for r in matching.name_search(asked, registry).collect()}
    assert got == {(w, r.entity) for w in words for r in registry.collect() if w.upper() in r.name.upper()}
    assert max(sizes) == 8 and min(sizes) == 1


def test_mails_are_looked_for_around_addresses_only(spark):
    local = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    cues = fixed.EMAIL_EXAMPLE_CUES
    before = "|".join(rf"{re.escape(c)}.{{0,{60 - len(c)}}}" for c in cues)
    after = "|".join(rf".{{0,{60 - len(c)}}}{re.escape(c)}" for c in cues)
    looked_back = lambda c: F.regexp_extract_all(c, F.lit(rf"(?is)(?<!(?:{before}))\b(?>{local}\b)(?!{after})"), F.lit(0))
    words = ["for example", "e.g.", "a@b.co", "x.y+z@mail.example.de", "@", "@.de", "a@b", "noreply@c.org,", "such as " + "y" * 50, "z" * 59, "\n", "Ä@ö.de"]
    pick = random.Random(5)
    texts = [" ".join(pick.choices([*words, *["w" * 40] * 8], k=12)) for _ in range(100)]
    small = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = small.select(candidates.plain_mails(F.col("t")).alias("a"), looked_back(F.col("t")).alias("b")).collect()
    cue = lambda e: any(c in e.lower() for c in cues)
    assert [r.a or [] for r in rows] == [[e for e in r.b if not cue(e)] for r in rows] and sum(len(r.a or []) for r in rows) > 50
    long = spark.range(1).select(F.concat(F.repeat(F.lit("some words of a text "), 20_000), F.lit("a@b.co")).alias("t"))

    def seconds(found):
        start = time.perf_counter()
        assert long.select(F.size(found).alias("n")).head().n == 1
        return time.perf_counter() - start

    seconds(candidates.plain_mails(F.col("t")))
    assert seconds(candidates.plain_mails(F.col("t"))) < seconds(looked_back(F.col("t"))) / 3


def test_every_pattern_is_tried_where_it_matches(spark):
    said = {
        "registration_number": ["Company Reg No: SC311560", "Registration Number: 1234567", "Handelsregisternummer: 12345", "HRB 12345", "hra 12345", "SIREN 123456789", "Siret: 12345678", "Chamber of Commerce No 12345", "CR  No 12345", "Commercial Register No 12345", "registered in England under number: 1234567", "Company Number: 12345678"],
        "vat_tax_number": ["VAT Reg No: GB 123 4567 89", "USt-IdNr.: DE 123456789", "TVA 123456", "Tax ID: 12-3456789", "GSTIN 123456", "ein 12-3456789", "x NL123456789B01"],
        "legal_name": ["OWNED BY ACME LIMITED", "operated by Acme GmbH", "administrators of Acme inc", "Registered name: Acme Ltd", "trading as Acme Ltd", "Licensed by Acme Ltd", "© 2020 Acme S.A.x", "xx Acme Pty Ltd", "Acme Holdings"],
        "phone": ["Call: +44 1358 724924"], "email": ["Mail: me@acme.de", "me@acme.de"], "full_address": ["HQ: 1 High Street, London", "Head  Office: 1 High Street, London"],
    }
    rows = [(f"{f}-{k}", 0, 0, "https://e.org/", f"<p>{t}</p>") for f, some in said.items() for k, t in enumerate(some)]
    pages = parse_pages(spark.createDataFrame(rows, "site string, batch int, page_ord int, url string, html string"))
    found = candidates.from_text(pages).unionByName(candidates.from_addresses(pages))
    got = {(r.site, r.field) for r in found.collect()}
    assert {(s, s.split("-")[0]) for s, *_ in rows} <= got


def test_plans_do_not_repeat_patterns(spark):
    """What several votes read, and the path of a URL, stand in the plan once and not in each use."""
    fields = spark.createDataFrame([("s", "Albany, NY 12207", "+1 212 555 0100")], "site string, full_address string, phone string")
    plan = jurisdiction.signals(fields)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") < 30
    scores = spark.createDataFrame([("https://e.org/team",)], "u string").select(url_score(F.col("u"), F.col("u")).alias("s"))
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("[^?#]*)") == 1


def test_states_and_countries_by_name(spark):
    pick, names = random.Random(3), sorted(fixed.US_STATES, key=lambda n: (-len(n), n))
    words = [*names, *fixed.COUNTRY_ALIASES, "united kingdom", "United States", "arkansas city", "x", "Virginia,", "U.S.A.x", "(NY)", ", TX 75001", "Ohios"]
    texts = [" ".join(pick.choices(words, k=pick.randrange(1, 4))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select(text.state_in_text(F.col("t")).alias("s"), text.country_in_text(F.col("t")).alias("c")).collect()
    for t, r in zip(texts, got):
        state = next((fixed.US_STATES[n] for n in names if re.search(rf"\b{n.lower()}\b", t.lower())), None)
        assert r.s == state if state else r.s in (None, *fixed.US_STATES.values()), t
        given = [n for a, n in fixed.COUNTRY_ALIASES.items() if re.search(rf"\b{re.escape(a)}\b", t.lower())]
        assert r.c == next(iter(given + [n for n in (fixed.UK, fixed.US) if n.lower() in t.lower()]), None), t
