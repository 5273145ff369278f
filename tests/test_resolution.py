"""Name search, verified articles, evidence of derived values, routing without registries, linear pages."""

import random
import time

from pyspark.sql import functions as F

from siteloom.operators import candidates, matching, registry, resolution
from siteloom.sources.pages import json_ld_nodes, parse_page


def test_name_search_finds_every_containing_name(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice(["a", "B ", "cd", "É", "  x", "Ltd"]) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    wanted = ["a", "B", "AB", "b cd", "cdcd", " x", "É", "ltd", "zzz", "", "   ", "B B B"] + [n[1:4] for n in names[:20]]
    registry_rows = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "entity string, name string")
    companies = spark.createDataFrame([(f"k{i}", w) for i, w in enumerate(wanted)] + [("null", None)], "key string, search_name string")
    got = {}
    for r in matching.name_search(companies, registry_rows, 1000).collect():
        got.setdefault(r.key, []).append((r.hit_ord, r.name, r.entity))
    for i, w in enumerate(wanted):
        u = w.strip().upper()
        hits = sorted((n, str(e)) for e, n in enumerate(names) if u and u in n.upper())
        assert [(n, e) for _, n, e in sorted(got.get(f"k{i}", []))] == hits, w
    few = matching.name_search(companies, registry_rows, 2).groupBy("key").count().agg(F.max("count")).first()[0]
    assert few == 2


def test_evidence_of_derived_names_and_subsidiaries(spark):
    kinds = "site string, batch int, stage int, page_ord int, seq int, url string, category string, field string, value string, method string, evidence string, confidence decimal(4,2)"
    found = spark.createDataFrame([], kinds)
    rows = [("a", "legal_name", "X Holdings, Inc.", "0.85"), ("a", "subsidiaries", "S1", "0.90"), ("a", "subsidiaries", "S2", "0.95"), ("a", "subsidiaries", "S1", "0.95"), ("c", "company_name", "C", "0.65")]
    plain = spark.createDataFrame([(s, 0, 0, 0, k, f"u{k}", "general", f, v, "m", "e", c) for k, (s, f, v, c) in enumerate(rows)], kinds.replace("decimal(4,2)", "string"))
    found = found.union(plain.withColumn("confidence", F.col("confidence").cast("decimal(4,2)")))
    got = {r.site: r for r in candidates.profiles(found, spark.createDataFrame([(s, f"{s}.com") for s in "abc"], "site string, domain string")).collect()}
    a, b, c = (got[s].evidence for s in "abc")
    assert got["a"].company_name == "X" and a["company_name"].method == "legal_name_suffix_strip" and float(a["company_name"].confidence) == 0.7
    assert a["company_name"].url == "u0" and a["company_name"].evidence == "Derived from legal_name: X Holdings, Inc."
    assert got["a"].subsidiaries == ["S2", "S1"] and a["subsidiaries"].value == "S2, S1" and a["subsidiaries"].url == "u2"
    assert got["b"].company_name == "b.com" and b["company_name"].method == "domain_fallback" and float(b["company_name"].confidence) == 0.3
    assert c["company_name"].method == "m" and "subsidiaries" not in c


def test_routes_without_registries(spark):
    names = ["domain", "company_name", "legal_name", "registration_number", "postal_code", "full_address", "city"]
    companies = spark.createDataFrame([(k, *[None] * 7) for k in "abcde"], ", ".join(f"{c} string" for c in ["key", *names]))
    found = [("a", "United Kingdom", None), ("b", "United States", "NY"), ("c", "United States", None), ("d", "France", None), ("e", None, None)]
    found = spark.createDataFrame(found, "key string, country string, state_abbr string")
    got = {r.key: (r.registry_type, r.registry_status, r.matched) for r in resolution.resolved_companies(companies, found, None, None).collect()}
    assert got == {
        "a": ("companies_house", "unavailable", False), "b": ("ny_dos", "unavailable", False), "c": ("unsupported", "state_required", False),
        "d": ("unsupported", "unsupported", False), "e": ("no_jurisdiction", "no_jurisdiction", False),
    }


def test_articles_are_verified_by_site_or_links(spark):
    brands = spark.createDataFrame([("A", "a.co.uk"), ("B", "b.com"), ("C", "c.com"), ("D", "d.com")], "brand string, domain string")
    hits = spark.createDataFrame([(x, 0, x, "") for x in "ABCD"], "query string, hit_ord int, title string, snippet string")
    box = lambda site: "{{Infobox company\n| name = N\n" + site + "}}"
    texts = [("A", box("| website = https://www.a.co.uk/x\n")), ("B", box("")), ("C", box("| website = c.org\n")), ("D", "no box")]
    outside = spark.createDataFrame([("B", "http://shop.b.com/1"), ("B", "http://b.com"), ("C", "http://x.org")], "title string, link string")
    got = {r.brand: (r.website, r.domain_match) for r in registry.verified_articles(brands, hits, spark.createDataFrame(texts, "title string, wikitext string"), outside).collect()}
    assert got == {"A": ("https://www.a.co.uk/x", True), "B": ("b.com", True), "C": ("c.org", False)}


def test_json_ld_at_any_depth(spark):
    deep = '[[{"@graph":[[{"@type":"Organization","name":"deep"}],{"@graph":[{"name":"deeper"}]}]}]]'
    blocks = "".join(f"<script type='application/ld+json'>{x}</script>" for x in (deep, "broken", '{"name":"flat"}', "[" * 5000))
    rows = json_ld_nodes(spark.createDataFrame([(1, parse_page(blocks)["json_ld"])], "page int, json_ld array<string>"))
    assert {r.n for r in rows.select(F.try_variant_get("node", "$.name", "string").alias("n")).collect()} == {"deep", "deeper", "flat"}


def test_pages_parse_in_time_in_proportion():
    start = time.process_time()
    for unit in ("<div>x", "<table><tr><td>a<td>b", "<div class=footer>x", "<div class=label>x<div class=value>y", "<p>x ", "<dl><dt>a<dd>b", "<a href=mailto:x@y.z>"):
        parse_page(unit * (200_000 // len(unit)))
    assert time.process_time() - start < 15


def test_page_columns():
    page = (
        "<title>T</title><h1>Head</h1><p>A paragraph of some length.<p>Another one, also long enough.</p></p><table><tr><th>Key</th><td>Value</td></tr>"
        "<tr><td>x</td></tr></table><dl><dt>a</dt><dd>b</dd></dl><div class='item'><span class=label>L</span><b class=value>V</b></div>"
        "<footer class=footer>Footer text that is long</footer><span data-cfemail='4313262c332f2603'>gone</span><a href='mailto:A@b.co?x'>m</a>"
        "<script type='application/ld+json'> {\"a\":1} </script>"
    )
    got = parse_page(page)
    assert got["title"] == "T" and got["headings"] == [{"tag": "h1", "text": "Head"}] and got["tables_kv"] == [{"Key": "Value"}]
    assert got["paragraphs"][0] == "A paragraph of some length." and got["div_kv"] == [{"a": "b", "L": "V"}]
    assert got["footer_texts"] == ["Footer text that is long"] and got["mailto"] == ["A@b.co"] and got["json_ld"] == ['{"a": 1}']
    assert "gone" not in got["clean_text"]
