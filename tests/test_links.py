"""Robots rules against the standard parser, links against the way without patterns, discovery under caps."""

import gzip
import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from siteloom.functions import urls
from siteloom.operators import links

LINES = [
    "User-agent: *", "User-agent: mozilla", "user-agent: Other/2", "User-Agent: Mozilla/5.0", "Disallow: /a", "Allow: /a/b", "Disallow:", "Allow: /",
    "Disallow: /a%20b", "disallow: /x?q=1", "Crawl-delay: 3", "# note", "", "", "Sitemap: https://h.example/m.xml", "Disallow: *", "nonsense", "Allow: /c # d",
]


@pytest.mark.parametrize("agent", ["*", links.AGENT, "other/1"])
def test_robots_rules_equal_the_standard_parser(spark, agent):
    rng = random.Random(3)
    bodies = {f"h{k}.example": "\n".join(rng.choice(LINES) for _ in range(rng.randrange(12))) for k in range(120)}
    paths = ["", "/", "/a", "/a/b/c", "/a b", "/a%20b/c", "/x?q=1&r", "/c", "/zz"]
    robots = spark.createDataFrame(list(bodies.items()), "host string, body string")
    asked = [f"https://{h}{p}" for h in bodies for p in paths] + ["https://unlisted.example/a"]
    got = {r.url for r in links.allowed(spark.createDataFrame([(u,) for u in asked], "url string"), links.robots_rules(robots, agent)).collect()}
    expected = {"https://unlisted.example/a"}
    for host, body in bodies.items():
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        expected |= {f"https://{host}{p}" for p in paths if parser.can_fetch(agent, f"https://{host}{p}")}
    assert got == expected


def test_canonical_links_by_pattern_equal_the_long_way(spark):
    rng = random.Random(5)
    bits = ["https://", "http://", "HTTP://", "h.ex", "E.com:80", "/", "//", "a", "B", "..", ".", "%20", "é", "?", "x=1", "&utm_source=q", "#f", " ", ".pdf", ".html", ":", "mailto:"]
    rows = [(rng.choice(["https://h.ex/a/b", "https://h.ex", "http://H.ex/x?y=1", "https://h.ex:8/q/"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6)))) for _ in range(4000)]
    rows += [("https://h.ex/a", None), ("https://h.ex/a", ""), ("https://h.ex/a", "/p/"), ("https://h.ex/a", "https://h.ex//")]
    d = spark.createDataFrame(rows, "base string, link string")
    both = d.select("base", "link", urls.canonical_url(F.col("base"), F.col("link")).alias("a"), urls._canonical_any(F.col("base"), F.col("link")).alias("b"))
    assert both.where("NOT a <=> b").collect() == []


def test_sitemap_roots(spark):
    rules = spark.createDataFrame([("s.ex", 0, False, "/p0"), ("s.ex", 1, None, "https://s.ex/m.xml")], "host string, ord int, allow boolean, path string")
    sites = spark.createDataFrame([("s.ex", "https://s.ex/")], "site string, start string")
    roots = links.sitemap_roots(sites, rules).orderBy("ord").collect()
    assert [r.url for r in roots] == ["https://s.ex/m.xml", "https://s.ex/sitemap.xml", "https://s.ex/sitemap_index.xml", "https://s.ex/sitemap/sitemap.xml"]


def test_zipped_sitemaps(spark):
    raw = [("a", bytearray(gzip.compress(b"<urlset/>"))), ("b", bytearray(b"<plain/>")), ("c", bytearray(b"\x1f\x8bbroken")), ("d", None)]
    got = {r.url: r.body for r in links.unzipped(spark.createDataFrame(raw, "url string, content binary")).collect()}
    assert got == {"a": "<urlset/>", "b": "<plain/>", "c": None, "d": None}
