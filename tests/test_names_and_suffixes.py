"""Token-set ratios and edit distances against plain restatements; registered domains by the published rules."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from siteloom.operators import matching, suffixes


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


@lru_cache(None)
def plain_ratio(a, b):
    words = lambda s: set("".join(c if c.isalnum() else " " for c in "".join(c for c in s if ord(c) < 128).lower()).split())
    x, y = words(a), words(b)
    if not x or not y:
        return 0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100
    a_len, b_len = (len(both) + bool(both) + len(s) for s in (left, right))
    best = 100 - 100 * plain_distance(left, right) / (a_len + b_len)
    if both:
        best = max(best, 100 - 100 * (1 + len(left)) / (len(both) + a_len), 100 - 100 * (1 + len(right)) / (len(both) + b_len))
    return int(round(best))


def test_token_set_ratio_of_ten_thousand_pairs(spark):
    rng = random.Random(12)
    stock = ["ACME", "WIDGET", "WIDGETS", "LTD", "INC", "GROUP", "and", "É", "Smith-Jones", "x", "co", "holding", "a" * 40, "b1", "&", "trade", "trades"]
    name = lambda: " ".join(rng.choice(stock) for _ in range(rng.randrange(7)))
    pairs = [(name(), name()) for _ in range(10_000)] + [("", ""), ("a", ""), ("!", "?"), ("A B", "b  a"), ("z" * 200, "y" * 70 + "z" * 70)]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    got = rows.select("a", "b", matching.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got[-2:]] == [None, None]
    assert [(r.a, r.b, r.r) for r in got[:-2]] == [(a, b, plain_ratio(a, b)) for a, b in pairs]


def test_edit_distance_of_any_length(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcé漢 ") for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 5, 63, 64, 65, 130])), text(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select(matching.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [plain_distance(a, b) for a, b in pairs]


def test_words_decide_scores_where_they_are_asked_for(spark):
    pairs = spark.createDataFrame([("Widgets of Acme", "ACME WIDGETS LLC", None, None, None, None, None, None)], "search_name string, current_entity_name string, city string, dos_process_city string, postal_code string, dos_process_zip string, county string, entity_type string")
    by_words, by_sequence = (float(matching.ny_scores(pairs, w).first().score) for w in (True, False))
    assert by_words == round(plain_ratio("WIDGETS OF ACME", "ACME WIDGETS LLC") / 100 * 40, 2) > by_sequence


LIST = """// a comment
com
biz
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
uk
co.uk and what follows is no rule

uk.com
公司.cn
cn
"""
#: Fixed values. Vectors of the published algorithm: host and registered domain.
VECTORS = [
    ("com", None), ("example.com", "example.com"), ("b.example.com", "example.com"), ("a.b.example.com", "example.com"), ("uk.com", None),
    ("example.uk.com", "example.uk.com"), ("a.b.example.uk.com", "example.uk.com"), ("test.ac", None), ("biz", None), ("domain.biz", "domain.biz"),
    ("jp", None), ("test.jp", "test.jp"), ("www.test.jp", "test.jp"), ("ac.jp", None), ("test.ac.jp", "test.ac.jp"), ("kyoto.jp", None),
    ("test.kyoto.jp", "test.kyoto.jp"), ("ide.kyoto.jp", None), ("b.ide.kyoto.jp", "b.ide.kyoto.jp"), ("a.b.ide.kyoto.jp", "b.ide.kyoto.jp"),
    ("c.kobe.jp", None), ("b.c.kobe.jp", "b.c.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"), ("city.kobe.jp", "city.kobe.jp"),
    ("www.city.kobe.jp", "city.kobe.jp"), ("ck", None), ("test.ck", None), ("b.test.ck", "b.test.ck"), ("www.ck", "www.ck"), ("www.www.ck", "www.ck"),
    ("us", None), ("test.us", "test.us"), ("ak.us", None), ("test.ak.us", "test.ak.us"), ("k12.ak.us", None), ("www.test.k12.ak.us", "test.k12.ak.us"),
    ("食狮.公司.cn", "食狮.公司.cn"), ("www.食狮.公司.cn", "食狮.公司.cn"), ("公司.cn", None), ("Example.COM", "example.com"), ("EXAMPLE.co.uk.", "example.co.uk"),
    ("example.com:8080", "example.com"), ("10.0.0.1", None), ("", None), (None, None), (".com", None), ("a..com", None), ("localhost", None),
]


def test_registered_domains_by_the_published_vectors(spark):
    rules = suffixes.suffix_rules(spark.createDataFrame([(x,) for x in LIST.splitlines()], "value string"))
    hosts = spark.createDataFrame([(h,) for h, _ in VECTORS], "host string")
    for small in (100_000, 0):
        got = {r.host: r.domain for r in suffixes.registered_domains(hosts.union(hosts), rules, small).collect()}
        assert got == dict(VECTORS)
    urls = spark.createDataFrame([("https://shop.Example.co.uk/x",), ("https://localhost/",)], "url string")
    assert {r.site for r in suffixes.with_site(urls, rules).collect()} == {"example.co.uk", "localhost"}
