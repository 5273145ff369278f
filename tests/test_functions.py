import pytest
from pyspark.sql import functions as F

from siteloom.functions import text, urls


def one(spark, f, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(f(*(F.col(c) for c in row.columns))).head()[0]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.valid_email, "People@brewdog.com", "people@brewdog.com"),
        (text.valid_email, "test@test.com", None),
        (text.valid_email, "x@mail5.example.com", "x@mail5.example.com"),
        (text.valid_email, None, None),
        (text.uk_postcode, "ab418bx", "AB41 8BX"),
        (text.uk_postcode, "90210", None),
        (text.valid_vat, "GB 897 6381 54", "GB 897 6381 54"),
        (text.valid_vat, "123", None),
        (text.valid_registration, "123456789", "12345678"),
        (text.valid_registration, "words", None),
        (text.company_number, "SC12345", "SC012345"),
        (text.company_number, "1234", "00001234"),
        (text.company_number, "", None),
        (text.country, "U.S.A.", "United States"),
        (text.country_in_text, "contact us", "United States"),
        (text.state_in_text, "Los Angeles, CA 90028", "CA"),
        (text.without_suffixes, "Acme Holdings, Inc.", "Acme"),
        (text.clean_address, "Address: 1 High St, London, London | Contact us, UK", "1 High St, London"),
        (urls.seed_url, " Ex.com ", "https://ex.com/"),
        (urls.base_domain, "https://jobs.a.co.uk/x", "a.co.uk"),
    ],
)
def test_scalars(spark, f, given, expected):
    assert one(spark, f, given) == expected


@pytest.mark.parametrize(
    ("base", "link", "expected"),
    [
        ("https://Ex.com/a/b?x=1", "../c/./d/?utm_source=q&b=2&a=&b=3#f", "https://ex.com/c/d?b=2&b=3"),
        ("https://e.com/a/", "x.pdf", None),
        ("https://e.com", "mailto:a", None),
        ("https://e.com/p", "?q=1", "https://e.com/p?q=1"),
        ("https://e.com/p", "//O.org", "https://o.org/"),
        ("https://e.com/x/y/", "..", "https://e.com/x"),
        ("https://e.com/x", None, None),
    ],
)
def test_canonical_links(spark, base, link, expected):
    assert one(spark, urls.canonical_url, base, link) == expected


def test_scores(spark):
    score = lambda path: tuple(one(spark, urls.url_score, f"https://h{path}", "https://h/"))
    assert [float(score(p)[0]) for p in ("/", "/en", "/blog/x", "/about-us", "/a/b/c/d/imprint")] == [20.0, 1.5, 0.5, 16.5, 10.5]
    assert score("/illegal")[1] == "legal"
