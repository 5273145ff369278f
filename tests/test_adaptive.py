"""The adaptive run stops site by site, never parses what it does not take, and keeps what all pages so far say."""

import pytest

from siteloom.operators import adaptive, candidates
from siteloom.sources.pages import parse_pages

URLS = "site string, domain string, url string, rank int"


def page(title="About", phone=None, legal=None, text=""):
    rows = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in (("Telephone", phone), ("Legal name", legal)) if v)
    return f"<html><head><title>{title}</title></head><body><table>{rows}</table><p>{text}</p></body></html>"


@pytest.fixture(scope="module")
def tables(spark):
    pages = {
        ("a", 1): page("Alpha", "+1 303 555 0001"), ("a", 2): page(phone="+1 303 555 0002", legal="Alpha One Ltd"), ("a", 3): page(),
        ("b", 1): page("Beta"), ("b", 2): page(), ("b", 3): page(phone="+1 303 555 0003"), ("b", 4): page(phone="+1 303 555 0004"),
        ("c", 1): page(), ("c", 2): page(text="We are Gamma Delta Works of note. Zeta Eta Firm too."), ("c", 3): page(text="Later Other Name here."), ("c", 4): page("Gamma"),
        ("d", 1): None, ("d", 2): page("Delta", legal="Delta Two Ltd"), ("d", 3): page(phone="+1 303 555 0005"),
    }
    urls = [(s, f"{s}.com", f"https://{s}.com/{n}", n) for s, n in pages] + [("e", "e.com", "https://e.com/1", 1)]
    fetched = [(f"https://{s}.com/{n}", h) for (s, n), h in pages.items() if h]
    return spark.createDataFrame(urls, URLS), spark.createDataFrame(fetched, "url string, html string")


def test_rounds_stop_site_by_site(spark, tables, monkeypatch):
    parsed = []

    def watched(pages):
        parsed.append({r.url for r in pages.select("url").collect()})
        return parse_pages(pages)

    monkeypatch.setattr(adaptive, "parse_pages", watched)
    known, taken = adaptive.adaptive_run(*tables, batch_pages=1)
    got = {r.site: r for r in known.collect()}
    pages = {}
    for r in taken.collect():
        pages.setdefault(r.site, set()).add((r.url[-1], r.batch))
    assert pages["a"] == {("1", 0)} and got["a"].phone == "+1 303 555 0001" and got["a"].legal_name is None and got["a"].sufficient
    assert pages["b"] == {("1", 0), ("2", 1), ("3", 2)} and got["b"].phone == "+1 303 555 0003"
    # a page that is missing counts; a name and a legal name are no contact
    assert pages["d"] == {("1", 0), ("2", 1), ("3", 2)} and got["d"].legal_name == "Delta Two Ltd" and got["d"].sufficient
    # names in text stand in once, until a page gives another, and are not looked for again
    assert len(pages["c"]) == 4 and got["c"].company_name == "Gamma" and not got["c"].sufficient
    assert got["e"].company_name == "e.com" and pages["e"] == {("1", 0)}
    read = set().union(*parsed)
    assert not any(u.startswith("https://a.com/") and u[-1] != "1" for u in read) and "https://b.com/4" not in read


def test_batches_and_the_most_pages_of_a_site(spark, tables):
    known, taken = adaptive.adaptive_run(*tables, batch_pages=2, most_pages=3)
    rows = {(r.site, r.url[-1], r.batch) for r in taken.collect()}
    assert {r for r in rows if r[0] == "b"} == {("b", "1", 0), ("b", "2", 0), ("b", "3", 1)}
    # the whole first batch counts, and its best values hold
    a = known.where("site = 'a'").first()
    assert (a.legal_name, a.phone) == ("Alpha One Ltd", "+1 303 555 0001")
    assert known.where("site = 'c'").first().company_name == "Gamma Delta Works"


def test_kept_candidates_give_the_same_profiles(spark, tables):
    urls, fetched = tables
    pages = urls.selectExpr("site", "url", "0 AS batch", "rank AS page_ord").join(fetched, "url")
    found = candidates.all_candidates(parse_pages(pages))
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert plain(candidates.profiles(found, urls)) == plain(candidates.profiles(candidates.kept_candidates(found), urls))
