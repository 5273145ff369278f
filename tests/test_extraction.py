from pyspark.sql import functions as F

from siteloom.operators import candidates, registry
from siteloom.sources.pages import parse_page, parse_pages

PAGE = """<html><head><title>BrewDog | Company Information</title><script type="application/ld+json">
{"@graph":[{"@type":["Organization"],"name":"BrewDog","subOrganization":[{"name":"A"},{"name":"B"},{"name":"A"}]}]}</script>
<script type="application/ld+json">bad{</script></head><body><p>BrewDog PLC. Company No: SC311560. VAT No: 897 6381 54</p>
<p>Registered office: Balmacassie, Ellon, Aberdeenshire, AB41 8BX</p><table><tr><td>Phone</td><td>+44 1358 724924</td></tr></table>
<a href="/cdn-cgi/l/email-protection#4313262c332f260321312634272c246d202c2e">x</a><p>For example, test@test.com or foo@bar.org</p></body></html>"""


def parsed(spark, rows):
    return parse_pages(spark.createDataFrame(rows, "site string, batch int, page_ord int, url string, html string"))


def test_profile_of_a_legal_page(spark):
    pages = parsed(spark, [("brewdog.com", 0, 0, "https://brewdog.com/pages/company-information", PAGE), ("e.org", 0, 0, "https://e.org/", None)])
    sites = pages.select("site", F.col("site").alias("domain"))
    rows = {r.site: r for r in candidates.profiles(candidates.all_candidates(pages), sites).collect()}
    got = rows["brewdog.com"]
    assert (got.company_name, got.registration_number, got.vat_tax_number, got.postal_code) == ("BrewDog", "SC311560", "897 6381 54", "AB41 8BX")
    assert (got.email, got.phone, got.city, got.country) == ("people@brewdog.com", "+44 1358 724924", "Ellon", "United Kingdom")
    assert got.subsidiaries == ["A", "B"] and got.sufficient
    assert (rows["e.org"].company_name, rows["e.org"].name_method, float(rows["e.org"].data_completeness)) == ("e.org", "domain_fallback", 0.12)


def test_ties_go_to_the_earliest(spark):
    rows = [("s", b, st, p, q, "f", f"{b}{st}{p}{q}", c) for b, st, p, q, c in [(1, 0, 0, 0, 0.9), (0, 2, 1, 0, 0.9), (0, 2, 0, 5, 0.9), (0, 0, 0, 0, 0.8)]]
    found = spark.createDataFrame(rows, "site string, batch int, stage int, page_ord int, seq int, field string, value string, confidence double")
    found = found.withColumns({c: F.lit("") for c in ("url", "category", "method", "evidence")})
    assert candidates.best_candidates(found).head().value == "0205"


def test_pages_without_structure():
    assert parse_page(None)["clean_text"] == ""
    got = parse_page("<p><b>x<dl><dt>a<dd>b</dl><p>c &amp; d")
    assert got["clean_text"].split("\n") == ["x", "a", "b", "c & d"]


def test_best_address(spark):
    names = "corpid_num string, addr_type string, date_filed string, ord int, addr1 string, addr2 string, city string, state string, zip5 string, country string, name string"
    rows = [("1", "1", "2024", 0, "a", None, "c", "NY", "1", None, None), ("1", "3", "2020", 1, "b", None, "c", "NY", "2", None, None),
            ("1", "3", "2021", 2, "d", None, "c", "NY", "3", None, None), ("1", "3", "2025", 3, None, None, "c", "NY", "4", None, None)]
    got = registry.best_address(spark.createDataFrame(rows, names)).head()
    assert (got.zip, got.addr_type_label, got.country) == ("3", "Principal Office", "United States")


def test_stream_of_progress(spark, tmp_path):
    from siteloom.streaming.events import frames, read_events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"site":"s","at":"2024-01-01T00:00:00Z","type":"log","msg":"hi"}\n')
    query = frames(read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("frames").head().frame == 'data: {"type":"log","level":"INFO","msg":"hi"}\n\n'
