"""Queries over tables larger than the quotas and patterns of the small test tables, against their SQL."""

import duckdb
import pytest

from siteloom.plans import catalog


def both(spark, folder, name, tables):
    con = duckdb.connect()
    for table, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = ", ".join(df.columns)
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["sitemap_pages", "discovery_report"])
def test_hosts_of_more_pages_than_quotas(spark, tmp_path, name):
    """1,100 pages in 40 sitemaps, and ten walked pages with 50 links each."""
    html = lambda k: "".join(f'<a href="/x/{k}-{i}">x</a>' for i in range(50)) if k < 20 else ""
    rows = [(k, f"https://big.example/p{k % 40:02d}/{k:04d}", html(k)) for k in range(1100)]
    rows = [(k, f"https://big.example/p00/{k:04d}" if k < 20 else u, h) for k, u, h in rows]
    got, expected = both(spark, tmp_path, name, {"pages": (rows, PAGES)})
    assert got == expected and (len(got) == 1100 or got[0][1] > 1500)


def test_titles_with_other_references(spark, tmp_path):
    titles = ["a &quot;b&quot;", "cut off &amp", "a &lt;b&gt; &amp;amp;", "&nbsp;", ""]
    rows = [(k, f"https://h.example/{k}", f"<html><head><title>{t}</title></head><body><p>x</p></body></html>") for k, t in enumerate(titles)]
    rows.append((9, "https://h.example/9", "<p>no title</p>"))
    got, expected = both(spark, tmp_path, "html_parse", {"pages": (rows, PAGES)})
    assert got == expected
