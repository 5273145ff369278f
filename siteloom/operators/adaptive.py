"""The adaptive run: pages of each site in batches, best first, until the site is known well enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators import candidates
from siteloom.sources.pages import parse_pages
from siteloom.sources.scratch import saved, spread


def adaptive_run(urls: DataFrame, fetched: DataFrame, batch_pages: int = 10, most_pages: int = 100, names=candidates.capital_names) -> tuple[DataFrame, DataFrame]:
    """(profiles, pages taken) of the sites of `urls` (site, domain, url, rank), with `fetched` pages (url, html).

    A round takes the next `batch_pages` of each open site, parses those only, and merges their candidates into what is kept
    of the rounds before: one row for each site and field, and each subsidiary once. A site that is known well enough then,
    by name and one other field, is closed by an anti-join, and its later pages are never read; so is one without pages
    left. Pages that could not be fetched count, but say nothing. Names are looked for in running text only while a site has
    no other name. There are at most `most_pages / batch_pages` rounds, each written.

    Pages taken are (site, url, batch). Sites of which no page says anything get their domain as their name.
    """
    ranked = urls.where(F.col("rank") <= most_pages).select(
        "site", "url", F.floor((F.col("rank") - 1) / batch_pages).cast("int").alias("batch"), F.col("rank").cast("int").alias("page_ord")
    )
    ranked = saved(ranked, "ranked-pages")
    open_sites = ranked.select("site").distinct()
    kept, taken = None, []
    for k in range(-(-most_pages // batch_pages)):
        now = saved(ranked.where(F.col("batch") == k).join(open_sites, "site", "left_semi"), "batch-pages")
        if now.isEmpty():
            break
        taken.append(now.select("site", "url", "batch"))
        parsed = saved(parse_pages(spread(now, "url").join(fetched.select("url", "html"), "url")), "batch-parsed")
        kept = saved(candidates.kept_candidates(candidates.all_candidates(parsed, kept, names)), "batch-candidates")
        known = candidates.profiles(kept, urls.join(now.select("site").distinct(), "site", "left_semi"), kept=True)
        open_sites = saved(known.where("NOT sufficient").select("site"), "open-sites")
    if kept is None:
        raise ValueError("there are no pages to take")
    every = taken[0]
    for some in taken[1:]:
        every = every.union(some)
    return candidates.profiles(kept, urls, kept=True), every
