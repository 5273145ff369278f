"""Link graphs and sitemaps: edges, breadth-first search, robots rules, and unions of URL sources."""

from __future__ import annotations

import gzip
import itertools
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import strip
from siteloom.functions.urls import canonical_url, host_of, same_site
from siteloom.sources.scratch import saved


def hrefs(html: Column) -> Column:
    """The link targets of a page, in order. A tag ends before the next one begins, so that tags without an end are read once."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^<>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, ord, dst) of the links inside a site, in canonical form; `ord` is a link's first place on its page."""
    page = F.col(url)
    # the page's own form is made before its links are unnested, once for a page
    found = pages.select(page.alias("_url"), canonical_url(page, page).alias("src"), F.array_distinct(hrefs(F.col(html))).alias("_hrefs"))
    found = found.where("src IS NOT NULL").select("_url", "src", F.posexplode("_hrefs").alias("ord", "_href"))
    found = found.select("src", "ord", canonical_url(F.col("_url"), F.col("_href")).alias("dst"))
    found = found.where(F.col("dst").isNotNull() & same_site(F.col("src"), F.col("dst")))
    return found.groupBy("src", "dst").agg(F.min("ord").alias("ord")).select("src", "ord", "dst")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst) links inside a site, in canonical form."""
    return page_links(pages, url, html).select("src", "dst")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(site, url, depth) of all that `seeds` (site, url) reach over `edges` (src, dst) in at most `depth` steps.

    A step joins the frontier with the edges and drops what was visited by an anti-join. Each frontier is written, so a step
    starts from files and not from the plans of all steps before it.
    """
    edges = saved(edges.select("src", "dst"), "edges")
    visited = saved(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = visited
    for k in range(1, depth + 1):
        found = frontier.join(edges, F.col("url") == F.col("src")).select("site", F.col("dst").alias("url")).distinct()
        frontier = found.join(visited.select("site", "url"), ["site", "url"], "left_anti").withColumn("depth", F.lit(k))
        frontier = saved(frontier, "frontier")
        visited = visited.unionByName(frontier)
    return visited


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(url, kind, ord, loc) of sitemap documents (url, body), in order; kind is page or sitemap. Bodies that are no XML have none.

    Documents are cut at the end of each entry, and a location ends before the next tag, so each is read once.
    """

    def of(kind: str, outer: str) -> Column:
        parts = F.split("body", rf"(?i)</{outer}\s*>", -1)
        inside = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda b: b.rlike(rf"(?i)<{outer}[\s>]"))
        inside = F.transform(inside, lambda b: F.element_at(F.split(b, rf"(?i)<{outer}(?=[\s>])", -1), -1))
        locs = F.flatten(F.transform(inside, lambda b: F.regexp_extract_all(b, F.lit(r"(?i)<loc(?:\s[^<>]*)?>(?:\s*<!\[CDATA\[)?([^<]*+)"), F.lit(1))))
        locs = F.transform(locs, lambda x: F.replace(strip(F.regexp_replace(x, r"\]\]>\s*\z", "")), F.lit("&amp;"), F.lit("&")))
        return F.transform(F.filter(locs, lambda x: x != ""), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), x.alias("loc")))

    both = F.concat(of("page", "url"), of("sitemap", "sitemap"))
    return sitemaps.where("body IS NOT NULL").select("url", F.explode(both).alias("x")).select("url", "x.kind", "x.ord", "x.loc")


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Distinct (url, kind, loc) of sitemap documents (url, body)."""
    return sitemap_entries(sitemaps).select("url", "kind", "loc").distinct()


#: Fixed value. The name under which sites are asked for.
AGENT = "Mozilla/5.0"


def _decoded(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus), c)


def robots_rules(robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, ord, allow, path) of the rules for `agent` in robots files (host, body), in order; (host, ord, null, location)
    for sitemaps.

    A group begins with its user-agent lines, which an empty line before any rule cancels. The first group that names the
    agent holds, else the first one for *. A rule without a path allows everything.
    """
    # blank lines count before comments go, rules after
    kinds = ["user-agent", "allow", "disallow", "sitemap", "crawl-delay", "request-rate"]

    def read(raw: Column) -> Column:
        line = strip(F.regexp_replace(raw, "#.*$", ""))
        return F.struct(
            (raw == "").alias("blank"), F.lower(strip(F.split_part(line, F.lit(":"), F.lit(1)))).alias("k"),
            F.contains(line, F.lit(":")).alias("pair"), _decoded(strip(F.regexp_extract(line, "^[^:]*:(.*)$", 1))).alias("v"),
        )

    lines = F.filter(F.transform(F.split("body", r"\r\n|\n|\r"), read), lambda p: p["blank"] | (p["pair"] & p["k"].isin(kinds)))
    item = "array<struct<g:int,k:string,v:string>>"

    def step(a: Column, p: Column) -> Column:
        # state 0: outside of a group, 1: after its agents, 2: after its first rule
        state, named = a["state"], ~p["blank"] & (p["k"] == "user-agent")
        rule = ~p["blank"] & ~p["k"].isin("user-agent", "sitemap") & (state != 0)
        fresh = (p["blank"] & (state != 0)) | (named & (state == 2))
        group = a["g"] + F.when(fresh, 1).otherwise(0)
        after = F.when(p["blank"], 0).when(named, 1).when(rule, 2).otherwise(state)
        kept = named | rule | (~p["blank"] & (p["k"] == "sitemap"))
        out = F.when(kept, F.array_append(a["out"], F.struct(group.alias("g"), p["k"].alias("k"), p["v"].alias("v")))).otherwise(a["out"])
        return F.struct(group.cast("int").alias("g"), after.cast("int").alias("state"), out.cast(item).alias("out"))

    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("state"), F.array().cast(item).alias("out"))
    rows = robots.select("host", F.aggregate(lines, zero, step)["out"].alias("_all"))
    name = agent.split("/")[0].lower()
    ruled = F.array_distinct(F.transform(F.filter("_all", lambda x: ~x["k"].isin("user-agent", "sitemap")), lambda x: x["g"]))
    agents = lambda g: F.transform(F.filter("_all", lambda x: (x["g"] == g) & (x["k"] == "user-agent")), lambda x: x["v"])
    any_agent = lambda g: F.array_contains(agents(g), "*")
    named = F.filter(ruled, lambda g: ~any_agent(g) & F.exists(agents(g), lambda v: F.contains(F.lit(name), F.lower(v))))
    rest = F.filter(ruled, any_agent)
    rows = rows.withColumn("_group", F.coalesce(F.get(F.array_sort(named), F.lit(0)), F.get(F.array_sort(rest), F.lit(0))))
    rows = rows.select("host", "_group", F.posexplode("_all").alias("ord", "x"))
    rows = rows.where((F.col("x.k") == "sitemap") | ((F.col("x.g") == F.col("_group")) & F.col("x.k").isin("allow", "disallow")))
    allow = F.when(F.col("x.k") != "sitemap", (F.col("x.k") == "allow") | (F.col("x.v") == ""))
    return rows.select("host", "ord", allow.alias("allow"), F.col("x.v").alias("path"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `urls` (url) that the first matching rule of their host allows, or that no rule matches."""
    target = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = urls.select("url").distinct().withColumn("_path", _decoded(F.when(target == "", "/").otherwise(target)))
    near = asked.join(rules.where("allow IS NOT NULL"), host_of(F.col("url")) == F.col("host"))
    # paths are compared as they are: a star stands for itself
    near = near.where(F.startswith("_path", "path"))
    first = near.groupBy("url").agg(F.min_by("allow", "ord").alias("_allow"))
    return urls.join(first.where("NOT _allow").select("url"), "url", "left_anti")


def sitemap_roots(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, url, ord) of the sitemaps of `sites` (site, start): those its robots file lists, then three usual places."""
    root = F.regexp_extract("start", r"^([a-z]+://[^/?#]*)", 1)
    usual = F.array(*(F.concat(root, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")))
    usual = sites.select("site", F.posexplode(usual).alias("ord", "url")).select("site", "url", (F.col("ord") + 1_000_000).alias("ord"))
    said = sites.join(rules.where("allow IS NULL"), host_of(F.col("start")) == F.col("host")).select("site", F.col("path").alias("url"), "ord")
    return said.union(usual).groupBy("site", "url").agg(F.min("ord").alias("ord"))


def unzipped(raw: DataFrame) -> DataFrame:
    """(url, body) of fetched sitemaps (url, content binary): gunzipped where they are gzip files. Broken files have no body."""

    def opened(contents: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace")
            except (OSError, EOFError, zlib.error):
                return None

        return contents.map(one)

    return raw.select("url", F.pandas_udf(opened, "string")(F.col("content")).alias("body"))


def closed_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct `url` of `urls` that the rules of their own host close."""
    asked = urls.select("url").distinct()
    return asked.join(allowed(asked, rules), "url", "left_anti")


def _open_on_site(rows: DataFrame, closed: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows (site, url, ...) that the robots file of the site's start does not close; it says nothing of other hosts."""
    hosts = sites.select("site", host_of(F.col("start")).alias("_host"))
    shut = closed.withColumn("_shut", F.lit(True)).join(hosts, host_of(F.col("url")) == F.col("_host")).select("site", "url")
    return rows.join(shut, ["site", "url"], "left_anti")


def _below(count: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else count < most


def walked_sitemaps(
    sites: DataFrame, roots: DataFrame, sitemaps: DataFrame, rules: DataFrame,
    most: int | None = 1000, most_visited: int | None = 25, most_known: int | None = 30, batch: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """((site, url) of listed pages, (site, url) of visited sitemaps) of `sites` (site, start), from `roots` (site, url, ord).

    Each site has a queue of sitemaps, of which a round takes the first `batch`; a round with none that is new ends the
    site's walk, and so do `most` pages or `most_visited` visited sitemaps before it. A child goes to the end of the queue
    if it is not visited and visited and queued ones are fewer than `most_known`. A sitemap adds pages in order until the
    site has `most` of them, and one at least. All sites take their rounds together, and quotas are running counts in order
    of queue and place; a round is written, and there are at most `most_visited` of them. A quota of None is none: a site's
    walk ends when its queue does.

    Pages are canonical, of the site's domain and not closed by its robots file.
    """
    entries = saved(sitemap_entries(sitemaps), "sitemap-entries")
    here = Window.partitionBy("site")
    closed = saved(closed_urls(entries.where("kind = 'page'").select(canonical_url(F.col("loc"), F.col("loc")).alias("url")), rules), "closed")
    queue = roots.withColumn("pos", F.row_number().over(here.orderBy("ord", "url")).cast("long")).select("site", "pos", "url")
    queue = saved(queue, "sitemap-queue")
    visited = pages = None
    for k in itertools.count() if most_visited is None else range(most_visited):
        ranked = queue.withColumn("_n", F.row_number().over(here.orderBy("pos"))).withColumn("_queued", F.count(F.lit(1)).over(here))
        if visited is not None:
            done = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_visited"))
            got = pages.groupBy("site").agg(F.count(F.lit(1)).alias("_pages"))
            ranked = ranked.join(done, "site", "left").join(got, "site", "left")
            ranked = ranked.where(_below(F.coalesce("_visited", F.lit(0)), most_visited) & _below(F.coalesce("_pages", F.lit(0)), most))
            ranked = ranked.drop("_visited", "_pages")
        fresh = ranked.where(F.col("_n") <= batch)
        fresh = fresh if visited is None else fresh.join(visited, ["site", "url"], "left_anti")
        fresh = saved(fresh.select("site", "pos", "url", "_queued"), "sitemap-batch")
        if fresh.isEmpty():
            break
        # what all sites have after this round
        now = fresh.select("site", "url").distinct()
        visited = now if visited is None else visited.union(now)
        counts = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_visited"))
        listed = fresh.join(entries.withColumnRenamed("url", "_map"), F.col("url") == F.col("_map")).select("site", "pos", "_queued", "kind", "ord", "loc")
        place = F.struct("pos", "ord")
        found = listed.where("kind = 'page'").join(sites, "site").select("site", "pos", "ord", "start", canonical_url(F.col("start"), F.col("loc")).alias("url"))
        found = found.where(F.col("url").isNotNull() & same_site(F.col("start"), F.col("url"))).select("site", "pos", "ord", "url")
        found = _open_on_site(found, closed, sites)
        known = found.withColumn("_first", F.row_number().over(Window.partitionBy("site", "url").orderBy("pos", "ord")) == 1)
        known = known.withColumn("_head", F.row_number().over(Window.partitionBy("site", "pos").orderBy("ord")) == 1)
        if pages is not None:
            before = pages.groupBy("site").agg(F.count(F.lit(1)).alias("_before"))
            old = pages.withColumn("_old", F.lit(True))
            known = known.join(old, ["site", "url"], "left").join(before, "site", "left")
            known = known.withColumn("_first", F.col("_first") & F.col("_old").isNull())
        else:
            known = known.withColumns({"_old": F.lit(None).cast("boolean"), "_before": F.lit(0)})
        taken = known.where("_old IS NULL")
        if most is not None:
            earlier = F.sum(F.col("_first").cast("int")).over(here.orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
            taken = known.withColumn("_have", F.coalesce("_before", F.lit(0)) + F.coalesce(earlier, F.lit(0)))
            taken = taken.where(F.col("_old").isNull() & ((F.col("_have") < most) | F.col("_head")))
        taken = saved(taken.select("site", "url").distinct(), "sitemap-pages")
        children = listed.where("kind = 'sitemap'").select("site", "pos", "ord", F.col("loc").alias("url"), "_queued")
        children = children.join(visited, ["site", "url"], "left_anti").join(counts, "site")
        left = F.greatest(F.col("_queued") - batch, F.lit(0)) + F.col("_visited")
        children = children.withColumn("_n", F.row_number().over(here.orderBy("pos", "ord", "url"))).where(_below(F.col("_n") - 1 + left, most_known))
        rest = ranked.where(F.col("_n") > batch).join(fresh.select("site").distinct(), "site", "left_semi").select("site", "pos", "url")
        added = children.select("site", (F.col("_n") + (k + 1) * 1_000_000_000).alias("pos"), "url")
        queue = saved(rest.union(added), "sitemap-queue")
        pages = taken if pages is None else pages.union(taken)
    if visited is None:
        none = sites.select("site", F.col("start").alias("url")).limit(0)
        return none, none
    return pages, visited


def sitemap_pages(sites: DataFrame, roots: DataFrame, sitemaps: DataFrame, rules: DataFrame, **caps: int | None) -> DataFrame:
    """(site, url) of the pages that the sitemaps of `sites` list; see `walked_sitemaps`."""
    return walked_sitemaps(sites, roots, sitemaps, rules, **caps)[0]


def walked_links(
    sites: DataFrame, starts: DataFrame, links: DataFrame, rules: DataFrame, depth: int = 2, most: int | None = 400, seeds: int = 10, batch: int = 5
) -> DataFrame:
    """(site, url, depth, fetched) of what a walk over `links` (src, ord, dst) finds from `starts` (site, n, url).

    Each site has a queue: the first `seeds` of its starts, and then what is found, in order of the page that links there
    and of the link's place on it, down to `depth`; links of pages of that depth are found, but not walked. Pages are taken
    `batch` at a time while less than `most` URLs are found, starts included; a batch is finished when the last is found,
    and what is found from then on is not queued. `fetched` are the pages that were taken.

    Levels are joined for all sites together. Inside a level the queue's order is a running count, so no site sends more
    than `most` pages to the next; where batches begin and end, and with which one a site stops, is decided by a fold over
    its at most `most` positions when all levels are there. If `most` is None, all that is queued is taken.
    """
    links = saved(links.select("src", "ord", "dst"), "links")
    closed = saved(closed_urls(links.select(F.col("dst").alias("url")), rules), "closed")
    here = Window.partitionBy("site")
    starts = saved(starts.groupBy("site", "url").agg(F.min("n").alias("n")), "walk-starts")
    queue = starts.where(F.col("n") < seeds).select("site", "url", (F.row_number().over(here.orderBy("n")) - 1).alias("pos"), F.lit(0).alias("depth"))
    queue = saved(queue, "walk-queue")
    known = starts.groupBy("site").agg(F.count(F.lit(1)).alias("found"))
    known = saved(known.join(queue.groupBy("site").agg(F.count(F.lit(1)).alias("queued")), "site"), "walk-counts")
    first_counts, positions, levels = known, [queue], []
    seen = starts.select("site", "url")
    for k in range(depth + 1):
        reached = queue.join(links, F.col("url") == F.col("src")).select("site", "pos", "ord", F.col("dst").alias("url"))
        best = reached.groupBy("site", "url").agg(F.min(F.struct("pos", "ord")).alias("at")).join(seen, ["site", "url"], "left_anti")
        best = _open_on_site(best, closed, sites)
        best = best.withColumn("_n", F.row_number().over(here.orderBy("at", "url"))).join(known, "site")
        queues = (F.lit(k + 1 <= depth)) & _below(F.col("found") + F.col("_n"), most)
        level = best.select(
            "site", "url", F.col("at.pos").alias("parent"), F.lit(k + 1).alias("depth"), queues.alias("queued"), (F.col("queued") + F.col("_n") - 1).alias("pos"),
        )
        level = saved(level, "walk-level")
        levels.append(level)
        if k == depth or level.isEmpty():
            break
        more = level.groupBy("site").agg(F.count(F.lit(1)).alias("_found"), F.count_if("queued").alias("_queued"))
        known = known.join(more, "site", "left").select(
            "site", (F.col("found") + F.coalesce("_found", F.lit(0))).alias("found"), (F.col("queued") + F.coalesce("_queued", F.lit(0))).alias("queued")
        )
        known = saved(known, "walk-counts")
        seen = seen.union(level.select("site", "url"))
        queue = level.where("queued").select("site", "url", "pos", "depth")
        positions.append(queue)
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    taken = positions[0]
    for some in positions[1:]:
        taken = taken.union(some)
    if most is None:
        begun = starts.join(positions[0].select("site", "url", F.lit(True).alias("_in")), ["site", "url"], "left")
        begun = begun.select("site", "url", F.lit(0).alias("depth"), F.coalesce("_in", F.lit(False)).alias("fetched"))
        return begun.union(every.select("site", "url", "depth", F.col("queued").alias("fetched")))
    gains = every.groupBy("site", "parent").agg(F.count(F.lit(1)).alias("_new"), F.count_if("queued").alias("_more")).withColumnRenamed("parent", "pos")
    steps = taken.join(gains, ["site", "pos"], "left").groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_new", F.lit(0)).alias("new"), F.coalesce("_more", F.lit(0)).alias("more")))).alias("_steps")
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("stop"), F.col("queued").cast("long").alias("known"), F.col("found").cast("long").alias("found"),
        F.lit(False).alias("over"), F.lit(0).cast("long").alias("seen"),
    )

    def step(a: Column, x: Column) -> Column:
        begins = x["pos"] == a["stop"]
        over = a["over"] | (begins & (a["found"] >= most))
        then = lambda new, old: F.when(over, old).otherwise(new).cast("long")
        return F.struct(
            F.when(begins, F.least(x["pos"] + batch, a["known"])).otherwise(a["stop"]).cast("long").alias("stop"),
            then(a["known"] + x["more"], a["known"]).alias("known"), then(a["found"] + x["new"], a["found"]).alias("found"),
            over.alias("over"), then(x["pos"] + 1, a["seen"]).alias("seen"),
        )

    ends = steps.join(first_counts, "site").select("site", F.aggregate("_steps", zero, step)["seen"].alias("_seen"))
    ends = saved(ends, "walk-ends")
    found = every.join(ends, "site").where(F.col("parent") < F.col("_seen")).select("site", "url", "depth", (F.col("queued") & (F.col("pos") < F.col("_seen"))).alias("fetched"))
    first = positions[0].select("site", "url", "pos")
    begun = starts.join(first, ["site", "url"], "left").join(ends, "site", "left")
    begun = begun.select("site", "url", F.lit(0).alias("depth"), F.coalesce(F.col("pos") < F.col("_seen"), F.lit(False)).alias("fetched"))
    return begun.union(found)


def discovered(
    sites: DataFrame, listed: DataFrame, links: DataFrame, rules: DataFrame, depth: int = 2, most: int | None = 400, seeds: int = 10, batch: int = 5
) -> DataFrame:
    """(site, url, listed, walked, depth, fetched, n_starts) of what is found on `sites` (site, start): the start, the pages of
    sitemaps (`listed`: site, url), and what a walk from the start and the first ten listed pages finds (`walked_links`).

    Listed pages are taken by URL; a start that is listed too is one of the ten. `links` has (src, ord, dst), or (src, dst).
    """
    links = links if "ord" in links.columns else links.withColumn("ord", F.lit(0))
    listed = saved(listed.select("site", "url").distinct(), "listed")
    first = listed.select("site", F.row_number().over(Window.partitionBy("site").orderBy("url")).alias("n"), "url").where(F.col("n") <= 10)
    starts = saved(sites.select("site", F.lit(0).alias("n"), F.col("start").alias("url")).union(first), "starts")
    walked = walked_links(sites, starts, links, rules, depth, most, seeds, batch)
    sizes = starts.groupBy("site").agg(F.count(F.lit(1)).alias("n_starts"))
    none = F.lit(None)
    rows = walked.select("site", "url", F.lit(False).alias("listed"), F.lit(True).alias("walked"), "depth", "fetched")
    rows = rows.union(listed.select("site", "url", F.lit(True), F.lit(False), none.cast("int"), F.lit(False)))
    rows = rows.groupBy("site", "url").agg(
        F.bool_or("listed").alias("listed"), F.bool_or("walked").alias("walked"), F.min("depth").alias("depth"), F.bool_or("fetched").alias("fetched")
    )
    return rows.join(sizes, "site")


def discovery_summary(found: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per site of `discovered`: all URLs in order and their number, how many sitemaps list, and how many the walk has beyond
    its starts; with `errors` (site, stage, url, error, message) also those, in order."""
    rows = found.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_discovered"), F.count_if("listed").alias("sitemap_urls_count"),
        (F.count_if("walked") - F.first("n_starts")).alias("bfs_urls_count"), F.array_sort(F.collect_list("url")).alias("urls"),
    )
    if errors is None:
        return rows
    lists = errors.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("stage", "url", "error", "message"))).alias("errors"))
    kind = dict(lists.dtypes)["errors"]
    return rows.join(lists, "site", "left").withColumn("errors", F.coalesce("errors", F.array().cast(kind)))


def discovery_errors(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame, visited: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(site, stage, url, error, message) of what was asked for and failed: robots files (host, error, message), visited
    sitemaps and fetched pages (url, error, message). Rows without an error did not fail."""
    home = sites.select("site", host_of(F.col("start")).alias("host"), F.regexp_extract("start", r"^([a-z]+://[^/?#]*)", 1).alias("_root"))
    robot = robots.where("error IS NOT NULL").join(home, "host")
    robot = robot.select("site", F.lit("robots_discovery").alias("stage"), F.concat("_root", F.lit("/robots.txt")).alias("url"), "error", "message")
    failed = lambda t: t.where("error IS NOT NULL").select("url", "error", "message")
    maps = visited.join(failed(sitemaps), "url").select("site", F.lit("sitemap_parse").alias("stage"), "url", "error", "message")
    walked = found.where("fetched").select("site", "url").join(failed(pages), "url")
    return robot.union(maps).union(walked.select("site", F.lit("bfs_link_fetch").alias("stage"), "url", "error", "message"))


def write_discovery(summary: DataFrame, path: str) -> None:
    """Summaries as JSON, one object for each site; empty lists are kept."""
    summary.withColumnRenamed("site", "domain").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def url_union(*sources: DataFrame) -> DataFrame:
    """Distinct (site, url) of several sources, in order."""
    out = sources[0].select("site", "url")
    for s in sources[1:]:
        out = out.union(s.select("site", "url"))
    return out.distinct()
