"""URL functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import fixed
from siteloom.functions.text import filled, strip

#: Fixed values. Public suffixes of two labels that the rule below does not give.
TWO_LABEL_SUFFIXES = ["me.uk", "ltd.uk", "plc.uk", "sch.uk", "nhs.uk", "police.uk", "id.au", "asn.au", "geek.nz", "gen.nz", "firm.in", "gen.in", "web.za"]
#: The second label of a suffix under a country of two letters; else the last label of a host is its suffix.
_SECOND_LABELS = "co|com|org|net|gov|gob|gouv|gub|ac|edu|or|ne|go|mil"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` evaluated once for a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def seed_url(c: Column) -> Column:
    """A seed as a full URL: https unless said otherwise, host in lower case, no query and no fragment."""
    raw = strip(c)
    url = F.when(F.startswith(raw, F.lit("http://")) | F.startswith(raw, F.lit("https://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme, host, path = (F.regexp_extract(url, r"^([^:]+)://([^/?#]*)([^?#]*)", k) for k in (1, 2, 3))
    return F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.coalesce(filled(path), F.lit("/")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def base_domain(url: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: the public suffix and one label before it; empty without one.

    Suffixes of two labels are `suffixes`, which a caller may read from a list of public suffixes, and those that have a
    kind of organisation under a country (co.uk, com.mx).
    """
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(1)), r"[?#:].*$", "")
    last = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    longer = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    two = last.isin(suffixes) | last.rlike(rf"^({_SECOND_LABELS})\.[a-z]{{2}}$")
    return F.when(two, longer).otherwise(last)


def same_site(a: Column, b: Column) -> Column:
    def host(c: Column) -> Column:
        bare = F.split_part(F.regexp_replace(F.lower(c), r"^https?://", ""), F.lit("/"), F.lit(1))
        return F.coalesce(filled(base_domain(c)), bare)

    return F.coalesce((host(a) == host(b)) & (host(a) != ""), F.lit(False))


def _resolved(base: Column, link: Column) -> Column:
    """A link against its page, as RFC 3986 has it, with dot segments removed."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(base, r"://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    path = path_of(base)
    folder = F.coalesce(filled(F.regexp_replace(path, r"[^/]*$", "")), F.lit("/"))
    full = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .when(link == "", base)
        .otherwise(F.concat(root, folder, link))
    )

    return let(full, _without_dots)


def _without_dots(url: Column) -> Column:
    def step(kept: Column, x: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(x == "..", up).when(x == ".", kept).otherwise(F.array_append(kept, x))

    def joined(steps: Column) -> Column:
        tail = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), step), tail), "/")

    path = path_of(url)
    clean = F.when(path.rlike(r"/\.\.?(/|\z)"), let(F.split(path, "/"), joined)).otherwise(path)
    start = filled(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    after = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.concat(start, clean, F.coalesce(after, F.lit("")))


def _clean_query(query: Column) -> Column:
    """Parameters with a value that track nothing, those with one name together, re-encoded."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.rlike("=.")),
        lambda p: F.struct(
            decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")
        ),
    )
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(fixed.TRACKING_PARAMETERS))

    def grouped(ps: Column) -> Column:
        names = F.array_distinct(F.transform(ps, lambda p: p["k"]))
        return F.flatten(F.transform(names, lambda k: F.filter(ps, lambda p: p["k"] == k)))

    shown = F.transform(let(pairs, grouped), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"])))
    return F.when(query != "", F.array_join(shown, "&")).otherwise("")


def canonical_url(base: Column, link: Column) -> Column:
    """A link of a page in canonical form, or null if it leads to no page.

    Most links are whole addresses or paths from the root, without parameters and dot segments: two patterns settle them,
    in generated code. Only others take the way through arrays of segments and parameters.
    """
    media = rf"(?i)\.({'|'.join(fixed.SKIPPED_ENDINGS)})\z"
    bare = F.regexp_replace(strip(link), "#.*", "")
    plain = ~bare.rlike(r"\?|/\.\.?(/|\z)|\s")
    whole = plain & bare.rlike(r"^https?://[^/?#A-Z:]+(:\d+)?(/.*)?\z")
    rooted = plain & bare.rlike(r"^/([^/].*)?\z") & base.rlike(r"^https?://[^/?#A-Z:]+(:\d+)?([/?#]|\z)")
    home = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    short = F.regexp_replace(F.regexp_replace(bare, r"^(https?://[^/]+)\z", "$1/"), r"^((?:https?://[^/]+)?/.*)/\z", "$1")
    ending = F.regexp_replace(bare, "^https?://[^/]+", "").rlike(media)
    fast = F.when(whole & ~ending, short).when(rooted & ~ending, F.concat(home, short))
    return F.when(whole | rooted, fast).otherwise(_canonical_any(base, link))


def _canonical_any(base: Column, link: Column) -> Column:
    def of(link: Column) -> Column:
        skipped = link.rlike("^(?:" + "|".join(re.escape(x) for x in fixed.SKIPPED_SCHEMES) + ")")
        return F.when((link != "") & ~skipped, let(_resolved(base, link), clean))

    def clean(url: Column) -> Column:
        return let(F.struct(F.lower(F.regexp_extract(url, "^([^:]+):", 1)).alias("scheme"), path_of(url).alias("path"), url.alias("url")), built)

    def built(u: Column) -> Column:
        scheme, path = u["scheme"], u["path"]
        media = F.lower(path).rlike(rf"\.({'|'.join(fixed.SKIPPED_ENDINGS)})\z")
        short = F.coalesce(filled(F.regexp_replace(path, "(.)/\\z", "$1")), F.lit("/"))
        query = let(F.regexp_extract(u["url"], r"\?([^#]*)", 1), _clean_query)
        tail = let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(scheme.isin("http", "https") & ~media, F.concat(scheme, F.lit("://"), host_of(u["url"]), short, tail))

    return let(strip(link), of)


def url_score(url: Column, start: Column) -> Column:
    """(score, category) of a page: how likely its path is to identify the company. Scores are decimals."""
    return let(F.lower(path_of(url)), lambda path: _path_score(url, start, path))


def _path_score(url: Column, start: Column, path: Column) -> Column:
    words = F.filter(F.split(F.translate(path, "/-_.", "    "), r"\s+"), lambda w: w != "")
    table = F.array(
        *(
            F.struct(
                F.lit(kw).alias("kw"), F.array(*(F.lit(t) for t in kw.replace("_", "-").split("-"))).alias("words"),
                F.lit(str(w)).cast("decimal(6,3)").alias("w"), F.lit(c).alias("c"),
            )
            for kw, w, c in fixed.URL_KEYWORDS
        )
    )
    # a keyword needs its first word in the path, also where its words stand apart: most paths have none
    apart = lambda k, ws: F.contains(path, k["words"][0]) & (F.size(F.array_except(k["words"], ws)) == 0)
    hits = let(words, lambda ws: F.filter(table, lambda k: F.contains(path, k["kw"]) | apart(k, ws)))
    firsts = sorted({re.split("[-_]", kw)[0] for kw, _, _ in fixed.URL_KEYWORDS})
    hits = F.when(path.rlike("|".join(firsts)), hits).otherwise(F.slice(table, 1, 0))
    three = F.lit("3").cast("decimal(6,3)")

    def fold(a: Column, k: Column) -> Column:
        better = k["w"] > a["best"]
        extra = F.least((k["w"] * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(6,3)"), three)
        return F.struct(
            F.when(better, k["w"]).otherwise(a["best"]).alias("best"),
            F.when(better, k["c"]).otherwise(a["c"]).alias("c"),
            F.when(better, a["bonus"]).otherwise((a["bonus"] + extra).cast("decimal(10,3)")).alias("bonus"),
        )

    zero = F.struct(
        F.lit("1").cast("decimal(6,3)").alias("best"), F.lit("general").alias("c"), F.lit("0").cast("decimal(10,3)").alias("bonus")
    )
    return let(F.aggregate(hits, zero, fold), lambda folded: _scored(url, start, path, folded))


def _scored(url: Column, start: Column, path: Column, folded: Column) -> Column:
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    total = (folded["best"] + folded["bonus"]).cast("decimal(12,4)")
    total = (
        F.when(depth == 1, total + F.lit("1.5").cast("decimal(3,1)"))
        .when(depth == 2, total + F.lit("1.0").cast("decimal(3,1)"))
        .when(depth > 4, total * F.lit("0.7").cast("decimal(3,1)"))
        .otherwise(total)
    )
    home = (host_of(url) == host_of(start)) & path.isin("", "/", "/index.html", "/index.php")
    low = path.rlike("|".join(fixed.LOW_VALUE_PATHS))
    kind = "decimal(8,2)"
    score = (
        F.when(home, F.lit("20").cast(kind)).when(path.rlike("(?i)" + fixed.LOCALE_ROOT), F.lit("1.5").cast(kind))
        .when(low, F.lit("0.5").cast(kind)).otherwise(F.round(total, 2).cast(kind))
    )
    category = F.when(home | path.rlike("(?i)" + fixed.LOCALE_ROOT), "homepage").when(low, "general").otherwise(folded["c"])
    return F.struct(score.alias("score"), category.alias("category"))
