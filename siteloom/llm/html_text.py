"""Main text of web pages by consensus host paths: containers are scored by page, voted on by host, then re-extracted."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, salt_of, saved, spread_join

_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*+"
#: A tag with quoted values; possessive repeats, so that a tag that never ends is read once.
_TAG = re.compile(rf"""<(/?)({_NAME})((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: The same where quotes are not closed: the tag ends at the next angle.
_BARE_TAG = re.compile(rf"<(/?)({_NAME})([^>]*+)>")
_TAG_START = re.compile(rf"</?{_NAME}")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose content is no text of the page, up to their end tag, whatever stands in it.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"}
_RAW_END = {tag: re.compile(f"</{tag}[^a-zA-Z0-9]", re.I) for tag in _RAW}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "time", "tt", "u", "var",
}
_CELLS = {"td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements, classes, ids and roles of what is not the article.
_OFF_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
_OFF_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "sidebar", "sidenav", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "respond", "disqus", "reply", "replies",
    "share", "sharing", "social", "related", "recommended", "widget", "login", "search", "skip",
}
#: What may stand beside such a word in one name: cookie-notice, sidebar-left, post-comments; but not has-sidebar.
_OFF_BESIDE = {
    "area", "article", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "entry", "form", "global",
    "icon", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "outer", "panel", "post",
    "posts", "primary", "right", "secondary", "section", "site", "thread", "title", "top", "wrap", "wrapper",
}
_OFF_NAMES = {"header", "site-header", "page-header", "siteheader", "pageheader", "banner"}
_OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_SCORED = {"html", "body", "main", "article", "section", "div", "td", "center", "form"}


def _off_name(name: str) -> bool:
    """Whether a class or id is made up of words for what is not the article, and of words that may stand beside them."""
    words = [w for w in re.split("[^a-z]+", name) if w]
    return any(w in _OFF_WORDS for w in words) and all(w in _OFF_WORDS or w in _OFF_BESIDE for w in words)


def _step(tag: str, attributes: dict[str, str], in_article: bool = False) -> tuple[str, bool]:
    """A container's step in a path, and whether its tag, role, classes or id speak against it.

    The step is the tag with its classes, numbers generalised so that pages of a host agree, and with what speaks against
    the container, so that it shares no path with one that nothing speaks against. Inside an article an id is a place to
    link to and speaks against nothing, nor do names against headings and paragraphs.
    """
    role = attributes.get("role", "").lower()
    names = f"{attributes.get('class', '')} {'' if in_article else attributes.get('id', '')}".lower().split()
    if in_article and (tag in _HEADINGS or tag == "p"):
        names = []
    against = [n for n in names if n in _OFF_NAMES or tag not in ("html", "body", "main") and _off_name(n)]
    if role in _OFF_ROLES:
        against.append(f"role={role}")
    if attributes.get("aria-hidden") == "true":
        against.append("hidden")
    classes = {re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()}
    parts = [tag, *sorted(classes), *sorted({re.sub(r"\d+", "#", f"!{n}") for n in against})]
    return ".".join(parts), bool(against) or tag in _OFF_TAGS


@dataclass
class Page:
    """A page as containers and text blocks. Containers are numbered, parents before children; 0 is the page itself.

    `path` is a hash of the steps from the page to the container: containers of pages of a host meet under it.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    against: list[bool] = field(default_factory=lambda: [False])
    #: where headings in the container belong: the container around a header of an article, or -1
    lift: list[int] = field(default_factory=lambda: [-1])
    #: container, text, characters inside links, links
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)
    sums: tuple[list[int], ...] | None = None

    def add(self, parent: int, tag: str, attributes: dict[str, str], in_article: bool, in_text: bool) -> int:
        from xxhash import xxh64_intdigest

        step, against = _step(tag, attributes, in_text)
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(xxh64_intdigest(step, self.path[parent]))
        self.against.append(against)
        self.lift.append(parent if tag == "header" and in_article else -1 if against else self.lift[parent])
        return len(self.tag) - 1


def parsed(page: str) -> Page:
    """The containers and blocks of a page, in one pass whose time grows with the page's length, however it is nested.

    Inline elements make no blocks; a line break counts as white space. Containers end with their end tag, or with one
    around them; a paragraph also ends where any block begins. Character references are decoded after tags are found.
    The headings in a header of an article belong to the article. A tag without an end is text.
    """
    out = Page()
    #: tag and container of each open element, and how many of each tag are open
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    links, linked, n_links, in_article = 0, 0, 0, 0
    held: list[str] = []
    tag_at, last_angle = _TAG, page.rfind(">")

    def home() -> int:
        tag, here = stack[-1] if stack else ("", 0)
        return out.lift[here] if tag in _HEADINGS and out.lift[here] >= 0 else here

    def flush() -> None:
        nonlocal linked, n_links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.blocks.append((home(), text, linked, n_links))
            held.clear()
        linked = n_links = 0

    def close_one() -> str:
        nonlocal in_article
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        in_article -= tag in ("article", "main")
        return tag

    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        if begin != at:
            text = page[at : begin if begin >= 0 else end]
            held.append(text)
            linked += len(text) if links else 0
            at = begin if begin >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            close, skip = ("-->", 3) if page.startswith("<!--", at) else (">", 1)
            found = page.find(close, at + 2)
            at = found + skip if found >= 0 else end
            continue
        m = tag_at.match(page, at) if at < last_angle else None
        if m is None and at < last_angle and tag_at is _TAG and _TAG_START.match(page, at):
            # quotes that are never closed: from here on tags end at the next angle
            tag_at = _BARE_TAG
            continue
        if m is None:
            if page.startswith("</", at) and at < last_angle:
                at = page.find(">", at) + 1
                continue
            held.append("<")
            linked += 1 if links else 0
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in _INLINE:
                links = max(0, links - (tag == "a"))
            elif tag in _CELLS:
                held.append(" ")
            elif tag not in _RAW and tag not in _VOID:
                flush()
                if open_tags.get(tag):
                    while close_one() != tag:
                        pass
                links = 0
            continue
        if tag in _RAW:
            if tag not in ("svg", "math") or not m[3].rstrip().endswith("/"):
                close = _RAW_END[tag].search(page, at)
                at = close.start() if close else end
            continue
        if tag in _VOID or tag in _CELLS:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            links += tag == "a"
            n_links += tag == "a"
            continue
        flush()
        while stack and (stack[-1][0] == "p" or stack[-1][0] in _IMPLIED.get(tag, ())):
            close_one()
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        here = stack[-1][1] if stack else 0
        if tag not in _HEADINGS and tag != "p" or attributes and _step(tag, attributes, open_tags.get("article", 0) > 0)[1]:
            here = out.add(here, tag, attributes, in_article > 0, open_tags.get("article", 0) > 0)
        stack.append((tag, here))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        in_article += tag in ("article", "main")
    flush()
    return out


def _weight(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def _sums(page: Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each container, over the blocks in it: text outside links, characters, characters inside links, links."""
    if page.sums is None:
        n = len(page.tag)
        weight, chars, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        for at, text, in_links, k in page.blocks:
            weight[at] += _weight(text, in_links)
            chars[at] += len(text)
            linked[at] += in_links
            links[at] += k
        for k in range(n - 1, 0, -1):
            if chars[k]:
                up = page.parent[k]
                weight[up] += weight[k]
                chars[up] += chars[k]
                linked[up] += linked[k]
                links[up] += links[k]
        page.sums = weight, chars, linked, links
    return page.sums


def off_article(page: Page) -> list[bool]:
    """The page's own verdict on each container: whether it is off the article.

    What speaks against a container counts, unless it holds the page itself: if no article or main stands outside of all
    such containers, those around a main, those whose articles have more text than all blocks outside of them (so they are
    no teasers), and those with most of the page's text stay. Text inside links does not count. Outside of articles, a
    container of three or more links that make up three quarters of its text is a menu, but not inside one with most of the
    page's text.
    """
    n = len(page.tag)
    weight, chars, linked, links = _sums(page)
    doubted, article = [False] * n, [""] * n
    for k in range(1, n):
        up = page.parent[k]
        doubted[k] = page.against[k] or doubted[up]
        article[k] = "" if page.against[k] else page.tag[k] if page.tag[k] in ("article", "main") else article[up]
    around = [0] * n
    plain, outside = 0, False
    for at, text, in_links, _ in page.blocks:
        own = _weight(text, in_links)
        plain += 0 if doubted[at] else own
        if own and article[at]:
            around[at] += own if article[at] == "article" else math.inf
            outside = outside or not doubted[at]
    for k in range(n - 1, 0, -1):
        around[page.parent[k]] += around[k]
    off, most = [False] * n, [False] * n
    for k in range(1, n):
        own = page.tag[k] not in ("html", "body")
        most[k] = most[page.parent[k]] or own and (2 * weight[k] > weight[0] or 2 * chars[k] > chars[0])
        holds = not outside and (around[k] > plain or 2 * weight[k] > weight[0])
        menu = own and not article[k] and not most[k] and links[k] >= 3 and 4 * linked[k] >= 3 * chars[k]
        off[k] = menu or page.against[k] and not holds
    return off


def kept_blocks(page: Page, off: list[bool]) -> list[tuple[int, str, int, int]]:
    gone = [False] * len(off)
    for k in range(1, len(off)):
        gone[k] = off[k] or gone[page.parent[k]]
    return [b for b in page.blocks if not gone[b[0]]]


def scored_containers(page: Page, blocks: list[tuple[int, str, int, int]]) -> list[tuple[int, int]]:
    """(path, score) of the containers that hold the page's article, outermost first; the score is the text outside links.

    In the chain of containers that each have three quarters of the text of the one around it, the search begins at the
    first article or main, if there is one, and goes on to the container within if the outer one adds mostly links.
    Containers that hold the same as the outermost one left get its score too: the host's votes decide between them.
    """
    inside: dict[int, list[int]] = {}
    children: dict[int, dict[int, str]] = {}
    held: dict[int, list[int]] = {}
    for at, text, linked, _ in blocks:
        sums = held.setdefault(at, [0, 0, 0])
        for i, x in enumerate((_weight(text, linked), len(text), linked)):
            sums[i] += x
    for k in range(len(page.tag) - 1, -1, -1):
        if (sums := held.get(k)) is None:
            continue
        path, up = page.path[k], page.parent[k]
        total = inside.setdefault(path, [0, 0, 0])
        above = held.setdefault(up, [0, 0, 0]) if k else [0, 0, 0]
        for i in range(3):
            total[i] += sums[i]
            above[i] += sums[i]
        if k:
            children.setdefault(page.path[up], {})[path] = page.tag[k]
    if 0 not in inside or not inside[0][0]:
        return []
    chain, here, least = [], 0, inside[0][0]
    while True:
        deeper = [(p, t) for p, t in children.get(here, {}).items() if 4 * inside[p][0] >= 3 * least]
        if not deeper:
            break
        here, tag = max(deeper, key=lambda d: (inside[d[0]][0], d[0]))
        if tag in _SCORED:
            chain.append((here, tag))
            least = inside[here][0]
        if tag == "article":
            break
    first = next((k for k, (_, tag) in enumerate(chain) if tag in ("article", "main")), 0)
    best: list[int] = []
    for path, _ in chain[first:]:
        if best:
            more, linked = (inside[best[-1]][i] - inside[path][i] for i in (1, 2))
            if more and 2 * linked <= more:
                break
            best = [] if more else best
        best.append(path)
    return [(path, inside[path][0]) for path in best]


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def path_verdicts(page: Page, off: list[bool]) -> dict[int, bool | None]:
    """For each path with text, whether the page finds it off the article; None if containers under it differ."""
    chars = _sums(page)[1]
    found: dict[int, bool | None] = {}
    for k in range(1, len(off)):
        if chars[k] and found.setdefault(page.path[k], off[k]) != off[k]:
            found[page.path[k]] = None
    return found


def page_repeats(page: Page) -> tuple[int, list[tuple[int, int]]]:
    """(signature of the page's article, [(path, signature)]) of the paths of boxes that the page itself keeps, beside its
    article or inside. A signature is a sum over the blocks under a path: pages with the same texts there have the same.

    Boxes are elements that make containers, of twenty characters or more. What is marked as an article or main is all the
    author's, also where it repeats.
    """
    from xxhash import xxh64_intdigest

    off = off_article(page)
    blocks = kept_blocks(page, off)
    own = next((p for p, _ in scored_containers(page, blocks)), 0)
    n = len(off)
    sums, holds, marked, chars = [0] * n, [False] * n, [False] * n, [0] * n
    for k in range(1, n):
        marked[k] = marked[page.parent[k]] or page.tag[k] in ("article", "main")
    for at, text, _, _ in blocks:
        sums[at] += xxh64_intdigest(text)
        chars[at] += len(text)
    by_path: dict[int, int] = {}
    held: set[int] = set()
    for k in range(n - 1, -1, -1):
        path = page.path[k]
        holds[k] = holds[k] or path == own
        if holds[k] or marked[k] or page.tag[k] not in _SCORED:
            held.add(path)
        if sums[k]:
            by_path[path] = by_path.get(path, 0) + sums[k]
        if sums[k] and chars[k] < 20:
            held.add(path)
        if k:
            sums[page.parent[k]] += sums[k]
            chars[page.parent[k]] += chars[k]
            holds[page.parent[k]] = holds[page.parent[k]] or holds[k]
    least = 1 << 64
    article = _signed(by_path.get(own, 0) % least)
    return article, [(_signed(p), _signed(x % least)) for p, x in by_path.items() if p not in held]


def page_votes(page: Page) -> list[tuple[int, int, int, int]]:
    """(path, score, off, voted) of a page: the scores of containers that hold its article, and its verdict on each path."""
    off = off_article(page)
    scores = dict(scored_containers(page, kept_blocks(page, off)))
    verdicts = path_verdicts(page, off).items()
    return [(_signed(p), scores.get(p, 0), int(v is True), int(v is not None)) for p, v in verdicts]


def main_text(page: Page, path: int | None = None, off_paths: dict[int, bool] | None = None) -> str:
    """The text of a page: blocks that are not off the article, under the winning path of its host.

    `off_paths` are the host's verdicts on paths about which its pages disagree; on all others the page's own is theirs
    too, and counts where the page itself has both kinds under one path. If the page has less than three quarters of its own best container's text under `path`, that is taken; all
    blocks left if it has neither.
    """
    off = off_article(page)
    if off_paths:
        mixed = {p for p, v in path_verdicts(page, off).items() if v is None}
        off = [own if p in mixed else off_paths.get(_signed(p), own) for p, own in zip(page.path, off)]
    blocks = kept_blocks(page, off)
    own = next((p for p, _ in scored_containers(page, blocks)), None)

    def under(path: int | None) -> list[tuple[int, str, int, int]]:
        if path is None:
            return []
        within = [False] * len(off)
        for k in range(len(off)):
            within[k] = page.path[k] == path or within[page.parent[k]]
        return [b for b in blocks if within[b[0]]]

    path = path if path is None or path >= 0 else path + (1 << 64)
    host, best = under(path), under(own)
    size, least = (sum(_weight(b[1], b[2]) for b in some) for some in (host, best))
    found = (best if 4 * size < 3 * least else host) or best or blocks
    return "\n\n".join(b[1] for b in found)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of votes by host and path, and the signatures of the texts under paths that pages keep beside their article."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        repeats: set[tuple[str, int, int, int]] = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parsed(page)
            for path, *vote in page_votes(page):
                total = sums.setdefault((host, path), [0, 0, 0])
                for i, x in enumerate(vote):
                    total[i] += x
            article, found = page_repeats(page)
            repeats.update((host, path, x, article) for path, x in found)
        rows = [(h, p, *v, None, None) for (h, p), v in sums.items()] + [(h, p, 0, 0, 0, x, a) for h, p, x, a in repeats]
        columns = list(zip(*rows)) or [[]] * 7
        names = ["host", "path", "score", "off", "voted", "signature", "article"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.int64()] * 6))], names)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path, off, on in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            verdicts = dict.fromkeys(on or (), False) | dict.fromkeys(off or (), True)
            texts.append(main_text(parsed(page), path, verdicts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["c0", "c1", "text"]
        )


def host_verdicts(pages: DataFrame) -> DataFrame:
    """Per host of `pages` (_host, _html): the winning `path`, and the disputed paths that are `off` and `on` the article.

    The path with the highest sum of scores wins. A path is disputed if pages do not all find the same of it; it is off if
    more than half of them find it off, each page with one vote; a page with both kinds under one path has none on it.

    What pages of a host say again beside different articles is no part of any of them, whatever its names: a path is off
    too if three articles or more have the very same texts under it, and more than half of those that have the path. Copies
    of an article count once, and a path that holds a page's article is never one.
    """
    kinds = "_host string, path long, score long, off long, voted long, signature long, article long"
    votes = saved(pages.where("_host <> ''").mapInArrow(_votes, kinds), "votes")
    said = votes.where("signature IS NOT NULL").select("_host", "path", "signature", "article").distinct()
    same = said.groupBy("_host", "path", "signature").agg(F.count(F.lit(1)).alias("_n"))
    repeated = same.groupBy("_host", "path").agg(F.max("_n").alias("_most"), F.sum("_n").alias("_all")).where("_most >= 3 AND 2 * _most > _all")
    repeated = repeated.groupBy("_host").agg(F.collect_list("path").alias("_repeated"))
    sums = votes.where("signature IS NULL").groupBy("_host", "path").agg(*(F.sum(c).alias(c) for c in ("score", "off", "voted")))
    disputed = (F.col("off") > 0) & (F.col("off") < F.col("voted"))
    is_off = 2 * F.col("off") > F.col("voted")
    best = F.max(F.when(F.col("score") > 0, F.struct("score", "path")))
    off, on = (F.collect_list(F.when(disputed & x, F.col("path"))) for x in (is_off, ~is_off))
    found = sums.groupBy("_host").agg(best["path"].alias("_path"), off.alias("_off"), on.alias("_on"))
    both = F.array_union("_off", F.coalesce("_repeated", F.array().cast("array<bigint>")))
    return found.join(repeated, "_host", "left").select("_host", "_path", both.alias("_off"), "_on")


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = 100_000
) -> DataFrame:
    """Per page: its id, its url, `text` (main text, blocks joined by blank lines; empty if none) and `n_chars`.

    A page scores its containers by their tags, roles, links, share of text and, outside of articles or by class, names made
    up of words for what is not the article; its host's pages then decide by votes (`host_verdicts`).

    Votes are summed by host and path, with partial sums in each batch, so a host with a third of all pages sends few rows.
    The verdicts, a row for each host, are written; up to `small` hosts are broadcast, more are joined with the host's
    pages dealt over salts. Null html counts as empty; a page with no readable host has its own verdicts only; repeated
    rows are extracted each for itself; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.expr(f"try_parse_url(`{url_col}`, 'HOST')")), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
    )
    winners = saved(host_verdicts(rows.select("_host", "_html")), "paths")
    if winners.count() <= small:
        found = rows.join(F.broadcast(winners), "_host", "left")
    else:
        found = spread_join(rows.withColumn("_salt", salt_of("_id", 64, run=1)), winners, ["_host"], "_salt", "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    texts = found.select("_id", "_url", "_html", "_path", "_off", "_on").mapInArrow(
        _extract, f"_id {kinds['_id']}, _url {kinds['_url']}, text string"
    )
    return texts.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )
