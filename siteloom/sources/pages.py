"""Web pages as nested columns: raw html in, one structured row out."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style"}
_QUIET = {"script", "style", "noscript", "svg", "iframe"}
#: Fixed values. Parts of class names of footers, and of labels and values beside each other.
_FOOTER_WORDS = ("footer", "legal", "imprint", "copyright", "bottom", "contact", "address", "impressum")
_KEY_WORDS = ("label", "key", "term", "title")
_VALUE_WORDS = ("value", "val", "desc", "data", "content")

PARSED_SCHEMA = (
    "title string, meta_description string, og_site_name string, og_title string, canonical_url string, "
    "headings array<struct<tag:string,text:string>>, paragraphs array<string>, tables_kv array<map<string,string>>, "
    "div_kv array<map<string,string>>, footer_texts array<string>, json_ld array<string>, mailto array<string>, "
    "clean_text string"
)


class _Tree(HTMLParser):
    """A page as lists in page order: elements, each with the stretch of elements and of texts that it holds.

    No element ends but by an end tag of its name, its own or one around it; stray end tags are ignored. An element that
    hides its text in an attribute holds that text and nothing else. Texts in scripts and styles are kept apart.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        #: of each element: its first text, the element and the text after it, and its number of children
        self.first: list[int] = []
        self.ends: list[int] = []
        self.last: list[int] = []
        self.inner: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.links: list[str] = []
        #: texts without white space around them, and of each the element, the paragraph, and whether it is quiet there
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.paragraph: list[int] = []
        self.quiet: list[bool] = []
        self.scripts: dict[int, list[str]] = {}
        #: tag and element of what is open, -1 inside an element that hides its text; open paragraphs with their quiet levels
        self.open: list[tuple[str, int]] = []
        self.names: dict[str, int] = {}
        self.paragraphs: list[tuple[int, int]] = []
        self.muted, self.by_link, self.n_silent, self.n_quiet = 0, False, 0, 0

    def _add(self, tag: str, attrs: dict[str, str]) -> int:
        k = len(self.tags)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.first.append(len(self.texts))
        self.ends.append(k + 1)
        self.last.append(len(self.texts))
        self.inner.append(0)
        self.at.setdefault(tag, []).append(k)
        if self.open:
            self.inner[self.open[-1][1]] += 1
        return k

    def _say(self, text: str) -> None:
        here = self.open[-1][1] if self.open else -1
        if here >= 0:
            self.inner[here] += 1
        if self.n_silent:
            self.scripts.setdefault(here, []).append(text)
        elif text := text.strip():
            self.texts.append(text)
            self.owner.append(here)
            inside, level = self.paragraphs[-1] if self.paragraphs else (-1, 0)
            self.paragraph.append(inside if self.n_quiet <= level else -1)
            self.quiet.append(self.n_quiet > 0)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and (not self.muted or self.by_link):
            self.links.append(given.get("href", "").strip())
        if self.muted:
            if tag not in _VOID:
                self.open.append((tag, -1))
                self.names[tag] = self.names.get(tag, 0) + 1
            return
        k = self._add(tag, given)
        if tag in _VOID:
            return
        self.open.append((tag, k))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.n_silent += tag in _SILENT
        self.n_quiet += tag in _QUIET
        if tag == "p":
            self.paragraphs.append((k, self.n_quiet))
        said = _hidden(given.get("data-cfemail", ""))
        by_link = not said and tag == "a"
        if by_link:
            said = _protected(given.get("href", "").strip())
        if said:
            self._say(said)
            self.muted, self.by_link = len(self.open), by_link

    def handle_startendtag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "a" and (not self.muted or self.by_link):
            self.links.append(given.get("href", "").strip())
        if not self.muted:
            self._add(tag, given)

    def _close(self) -> str:
        tag, k = self.open.pop()
        if k >= 0:
            self.muted = 0 if self.muted > len(self.open) else self.muted
            self.ends[k], self.last[k] = len(self.tags), len(self.texts)
            self.n_silent -= tag in _SILENT
            self.n_quiet -= tag in _QUIET
            if tag == "p":
                self.paragraphs.pop()
        return tag

    def handle_endtag(self, tag):
        while self.names.get(tag):
            name = self._close()
            self.names[name] -= 1
            if name == tag:
                break

    def handle_data(self, data):
        if not self.muted:
            self._say(data)

    def finish(self) -> None:
        while self.open:
            self._close()
        self.sizes = [0, *accumulate(map(len, self.texts))]

    def text(self, k: int) -> str:
        return " ".join(self.texts[self.first[k] : self.last[k]])

    def size(self, k: int) -> int:
        """Characters of the texts in element `k`: known without joining them."""
        return self.sizes[self.last[k]] - self.sizes[self.first[k]]

    def all(self, *tags: str) -> list[int]:
        if len(tags) == 1:
            return self.at.get(tags[0], [])
        return sorted(k for t in tags for k in self.at.get(t, ()))

    def within(self, k: int, found: list[int]) -> tuple[int, int]:
        """The stretch of `found`, elements in page order, that is below element `k`."""
        return bisect_right(found, k), bisect_left(found, self.ends[k])

    def has_class(self, k: int, words: tuple[str, ...]) -> bool:
        given = self.attrs[k].get("class")
        return bool(given) and any(w in c for c in given.lower().split() for w in words)

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers, which nobody reads, are not counted."""
        return j


def _hidden(hexed: str) -> str | None:
    try:
        raw = bytes.fromhex(hexed)
    except ValueError:
        return None
    return "".join(chr(b ^ raw[0]) for b in raw[1:]).strip() if len(raw) > 1 else None


def _protected(href: str) -> str | None:
    """The address in a link to a mail protection page."""
    protected = not href.lower().startswith("mailto:") and "/cdn-cgi/l/email-protection#" in href
    return _hidden(href.split("#")[-1].strip()) if protected else None


def _unnested(block: str) -> list[str]:
    """The JSON objects of a block in order: those of arrays and of @graph lists, however deep, each for itself."""
    try:
        ahead, out = [json.loads(block)], []
    except (ValueError, RecursionError):
        return []
    while ahead:
        x = ahead.pop()
        inner = x if isinstance(x, list) else x.get("@graph") if isinstance(x, dict) else []
        if isinstance(inner, list):
            ahead += reversed(inner)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return out


def _pairs(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    return {k: v for k, v in pairs if k and v and len(k) <= 80 and len(v) <= 500}


def _tables(page: _Tree) -> list[dict[str, str]]:
    rows, cells, pairs = [], page.all("th", "td"), []
    for r in page.all("tr"):
        a, b = page.within(r, cells)
        if b - a == 2 and page.size(cells[a]) <= 80 and page.size(cells[a + 1]) <= 500:
            rows.append(r)
            pairs.append((page.text(cells[a]), page.text(cells[a + 1])))
    found = []
    for table in page.all("table"):
        a, b = page.within(table, rows)
        found.append(_pairs(pairs[a:b]))
    return [x for x in found if x]


def _labelled(page: _Tree) -> dict[str, str]:
    out: dict[str, str] = {}

    def pair(k: int, v: int) -> None:
        if page.size(k) <= 80 and page.size(v) <= 500:
            out.update(_pairs([(page.text(k), page.text(v))]))

    names, values = page.all("dt"), page.all("dd")
    taken = (-1, 0)
    for dl in page.all("dl"):
        (a, b), (c, d) = page.within(dl, names), page.within(dl, values)
        # a list inside of one that has just given the same pairs adds nothing
        if b - a == d - c and not (page.ends[dl] <= taken[0] and c - a == taken[1]):
            taken = (page.ends[dl], c - a)
            for k, v in zip(names[a:b], values[c:d]):
                pair(k, v)
    keys, values = ([k for k in range(len(page.tags)) if page.has_class(k, words)] for words in (_KEY_WORDS, _VALUE_WORDS))
    for box in page.all("div", "section", "ul", "ol"):
        (a, b), (c, d) = page.within(box, keys), page.within(box, values)
        if a < b and c < d and keys[a] != values[c]:
            pair(keys[a], values[c])
    return out


def parse_page(html: str | None) -> dict:
    """The parsed columns of a page. What is looked up inside an element is a stretch of the page's lists, and texts longer
    than their limits are not joined, so the time does not grow with the depth of nesting. A paragraph's text ends where
    another paragraph begins in it."""
    if not html or not html.strip():
        return {"clean_text": ""}
    page = _Tree()
    page.feed(html)
    page.close()
    page.finish()
    mailto = []
    for href in page.links:
        if href.lower().startswith("mailto:"):
            if address := href[7:].split("?")[0].strip():
                mailto.append(address)
        elif seen := _protected(href):
            mailto.append(seen)
    metas = [page.attrs[m] for m in page.all("meta")]

    def meta(key: str, value: str, fold: bool = False) -> str | None:
        found = (m for m in metas if (m.get(key, "").lower() if fold else m.get(key)) == value)
        return (m.get("content", "").strip() or None) if (m := next(found, None)) else None

    def only_text(k: int) -> str | None:
        whole = page.inner[k] == 1 and page.last[k] == page.first[k] + 1 and page.owner[page.first[k]] == k
        return page.texts[page.first[k]] if whole else None

    title = next(iter(page.all("title")), None)
    canonical = next((page.attrs[x] for x in page.all("link") if page.attrs[x].get("rel", "").lower() == "canonical"), None)
    labelled = _labelled(page)
    heads = [(page.tags[h], page.text(h)) for h in page.all("h1", "h2", "h3", "h4") if page.size(h) < 200]
    feet = [page.text(x) for x in page.all("footer", "div", "section", "address") if page.size(x) <= 3000 and page.has_class(x, _FOOTER_WORDS)]
    paragraphs: dict[int, list[str]] = {p: [] for p in page.all("p")}
    for text, p in zip(page.texts, page.paragraph):
        if p >= 0:
            paragraphs[p].append(text)
    return {
        "title": only_text(title) if title is not None else None,
        "meta_description": meta("name", "description", fold=True),
        "og_site_name": meta("property", "og:site_name"),
        "og_title": meta("property", "og:title"),
        "canonical_url": (canonical.get("href", "").strip() or None) if canonical else None,
        "headings": [{"tag": t, "text": x} for t, x in heads if x and len(x) < 200],
        "paragraphs": [x for some in paragraphs.values() if len(x := " ".join(some)) >= 20],
        "tables_kv": _tables(page),
        "div_kv": [labelled] if labelled else [],
        "footer_texts": [x for x in feet if 15 <= len(x) <= 3000],
        "json_ld": [
            x for s in page.all("script") if page.attrs[s].get("type") == "application/ld+json"
            for x in _unnested("".join(page.scripts.get(s, ())).strip())
        ],
        "mailto": mailto,
        "clean_text": "\n".join(x for x, hidden in zip(page.texts, page.quiet) if not hidden),
    }


_LISTS = ("headings", "paragraphs", "tables_kv", "div_kv", "footer_texts", "json_ld", "mailto")


_MAPS = ("tables_kv", "div_kv")
_ARROW = pa.struct(
    [
        (name, pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])) if name == "headings"
         else pa.list_(pa.map_(pa.string(), pa.string())) if name in _MAPS else pa.list_(pa.string()) if name in _LISTS else pa.string())
        for name in (x.split(" ")[0] for x in PARSED_SCHEMA.split(", "))
    ]
)


def _parse_all(pages: pa.Array) -> pa.Array:
    rows = []
    for html in pages.to_pylist():
        row = dict.fromkeys(_LISTS, ()) | parse_page(html)
        rows.append(row | {n: [list(m.items()) for m in row[n]] for n in _MAPS})
    return pa.array(rows, _ARROW)


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def parse_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with the html replaced by its parsed columns; the only Python step of the extraction plan."""
    rest = [c for c in pages.columns if c != html_col]
    parsed = F.arrow_udf(_parse_all, PARSED_SCHEMA)
    return pages.select(*rest, parsed(F.col(html_col)).alias("_page")).select(*rest, "_page.*")


def json_ld_nodes(pages: DataFrame) -> DataFrame:
    """One row for each JSON-LD object of parsed pages, as a variant `node` with its place `path`."""
    nodes = pages.select("*", F.posexplode("json_ld").alias("path", "_text"))
    return nodes.withColumn("node", F.try_parse_json("_text")).where("node IS NOT NULL").drop("_text")
