"""Main text by consensus host paths: hand-made pages, hostile pages, votes, and the query against a plain restatement."""

import random
import time
from collections import Counter, defaultdict

import pytest

from siteloom.llm.html_text import extract_main_text, kept_blocks, main_text, off_article, parsed, scored_containers


def on_page(page):
    found = parsed(page)
    return [b[1] for b in kept_blocks(found, off_article(found))]


PAGE = """<html><head><title>t</title></head><body><div class="cookie-notice">We use <p>cookies</p></div><nav><a href=/>menu</a></nav>
<main><article class="post-{n}"><h1>T &amp; U {n}</h1><p>One<br>two <a href=x>link</a> and much more of the text<aside>side</aside>
<p>Three <script>var a="</p>"</script>four<div class="ad">buy</div><ul><li>a<li>b</ul><form><p>name</form></article>
<section id=comments><p>troll text that is long enough to count as a block of its own</section></main><footer>f</footer>"""
TEXT = "T & U {n}\n\nOne two link and much more of the text\n\nThree four\n\na\n\nb"


@pytest.mark.parametrize("small", [100, 0])
def test_html_extraction(spark, small):
    pages = [(i, f"https://h{i % 2}.example/{i}", PAGE.replace("{n}", str(i)), "k") for i in range(6)]
    pages += [(10, "https://h0.example/x", "", "k"), (11, None, None, "k"), (12, "::", "<p>lone &lt;b&gt;", "k"), (12, "::", "<p>lone &lt;b&gt;", "k")]
    rows = extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string"), small=small).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in rows}
    assert len(rows) == len(pages)
    assert all(got[i] == (TEXT.replace("{n}", str(i)), len(TEXT.replace("{n}", str(i)))) for i in range(6))
    assert got[10] == got[11] == ("", 0) and got[12] == ("lone <b>", 8)


def test_html_of_odd_pages():
    for page in ("<", "<p", "<!-- x", "<script>", "a<b>c</b>d", "</p></div>x", "<p>x" * 500, "<div>" * 500 + "x", '<a href="'):
        main_text(parsed(page))
    assert main_text(parsed("a<b>c</b>d"), 7) == "acd"
    assert main_text(parsed('<p title="a>b">x<p title="open>y<p>z')) == "x\n\ny\n\nz"
    assert main_text(parsed("1 < 2 <! x > &lt;b&gt; </> <p")) == "1 < 2 <b> <p"


@pytest.mark.parametrize(
    "tag", ["div class='content has-sidebar'", "div class=no-sidebar", "div class='comments-open'", "div id=search-results", "article class=related-topic",
            "div id='ad-free-content'", "form id=aspnetForm", "div class=sidebar-wrapper"],
)
def test_html_wrapper_with_the_page_is_no_side_part(tag):
    text = "A paragraph of the article that goes on for some time. " * 4
    page = f"<body><{tag}><div class=nav><a href=/>home</a></div><h1>Head</h1><p>{text}<div class='cookie-notice'>We use cookies</div></{tag.split()[0]}><footer>f</footer></body>"
    assert main_text(parsed(page)) == f"Head\n\n{text.strip()}"


def test_html_sections_of_an_article_keep_their_text_whatever_their_ids():
    text = "Long text about looking things up, with many words in it. " * 5
    page = f"<article><h1>Head</h1><section id=login><h2>Log in</h2><p>First do this.</p></section><section id=search><h2 class=title-search>Search</h2><p class=notice>{text}</p></section><div class=ad>buy</div></article>"
    assert main_text(parsed(page)) == f"Head\n\nLog in\n\nFirst do this.\n\nSearch\n\n{text.strip()}"


def test_html_texts_that_a_host_says_again_are_no_article(spark):
    """Boxes with names in other languages, beside and inside the article, and copies of one article."""

    def page(host, k, box="Kaufen Sie jetzt unsere neuen Schuhe im Laden", own="Hinweis: heute nur die halbe Zahl"):
        text = f"Article {k} of its host says what no other says, number {k * 7919 % 1000}. " * 6
        return f"<body><div class=werbung><p>{box}</p></div><div class=text><h1>Head {k}</h1><p>{text}</p><div class=kasten>{own}</div></div></body>", f"Head {k}\n\n{text.strip()}"

    pages, expected = [], {}
    for k in range(6):
        html, text = page("h", k)
        pages.append((k, "https://h.example/%d" % k, html))
        expected[k] = text
    # another text under the path of a box goes with the box
    html, text = page("h", 6, box="Something else")
    pages.append((6, "https://h.example/6", html))
    expected[6] = text
    # two pages of a host are no majority of three, and copies count once
    for k in (10, 11, 12, 13):
        html, text = page("two", 10 if k < 13 else 11)
        pages.append((k, "https://two.example/%d" % k, html))
        expected[k] = text
    rows = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(7):
        assert rows[k] == expected[k]
    for k in (10, 11, 12, 13):
        assert "Hinweis" in rows[k] and expected[k] in rows[k]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_side_parts_go_beside_an_article():
    side = "<div id=comments><article class=comment-body><p>" + "troll text " * 40 + "</article></div><aside><article>teaser</article></aside>"
    assert main_text(parsed(f"<article><p>Short text.</article>{side}")) == "Short text."
    assert on_page("<div class=sidebar><main><p>Text.</main></div><p>more") == ["Text.", "more"]
    teasers = "<aside><article>teaser</article></aside>"
    assert main_text(parsed(f"<div class=post><p>The text of the page.</div>{teasers}")) == "The text of the page."


def test_html_keeps_headline_and_lead_around_the_inner_container(spark):
    body = "<p>" + "body text of the entry " * 60 + "</p>"
    page = "<body><div class=links><a href=/>all the other pages of this site</a></div><div class=post><h1>Head</h1><p class=lead>Lead.</p><div class=entry>%s</div></div>"
    odd = "<body><div class=post><p>Small.</p></div><div class=story><h1>Own</h1>" + body + "</div>"
    pages = [(i, f"https://h.example/{i}", page % body) for i in range(5)] + [(9, "https://h.example/9", odd)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    text = ("body text of the entry " * 60).strip()
    assert all(got[i] == f"Head\n\nLead.\n\n{text}" for i in range(5))
    assert got[9].endswith(f"Own\n\n{text}")


@pytest.mark.parametrize("unit", ["<div>x", "<div ", "<a ", '<a b="', "<ul><li>x", "<script ", "<!--", "</p", "<div></p>", "<article><header><h1>x", "<", "<p><b>x<br>"])
def test_html_of_a_megabyte_takes_time_in_proportion(unit):
    start = time.process_time()
    main_text(parsed(unit * (1_000_000 // len(unit))), 5, {1: True})
    main_text(parsed("<p>" + unit * (200_000 // len(unit)) + '">'), 5, {1: True})
    assert time.process_time() - start < 8


def test_html_keeps_the_headline_of_an_article_with_a_header():
    page = "<header><h1>Site</h1></header><article><header><div><h1>Title</h1></div><p>by A<nav><h2>Menu</h2></nav></header><p>Body of it</article>"
    assert main_text(parsed(page)) == "Title\n\nBody of it"


def test_html_menu_by_links_beside_the_article_but_not_inside():
    links = "<ul>" + "<li><a href=x>some page</a>" * 4 + "</ul>"
    assert on_page(f"<body><div class=top>{links}</div><div class=post><p>{'Long text. ' * 30}</p>{links}</div>")[1:] == ["some page"] * 4
    assert on_page(f"<body>{links}") == ["some page"] * 4


def test_html_votes_of_the_host_change_pages(spark):
    prose = lambda n: "<p>" + "prose of some length " * n + "</p>"
    text = lambda n: ("prose of some length " * n).strip()
    # on host a, nearly all pages hold the article in a box named like a notice: one with a short article follows them
    box = "<body><div class='notice box'>%s</div><div class=rest>%s</div>"
    pages = [(i, "https://a.x/1", box % (prose(30), "<p>rest of it")) for i in range(5)] + [(5, "https://a.x/2", box % (prose(2), prose(3)))]
    # on host b, pages have few comments: one with more comments than text follows them
    talk = "<body><div class=post>%s</div><div class=comments>%s</div>"
    pages += [(10 + i, "https://b.x/1", talk % (prose(30), "<p>troll text")) for i in range(5)] + [(15, "https://b.x/2", talk % (prose(2), prose(9)))]
    pages += [(20, None, pages[5][2]), (21, "https://alone.x", pages[11][2]), (22, "https://lone.x", pages[5][2])]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[5] == f"{text(2)}\n\n{text(3)}" and got[20] == got[22] == text(3)
    assert got[15] == text(2) and got[10] == text(30) and got[21] == f"{text(2)}\n\n{text(9)}"


def brute_extraction(pages):
    """The query once more, with containers as tuples of ancestors and every sum taken anew."""
    found = {i: (u.split("/")[2] if u else "", parsed(h or "")) for i, u, h in pages}

    def chain(page, k):
        out = [k]
        while out[-1]:
            out.append(page.parent[out[-1]])
        return out

    def within(page, k):
        return [b for b in page.blocks if k in chain(page, b[0])]

    def weight(blocks):
        return sum(max(0, len(b[1]) - 2 * b[2]) for b in blocks)

    def verdicts(page):
        def article(k):
            for x in chain(page, k):
                if page.against[x]:
                    return ""
                if page.tag[x] in ("article", "main"):
                    return page.tag[x]
            return ""

        doubted = lambda k: any(page.against[x] for x in chain(page, k))
        plain = weight([b for b in page.blocks if not doubted(b[0])])
        outside = any(article(b[0]) and not doubted(b[0]) and weight([b]) for b in page.blocks)
        total, chars = weight(page.blocks), sum(len(b[1]) for b in page.blocks)
        out = []
        for k in range(1, len(page.tag)):
            own = within(page, k)
            mine = [b for b in own if article(b[0]) and weight([b])]
            holds = not outside and (any(article(b[0]) == "main" for b in mine) or weight(mine) > plain or 2 * weight(own) > total)
            most = any(page.tag[x] not in ("html", "body", "") and (2 * weight(within(page, x)) > total or 2 * sum(len(b[1]) for b in within(page, x)) > chars) for x in chain(page, k))
            size, linked, links = (sum(x) for x in zip(*((len(b[1]), b[2], b[3]) for b in own))) if own else (0, 0, 0)
            menu = page.tag[k] not in ("html", "body") and not article(k) and not most and links >= 3 and 4 * linked >= 3 * size
            out.append(menu or page.against[k] and not holds)
        return [False, *out]

    votes, scores, own = defaultdict(list), defaultdict(Counter), {}
    for i, (host, page) in found.items():
        own[i] = defaultdict(set)
        off = verdicts(page)
        for k in range(1, len(off)):
            if within(page, k):
                own[i][page.path[k]].add(off[k])
        if host:
            for path, kinds in own[i].items():
                if len(kinds) == 1:
                    votes[host, path] += kinds
            scores[host].update(dict(scored_containers(page, [b for b in page.blocks if not any(off[x] for x in chain(page, b[0]))])))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    out = {}
    for i, (host, page) in found.items():
        off = verdicts(page)
        for k in range(1, len(off)):
            cast = votes.get((host, page.path[k]), [])
            if len(own[i][page.path[k]]) == 1 and 0 < sum(cast) < len(cast):
                off[k] = 2 * sum(cast) > len(cast)
        blocks = [b for b in page.blocks if not any(off[x] for x in chain(page, b[0]))]
        top = max(scores[host].items(), key=lambda x: (x[1], signed(x[0])))[0] if host and scores[host] else None
        best = next((p for p, _ in scored_containers(page, blocks)), None)
        under = lambda p: [b for b in blocks if p is not None and any(page.path[x] == p for x in chain(page, b[0]))]
        pick = under(best) if 4 * weight(under(top)) < 3 * weight(under(best)) else under(top)
        out[i] = "\n\n".join(b[1] for b in pick or under(best) or blocks)
    return out


def test_html_extraction_against_a_plain_restatement(spark):
    rng = random.Random(12)
    tags = ["div", "div class=post", "div class='box notice'", "div class=comments", "section", "article", "main", "aside", "ul", "header", "div class=c7", "form"]

    def part(depth):
        if depth == 0 or rng.random() < 0.35:
            words = " ".join(rng.choice(["alpha", "be", "gamma &amp; co", "de la"]) for _ in range(rng.randrange(1, 40)))
            return rng.choice([f"<p>{words}", f"<h1>{words}</h1>", f"<p><a href=x>{words}</a>" * rng.choice([1, 3])])
        tag = rng.choice(tags)
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag.split()[0]}>"

    pages = [(i, rng.choice(["https://a.x/1", "https://b.x/q", None]), "<html><body>" + "".join(part(4) for _ in range(rng.randrange(1, 4)))) for i in range(150)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extract_main_text(rows).collect()}
    expected = brute_extraction(pages)
    assert got == expected
    assert sum(main_text(parsed(h)) != got[i] for i, _, h in pages) > 5
