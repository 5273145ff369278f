"""Operators restated in plain Python: token counts by the tokenizers library, Pfair slots, the ordinal fit, language evidence."""

import math
import random
import re
import time
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.language import _grams, identify_languages, train_grams, visible
from siteloom.llm.mixing import mix
from siteloom.llm.quality import fit_ordinal
from siteloom.llm.token_counts import PieceCounter, count_tokens, load_pieces, token_counts


@pytest.fixture(scope="module")
def unigram():
    path = str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = load_pieces(path)
    unknown = next(i for i, (p, _) in enumerate(pieces) if p == "<unk>")
    library = Tokenizer(models.Unigram(pieces, unk_id=unknown, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return path, pieces, lambda t: len(library.encode(t, add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, unigram):
    path, pieces, expected = unigram
    rng = random.Random(1)
    letters = "aeinrst  ▁.,-\n\t0123éßñЖ漢😀́<>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [" ", "  ", "▁", "a", " a", "a ", "a  b", "<unk>", "<s> </s>", "<0x41>", "aaaaaaaaaaaaaaaa" * 40, "the of and " * 300, "漢" * 3000, "x" * 20_000]
    counter = PieceCounter(pieces)
    assert [counter.count(t) for t in texts] == [expected(t) for t in texts]
    docs = [(i, t, 5) for i, t in enumerate(texts[:200])] + [(900, None, 5), (901, "", 5), (0, texts[0], 5), (None, texts[1], 5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, n_pieces int")
    got = [tuple(r) for r in count_tokens(rows, path).collect()]
    assert sorted(got, key=repr) == sorted([(i, expected(t) if t else 0, len(t or "")) for i, t, _ in docs], key=repr)
    assert token_counts(rows, pieces).columns == ["doc_id", "n_pieces", "n_pieces"]
    assert count_tokens(rows.limit(0), path).count() == 0


def test_token_counts_of_equal_scores_and_a_full_cache(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    from siteloom.llm import token_counts as module

    # many segmentations score the same
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("aab", -3.0), ("▁", -1.0), ("▁a", -2.0), ("bb", -1.5)]
    pieces += [(f"<0x{k:02X}>", -9.0) for k in range(256)]
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    rng = random.Random(2)
    monkeypatch.setattr(module, "_CACHE_CHARS", 40)
    counter = PieceCounter(pieces)
    for _ in range(800):
        text = "".join(rng.choice("aab b é") for _ in range(rng.randrange(1, 14)))
        assert counter.count(text) == len(library.encode(text).ids), text
    assert sum(map(len, counter.known)) <= 40
    with pytest.raises(ValueError, match="across word ends"):
        PieceCounter([("a▁b", -1.0)])


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 0.3, None: 2.5}])
def test_mix_slot_by_slot(spark, weights):
    """Every prefix of the slots against the ideal flow, restated event by event, and every source's rows in their order."""
    rng = random.Random(4)
    docs = [(rng.randrange(300), rng.choices(["a", "b", "c", None], [6, 2, 1, 1])[0]) for _ in range(500)] + [(None, "a"), (None, "a")]
    rows = spark.createDataFrame(docs, "doc_id long, source string").repartition(3)
    got = mix(rows, weights=weights, block_rows=6, stretch=25).select("source", F.xxhash64("doc_id", "source").alias("h"), "mix.*").collect()
    sizes = {s: sum(x == s for _, x in docs) for _, s in docs}
    share = {s: Fraction(float(n) ** 0.9 if weights is None else weights[s]) for s, n in sizes.items()}
    units = {s: -(-n // 3) for s, n in sizes.items()}
    assert len(got) == len(docs)
    order = {r.slot: r.source for r in got}
    assert sorted(order) == list(range(sum(units.values())))
    had, flow = dict.fromkeys(units, 0), dict.fromkeys(units, Fraction(0))
    for slot in range(len(order)):
        had[order[slot]] += 1
        left = Fraction(1)
        while left:
            alive = [s for s in units if flow[s] < units[s]]
            total = sum(share[s] for s in alive)
            step = min([left / total, *((units[s] - flow[s]) / share[s] for s in alive)])
            for s in alive:
                flow[s] += step * share[s]
            left -= step * total
        assert all(abs(had[s] - flow[s]) < 2 for s in units)
    for s in sizes:
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.slot, r.position))
        assert [(r.block, r.position) for r in own] == [(k // 6, k % 3) for k in range(sizes[s])]
        assert [r.h for r in own] == sorted(r.h for r in own)


def test_ordinal_fit_is_near_the_optimum():
    rng = np.random.default_rng(3)
    n, d, size = 1500, 6, 64
    x = rng.random((n, d)) < 0.4
    score = x @ np.array([3.0, -2.5, 2.0, -3.0, 1.5, 0.0]) + rng.logistic(size=n)
    grades = (score > -1).astype(int) + (score > 2)
    rows = [np.flatnonzero(r) for r in x]
    model = fit_ordinal(rows, grades, size, shift=0.0, ridge=1e-3, steps=3000)
    used = sorted(model.weights)
    assert len(used) >= 4 and model.thresholds[0] < model.thresholds[1]

    def loss(p):
        below = 1 / (1 + np.exp(-(p[len(used) :][None, :] - (x[:, used] @ p[: len(used)])[:, None])))
        cumulative = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        return -np.log(np.diff(cumulative)[np.arange(n), grades]).mean() + 5e-4 * (p[: len(used)] ** 2).sum()

    p = np.array([model.weights[k] for k in used] + model.thresholds)
    # a plain optimiser: steps along numeric slopes, halved until they help
    best, at = loss(p), p.copy()
    for _ in range(200):
        slope = np.array([(loss(at + e) - loss(at - e)) / 2e-5 for e in 1e-5 * np.eye(len(at))])
        step = 1.0
        while step > 1e-6 and loss(at - step * slope) >= loss(at):
            step /= 2
        at = at - step * slope if step > 1e-6 else at
    assert loss(at) > best - 5e-4 and np.abs(at - p).max() < 0.2


LANGS = {"aa": ["kirat", "monso", "beliu", "tarki"], "bb": ["wezhe", "quaff", "xylem", "jinxy"]}


def plain_languages(pages, langs, table, strength=5.0, trigrams=40.0):
    rows = []
    for i, url, html in pages:
        host = (re.match(r"[a-z]+://([^/]*)", url or "") or ["", ""])[1].lower()
        tag = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", html or "")
        declared = "" if not tag else tag[1].lower() if tag[1].lower() in langs else "other"
        last = (re.search(r"\.([a-z]+)$", host) or ["", ""])[1]
        path = (re.match(r"(?i)^[a-z]+://[^/]*/([a-z]{2})(?:/|$)", url or "") or ["", ""])[1].lower()
        suffix = f"/{path}" if path in langs else last if len(last) == 2 else ""
        labels = host.split(".")
        keep = 3 if len(labels) > 2 and len(last) == 2 and labels[-2] in ("co", "com", "org", "net", "gov", "ac", "edu") else 2
        domain = host if re.match(r"^[0-9.]+$", host) else ".".join(labels[-keep:]) if len(labels) > 1 else ""
        grams = _grams(re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html or "").encode())
        log = table[:, grams].sum(axis=1) * (min(1.0, trigrams / len(grams)) if len(grams) else 0.0)
        rows.append((i, host, domain, last, declared, suffix, log - log.max()))
    soft = [np.round(1e6 * np.exp(r[-1]) / np.exp(r[-1]).sum()) / 1e6 for r in rows]

    def sums(*keys):
        out = defaultdict(lambda: np.zeros(len(langs)))
        for r, s in zip(rows, soft):
            out[tuple(r[k] for k in keys)] += s
        return out

    base = sum(soft)
    smooth = lambda own, above: (own + strength * above) / (own.sum() + strength)
    hosts, domains, tlds = sums(3, 2, 1), sums(3, 2), sums(3)
    top = (base + 1) / (base + 1).sum()
    found = {}
    for r in rows:
        logs = r[-1] + np.log(smooth(hosts[r[3], r[2], r[1]], smooth(domains[r[3], r[2]], smooth(tlds[r[3],], top))))
        for k in (4, 5):
            seen = sums(k)
            logs = logs + (np.log((seen[r[k],] + 0.5) / (base + 0.5 * len(seen))) if r[k] else 0)
        found[r[0]] = (langs[int(np.argmax(np.round(logs, 9)))], float(np.exp(logs - logs.max()).max() / np.exp(logs - logs.max()).sum()))
    return found


def test_language_evidence_against_a_plain_restatement(spark):
    rng = random.Random(6)
    say = lambda lang, n: " ".join(rng.choice(LANGS[lang]) for _ in range(n))
    docs = [(i, say(lang, 20), lang) for i in range(40) for lang in [sorted(LANGS)[i % 2]]]
    langs, table = train_grams(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    hosts = ["www.a.co.uk", "b.co.uk", "x.example.de", "y.example.de", "10.0.0.1", "10.0.0.2", "plain.com"]
    pages = []
    for i in range(160):
        host = rng.choice(hosts)
        lang = "aa" if rng.random() < (0.9 if host[0] in "wx1" else 0.2) else "bb"
        said = rng.choice([f' lang="{lang}"', ' lang="zz"', "", ""])
        body = say(lang, rng.choice([0, 0, 1, 8])) + rng.choice(["", " " + say(rng.choice(sorted(LANGS)), 2)])
        pages.append((i, f"http://{host}/{rng.choice([lang, 'q', 'x1'])}/{i}", f"<html{said}><head>xylem</head><p>{body}<!-- tarki -->"))
    pages += [(900, None, "<p>" + say("aa", 3)), (901, "http://www.a.co.uk", None), (902, "", "")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in identify_languages(rows, (langs, table)).collect()}
    expected = plain_languages(pages, langs, table)
    assert {i: r.lang for i, r in got.items()} == {i: e[0] for i, e in expected.items()}
    assert all(abs(r.p_lang - expected[i][1]) < 1e-6 for i, r in got.items())
    # pages without text get both languages from what stands beside it
    assert {r.lang for r in got.values() if r.text_lang is None} == set(LANGS)


def test_language_of_pages_without_a_model(spark):
    empty = train_grams(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "http://a.b/c", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    got = identify_languages(rows, empty).collect()
    assert [(r.page_id, r.lang, r.p_lang, r.text_lang) for r in got] == [(1, None, None, None), (2, None, None, None)]


def test_language_ties_go_to_the_first_by_name(spark):
    model = (["aa", "bb"], np.log(np.full((2, 1 << 14), 1 / (1 << 14))))
    rows = spark.createDataFrame([(1, "http://a.b/c", "<p>some text"), (1, "http://a.b/c", "<p>some text")], "page_id long, url string, html string")
    assert [(r.lang, r.text_lang) for r in identify_languages(rows, model).collect()] == [("aa", None)] * 2


def test_visible_text_in_one_pass():
    old = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(9)
    bits = ["<script>", "</script>", "<style a=1>", "</STYLE >", "<head>", "</head>", "<header>", "<!-- ", "-->", "<p>", "x y", "<", ">", "é"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert visible(page) == old.sub(" ", page), page
    start = time.process_time()
    for unit in ("<script ", "<!-- ", "<", "<style><head>", "<p>x"):
        visible(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 5
