"""Operators that learn: held-out accuracy, and behaviour on nulls, empties and small tables."""

import random

import pytest

from siteloom.llm.language import identify_languages, train_grams
from siteloom.llm.quality import accepted, fit_ordinal, graded, train_quality


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_on_held_out_documents(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("the", "on", "in") for b in ("re", "ti", "ou") for c in ("an", "er", "st", "ly")]
    docs, labels = [], []
    for i in range(1200):
        n = rng.randrange(5, 120)
        text, quality, toxic = sentence(rng, n, words), 1, 0
        if i % 4 == 1:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif i % 4 == 2:
            text, toxic = text + " " + rng.choice(["scumlot", "idiotic", "trashy"]) + " " + sentence(rng, 5, words), 1
        docs.append((i, text, "c"))
        if i < 800:
            labels.append((i, quality, toxic))
    docs += [(5000, None, "c"), (5001, "", "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    model = train_quality(d, spark.createDataFrame([*labels, (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    kept = accepted(d, model, 0.8)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    held = range(800, 1200)
    assert sum((i in ids) == (i % 4 in (0, 3)) for i in held) / len(held) > 0.97
    rows = graded(d.select("doc_id", "text"), model, keep_text=False).select("quality.*").collect()
    assert len(rows) == len(docs) and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    none = train_quality(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert accepted(d.limit(0), none).count() == 0


def test_ordinal_fit_without_rows():
    import numpy as np

    assert fit_ordinal([], np.zeros(0, np.int64), 16).weights == {}


LANGS = {"aa": ["kirat", "monso", "beliu", "tarki"], "bb": ["wezhe", "quaff", "xylem", "jinxy"], "cc": ["öbern", "süßer", "grüße", "häuse"]}


def test_language_identification(spark):
    rng = random.Random(4)
    docs = [(i, sentence(rng, 30, LANGS[lang]), lang) for i in range(60) for lang in [sorted(LANGS)[i % 3]]]
    model = train_grams(spark.createDataFrame([*docs, (99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string"))
    pages, truth = [], {}
    for i in range(90):
        lang = sorted(LANGS)[i % 3]
        truth[i] = lang
        body = sentence(rng, rng.choice([0, 3, 40]), LANGS[lang])
        pages.append((i, f"http://www.{lang}.example.com/{i}", f'<html lang="{lang}"><script>xylem</script><p>{body}</p>', "z"))
    pages += [(200, None, None, "z"), (201, "not a url", "", "z"), (201, "not a url", "", "z")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string, lang string")
    rows = identify_languages(p, model).collect()
    assert len(rows) == len(pages) and all(0 < r.p_lang <= 1 + 1e-9 for r in rows)
    assert sum(r.lang == truth[r.page_id] for r in rows if r.page_id in truth) == 90
    assert identify_languages(p.limit(0), model).count() == 0


def plain_features(text):
    """What a text shows, character by character."""
    words, word = set(), ""
    for c in text.lower() + " ":
        if c.isalnum() and not c.isdigit() and not c.isnumeric() or c.isalpha():
            word += c
        elif word:
            words.add(word)
            word = ""
    found = set(words)
    for w in words:
        found |= {f"^{w[:k]}" for k in (4, 5) if len(w) > k}
    run = ""
    for c in text + " ":
        if not (c.isalnum() or c == "_" or c.isspace()):
            run += c
        else:
            if len(run) > 1:
                found.add("!" + run[:3])
            run = ""
    raw = text.split()
    if len(raw) >= 8:
        share = lambda hits: sum(hits) / len(raw)
        found |= {
            f"~distinct{int(10 * len(set(raw)) / len(raw))}", f"~upper{int(5 * share(w.isupper() for w in raw))}",
            f"~bare{int(5 * share(not any(c.isalnum() for c in w) for w in raw))}", f"~marked{int(5 * share(not w[-1].isalnum() for w in raw))}",
            f"~same{int(10 * share(a == b for a, b in zip(raw, raw[1:])))}",
        }
    return found


def test_quality_query_by_plain_python(spark):
    """Features, their selection, scores and acceptance restated; the fit itself is held against an optimiser elsewhere."""
    import math
    import random

    from xxhash import xxh32_intdigest

    from siteloom.llm.quality import accepted, features_of, graded, train_quality

    rng = random.Random(9)
    calm = [f"{a}{b}" for a in ("cal", "mor", "sen", "lí") for b in ("da", "ten", "ous", "er")]
    texts, grades = {}, {}
    for k in range(400):
        words = [rng.choice(calm) for _ in range(rng.randrange(3, 60))]
        grade = k % 3
        if grade == 0:
            words = [w.upper() + rng.choice(["!!", "?!?", "", "$$"]) for w in words]
        if grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["grump", "grumpy", "zlork"])
        texts[k], grades[k] = " ".join(words), grade
    for text in [*texts.values(), "", "a", "x_y 12 é--ü ...", "word " * 9, "A1 B2 -- C3 !! D4 ?? E5 ;; F6"]:
        assert features_of(text) == plain_features(text)
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, g in grades.items() if k % 4], "doc_id long, quality int, toxic int")
    size = 1 << 18
    model = train_quality(docs, labels, size=size)
    slots = {k: {xxh32_intdigest(f) % size for f in plain_features(t)} for k, t in texts.items()}
    rated = [k for k in texts if k % 4]
    chosen = set()
    for s in set().union(*(slots[k] for k in rated)):
        having = [k for k in rated if s in slots[k]]
        moved = z = 0.0
        for level in (0, 1):
            share = sum(grades[k] <= level for k in rated) / len(rated)
            more = sum(grades[k] <= level for k in having) - len(having) * share
            moved, z = max(moved, abs(more) / len(having)), max(z, abs(more) / math.sqrt(len(having) * share * (1 - share)))
        if len(having) >= 5 and z > 4 and moved >= 0.3:
            chosen.add(s)
    assert len(chosen) <= 512 and set(model.weights) == chosen
    below = lambda score, k: 1 / (1 + math.exp(-max(-35.0, min(35.0, model.thresholds[k] - score))))
    kept = {r.doc_id for r in accepted(docs, model, 0.8).collect()}
    for r in graded(docs.drop("score"), model, keep_text=False).collect():
        score = sum(model.weights.get(s, 0.0) for s in slots[r.doc_id])
        assert r.quality.score == pytest.approx(score) and r.quality.p_top == pytest.approx(1 - below(score, 1))
        assert r.quality.expected_grade == pytest.approx(2 - below(score, 0) - below(score, 1))
        assert (r.doc_id in kept) == (r.quality.p_top >= 0.8)
    assert sum((grades[k] == 2) == (k in kept) for k in texts if k % 4 == 0) > 70
