"""Ranked search and the conversation trie against brute force, the toxicity classifier by held-out accuracy and its optimum."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import ranked_search as search
from siteloom.llm.prefix_trie import conversation_trie, rebuilt, turn_sequences
from siteloom.llm.ranked_search import Collection, Shard, ranked_search, variable_blocks
from siteloom.llm.toxicity import ToxicityModel, fit_linear, grams_of, remainder, scored, train_toxicity


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute_search(docs, items, most=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    out = []
    for item, text in items:
        scores = []
        for i, tf, n in held:
            score, m = 0, 10 + (90 * n * n_docs) // n_terms
            for t in set(terms(text)):
                df = sum(t in c for _, c, _ in held)
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scores)[:most], 1):
            out.append((item, rank, i if known else None, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_docs": 16, "block_terms": 20}])
def test_ranked_search(spark, options):
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 20, 200])))) for k in range(150)]
    docs += [(1000 + k, "same text, Same TEXT") for k in range(15)] + [(None, "same text w1"), (None, None), (7, "w1 w2 repeated id")]
    docs += [(2000, ""), (2001, "?! ..."), (2002, "é-É ünï w1 " * 2000), (2003, None)]
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 8, 40])))) for k in range(12)]
    items += [(50, "same"), (51, ""), (52, None), (53, "never seen"), (54, "W1 w1 é É"), (None, "w2 w3"), (1, "w5 second row of an id")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in ranked_search(d, q, **options).collect()), key=str)
    assert got == brute_search(docs, items)
    assert ranked_search(d.limit(0), q).count() == 0 and ranked_search(d, q.limit(0)).count() == 0


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(1)
    lists = [rng.integers(1, 1000, n) for n in (1, 2, 7, 12, 12)] + [np.repeat([5, 900], 6)]
    for values, ends in zip(lists, variable_blocks(lists, block_cost=2.0, widest=6)):
        n, price = len(values), 2.0 * values.mean()
        cost = lambda cuts: sum((b - a) * values[a:b].max() + price for a, b in zip([0, *cuts], cuts))
        every = []
        for mask in range(1 << (n - 1)):
            cuts = [i for i in range(1, n) if mask >> (i - 1) & 1] + [n]
            if max(b - a for a, b in zip([0, *cuts], cuts)) <= 6:
                every.append(cost(cuts))
        assert cost(ends.tolist()) == pytest.approx(min(every))
    long = [rng.integers(1, 10**6, 5000), np.full(3000, 7)]
    for values, ends in zip(long, variable_blocks(long)):
        assert ends[-1] == len(values) and (np.diff(ends) > 0).all()


def test_search_skips_blocks_and_stays_exact():
    rng = random.Random(8)
    texts = [[f"t{int(rng.expovariate(0.02))}" for _ in range(30)] for _ in range(3000)]
    for k in range(12):
        texts[k * 200] = ["gem"] * (k + 5) + ["t1"]
    counts = [Counter(t) for t in texts]
    lengths = np.array([len(t) for t in texts])
    whole = Collection(len(texts), int(lengths.sum()))
    row = search._shard_row(0, lengths, [list(c) for c in counts], [list(c.values()) for c in counts], whole)
    shard = Shard(row, whole)
    weights = {t: 1 + k % 5 for k, t in enumerate(row["terms"])}
    query = [(t, weights[t] * (40 if t == "gem" else 1)) for t in ("gem", "t1", "t5", "t9", "t40", "t200") if t in weights]
    places, scores, looked = shard.best(query, 10)
    m = whole.length_part(lengths)
    brute = [sum(w * int((10**9 * c[t]) // (1000 * c[t] + 8 * m[i])) for t, w in query if c[t]) for i, c in enumerate(counts)]
    best = sorted(range(len(brute)), key=lambda i: (-brute[i], i))[:10]
    assert places.tolist() == best and scores.tolist() == [brute[i] for i in best]
    assert looked < 0.7 * len(shard.stretches([(shard.number[t], w) for t, w in query])[0])


def brute_trie(rows, rebuild=True):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in under if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(key)))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            sum(len(k) == len(key) + 1 and k[: len(key)] == key for k in nodes), len(leaves),
            sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in under if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("local", [1, 3, 4096])
def test_conversation_trie(spark, local):
    rng = random.Random(local)
    rows = []
    for c in range(60):
        first = rng.choice(["hello", "hé", ""])
        turns = [first, *(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 7])))]
        turns = ["long", "shared", "head", "of", "many", "turns", "and", "more", rng.choice("xyz")] if c % 4 == 0 else turns
        rows += [(c, k, "user" if k % 2 == 0 else None, t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"copy {k}") for c in range(100, 130) for k in range(4)]
    rows += [(None, 0, "user", "lost"), (200, None, "user", "null turn first"), (200, 0, None, None), (200, 0, "user", "tie"), (200, 0, "user", "tie")]
    rows += [(-3, 1, "user", "negative"), (2**40 + 1, 0, "user", "t" * 100_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    sequences = turn_sequences(table)
    got = sorted((tuple(r) for r in conversation_trie(rebuilt(sequences), local=local).collect()), key=str)
    assert got == brute_trie(rows)
    if local == 3:
        got = sorted((tuple(r) for r in conversation_trie(sequences, local=local, small=0).collect()), key=str)
        assert got == brute_trie(rows, rebuild=False)
        assert conversation_trie(turn_sequences(table.limit(0)), local=local).count() == 0


def test_toxicity_by_held_out_accuracy(spark):
    rng = random.Random(4)
    syllables = ["ba", "ko", "ri", "tu", "len", "mos", "da", "ve", "sil"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(1500):
        text = [word() for _ in range(rng.choice([5, 30, 200, 900]))]
        toxic = k % 6 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["grump", "fool", "zlork"]) + rng.choice(["", *syllables]))
        docs.append((k, " ".join(text), "l", 0.5))
        labels.append((k, int(toxic)))
    docs += [(5000, None, None, None), (5001, "", "", None), (None, "calm " * 200_000, "", None), (None, "ba ko", "", 1.0), (3, "twice an id", "", 1.0)]
    labels += [(None, 1), (9, None), (7, 0), (99_999, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxicity string, score double")
    m = train_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = scored(d.withColumn("fold", remainder(F.col("doc_id"))), m).toDF("doc_id", "text", "t", "s", "fold", "p").collect()
    assert len(rows) == len(docs) and all(0 <= r.p <= 1 for r in rows)
    assert all(r.fold == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.fold == 0 and r.doc_id is not None and r.doc_id < 1500 and r.text != "twice an id"]
    assert len(held) > 200
    assert sum((r.p >= 0.5) == (truth[r.doc_id] == 1) for r in held) >= 0.97 * len(held)
    empty = [r.p for r in rows if not r.text]
    assert len(set(empty)) == 1 and empty[0] < 0.5
    # labels of the held-out fold are not read
    turned = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    assert train_toxicity(d, turned) == m
    assert scored(d.limit(0), m).count() == 0
    assert train_toxicity(d, turned.where("toxic = 1")).score(set()) > 0.9
    assert train_toxicity(d.limit(0), turned.limit(0)).score(set()) == 0.5


def test_toxicity_counts_and_fit():
    rng = np.random.default_rng(0)
    x = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    toxic = np.array([int(3 in c) if rng.random() < 0.9 else int(rng.random() < 0.5) for c in x])
    ratios, weight, ridge = np.array([0.1, -0.2, 0.3, 2.0, -1.0, 0.05]), 1 + toxic, 1e-3
    bias, weights = fit_linear(x, toxic, weight.astype(float), ratios, ridge)
    dense = np.zeros((300, 6))
    for i, c in enumerate(x):
        dense[i, c] = 1
    p = 1 / (1 + np.exp(-(dense @ weights + bias)))
    slope = ratios * (dense.T @ (weight * (p - toxic))) / weight.sum() + ridge * weights / ratios
    assert np.abs(slope).max() < 1e-4 and abs((weight * (p - toxic)).sum() / weight.sum()) < 1e-4
    assert grams_of("ab") == {"<ab>"} and grams_of("a") == {"<a>"} and grams_of("abc") == {"<abc", "abc>", "<abc>"}
    assert ToxicityModel(0.0, {"<ab>": 1.0}).score({"<ab>"}) == pytest.approx(1 / (1 + math.exp(-1)))


def test_toxicity_counts_match_brute_force():
    from siteloom.llm.toxicity import GramCounter

    texts = [(1, "Fool fools"), (0, "good fool"), (0, ""), (1, None), (1, "fool")]
    counter, brute = GramCounter(), {}
    for label, text in texts:
        counter.add(label, text)
        for g in set().union(*(grams_of(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower()))):
            brute.setdefault(g, [0, 0])[label] += 1
    batch = counter.take()
    assert {g: [c, t] for g, t, c in zip(*(col.to_pylist() for col in batch.columns))} == brute
