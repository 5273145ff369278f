"""Operators with exact results, against brute force on small tables with nulls, empties, copies, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm.dac import Packed, pack
from siteloom.llm.decontaminate import contamination_report, decontaminate
from siteloom.llm.exact_dedup import exact_dedup
from siteloom.llm.mixing import Flow, mix, mixed_to_weights, pfair_stretch, quotas
from siteloom.llm.ngram_join import near_duplicates
from siteloom.llm.pii import personal_data, sanitised

DOC = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = ["a", "b", "a", None, "", "A", "a ", "é", "b"]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "a", "x", 7)], f"{DOC}, keep_id string, _digest int")
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 1)) if weak else None
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, digest=digest).collect()}
    groups = {}
    for i, t in [*enumerate(texts), (None, "a")]:
        groups.setdefault(t or "", []).append(i)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = {t: max(i for i in ids if i is not None) for t, ids in groups.items()}
    assert got == {(i, best[t], len(ids), i == best[t], sha(t)) for t, ids in groups.items() for i in ids}
    assert exact_dedup(docs.limit(0)).count() == 0


def brute_components(docs):
    sets, links = {}, {i: {i} for i in docs}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in docs:
        seen, ahead = {i}, [i]
        while ahead:
            new = links[ahead.pop()] - seen
            seen |= new
            ahead += new
        out[i] = (len(sets[i]), min(seen))
    return out


def test_near_duplicates_of_ids_at_the_ends_of_the_range(spark):
    top, text = 2**63 - 1, " ".join(f"w{k}" for k in range(50))
    docs = [(top, text), (top, "another text of six words here"), (-(2**63), text + " more"), (5, "Another text of six words here"), (None, text)]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()), key=repr)
    low = -(2**63)
    assert got == sorted([(top, 46, low), (top, 2, 5), (low, 47, low), (5, 2, 5), (None, 46, low)], key=repr)


def test_near_duplicates(spark):
    rng = random.Random(5)
    docs, passage = {}, words(rng, 60)
    for base in range(12):
        text = words(rng, rng.choice([4, 5, 30, 120, 300])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            docs[len(docs)] = " ".join(copy) if base % 3 else passage + " " + " ".join(copy)
    chain = words(rng, 200).split()
    for k in range(8):  # each links with the next only
        docs[100 + k] = " ".join(chain[10 * k : 10 * k + 110])
    docs |= {200: None, 201: "", 202: " \t", 203: "One two", 204: "oNE\ntwo", 205: "one two three", 206: passage, 207: passage.upper()}
    rows = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], f"{DOC}, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    assert got == brute_components(docs)
    small = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows, common=3, small=0).collect()}
    assert small == got
    assert near_duplicates(rows.limit(0)).count() == 0


def test_near_duplicates_with_null_ids(spark):
    rng = random.Random(6)
    base = words(rng, 200, 5000)
    same = base.split()
    near = " ".join([*same[:190], "new", *same[191:]])
    lone = words(rng, 40, 5000)
    # rows without an id come first in the task, and one has a set of its own
    docs = [(None, base), (None, near), (None, lone), (None, None), (4, base), (7, near), (9, words(rng, 40, 5000)), (None, near)]
    rows = spark.createDataFrame(docs, DOC).coalesce(1)
    got = [(r.doc_id, r.component_id) for r in near_duplicates(rows).collect()]
    assert sorted(got, key=repr) == sorted([(None, 4)] * 3 + [(None, None)] * 2 + [(4, 4), (7, 4), (9, 9)], key=repr)


def test_near_duplicates_of_repeated_ids_go_by_row(spark):
    rng = random.Random(7)
    a, b, c, d = (words(rng, 60, 5000) for _ in range(4))
    docs = [(1, a), (7, a + " more"), (7, b), (7, b), (5, c), (5, d), (9, d + " more"), (4, b + " more"), (None, d), (5, None)]
    rows = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], f"{DOC}, _key string, component_id int")
    # two texts of id 5: one stands alone, one is linked with 9; ids name components, the least of their rows
    expected = [(1, 57, 1), (7, 56, 4), (7, 56, 4), (7, 57, 1), (5, 56, 5), (5, 56, 5), (9, 57, 5), (4, 57, 4), (None, 56, 5), (5, 0, 5)]
    expected = sorted([(1, 56, 1), *expected[1:]], key=repr)
    assert sorted(map(tuple, near_duplicates(rows).collect()), key=repr) == expected


@pytest.mark.parametrize("size", [150])
def test_near_duplicates_of_a_hot_group_with_far_copies(spark, size):
    rng = random.Random(11)
    base, docs = words(rng, size, 10**6).split(), {}
    for i in range(160):  # copies with few and with many words of their own, around the least similarity
        copy = list(base)
        for p in rng.sample(range(size), rng.choice([0, 1, 2, 3, 4, 4, 5, 6, 8])):
            copy[p] = f"x{rng.random()}"
        docs[i] = " ".join(copy[: size - rng.choice([0, 0, 3])])
    rows = spark.createDataFrame(list(docs.items()), DOC).repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(rows).collect()} == brute_components(docs)


def brute_report(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, text in docs:
        w, hit, seen = cut(text), set(), set()
        for item, t in items:
            v = cut(t)
            n = min(10, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        seen.add(str(item))
        out[i] = (len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize(("block", "small"), [(1_000_000, 9), (7, 1000), (7, 0)])
def test_decontamination(spark, block, small):
    rng = random.Random(3)
    items = [(k, words(rng, n)) for k, n in enumerate([3, 10, 12, 40, 40, 9])] + [(10, None), (11, "--"), (2, "éa ÉA 7")]
    parts = [t for _, t in items if t]
    docs = [(i, " ".join([words(rng, rng.randrange(20)), rng.choice(parts).upper(), words(rng, 5), rng.choice(parts)[5:]])) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "plain words"), (93, parts[3] + "\n" + parts[3]), (93, parts[3] + "\n" + parts[3]), (None, parts[4])]
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], f"{DOC}, found string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in contamination_report(d, b, block_windows=block, small=small).collect()}
    expected = brute_report(docs, items)
    assert got == expected
    kept = decontaminate(d, b, block_windows=block, small=small)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in expected.items() if not r[4]}
    cleaned = [(r.doc_id, r.text) for r in decontaminate(d, b, remove="spans", block_windows=block, small=small).collect()]
    assert len(cleaned) == len(docs) and dict(cleaned)[92] == "plain words" and dict(cleaned)[90] is None
    assert contamination_report(d.limit(0), b).count() == 0 and not any(r.contaminated for r in contamination_report(d, b.limit(0)).collect())


def test_dac_round_trip():
    rng = np.random.default_rng(1)
    for top, n in ((200, 5000), (60_000, 5000), (2**32 - 1, 3000), (1, 0), (70_000, 1)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        packed = Packed(pack(ids))
        assert len(packed) == n and (packed.all() == ids).all()
        assert all(packed[i] == ids[i] for i in range(0, n, 37))


def brute_pii(text):
    def luhn(d):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (_, p, ok) in enumerate(kinds)]
    listed = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(x for f in found for x in f))
    return (*map(len, found), hashlib.sha256(listed.encode()).hexdigest())


def test_personal_data(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "_x@d.e", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111", "+1 (234) 567-890", "+12", "é", "𝒳", " ", ",", "@", "..", "9"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(150)]
    texts += [None, "", "1" * 5000, " ".join(f"u{i}@m{i % 7}.com" for i in range(300)), "a" * 3000 + "@" + "b.c" * 200]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)], f"{DOC}, spans int")
    got = personal_data(rows).collect()
    assert len(got) == len(texts) + 1
    assert all(tuple(r)[1:6] == brute_pii(texts[r.doc_id] or "") for r in got)
    assert personal_data(rows.limit(0)).count() == 0


def filler(k):
    """Words that no other text has, so that texts are no near copies."""
    return " ".join(f"fill{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}{'abcdefghij'[j % 10]}{'abcdefghij'[j // 10]}" for j in range(40))


def test_sanitisation_removes_telling_terms(spark):
    ws = ["red", "blue", "green", "odd"]
    docs = [(i, f"call zorblat at z@q.io for {w} things {filler(i)}") for i, w in enumerate(ws)] + [(9 + i, f"call the {w} things for nothing") for i, w in enumerate(ws)]
    # words of near copies tell nothing, whatever value they share
    docs += [(20 + i, f"mail y@r.org {filler(50)} word{'abcdef'[i]}") for i in range(6)]
    d = spark.createDataFrame(docs, DOC)
    rows = personal_data(d, evidence=4).join(d, "doc_id").select("doc_id", "spans", sanitised(F.col("text"), F.col("found"), F.col("removed_terms")).alias("clean"))
    got = {r.doc_id: (r.spans, r.clean) for r in rows.collect()}
    assert got[0] == ("term:5:12,email:16:22", f"call  at [EMAIL] for red things {filler(0)}")
    assert all(got[i] == ("", t) for i, t in docs if 9 <= i < 20)
    assert all(got[i][0] == "email:5:12" for i in range(20, 26))


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_sanitisation_marks_terms_in_documents_without_the_value(spark, small):
    docs = [(i, f"call zorblat at z@q.io for n{'abcd'[i]}n things {filler(i)}") for i in range(4)] + [(4, "only Zorblat and more things")]
    docs += [(5 + i, "call at for and more things only") for i in range(95)] + [(4, "only Zorblat and more things")]
    rows = [r for r in personal_data(spark.createDataFrame(docs, DOC), evidence=10, small=small).collect() if r.doc_id < 6]
    # the row that repeats id and text counts once: share log(100 * 4 / (4 * 5)) / log(100 / 4) = 0.93, generalised
    assert sorted((r.doc_id, r.spans) for r in rows) == [(i, "term:5:12,email:16:22") for i in range(4)] + [(4, "term:5:12")] * 2 + [(5, "")]
    assert not any(r.removed_terms for r in rows)


def brute_terms(docs, evidence, remove_at=0.95, generalise_at=0.85):
    """(spans, removed terms) of each (id, text), from the definitions: document counts over distinct rows."""
    email, secret = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?i)(?:token|password)\s?[:=] ?[\"']?([A-Za-z0-9]{12,})"
    ip, once = r"[0-9]+(?:\.[0-9]+){3}", {(i, t or "") for i, t in docs}
    spans, entities, terms = {}, {}, {}
    for row in once:
        text = row[1]
        found = [(m.start(), 0, m.end(), m[0]) for m in re.finditer(email, text)] + [(m.start(), 1, m.end(), m[0]) for m in re.finditer(ip, text)]
        found += [(m.start(1), 4, m.end(1), m[1]) for m in re.finditer(secret, text) if re.search("[0-9]", m[1])]
        spans[row], entities[row] = found, set()
        for _, k, _, hit in found:
            value = hit.lower() if k == 0 else hit if k == 4 else re.sub("[^0-9]", "", hit)
            entities[row] |= {("value", k, value), ("kind", k)}
            if k < 4:
                entities[row].add(("group", k, value.split("@")[1] if k == 0 else hit.rpartition(".")[0]))
        bare = re.sub(r"[\w+/=-]*[0-9][\w+/=-]*", " ", re.sub(secret, " ", re.sub(email, " ", text)))
        terms[row] = {t for t in re.findall(r"[^\W\d_]+", bare.lower()) if len(t) >= 3}
    n, n_t = len(once), Counter(t for ts in terms.values() for t in ts)
    n_c = Counter(c for cs in entities.values() for c in cs)
    n_ct = Counter((c, t) for row in once for c in entities[row] for t in terms[row])
    out = {}
    for (c, t), k in n_ct.items():
        families = [{min(hashlib.md5(x.encode()).hexdigest()[8 * i : 8 * i + 8] for x in terms[row]) for row in once if c in entities[row] and t in terms[row]} for i in range(3)]
        if k >= 2 and n_c[c] < n and k * math.log(n / n_c[c]) >= evidence and all(len(f) > 1 for f in families) and 2 * len(families[0]) >= k:
            share = round(math.log(n * k / (n_c[c] * n_t[t])) / math.log(n / n_c[c]), 9)
            if share >= generalise_at:
                out[t] = out.get(t, False) or share >= remove_at
    result = {}
    for row in once:
        hits = [(m.start(), 5, m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", row[1]) if m[0].lower() in out and m[0].lower() in terms[row]]
        kinds = ("email", "ip", "card", "phone", "secret", "term")
        result[row] = (",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in sorted(spans[row] + hits)), sorted(t for t in terms[row] if out.get(t)))
    return result


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_personal_data_terms_against_brute_force(spark, small):
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in ("kor", "Éli", "mun", "tra") for b in ("ba", "den", "sul", "vix", "ó") for c in "abcdefghijklmnop"]
    docs = []
    for i in range(240):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]
        if i % 6 == 0:
            parts += ["Contact", f"u{i % 4}@m{i % 3}.org"]
        if i % 8 == 0:
            parts += ["Server", f"10.0.{i % 2}.{i % 5}"] + ["host"] * (i % 16)
        if i % 10 == 0:
            parts += [f'token = "{rng.randrange(10**15, 10**16):x}a1b2cde"', "deploy"]
        docs.append((i, " ".join(parts)))
    docs += [(1000, "server and host"), (1001, "deploy host host"), (1002, None), (None, "Contact x@y.z"), (0, docs[0][1]), (0, docs[0][1]), (0, "Contact again"), (0, docs[0][1])]
    rows = spark.createDataFrame([(i, t, 3) for i, t in docs], f"{DOC}, _key int").repartition(3)
    got = [((r.doc_id, r.spans), sorted(r.removed_terms), r.n_spans) for r in personal_data(rows, evidence=8, small=small).collect()]
    expected = brute_terms(docs, 8)
    full = [((i, expected[i, t or ""][0]), expected[i, t or ""][1], len(list(filter(None, expected[i, t or ""][0].split(","))))) for i, t in docs]
    assert sorted(got, key=repr) == sorted(full, key=repr)
    assert {t for _, ts, _ in full for t in ts} >= {"contact", "server"} and not any("kor" in t for _, ts, _ in full for t in ts)
    # the label of a secret tells of it by construction; words beside it do by what documents say
    assert not any(t == "token" for _, ts, _ in full for t in ts)
    assert any("deploy" in docs[i][1] and "term" in s for (i, s), _, _ in full if i is not None and i < 240)


def test_labels_without_an_end_are_read_in_linear_time(spark):
    import time

    texts = ["password=" * 120_000, "token: " * 150_000, "a_b_c-" * 180_000, "secret = 'x" * 100_000, "1 " * 400_000 + "key=" + "z" * 300_000 + "7"]
    d = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(1)
    personal_data(d.limit(0)).count()
    began = time.time()
    rows = personal_data(d).collect()
    assert time.time() - began < 60 and sum(r.n_secret for r in rows) == 0
    value = "password=" * 120_000 + "1"
    row = personal_data(spark.createDataFrame([(0, value)], DOC)).collect()[0]
    assert row.spans == f"secret:9:{len(value)}"


def test_labelled_secrets(spark):
    texts = ['x token = "04dbebab91ab" y', "my API_KEY: abcdef-12345-zz", "db_password=Secret12345678== end", "token = abcdefghijklmnop", "token 1234567890123", "retoken = 1234567890123"]
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: (r.spans, r.n_secret) for r in personal_data(d).collect()}
    for i, value in enumerate(["04dbebab91ab", "abcdef-12345-zz", "Secret12345678=="]):
        at = texts[i].index(value)
        assert got[i] == (f"secret:{at}:{at + len(value)}", 1)
    assert got[3] == got[4] == got[5] == ("", 0)


def test_pfair_stretch_meets_shares_to_less_than_a_unit():
    rng = random.Random(6)
    for counts in ([7, 1, 1, 30], [1], [5, 5, 5], *([rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))] for _ in range(30))):
        had, total = [0] * len(counts), sum(counts)
        for t, (k, j) in enumerate(zip(*(x.tolist() for x in pfair_stretch(counts))), 1):
            assert j == had[k]
            had[k] += 1
            assert all(abs(h - Fraction(t * n, total)) < 1 for h, n in zip(had, counts))


@pytest.mark.parametrize("stretch", [3, 40, 10**6])
def test_quotas_follow_the_flow_of_exact_weights_in_every_phase(stretch):
    rng = random.Random(stretch)
    cases = [({"a": 1000.3, "b": 0.2, "c": 333.1, "d": 0.7, "e": 50.0}, {"a": 3000, "b": 2, "c": 300, "d": 3, "e": 1})]
    for _ in range(12):
        names = "abcdefgh"[: rng.randrange(1, 9)]
        cases.append(({s: rng.paretovariate(0.6) for s in names}, {s: rng.choice([1, 2, 9, 60, 300]) for s in names}))
    for weights, units in cases:
        weights = {s: Fraction(w) for s, w in weights.items()}
        flow = Flow(weights, units)
        had, served, slot = dict.fromkeys(units, 0), dict.fromkeys(units, Fraction(0)), 0
        for start, given in quotas(flow, flow.cuts(stretch)):
            assert start == slot and all(had[s] == a and n > 0 for s, (a, n) in given.items())
            names = list(given)
            for k, _ in zip(*pfair_stretch([given[s][1] for s in names])):
                had[names[k]] += 1
                slot += 1
                left = Fraction(1)  # one slot of the ideal flow, followed event by event
                while left:
                    alive = [x for x in units if served[x] < units[x]]
                    total = sum(weights[x] for x in alive)
                    step = min([left / total, *((units[x] - served[x]) / weights[x] for x in alive)])
                    for x in alive:
                        served[x] += step * weights[x]
                    left -= step * total
                # two units are a block
                assert all(abs(had[x] - served[x]) < 2 for x in units)
            assert all(abs(had[x] - served[x]) < 1 for x in units)
        assert had == units


def test_mix_holds_given_weights_below_a_thousandth(spark):
    d = spark.createDataFrame([(i, "a") for i in range(3000)] + [(5000 + i, "b") for i in range(3)], "doc_id long, source string")
    kept = []
    for options in ({}, {"small": 0}, {"bucket_rows": 50}):
        rows = mix(d, weights={"a": 0.9996, "b": 0.0004}, block_rows=2, **options).select("doc_id", "source", "mix.*").collect()
        assert len(rows) == 3003 and sorted(r.slot for r in rows) == list(range(3003))
        had = 0
        for t, r in enumerate(sorted((r for r in rows if r.within), key=lambda r: r.slot), 1):
            had += r.source == "b"
            assert abs(had - t * 0.0004) < 2
        kept.append(sorted(map(tuple, rows)))
    assert kept[0] == kept[1] == kept[2]


def test_mix(spark):
    docs = [(i, "s1" if i % 3 else None if i % 2 else "s2", i % 5) for i in range(400)] + [(None, "s1", k) for k in range(9)] + [(7, "s1", 0)] * 3
    d = spark.createDataFrame(docs, "doc_id long, source string, mix int")
    rows = mix(d, block_rows=8).toDF("doc_id", "source", "own", "mix").select("doc_id", "source", "mix.*").collect()
    assert len(rows) == 412
    assert len({(r.slot, r.position) for r in rows}) == 412
    # half a block a slot
    assert all(len({r.slot for r in rows if (r.source, r.block) == key}) <= 2 for key in {(r.source, r.block) for r in rows})
    assert {r.slot for r in rows} == set(range(1 + max(r.slot for r in rows)))
    kept = mixed_to_weights(d.drop("mix"), block_rows=8)
    assert kept.columns == ["doc_id", "source"] and kept.count() == sum(r.within for r in mix(d.drop("mix")).select("mix.*").collect())
    assert mix(d.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no weight"):
        mix(d, weights={"s1": 1.0})
    for wrong in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError, match="above zero"):
            mix(d, weights={"s1": 1.0, "s2": wrong, None: 1.0})
    with pytest.raises(ValueError, match="even"):
        mix(d, block_rows=3)


def test_token_files(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from siteloom.llm.token_files import document_digests, read_documents, token_at, write_token_file

    path = str(P.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    texts = ["Hello, world. It's 12.5%!", None, "", "  a\n\nb\tc  ", "ÉTÉ İstanbul ΣΑΣ", "x<|endoftext|>y <|STARTOFTEXT|>", "don't. U.S.A., a.b,", "é 한글 가", "word " * 500]
    rows = spark.createDataFrame([(i * 7 % 9, t, 0) for i, t in enumerate(texts)], f"{DOC}, start int")
    write_token_file(rows, f"file://{tmp_path}/t", path, shards=3, block_tokens=100)
    expected, at, flat = {}, 0, []
    for i, t in sorted((i * 7 % 9, t) for i, t in enumerate(texts)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        flat += ids
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in document_digests(spark, f"file://{tmp_path}/t").collect()} == expected
    assert [x for r in sorted(read_documents(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start) for x in r.ids] == flat
    assert [token_at(spark, f"file://{tmp_path}/t", p) for p in (0, 17, at - 1, at)] == [flat[0], flat[17], 2, None]
    write_token_file(rows.limit(0), f"file://{tmp_path}/e", path)
    assert document_digests(spark, f"file://{tmp_path}/e").count() == 0


def test_scratch_tables_need_a_shared_folder_and_can_be_cleared(spark, tmp_path):
    from types import SimpleNamespace

    from siteloom.llm.common import clear_scratch, saved, scratch_path, shared_folder

    unset = SimpleNamespace(get=lambda key, default: None)
    far = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(far)
    near = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]", applicationId="y"))
    assert shared_folder(near) == shared_folder(near) != ""
    other = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: f"file://{tmp_path}/"), sparkContext=SimpleNamespace(master="yarn", applicationId="z"),
        _jvm=spark._jvm, _jsc=spark._jsc,
    )
    assert scratch_path(other, "t").startswith(f"file://{tmp_path}/siteloom/z/t-")
    spark.range(3).write.parquet(scratch_path(other, "t"))
    clear_scratch(other)
    assert not (tmp_path / "siteloom" / "z").exists()
    assert saved(spark.range(3), "t").count() == 3
