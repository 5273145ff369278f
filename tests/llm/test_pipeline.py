"""The pipeline, stage by stage, on a small folder of tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siteloom.llm import queries
from siteloom.llm.quality import features_of, train_quality

TEXTS = [f"{a}{b}{c}" for a in ("the", "on", "in", "qua") for b in ("re", "ti", "ou", "ma") for c in ("an", "er", "st", "ly", "xo")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    sentence = lambda n: " ".join(rng.choice(TEXTS) for _ in range(n))
    docs, labels = [], []
    for i in range(240):
        text, quality = sentence(rng.randrange(20, 90)), 1
        if i % 6 == 5:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, quality, 0))
    passage = sentence(30)
    for k in (3, 8):
        docs[k][1] += " " + passage
    docs[10][1] = docs[9][1] + " extra"
    docs[12][1] = docs[9][1]
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages(spark, folder):
    pytest.importorskip("public_tokenizers")
    path, docs = folder
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    now, seen = queries.table(spark, path, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, path)
        seen.append({r.doc_id for r in after.collect()})
        if len(seen) < 5:
            assert after.columns == now.columns
            now = after
    good = {i for i in range(240) if i % 6 != 5}
    assert len(seen[0] ^ good) <= 4
    assert seen[1] == seen[0] - {10, 12}
    assert seen[2] == seen[1] - {3, 8}
    assert seen[3] <= seen[2] and len(seen[3]) > 0.7 * len(seen[2]) and seen[4] == seen[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == seen[4]


def test_run_equals_plain_python(spark, folder):
    """Every stage once more without Spark: scores, components, windows, and the library's ids."""
    P = pytest.importorskip("public_tokenizers")
    from test_exact import brute_components, brute_report
    from tokenizers import Tokenizer

    path, docs = folder
    model = train_quality(queries.table(spark, path, "documents"), queries.table(spark, path, "labels"))
    texts = {d[0]: d[1] for d in docs}
    texts = {i: t for i, t in texts.items() if model.graded(model.score(features_of(t)))[1] >= queries.LEAST_P_TOP}
    comps = brute_components(texts)
    texts = {i: t for i, t in texts.items() if comps[i][1] == i}
    items = [tuple(r) for r in queries.table(spark, path, "benchmark").select("item_id", "text").collect()]
    report = brute_report(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not report[i][4]}
    library, at, expected = Tokenizer.from_file(str(P.path(queries.WORD_TOKENIZER))), 0, {}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        expected[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, path).collect()} == expected


def test_mixing_keeps_rows_beside_a_source_of_one_row(spark):
    docs = [(i, f"s{i % 4}") for i in range(4000)] + [(9000, "lone"), (9001, None)]
    kept = corpus_pipeline.mixing(spark, spark.createDataFrame(docs, "doc_id long, source string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in docs]


def test_rows_that_repeat_an_id_are_kept_by_text(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4))
    docs = [(1, a), (7, a + " more"), (7, b), (7, b), (5, c), (5, d), (9, d + " more"), (None, "x y"), (11, "")]
    kept = corpus_pipeline.near_duplicate_groups(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert rows == sorted([(1, a), (7, b), (5, c), (5, d), (None, "x y"), (11, "")], key=repr)


def test_mixing_reaches_the_token_file(spark, tmp_path):
    """The last stage's rows follow the order of the mixing stage, whether that was written and reread or not."""
    pytest.importorskip("public_tokenizers")
    rows = [(i, f"w{i} common words", f"s{0 if i < 300 else 1}") for i in range(400)] + [(7, "again", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = corpus_pipeline.mixing(spark, docs, "").repartitionByRange(5, "source", "doc_id").sortWithinPartitions("text")
    order = [r.doc_id for r in mixed.collect()]
    assert [r.doc_id for r in corpus_pipeline.token_file(spark, mixed, "").collect()] == order
    mixed.write.parquet(f"file://{tmp_path}/mixed")
    again = corpus_pipeline.token_file(spark, spark.read.parquet(f"file://{tmp_path}/mixed"), "").collect()
    assert [r.doc_id for r in again] == order
    by_id = sorted(again, key=lambda r: r.start)
    assert [r.doc_id for r in by_id] == sorted(order) and order != sorted(order)
    assert [r.start for r in by_id] == [0, *np.cumsum([r.n_tokens for r in by_id])[:-1]]


def test_sources_follow_their_weights_in_the_result(spark):
    pytest.importorskip("public_tokenizers")
    docs = [(i, f"w{i}", f"s{0 if i < 3000 else 1}") for i in range(4000)]
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), "")
    found = [r.doc_id for r in corpus_pipeline.token_file(spark, mixed, "").collect()]
    share, first = 3000**0.9 / (3000**0.9 + 1000**0.9), 0
    for n, i in enumerate(found[:2000], 1):
        first += i < 3000
        assert abs(first - n * share) < 8
