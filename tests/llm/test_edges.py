"""Null and repeated ids, very long texts, empty tables and clashing names, where other tests leave them out."""

import zlib

import numpy as np
import pytest

from siteloom.llm.quality import accepted, graded, train_quality
from siteloom.llm.token_files import document_digests, token_at, write_token_file


def test_token_file_of_null_and_repeated_ids(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    docs = [(3, "x y"), (None, "b"), (3, "x y"), (None, None), (3, "a"), (None, "b"), (-1, "long " * 30_000), (2**40, "z")]
    rows = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, shard string, n int").repartition(3)
    write_token_file(rows, f"file://{tmp_path}/t", path, shards=2, block_tokens=50)
    expected, at, flat = [], 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        flat += ids
    got = sorted(map(tuple, document_digests(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[1])
    assert got == expected
    assert [token_at(spark, f"file://{tmp_path}/t", p) for p in (0, 5, at - 1, at, -1)] == [flat[0], flat[5], 2, None, None]


def test_quality_of_odd_rows(spark):
    kinds = "doc_id long, text string, quality string, score double"
    texts = [(k, f"{'good calm words here' if k % 2 else 'BAD!! NOISE!! HERE!!'} {k % 7}", "q", 0.0) for k in range(200)]
    docs = texts + [(500, None, None, None), (500, None, None, None), (501, "", "", 1.0), (None, "good " * 200_000, "", 1.0), (3, "twice", "", 1.0)]
    d = spark.createDataFrame(docs, kinds)
    labels = [(k, k % 2, 0) for k in range(150)] + [(1, 1, 0), (1, 1, None), (999, 1, 1), (7, None, 1)]
    model = train_quality(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = graded(d, model).collect()
    assert len(rows) == len(docs) and all(0 <= r[-1].p_top <= 1 for r in rows)
    same = {r[-1].p_top for r in rows if r[0] in (500, 501)}
    assert len(same) == 1
    kept = accepted(d, model, 0.5)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} >= {k for k in range(200) if k % 2}
    assert graded(d.limit(0), model).count() == 0
