"""What Python workers hold: they are reused, so memory that one task takes or leaves counts beside the next one's."""

import tracemalloc

import numpy as np
import pyarrow as pa

from siteloom.llm import common, ngram_join


def test_counts_of_shingles_take_little_more_than_their_buffer(monkeypatch):
    held, rng = 1_000_000, np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 22, 1000, np.uint64)) for _ in range(900)]

    class Given:
        def __init__(self, width):
            pass

        def of(self, texts):
            return [sets[int(t)].copy() for t in texts]

    monkeypatch.setattr(ngram_join, "Shingler", Given)
    batches = [pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(a, a + 100)])], ["text"]) for a in range(0, 900, 100)]
    tracemalloc.start()
    (found,) = ngram_join._local_counts(5, 3, held)(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert found.column(0).to_pylist() == values[counts >= 3].tolist() and found.column(1).to_pylist() == counts[counts >= 3].tolist()
    assert peak < 2 * 8 * held


def test_repeated_values():
    for values in ([], [7], [7, 7], [7, 7, 7], [3, 9, 3, 9, 9, 3, 3, 1]):
        got = ngram_join._repeated(np.array(values, np.uint64), 3)
        assert [x.tolist() for x in got] == [sorted({v for v in values if values.count(v) >= 3}), [values.count(v) for v in sorted(set(values)) if values.count(v) >= 3]]


def test_a_set_above_the_buffer_is_counted():
    text = " ".join(f"w{i}" for i in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 4)], ["text"])
    assert sum(r.num_rows for r in ngram_join._local_counts(5, 1, 100)(iter([batch]))) == 4 * 296


def test_tasks_of_the_join_drop_what_others_kept():
    common.kept("words", lambda: [1])
    list(ngram_join._local_counts(5, 3, 100)(iter([])))
    assert not common._KEPT
