"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_batches, saved, spread_join

#: Bytes that separate words after lower-casing A-Z: all of ASCII but digits and letters. Other bytes belong to words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_CHUNK_BYTES = 4_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSet:
    """Windows of words: rolling hashes find them in a stream of words, exact comparison confirms each one."""

    def __init__(self, windows: list[tuple[bytes, str]]):
        self.codes: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for window, item in windows:
            key = tuple(self.codes.setdefault(w, len(self.codes)) for w in window.split(b" "))
            self.items.setdefault(key, []).append(item)
        self.hashes = {}
        for n in sorted({len(k) for k in self.items}):
            keys = np.array([k for k in self.items if len(k) == n], dtype=np.int64)
            self.hashes[n] = np.unique(self._rolled(keys.reshape(-1), n)[::n])

    @staticmethod
    def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
        values = codes.astype(np.uint64) + np.uint64(1)
        values = (values ^ (values << np.uint64(29))) * _FACTOR
        out = np.zeros(max(len(codes) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            out = out * _FACTOR + values[k : k + len(out)]
        return out ^ (out >> np.uint64(31))

    def found(self, codes: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(position, length, items) of each window in `codes`, where -1 stands for words that no window has."""
        hits = []
        bad = np.concatenate([[0], np.cumsum(codes < 0)])
        for n, known in self.hashes.items():
            if len(codes) < n:
                continue
            rolled = self._rolled(codes, n)
            at = np.flatnonzero(bad[n:] == bad[:-n])
            rolled = rolled[at]
            slot = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            for p in at[known[slot] == rolled].tolist():
                if items := self.items.get(tuple(codes[p : p + n].tolist())):
                    hits.append((p, n, items))
        return hits


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                n = min(width, len(words))
                found = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
                for some in range(0, len(found), 100_000):
                    part = sorted(found)[some : some + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["_item", "_window"]
                    )

    return run


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (_item, _window) pairs; an item shorter than `width` words is one window, one without words has none."""
    texts = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    )
    return texts.mapInArrow(_windows_of(width), "_item string, _window binary").distinct()


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("stops", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("stops", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)


def _texts_of(batch: pa.RecordBatch, at: int) -> Iterator[list[bytes | None]]:
    """The texts of a batch in runs of a bounded number of bytes."""
    some, size = [], 0
    for text in batch.column(at).cast(pa.binary()).to_pylist():
        some.append(text)
        size += len(text or b"")
        if size > _CHUNK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _findings(windows: WindowSet, texts: list[bytes]) -> list[dict]:
    """For each text: its number of words, merged spans of words that are hit, and the items they come from."""
    known = windows.codes.get
    codes, starts, at = [], [], 0
    for text in texts:
        words = words_of(text)
        starts.append(at)
        codes.append(np.array([known(w, -1) for w in words] + [-1], dtype=np.int64))
        at += len(words) + 1
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for p, n, of in windows.found(np.concatenate(codes)) if codes else []:
        k = int(np.searchsorted(starts, p, "right")) - 1
        spans.setdefault(k, []).append((p - starts[k], p - starts[k] + n))
        items.setdefault(k, set()).update(of)
    return [_finding(len(codes[k]) - 1, spans.get(k, []), items.get(k, set())) for k in range(len(texts))]


def _finding(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    own = _merged(spans)
    return {"n_words": n_words, "starts": [a for a, _ in own], "stops": [b for _, b in own], "items": sorted(items)}


def _without(text: bytes, found: dict) -> bytes:
    if not found["starts"]:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    parts, last = [], 0
    for a, b in zip(found["starts"], found["stops"]):
        parts.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, text[last:]])


def _digest(text: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(text)


def _scan(windows, text_at: int, kept: list[int], cut: bool):
    """One pass over documents against one broadcast block of windows; `kept` columns and `found` come out."""
    ready: list[WindowSet] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not ready:
                ready.append(WindowSet(windows.value))
            found = [f for texts in _texts_of(batch, text_at) for f in _findings(ready[0], [t or b"" for t in texts])]
            yield _with_found(batch, text_at, kept, cut, found)

    return run


def _with_found(batch: pa.RecordBatch, text_at: int, kept: list[int], cut: bool, found: list[dict]) -> pa.RecordBatch:
    columns = [batch.column(i) for i in kept]
    if cut:
        texts = batch.column(text_at).cast(pa.binary()).to_pylist()
        new = [None if x is None else _without(x, f) for x, f in zip(texts, found)]
        columns[kept.index(text_at)] = pa.array(new, pa.binary()).cast(pa.string())
    names = [f"c{i}" for i in range(len(columns))] + ["found"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(found, _FOUND_ARROW)], names)


def _hits(windows):
    """The texts that a block of windows hits, as (digest, starts, stops, items)."""
    ready: list[WindowSet] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not ready:
                ready.append(WindowSet(windows.value))
            for texts in _texts_of(batch, 0):
                found = _findings(ready[0], [t or b"" for t in texts])
                hit = [(_digest(t), f) for t, f in zip(texts, found) if f["starts"]]
                columns = [pa.array([d for d, _ in hit], pa.binary())]
                columns += [pa.array([f[k] for _, f in hit], t) for k, t in (("starts", _LONGS), ("stops", _LONGS), ("items", pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "starts", "stops", "items"])

    return run


_LONGS = pa.list_(pa.int64())


def _digested(text_at: int):
    """Rows with the digest and the number of words of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            more = [pa.array([_digest(t) for t in texts], pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())]
            columns = [*batch.columns, *more]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def _joined(text_at: int, kept: list[int], cut: bool, n: int):
    """Rows with what all blocks found in their texts (columns n to n + 3: words, starts, stops, items of the blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, starts, stops, items in zip(*(batch.column(n + i).to_pylist() for i in range(4))):
                spans = [(a, b) for x, y in zip(starts or (), stops or ()) for a, b in zip(x, y)]
                found.append(_finding(words, spans, {i for some in items or () for i in some}))
            yield _with_found(batch, text_at, kept, cut, found)

    return run


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_windows: int = 1_000_000,
    keep_text: bool = True,
    cut: bool = False,
    small: int = 1_000_000,
) -> DataFrame:
    """`docs` with a last column `found`: n_words, hit word spans (starts, stops; merged, stop exclusive) and item ids.

    The benchmark's windows are written and counted first. Up to `block_windows` of them are broadcast, and one pass over
    the documents finds them, without any shuffle. A larger benchmark is broadcast in blocks of that size, one after the
    other: each has a pass of its own that writes what it hits, by digest of the text, and is then freed, so the driver and
    a worker hold one block at a time; the hits of all blocks are joined to the documents at last. With `cut`, the words of
    hit spans, and what lies between them, are removed from the text.

    Null texts have no words; repeated rows are scanned each for itself; an empty benchmark finds nothing; columns of
    `docs` are carried by position, so a column named like ours is no problem until the caller selects by name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pairs = saved(benchmark_windows(benchmark, item_col, item_text_col, width), "windows")
    blocks = max(1, -(-pairs.count() // block_windows))
    text_at, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*(f"_{i}" for i in range(len(names))))
    fields, n = docs.schema.fields, len(names)
    kept = [i for i in range(n) if keep_text or i != text_at]
    schema = T.StructType([*(fields[i] for i in kept), T.StructField("found", _FOUND)])

    def block(b: int):
        part = pairs.where(F.pmod(F.xxhash64("_window"), F.lit(blocks)) == b).select("_window", "_item")
        return spark.sparkContext.broadcast([(bytes(w), i) for w, i in part.toLocalIterator()])

    if blocks == 1:
        return docs.mapInArrow(_scan(block(0), text_at, kept, cut), schema).toDF(*(names[i] for i in kept), "found")
    lists = "starts array<bigint>, stops array<bigint>, items array<string>"
    hits = []
    for b in range(blocks):
        windows = block(b)
        hits.append(saved(docs.select(f"_{text_at}").mapInArrow(_hits(windows), f"digest binary, {lists}"), "hits"))
        windows.destroy()
    every = reduce(DataFrame.union, hits).distinct()
    every = every.groupBy("digest").agg(*(F.collect_list(F.struct(*_SPANS)).getField(c).alias(c) for c in _SPANS))
    every = saved(every, "all-hits")
    more = [T.StructField("digest", T.BinaryType()), T.StructField("words", T.LongType())]
    rows = docs.mapInArrow(_digested(text_at), T.StructType([*fields, *more]))
    if every.count() <= small:
        rows = rows.join(F.broadcast(every), "digest", "left")
    else:
        plain = [f.name for f in fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        salt = F.pmod(F.xxhash64(*plain), F.lit(64))
        rows = spread_join(rows.withColumn("_salt", salt), every, ["digest"], "_salt", "left")
    rows = rows.select(*(f"_{i}" for i in range(n)), "words", *_SPANS)
    return rows.mapInArrow(_joined(text_at, kept, cut, n), schema).toDF(*(names[i] for i in kept), "found")


_SPANS = ("starts", "stops", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """`docs` without what the benchmark has: whole `documents` that hold any window, or only the `spans`."""
    columns = docs.columns
    found = find_benchmark(docs, benchmark, cut=remove == "spans", **options)
    names = [f"_{i}" for i in range(len(columns))]
    found = found.toDF(*names, "_found")
    if remove == "documents":
        found = found.where(F.size("_found.starts") == 0)
    return found.select(*names).toDF(*columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows = docs.select(F.col(id_col), F.col(options.get("text_col", "text")))
    found = find_benchmark(rows, benchmark, keep_text=False, **options).toDF("_id", "_found")
    starts = F.aggregate("_found.starts", F.lit(0).cast("long"), lambda a, x: a + x)
    hit = F.aggregate("_found.stops", F.lit(0).cast("long"), lambda a, x: a + x) - starts
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        (F.size("_found.starts") > 0).alias("contaminated"),
    )
