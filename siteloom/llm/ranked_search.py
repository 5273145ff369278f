"""Ranked lexical search: a sharded index whose posting blocks have variable bounds, and exact search that skips blocks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siteloom.llm.common import bounded_batches, saved

#: Bytes between terms after A-Z is lower-cased: all of ASCII but digits and letters. Other bytes belong to terms.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_SPARSE = 64
_INDEX = "shard long, docs binary, terms array<string>, cuts binary, places binary, frequencies binary, block_cuts binary, block_ends binary, block_tops binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Collection:
    """What scores need to know of all documents: how many have a term, and how many terms they have together."""

    documents: int
    terms: int

    def length_part(self, n: np.ndarray) -> np.ndarray:
        return 10 + (90 * n * self.documents) // self.terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives to a document's score, without the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def variable_blocks(values: list[np.ndarray], piece: int = 1024, widest: int = 128, block_cost: float = 8.0) -> list[np.ndarray]:
    """For each list of values, the ends of its blocks: those with the least sum of what block maxima exceed the values by,
    plus `block_cost` mean values of the list for each block.

    A dynamic programme over the end of the last block, for blocks of at most `widest` values inside pieces of `piece`
    values; all pieces are worked on side by side.
    """
    pieces = [(k, at) for k, v in enumerate(values) for at in range(0, len(v), piece)]
    ends: list[list[np.ndarray]] = [[] for _ in values]
    # pieces of like length share an array, so that short lists are not padded to long ones
    pieces.sort(key=lambda p: min(piece, len(values[p[0]]) - p[1]))
    per = max(1, 4_000_000 // (piece + 8 * widest))
    for some in (pieces[i : i + per] for i in range(0, len(pieces), per)):
        sizes = np.array([min(piece, len(values[k]) - at) for k, at in some])
        longest = int(sizes.max())
        grid = np.zeros((len(some), longest))
        for row, (k, at) in enumerate(some):
            grid[row, : sizes[row]] = values[k][at : at + piece]
        cost = np.array([block_cost * values[k].mean() for k, _ in some])
        best = np.full((len(some), longest + 1), np.inf)
        best[:, 0] = 0.0
        width = min(widest, longest)
        tops = np.zeros((len(some), width))
        back = np.zeros((len(some), longest + 1), dtype=np.int32)
        lengths = np.arange(1, width + 1, dtype=float)
        # befores[:, j]: the best cost up to the value before a block of j + 1 values
        befores = np.full((len(some), width), np.inf)
        for i in range(longest):
            tops[:, 1:] = tops[:, :-1]
            tops[:, 0] = 0.0
            np.maximum(tops, grid[:, i : i + 1], out=tops)
            befores[:, 1:] = befores[:, :-1]
            befores[:, 0] = best[:, i]
            total = befores + tops * lengths
            take = total.argmin(axis=1)
            best[:, i + 1] = total[np.arange(len(some)), take] + cost
            back[:, i + 1] = take + 1
        for row, (k, at) in enumerate(some):
            cuts, i = [], int(sizes[row])
            while i:
                cuts.append(at + i)
                i -= int(back[row, i])
            ends[k].append(np.array(cuts[::-1], dtype=np.int64))
    return [np.sort(np.concatenate(e)) if e else np.zeros(0, np.int64) for e in ends]


def _tokenised(wanted):
    """(id, length, terms, frequencies) of the documents that have a term; only wanted terms are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = wanted.value
        for batch in batches:
            keep, lengths, terms, counts = [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text or b"")
                if words:
                    found = Counter(filter(asked.__contains__, words))
                    keep.append(k)
                    lengths.append(len(words))
                    terms.append([t.decode("utf-8", "replace") for t in found])
                    counts.append(list(found.values()))
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64())]
            columns += [pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "length", "terms", "frequencies"])

    return run


def _shard_row(shard: int, lengths: np.ndarray, terms: list[list[str]], counts: list[list[int]], whole: Collection) -> dict:
    """The index of a shard: for each term its documents, frequencies and blocks, all in flat arrays with cuts."""
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(t, len(numbers)) for some in terms for t in some], dtype=np.int64)
    tf = np.array([n for some in counts for n in some], dtype=np.int64)
    place = np.repeat(np.arange(len(terms), dtype=np.int64), [len(t) for t in terms])
    order = np.argsort(flat, kind="stable")
    flat, tf, place = flat[order], tf[order], place[order]
    cuts = np.searchsorted(flat, np.arange(len(numbers) + 1))
    gains = impacts(tf, whole.length_part(lengths)[place])
    lists = [gains[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    ends = variable_blocks(lists)
    tops = [np.maximum.reduceat(v, np.concatenate([[0], e[:-1]])) for v, e in zip(lists, ends)]
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return {
        "shard": shard, "docs": lengths.astype("<i8").tobytes(), "terms": list(numbers), "cuts": cuts.astype("<i8").tobytes(),
        "places": place.astype("<i4").tobytes(), "frequencies": tf.astype("<i8").tobytes(),
        "block_cuts": np.cumsum([0, *map(len, ends)]).astype("<i8").tobytes(),
        "block_ends": joined(ends).astype("<i4").tobytes(), "block_tops": joined(tops).astype("<i8").tobytes(),
    }


def _sharded(whole: Collection):
    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 6]

    def run(group: pa.Table) -> pa.Table:
        # places follow ids, nulls first, so that equal scores are ordered by place
        group = group.sort_by([("_null", "descending"), ("id", "ascending"), ("row", "ascending")])
        row = _shard_row(
            group.column("shard")[0].as_py(), group.column("length").to_numpy(),
            group.column("terms").to_pylist(), group.column("frequencies").to_pylist(), whole,
        )
        columns = [pa.array([row[n]], k) for n, k in zip(names, kinds)]
        ids = pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group.column("id").combine_chunks())
        return pa.Table.from_arrays([*columns, ids], [*names, "ids"])

    return run


class Shard:
    """A shard of the index, opened for searches."""

    def __init__(self, row: dict, whole: Collection):
        read = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        self.size = len(row["docs"]) // 8
        self.number = {t: k for k, t in enumerate(row["terms"])}
        self.cuts, self.places = read("cuts", "<i8"), read("places", "<i4")
        self.gains = impacts(read("frequencies", "<i8"), whole.length_part(read("docs", "<i8"))[self.places])
        self.block_cuts, self.ends, self.tops = read("block_cuts", "<i8"), read("block_ends", "<i4"), read("block_tops", "<i8")

    def stretches(self, wanted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the blocks of the wanted lists (number, weight) change, and the bound of each stretch between: the sum over
        lists of the weighted top of the block that a document in the stretch would be in.

        As with WAND's cursors, a list gives nothing between two of its documents if that is worth telling: lists with less
        than one document in `_SPARSE` count posting by posting."""
        at, change = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for k, weight in wanted:
            places = self.places[self.cuts[k] : self.cuts[k + 1]]
            ends = self.ends[self.block_cuts[k] : self.block_cuts[k + 1]]
            tops = weight * self.tops[self.block_cuts[k] : self.block_cuts[k + 1]]
            if len(places) * _SPARSE < self.size:
                at += [places, places + 1]
                tops = weight * self.gains[self.cuts[k] : self.cuts[k + 1]]
            else:
                # a block bounds the documents from its first to its last, and nothing between two blocks
                at += [places[np.concatenate([[0], ends[:-1]])], places[ends - 1] + 1]
            change += [tops, -tops]
        at, change = np.concatenate(at), np.concatenate(change)
        order = np.argsort(at, kind="stable")
        at, bounds = at[order], np.cumsum(change[order])
        last = np.append(at[1:] != at[:-1], True)
        return at[last], bounds[last]

    def best(self, query: list[tuple[str, int]], most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, stretches looked into) of the `most` best documents for weighted terms, ties by place.

        Stretches are taken by falling bound, in runs that double; a run ends all below the score of the last of the best
        so far, which no document there can reach. Ties with it can still matter, so equal bounds are looked into.
        """
        wanted = [(self.number[t], w) for t, w in query if w > 0 and t in self.number]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not wanted:
            return places, scores, 0
        starts, bounds = self.stretches(wanted)
        stops = np.append(starts[1:], self.size)
        order = np.argsort(-bounds, kind="stable")
        at, run, least = 0, 16, 1
        while at < len(order) and bounds[order[at]] >= least:
            some = order[at : at + run]
            some = np.sort(some[bounds[some] >= least])
            at, run = at + run, run * 2
            found = self._scored(wanted, starts[some], stops[some])
            places, scores = (np.concatenate(x) for x in zip((places, scores), found))
            keep = np.lexsort((places, -scores))[:most]
            places, scores = places[keep], scores[keep]
            if len(scores) == most:
                least = max(1, int(scores[-1]))
        return places, scores, min(at, len(order))

    def _scored(self, wanted: list[tuple[int, int]], starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the documents of some stretches that have a wanted term."""
        seen, gains = [], []
        for k, weight in wanted:
            low, high = self.cuts[k], self.cuts[k + 1]
            mine = self.places[low:high]
            first, last = np.searchsorted(mine, starts), np.searchsorted(mine, stops)
            n = last - first
            if total := int(n.sum()):
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                seen.append(mine[at])
                gains.append(weight * self.gains[low:high][at])
        if not seen:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, index = np.unique(np.concatenate(seen), return_inverse=True)
        scores = np.zeros(len(places), np.int64)
        np.add.at(scores, index, np.concatenate(gains))
        return places[scores > 0], scores[scores > 0]


def _searched(queries, whole: Collection, most: int, id_type: pa.DataType):
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in names if n != "shard"}
                shard, ids = Shard(row, whole), batch.column("ids")[k].values
                number, scores, at = [], [], []
                for q, terms in queries.value:
                    places, found, _ = shard.best(terms, most)
                    number += [q] * len(places)
                    scores.append(found)
                    at.append(places)
                at = pa.array(np.concatenate(at) if at else [], pa.int64())
                found = pa.array(np.concatenate(scores) if scores else [], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), ids.take(at).cast(id_type), found], ["query", "id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({t.decode("utf-8", "replace") for t in terms_of(x or b"")}) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["query", "terms"])


def build_index(docs: DataFrame, terms: set[str], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 8_192) -> tuple[DataFrame, Collection, dict[str, int]]:
    """(index, collection, document counts of `terms`) of all documents; the index has a row for each shard.

    Documents are dealt over shards by a hash of their place in the table, so a shard has about `shard_docs` documents
    whatever their ids. A shard has the postings of `terms`, cut into blocks by `variable_blocks`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    asked = spark.sparkContext.broadcast(frozenset(t.encode() for t in terms))
    known = rows.mapInArrow(_tokenised(asked), f"id {kind}, length long, terms array<string>, frequencies array<long>")
    known = saved(known.withColumn("row", F.monotonically_increasing_id()), "postings")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
    whole = Collection(size["n"], size["l"])
    held = known.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # at most a row for each of `terms`
    counts = {r["t"]: r["df"] for r in held.collect()}
    shards = max(1, -(-whole.documents // shard_docs))
    known = known.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn("_null", F.col("id").isNull())
    made = known.groupBy("shard").applyInArrow(_sharded(whole), f"{_INDEX}, ids array<{kind}>")
    return saved(made, "index"), whole, counts


def ranked_search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
    most: int = 10, block_terms: int = 500_000, shard_docs: int = 8_192,
) -> DataFrame:
    """The `most` best documents of each query: its id, `rank` from 1, the document's id and `score`; ties by ascending id.

    With N documents that have a term and L terms in them, a term that df documents have weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms scores w ((10^9 tf) div (1000 tf + 8 m)) for it, with
    m = 10 + (90 n N) div L. Documents that score 0 are left out.

    Queries are taken in blocks of about `block_terms` terms, each with an index of the terms it asks for over all
    documents, so what is broadcast is bounded. A shard is searched by itself; its best documents, at most `most` a query,
    meet under the query, where a limit inside each task comes before the shuffle.

    Null texts have no terms; documents and queries without terms find nothing; repeated rows are ranked each, equal ids
    in any order; null ids rank before others; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).cast("string").alias("text"))
    kind = asked.schema["query"].dataType.simpleString()
    asked = asked.mapInArrow(_query_terms, f"query {kind}, terms array<string>").withColumn("number", F.monotonically_increasing_id())
    asked = saved(asked.where(F.size("terms") > 0), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    doc_kind = docs.schema[id_col].dataType
    parts = []
    for k in range(blocks):
        # a block has about `block_terms` terms
        some = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k).select("number", "terms").collect()
        index, whole, held = build_index(docs, {t for r in some for t in r["terms"]}, id_col, text_col, shard_docs)
        weight = {t: math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * df + 1))) for t, df in held.items()}
        weighed = [(r["number"], [(t, weight[t]) for t in r["terms"] if t in weight]) for r in some]
        shared = spark.sparkContext.broadcast(weighed)
        found = index.mapInArrow(_searched(shared, whole, most, to_arrow_type(doc_kind)), f"query long, id {doc_kind.simpleString()}, score long")
        parts.append(saved(found, "found"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = asked.select(F.col("query").alias("_name"), "number")
    joined = best.join(names, best["query"] == names["number"])
    return joined.select(F.col("_name").alias(query_id), F.col("rank").cast("int"), F.col("id").alias(id_col), "score")

