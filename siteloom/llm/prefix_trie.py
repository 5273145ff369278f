"""Prefix trie of conversations: distributed MSD radix partitioning over dictionary-encoded turns, finished by multikey quicksort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, saved, spread_join

_NO_IDS = hashlib.sha256(b"").hexdigest()
_NODE = "up string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NODE_TYPES = [pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
_PART = 50_000


def turn_sequences(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", salts: int = 256
) -> DataFrame:
    """(conv, ids, sizes): each conversation's turns in order, as numbers of the dictionary of distinct (role, text) pairs, and
    the UTF-8 bytes of their texts.

    Turns are ordered by `turn`, nulls first, then by role and text, so that repeated rows have a defined place. Null roles
    and texts are empty; rows without a conversation are left out. Texts are shuffled once, to be ordered; the dictionary
    has their SHA-256 digests, and a turn that a third of all conversations begin with is joined over `salts`. A
    conversation is one row of 16 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.where("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    placed = rows.select(
        "conv", F.row_number().over(order).alias("place"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
    )
    placed = saved(placed, "turns")
    numbered = placed.groupBy("digest").agg(F.first("size").alias("_size")).select("digest", F.monotonically_increasing_id().alias("id"))
    numbered = saved(numbered, "turn-dictionary")
    coded = spread_join(placed.withColumn("_salt", F.pmod(F.xxhash64("conv"), F.lit(salts))), numbered, ["digest"], "_salt")
    turns = coded.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "id", "size"))).alias("t"))
    return turns.select("conv", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def rebuilt(sequences: DataFrame, family: int = 5, folds: int = 9) -> DataFrame:
    """Sequences in which conversation c begins with the first h turns of c - c mod `family` (all if fewer, none if that is
    absent) and goes on with its own after its first h; h is crc32(c in decimal) mod `folds`. A result may have no turn."""
    sequences = saved(sequences, "sequences")
    base = sequences.select(F.col("conv").alias("_base"), F.col("ids").alias("_ids"), F.col("sizes").alias("_sizes"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(folds)).cast("int")
    rows = sequences.withColumn("_h", h).withColumn("_base", F.col("conv") - F.pmod("conv", F.lit(family))).join(base, "_base", "left")

    def spliced(own: str, first: str) -> Column:
        head = F.coalesce(F.slice(first, F.lit(1), F.col("_h")), F.array().cast("array<bigint>"))
        tail = F.slice(own, F.col("_h") + 1, F.greatest(F.size(own) - F.col("_h"), F.lit(0)))
        return F.concat(head, tail)

    return rows.select("conv", spliced("ids", "_ids").alias("ids"), spliced("sizes", "_sizes").alias("sizes"))


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): SHA-256 of the ids of each key, from parts that come in order; a key's ids are never held together."""
    key, hasher = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([hasher.hexdigest()], pa.string())], ["key", "ends"])

    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if hasher is not None:
                    yield row()
                key, hasher = k, hashlib.sha256(part.encode())
            else:
                hasher.update(b"," + part.encode())
    if hasher is not None:
        yield row()


def distinct_sequences(sequences: DataFrame, run: int = 4096) -> DataFrame:
    """Each distinct sequence once: ids, sizes, `n` conversations that have it, the `first` of them, and `ends`, the SHA-256
    of all of them in decimal, ascending, joined by commas.

    Copies meet in partial sums. Their ids are joined in parts of `run` neighbouring numbers, which are hashed in order as a
    stream: however many conversations share a sequence, no task holds them together.
    """
    key = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    keyed = saved(sequences.withColumn("key", key), "keyed")
    whole = keyed.groupBy("key").agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("first")
    )
    parts = keyed.groupBy("key", F.floor(F.col("conv") / run).alias("part")).agg(F.array_sort(F.collect_list("conv")).alias("c"))
    parts = parts.select("key", "part", F.array_join(F.col("c").cast("array<string>"), ",").alias("ids"))
    ends = parts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(_hashed_ends, "key string, ends string")
    return whole.join(ends, "key").select("ids", "sizes", "n", "first", "ends")


def _finish(rows: list[tuple], depth: int, parent: int | None) -> list[list]:
    """The nodes of a bucket of distinct sequences that share their first `depth` turns, parents before children.

    A row is (ids, sizes, n, first, ends). Multikey quicksort splits rows by their turn at a depth into less, equal and
    greater ones; each equal part is a node, and goes on at the next depth. The stack is explicit, as depth is not bounded.
    """
    nodes: list[list] = []  # conv, depth, parent's index, members, children, leaves, saved, ends
    work = [(True, rows, depth, -1)]
    while work:
        is_node, rows, d, up = work.pop()
        if is_node:
            n, first = sum(r[2] for r in rows), min(r[3] for r in rows)
            size = rows[0][1][d - 1] if d else 0
            rest = [r for r in rows if len(r[0]) > d]
            ends = next((r[4] for r in rows if len(r[0]) == d), _NO_IDS)
            nodes.append([first, d, up, n, 0, 0, (n - 1) * size, ends])
            if up >= 0:
                nodes[up][4] += 1
            if rest:
                work.append((False, rest, d, len(nodes) - 1))
            continue
        pivot = rows[len(rows) // 2][0][d]
        less, equal, more = [], [], []
        for r in rows:
            (equal if r[0][d] == pivot else less if r[0][d] < pivot else more).append(r)
        work += [(False, part, d, up) for part in (less, more) if part]
        work.append((True, equal, d + 1, up))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] >= 0:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    for node in nodes[1:]:
        node[2] = nodes[node[2]][0]
    nodes[0][2] = parent
    return nodes


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all buckets of a task, whose rows come bucket by bucket."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    out: list[list] = []
    here, rows = None, []

    def close() -> None:
        bucket, up, depth, parent = here
        for k, (conv, d, above, n, children, leaves, tokens, ends) in enumerate(_finish(rows, depth, parent)):
            out.append([None if k else up, k == 0, conv, d, above, n, children, leaves, tokens, ends])

    def part() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), _NODE_TYPES)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for bucket, up, depth, parent, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if here is None or bucket != here[0]:
                if rows:
                    close()
                    if len(out) >= _PART:
                        yield part()
                here, rows = (bucket, up, depth, parent), []
            rows.append(tuple(row))
    if rows:
        close()
    if out:
        yield part()


def _bucket_of(ids: Column, depth: Column) -> Column:
    """The name of the bucket of sequences that share their first `depth` turns: 128 bits of hash beside the depth."""
    head = F.slice(ids, F.lit(1), depth)
    return F.concat_ws(":", depth, *(F.hex(F.xxhash64(F.lit(seed), head)) for seed in (1, 2)))


def conversation_trie(sequences: DataFrame, local: int = 4096, small: int = 200_000) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv, ids, sizes), one row each: `conv_id`, the smallest conversation that
    begins with it; `depth`; `parent_conv_id`, that of its parent, null for the root; `n_convs`; `n_children`; `n_leaves`;
    `saved_tokens`, what storing shared turns once saves in its subtree; `ends_sha256` of the conversations that end there.

    Equal sequences are one row. Buckets begin with the root's; a bucket of more than `local` distinct sequences is split
    by the first turn in which they differ, which the least and the greatest of them show, so a long prefix that all share
    takes one round and not one for each turn. A round is a grouping of all rows that are left, with partial sums, and a
    join with the split buckets, which is broadcast up to `small` of them. Smaller buckets are finished inside tasks by
    multikey quicksort. Sums of subtrees then go up round by round.

    Conversations without turns are members of the root; an empty table has no nodes.
    """
    bounded_batches(sequences.sparkSession)
    none = F.lit(None)
    rows = distinct_sequences(sequences).select(
        F.lit("0").alias("bucket"), none.cast("string").alias("up"), F.lit(0).alias("depth"), none.cast("long").alias("parent"),
        "ids", "sizes", "n", "first", "ends",
    )
    rows = saved(rows, "trie-rows")
    finished, rounds = [], []
    while True:
        both = F.struct("ids", "sizes")
        stats = rows.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("_rows"), F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
            F.min(both).alias("low"), F.max("ids").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"),
        )
        differ = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), False)
        large = stats.where(F.col("_rows") > local).withColumn("branch", (differ - 1).cast("int"))
        sizes = F.concat(F.array(F.lit(0).cast("long")), F.col("low.sizes"))
        chain = F.slice(sizes, F.col("depth") + 1, F.col("branch") - F.col("depth") + 1)
        large = saved(large.select("bucket", "up", "depth", "parent", "n", "first", "branch", chain.alias("chain")), "trie-buckets")
        n_large = large.count()
        if not n_large:
            finished.append(rows)
            break
        marks = large.select("bucket", "branch", F.col("first").alias("_first"))
        if n_large <= small:
            finished.append(rows.join(F.broadcast(marks.select("bucket")), "bucket", "left_anti"))
            split = rows.join(F.broadcast(marks), "bucket")
        else:
            salted = rows.withColumn("_salt", F.pmod(F.xxhash64("first"), F.lit(64)))
            both_kinds = spread_join(salted, marks, ["bucket"], "_salt", "left")
            finished.append(both_kinds.where("branch IS NULL").select(rows.columns))
            split = both_kinds.where("branch IS NOT NULL")
        split = saved(split.select(*rows.columns, "branch", "_first"), "trie-split")
        ended = split.where("size(ids) = branch").select("bucket", "ends")
        rounds.append((large, ended))
        rows = split.where("size(ids) > branch").select(
            _bucket_of(F.col("ids"), F.col("branch") + 1).alias("bucket"), F.col("bucket").alias("up"), (F.col("branch") + 1).alias("depth"),
            F.col("_first").alias("parent"), "ids", "sizes", "n", "first", "ends",
        )
    left = finished[0]
    for part in finished[1:]:
        left = left.union(part)
    left = left.select("bucket", "up", "depth", "parent", "ids", "sizes", "n", "first", "ends")
    nodes = saved(left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_finished, _NODE), "trie-nodes")
    tables = [nodes]
    tops = nodes.where("top").select("up", "n_leaves", "saved_tokens")
    for large, ended in reversed(rounds):
        sums = tops.groupBy("up").agg(
            F.count(F.lit(1)).alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        sums = sums.withColumnRenamed("up", "bucket")
        above = large.join(sums, "bucket").join(ended, "bucket", "left")
        above = above.select("*", F.posexplode("chain").alias("_k", "_size"))
        below = Window.partitionBy("bucket").orderBy(F.desc("_k"))
        own = F.sum((F.col("n") - 1) * F.col("_size")).over(below)
        depth = F.col("depth") + F.col("_k")
        last = depth == F.col("branch")
        above = above.select(
            F.when(F.col("_k") == 0, F.col("up")).alias("up"), (F.col("_k") == 0).alias("top"), F.col("first").alias("conv_id"),
            depth.cast("long").alias("depth"), F.when(F.col("_k") == 0, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.col("_children")).otherwise(1).alias("n_children"), F.col("_leaves").alias("n_leaves"),
            (F.col("_saved") + own).alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(_NO_IDS))).otherwise(_NO_IDS).alias("ends"),
        )
        above = saved(above, "trie-nodes")
        tables.append(above)
        inner = above.where("top").select("up", "n_leaves", "saved_tokens")
        # children of a bucket above may be finished ones or split ones
        tops = nodes.where("top").select("up", "n_leaves", "saved_tokens").union(inner)
    found = tables[0]
    for table in tables[1:]:
        found = found.union(table)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")
    )
