"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import saved

_STRETCHES = "start long, sources array<string>, firsts array<long>, counts array<long>"
_PART = 100_000


class Flow:
    """The ideal flow of units: each source is served in proportion to its weight until it has no more units.

    In a time v that serves a source of weight w by v w units, a source of n units runs out at n / w. The slots used up by
    v are D + v W, with D the units of sources that ran out before v and W the weights of the others; all exact.
    """

    def __init__(self, weights: dict[str, Fraction], units: dict[str, int]):
        self.weights, self.units = weights, units
        self.order = sorted(weights, key=lambda s: (units[s] / weights[s], s))
        self.ends = [units[s] / weights[s] for s in self.order]
        self.dead, self.alive = [0], [sum(weights.values(), Fraction(0))]
        for s in self.order:
            self.dead.append(self.dead[-1] + units[s])
            self.alive.append(self.alive[-1] - weights[s])
        #: the slots at which sources run out
        self.slots = [d + e * w for d, e, w in zip(self.dead, self.ends, self.alive)]

    def time_of(self, slot: int) -> Fraction:
        p = min(bisect_left(self.slots, slot), len(self.slots) - 1)
        return (slot - self.dead[p]) / self.alive[p]

    def cuts(self, stretch: int) -> list[int]:
        """Where the line of slots is cut: every `stretch` slots, and just before and after a source runs out."""
        total = sum(self.units.values())
        found = {0, total, *range(0, total, stretch)}
        for t in self.slots:
            found |= {math.floor(t), math.ceil(t)}
        return sorted(t for t in found if t <= total)


def quotas(flow: Flow, cuts: list[int]) -> Iterator[tuple[int, dict[str, tuple[int, int]]]]:
    """(start, {source: (units before, units within)}) of each stretch between cuts.

    At a cut each source has had its flow rounded down or up, so it is less than one unit away. Units that the flow has
    ended by a cut are given by then, and the rest of a stretch goes to units that the flow has begun, earliest end first:
    earliest deadline first on stretches. The flow itself fits these windows, so the rule can always be met.
    """
    had = dict.fromkeys(flow.weights, 0)
    live, gone = list(flow.order), 0
    for start, stop in zip(cuts, cuts[1:]):
        v = flow.time_of(stop)
        given, begun = {}, []
        left = stop - start
        for s in live[gone:]:
            w = flow.weights[s]
            served = min(v * w, flow.units[s])
            whole = math.floor(served)
            if whole > had[s]:
                given[s] = whole - had[s]
                left -= given[s]
            if served > whole and had[s] <= whole:
                begun.append(((whole + 1) / w, s))
        if left < 0 or left > len(begun):
            raise AssertionError("a stretch can't be filled")
        for _, s in heapq.nsmallest(left, begun):
            given[s] = given.get(s, 0) + 1
        yield start, {s: (had[s], n) for s, n in given.items()}
        for s, n in given.items():
            had[s] += n
        while gone < len(live) and had[live[gone]] == flow.units[live[gone]]:
            gone += 1


def pfair_stretch(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(source, unit) for each slot of a stretch that `counts` fill, by earliest deadline first among released units.

    Unit j (from 0) of a source with n units in P slots is released at slot floor(j P / n) and due by slot
    ceil((j + 1) P / n). The counts add up to P, so every deadline is met, and after any t slots each source has had less
    than one unit more or less than t n / P.
    """
    total = sum(counts)
    ahead = [(0, -(-total // n), k, 0) for k, n in enumerate(counts)]
    heapq.heapify(ahead)
    ready: list[tuple[int, int, int]] = []
    sources, units = np.empty(total, np.int32), np.empty(total, np.int64)
    for slot in range(total):
        while ahead and ahead[0][0] <= slot:
            _, due, k, j = heapq.heappop(ahead)
            heapq.heappush(ready, (due, k, j))
        due, k, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        sources[slot], units[slot] = k, j
        if j + 1 < (n := counts[k]):
            heapq.heappush(ahead, ((j + 1) * total // n, -(-(j + 2) * total // n), k, j + 1))
    return sources, units


def _scheduled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, names, firsts, counts in zip(*(c.to_pylist() for c in batch.columns)):
            sources, units = pfair_stretch(counts)
            units += np.array(firsts)[sources]
            names = pa.array(names, pa.string())
            for at in range(0, len(units), _PART):
                some = slice(at, at + _PART)
                slots = np.arange(start + at, start + at + len(units[some]))
                columns = [names.take(pa.array(sources[some])), pa.array(units[some]), pa.array(slots)]
                yield pa.RecordBatch.from_arrays(columns, ["_source", "_block", "_slot"])


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    smoothing: float = 0.9,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = 8,
    stretch: int = 1_000_000,
    bucket_rows: int = 20_000,
    small: int = 500_000,
) -> DataFrame:
    """`docs` with a last column `mix`: the source's `block`, its `slot`, the row's `position` in the slot, and `within`:
    whether the slot comes before the first source ran out, up to where the weights hold for every source.

    A source's rows are ordered by a hash of their columns and cut into units of half of `block_rows` (which is even). The
    ideal flow (`Flow`) serves sources by their exact weights, and goes on among those that remain when one runs out. The
    line of slots is cut into stretches of at most `stretch` slots, at whose ends each source has had its flow rounded
    down or up (`quotas`, the one pass over stretches and sources, on the driver). Inside a stretch units have release
    slots and deadlines of their share, and the earliest deadline goes first (`pfair_stretch`); stretches are scheduled side
    by side. A source is less than one unit from its line inside a stretch, and the line is less than one unit from the
    flow, so after any number of slots it has had less than one block, of `block_rows` rows, more or less than its weight
    asks. Nothing of this depends on the size of the table but the number of stretches.

    The table of slots is broadcast up to `small` units and joined by a shuffle beyond. Without `weights`, a source weighs
    its row count to the power `smoothing`. Ranks come from counts of (source, bucket) and a row number inside each bucket
    of about `bucket_rows` rows; buckets are ranges of the hash, so their number does not change the order, and a source
    with a third of all rows is dealt over all buckets. No row is dropped or repeated here; see `mixed_to_weights`.

    Null sources form one source; null and repeated ids are rows like others, and rows that are equal in all columns take
    their places in any order; columns pass through by position; an empty table gives an empty result. Sources missing in
    `weights` raise ValueError, as do weights that are not above zero and finite, and an odd `block_rows`.
    """
    if block_rows < 2 or block_rows % 2:
        raise ValueError("block_rows is to be even")
    spark, unit_rows = docs.sparkSession, block_rows // 2
    names = docs.columns
    rows = docs.toDF(*(f"_{i}" for i in range(len(names))))
    source = F.col(f"_{names.index(source_col)}").cast("string")
    # maps have no hash
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    rows = rows.withColumns({"_source": F.coalesce(F.concat(F.lit("="), source), F.lit("")), "_hash": F.xxhash64(*plain)})
    sizes_of = saved(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    # one row for each source, as many as there are target weights
    sizes = {r["_source"]: r["n"] for r in sizes_of.collect()}
    if not sizes:
        kind = "struct<block: bigint, slot: bigint, position: bigint, within: boolean>"
        return rows.select(*(f"_{i}" for i in range(len(names))), F.lit(None).cast(kind)).toDF(*names, "mix")
    if weights is None:
        weighed = {s: float(n) ** smoothing for s, n in sizes.items()}
    else:
        known = {"" if s is None else f"={s}": w for s, w in weights.items()}
        if missing := [s[1:] for s in sizes if s not in known]:
            raise ValueError(f"no weight for sources {missing[:5]}")
        weighed = {s: known[s] for s in sizes}
    if wrong := [s[1:] for s, w in weighed.items() if not 0 < w < math.inf]:
        raise ValueError(f"weights of sources {wrong[:5]} are not above zero and finite")
    exact = {s: Fraction(w) for s, w in weighed.items()}
    units = {s: -(-n // unit_rows) for s, n in sizes.items()}
    # the weights hold for every source while each has whole units left
    horizon = int(sum(exact.values()) * min(n // unit_rows / exact[s] for s, n in sizes.items()))
    flow = Flow(exact, units)
    dealt = [(start, list(q), [a for a, _ in q.values()], [n for _, n in q.values()]) for start, q in quotas(flow, flow.cuts(stretch)) if q]
    stretches = spark.createDataFrame(dealt, _STRETCHES).repartition(min(len(dealt), 1000))
    table = saved(stretches.mapInArrow(_scheduled, "_source string, _block long, _slot long"), "mix-slots")
    buckets = -(-sum(sizes.values()) // bucket_rows)
    rows = rows.withColumn("_bucket", F.floor((F.col("_hash").cast("double") / 2.0**64 + 0.5) * buckets))
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_source", "_bucket").orderBy("_hash")
    ranked = rows.withColumn("_rank", F.row_number().over(inner) - 1).join(offsets, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / unit_rows))
    ranked = ranked.join(F.broadcast(table) if sum(units.values()) <= small else table, ["_source", "_block"])
    slot = F.col("_slot")
    where = F.struct(
        F.floor(F.col("_rank") / block_rows).alias("block"), slot.alias("slot"), (F.col("_rank") % unit_rows).alias("position"),
        (slot < horizon).alias("within"),
    )
    return ranked.select(*(f"_{i}" for i in range(len(names))), where).toDF(*names, "mix")


def _in_slot_order(mixed: DataFrame, where: str | None, ordered: bool) -> DataFrame:
    """The rows of a table from `mix`, all or those `where` holds, in slot order over range partitions, without `mix`."""
    at = mixed.columns[:-1]
    mixed = mixed.toDF(*(f"_{i}" for i in range(len(at))), "_mix")
    mixed = mixed.where(where) if where else mixed
    if ordered:
        mixed = mixed.repartitionByRange("_mix.slot").sortWithinPartitions("_mix.slot", "_mix.position")
    return mixed.drop("_mix").toDF(*at)


def mixed_rows(docs: DataFrame, ordered: bool = True, **options) -> DataFrame:
    """All rows of `docs` in slot order over range partitions; those of sources that last longer follow to the end."""
    return _in_slot_order(mix(docs, **options), None, ordered)


def mixed_to_weights(docs: DataFrame, ordered: bool = True, **options) -> DataFrame:
    """The rows of `docs` whose slots come before the first source runs out, in slot order over range partitions.

    What is left meets the target weights to less than one block for each source, after any number of slots. A small source
    can run out early, and all rows from there on are dropped: for callers that want no other rows. See `mixed_rows`.
    """
    return _in_slot_order(mix(docs, **options), "_mix.within", ordered)
