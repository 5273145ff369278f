"""N-gram Jaccard self-join of documents: a grouped prefix join, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, forget, salt_of, saved, spread_join
from siteloom.llm.components import components

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BYTES = 1_000_000
#: Least hashes of a set that seek its first partners; as a random sample of the set, near copies share most of them.
_HEAD = 6


class _WordHashes(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts: words lower-cased in A-Z, cut at ASCII white space."""

    def __init__(self, width: int):
        self.width, self.words = width, _WordHashes()

    def _rolled(self, values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(max(len(values) - n + 1, 0), n, dtype=np.uint64)
        for k in range(n):
            out = (out ^ values[k : k + len(out)]) * _FACTOR
            out ^= out >> np.uint64(29)
        return out

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        cut = [text.translate(_FOLD).split() for text in texts]
        ends = np.cumsum([len(words) for words in cut])
        hashed = self.words
        values = np.fromiter((hashed[w] for words in cut for w in words), np.uint64, int(ends[-1]) if len(ends) else 0)
        rolled = self._rolled(values, self.width)
        out = []
        for words, end in zip(cut, ends):
            start = end - len(words)
            if len(words) >= self.width:
                out.append(np.unique(rolled[start : end - self.width + 1]))
            else:
                out.append(self._rolled(values[start:end], len(words)) if words else np.zeros(0, np.uint64))
        return out


def _chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a bounded number of bytes, with the row of the first."""
    some, size, first = [], 0, 0
    for k, text in enumerate(batch.column(text_at).cast(pa.binary()).to_pylist()):
        some.append(text or b"")
        size += len(some[-1])
        if size > _CHUNK_BYTES:
            yield first, some
            some, size, first = [], 0, k + 1
    if some:
        yield first, some


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _repeated(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that `values` holds `least` times or more, and how often; `values` is sorted in place, and not copied."""
    values.sort()
    some = values[least - 1 :][values[least - 1 :] == values[: max(len(values) - least + 1, 0)]]
    some = np.unique(some)
    return some, np.searchsorted(values, some, "right") - np.searchsorted(values, some)


def _local_counts(width: int, least: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        # one buffer for the sets of many documents: as lists of arrays, with what counts them, they take six times as much
        shingler, values, size = Shingler(width), np.empty(held, np.uint64), 0

        def counted() -> pa.RecordBatch:
            often, counts = _repeated(values[:size], least)
            return pa.RecordBatch.from_arrays([_signed(often), pa.array(counts, pa.int64())], ["shingle", "n"])

        for batch in batches:
            for _, texts in _chunks(batch, 0):
                for new in shingler.of(texts):
                    if size + len(new) > len(values):
                        yield counted()
                        size = 0
                        if len(new) > len(values):
                            values = np.empty(len(new), np.uint64)
                    values[size : size + len(new)] = new
                    size += len(new)
        if size:
            yield counted()

    return run


def frequent_shingles(texts: DataFrame, width: int, most: int, least: int = 3, held: int = 3_000_000) -> np.ndarray:
    """At most `most` shingles that many documents have, rarest first; they come last in the global order of shingles.

    Any fixed order gives the same links: this table only keeps common passages out of the prefixes. A shingle counts
    where a task meets it in `least` or more documents, so nearly all shingles, which are rare, are never shuffled.
    """
    # small splits are counted together: what a task meets often must mean the same whatever the size of the splits
    parts, slots = texts.rdd.getNumPartitions(), texts.sparkSession.sparkContext.defaultParallelism
    texts = texts.coalesce(max(1, 2 * slots, parts // 16))
    counts = texts.mapInArrow(_local_counts(width, least, held), "shingle long, n long")
    counts = saved(counts.groupBy("shingle").agg(F.sum("n").alias("n")), "frequent")
    level = F.floor(F.log2("n") * 8)
    room, cut = most, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        cut = row["level"]
    if cut is None:
        return np.zeros(0, np.uint64)
    rows = counts.where(level >= cut).toPandas().sort_values(["n", "shingle"])
    return rows["shingle"].to_numpy(np.int64).view(np.uint64)


_SET_SCHEMA = "doc_id long, n_shingles long, group_key binary, set_key binary, prefix array<long>, n_rare int, head array<long>"


def _sets(width: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        forget()
        shingler, common = Shingler(width), frequent.value
        order = np.argsort(common)
        common = common[order]
        seen: set[bytes] = set()
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                sizes, groups, keys, prefixes, rare, heads = [], [], [], [], [], []
                known = batch.column(0).slice(first, len(texts)).is_valid().to_pylist()
                for named, values in zip(known, shingler.of(texts)):
                    n = len(values)
                    at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
                    late = common[at] == values if len(common) else np.zeros(n, bool)
                    ordered = np.concatenate([values[~late], values[late][np.argsort(order[at[late]])]])
                    prefix = ordered[: n - -(-3 * n // 4) + 1] if n else ordered
                    group = xxh3_128_digest(prefix.tobytes(), n)
                    sizes.append(n)
                    keys.append(xxh3_128_digest(values.tobytes()))
                    groups.append(group)
                    # a row without an id can't stand for its group: the next one with an id does
                    new = n and named and group not in seen
                    prefixes.append(prefix.view(np.int64) if new else None)
                    rare.append(min(len(prefix), n - int(late.sum())))
                    heads.append(values[:_HEAD].view(np.int64) if new else None)
                    if named:
                        seen.add(group)
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(groups, pa.binary()),
                        pa.array(keys, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(rare, pa.int32()),
                        pa.array(heads, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "group_key", "set_key", "prefix", "n_rare", "head"],
                )

    return run


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler(width)
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            rows = zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)))
            for a, (left, right) in zip(batch.column(0).to_pylist(), rows):
                if last[0] != a:
                    last = (a, shingler.of([left])[0])
                other = shingler.of([right])[0]
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= 75 * (len(last[1]) + len(other) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class GroupedPrefixJoin:
    """The steps of the join over one table of documents; see `near_duplicates`."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, common: int, small: int):
        self.spark: SparkSession = docs.sparkSession
        bounded_batches(self.spark)
        self.docs = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        )
        self.width, self.small = width, small
        frequent = frequent_shingles(self.docs.select("text"), width, common)
        frequent = self.spark.sparkContext.broadcast(frequent)
        self.sets = saved(self.docs.mapInArrow(_sets(width, frequent), _SET_SCHEMA), "sets")
        ids = self.sets.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn(
            "_own", F.when(F.col("prefix").isNotNull(), F.col("doc_id"))
        )
        #: documents with equal sets: `rep` stands for them, `low` is their least id
        self.classes = saved(
            ids.groupBy("group_key", "set_key").agg(
                F.coalesce(F.min("_own"), F.min("doc_id")).alias("rep"),
                F.min("_own").alias("own"),
                F.min("doc_id").alias("low"),
                F.max("n_shingles").alias("n"),
            ),
            "classes",
        )
        #: the documents that gave a group's prefix, at most one for each group and task, as the class they stand for
        self.holders = saved(
            ids.where("prefix IS NOT NULL")
            .select("doc_id", "group_key", "set_key", "head")
            .join(self.classes.select("group_key", "set_key", "rep", "n"), ["group_key", "set_key"])
            .select("doc_id", "group_key", "rep", "n", "head"),
            "holders",
        )

    def _few(self, df: DataFrame) -> DataFrame:
        """`df` marked for broadcast if it is a written table of few rows, else as it is."""
        return F.broadcast(df) if df.count() <= self.small else df

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) of distinct candidate `pairs` whose sets are similar enough."""
        pairs = saved(pairs, "pairs")
        ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
        texts = self.docs.join(self._few(ids), "doc_id", "left_semi")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
        # the first of a large group is `a` of all its copies: their texts are dealt over salts
        hot = pairs.groupBy("a").count().where("count > 64").select("a", F.lit(True).alias("_hot"))
        salt = F.when(F.col("_hot"), salt_of("b", 64, run=1)).otherwise(0)
        rows = pairs.join(hot, "a", "left").withColumn("_salt", salt).select("a", "b", "_salt")
        both = spread_join(rows.join(right, "b"), left, ["a"], "_salt", homes=rows.select("a", "_salt"))
        both = both.select("a", "b", "left", "right")
        return saved(both.mapInArrow(_verify(self.width), "a long, b long"), "links").distinct()

    @staticmethod
    def near_in_size(a: str, b: str):
        return F.col(a) * 4 >= F.col(b) * 3, F.col(b) * 4 >= F.col(a) * 3

    def first_links(self) -> DataFrame:
        """Links of each class with the first of its group, and of groups with the least group that shares a least hash."""
        heads = self.classes.groupBy("group_key").agg(F.min("own").alias("a"))
        inner = self.classes.select("group_key", F.col("rep").alias("b")).join(heads, "group_key").select("a", "b")
        keys = self.holders.select("rep", "n", F.explode("head").alias("token")).distinct()
        keys = keys.withColumn("_salt", salt_of("rep", 64))
        pivots = keys.groupBy("token").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        sizes = self.holders.select(F.col("rep").alias("a"), F.col("n").alias("m")).distinct()
        pairs = spread_join(keys, pivots.select("token", "a"), ["token"], "_salt").where("a <> rep")
        pairs = pairs.select("a", F.col("rep").alias("b"), "n").distinct().join(sizes, "a")
        ok = self.near_in_size("n", "m")
        return self.verified(inner.where("a <> b").union(pairs.where(ok[0] & ok[1]).select("a", "b")).distinct())

    def postings(self, comps: DataFrame) -> DataFrame:
        """(prefix, n_rare, rep, n, comp) for each group, once for each component in the group."""
        named = self.classes.join(comps, F.col("rep") == F.col("node"), "left")
        named = saved(named.select("group_key", "rep", "n", F.coalesce("comp", "rep").alias("comp")), "named")
        groups = named.groupBy("group_key", "comp").agg(F.min("rep").alias("rep"), F.max("n").alias("n"))
        self.mates = named.select("group_key", "comp", F.col("rep").alias("mate")).join(
            groups.select("group_key", "comp", "rep"), ["group_key", "comp"]
        )
        firsts = self.holders.groupBy("group_key").agg(F.min("doc_id").alias("doc_id"))
        known = saved(firsts.join(groups, "group_key").drop("group_key"), "known")
        rows = self.sets.where("prefix IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "prefix", "n_rare")
        return rows.join(self._few(known), "doc_id")

    def crossing(self, comps: DataFrame) -> DataFrame:
        """(token, rep, n, comp, f) of the prefix shingles that groups of two or more components share; f groups have it.

        Shingles outside of the table of common ones are in few documents: their rows are dealt out once, and a window over
        a shingle sees whether its components differ. Common ones are summed in partial sums first, as each may be in a
        third of all groups, and the few that are shared then meet their rows again.
        """
        groups, of = self.postings(comps), ["rep", "n", "comp"]
        own = Window.partitionBy("token")
        rare = groups.select(F.explode(F.slice("prefix", 1, F.col("n_rare"))).alias("token"), *of)
        ends = [F.min("comp").over(own).alias("_a"), F.max("comp").over(own).alias("_b"), F.count(F.lit(1)).over(own).alias("f")]
        rare = rare.select("token", *of, *ends).where("_a < _b").select("token", *of, "f")
        late = F.slice("prefix", F.col("n_rare") + 1, F.greatest(F.size("prefix") - F.col("n_rare"), F.lit(0)))
        common = groups.where(F.size("prefix") > F.col("n_rare")).select(F.explode(late).alias("token"), *of)
        sums = common.groupBy("token").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count(F.lit(1)).alias("f"))
        shared = saved(sums.where("_a < _b").select("token", "f"), "shared")
        return saved(rare.union(common.join(self._few(shared), "token").select("token", *of, "f")), "crossing")

    def merged(self, comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components after `links` are added."""
        if links.isEmpty():
            return comps
        named = links
        for side in ("a", "b"):
            of = comps.select(F.col("node").alias(side), F.col("comp").alias("_" + side))
            named = named.join(of, side, "left").withColumn("_" + side, F.coalesce("_" + side, side))
        new = components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        new = new.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        nodes = nodes.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")).union(comps)
        nodes = nodes.join(new, F.col("comp") == F.col("_node"), "left")
        return saved(nodes.select("node", F.coalesce("_comp", "comp").alias("comp")), "comps")

    @staticmethod
    def relabelled(postings: DataFrame, comps: DataFrame) -> DataFrame:
        moved = postings.drop("comp").join(comps, F.col("rep") == F.col("node"), "left")
        return moved.select("token", "rep", "n", F.coalesce("comp", "rep").alias("comp"), "f")

    def stars(self, crossing: DataFrame, turn: int) -> DataFrame:
        """Candidates between each component of a shingle, by one of its classes, and one component of the shingle.

        A hash of the class and the turn picks both, so that each turn tries other pairs.

        Pairs that share few shingles in this way are left to `rest`, which misses none.
        """
        pick = F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n")
        heads = crossing.groupBy("token", "comp").agg(F.min(pick).alias("b"))
        pivots = heads.groupBy("token").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        pairs = heads.join(pivots, "token").where("a.rep <> b.rep").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_shared"))
        pairs = pairs.select("_shared", F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.n").alias("_m"), F.col("b.n").alias("_n"))
        ok = self.near_in_size("_m", "_n")
        pairs = pairs.where(ok[0] & ok[1] & (F.col("_shared") >= self.must_share("_m", "_n")))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    @staticmethod
    def must_share(a: str, b: str):
        """How many shingles the prefixes of similar sets of sizes `a` and `b` share at least.

        At most n - overlap shingles of a set are not in the other, and of the two prefixes the one that ends first in the
        global order has all its common shingles in the other.
        """
        overlap = F.ceil((F.col(a) + F.col(b)) * 3 / 7)

        def least(n: str):
            return overlap - F.ceil(F.col(n) * 3 / 4) + 1

        return F.greatest(F.lit(1), F.least(least(a), least(b)))

    def rest(self, crossing: DataFrame) -> DataFrame:
        """All candidates between components: groups that fit in size and share enough shingles of their prefixes.

        Groups meet by bands of size: under a key of shingle, size class of the smaller and difference of the classes, hashed.
        If two groups must share k shingles, the rarest that they share has k - 1 more frequent ones on both sides: `_top`
        counts a group's shingles from the most frequent, and rows that can't be that rarest one do not meet. So a copy with
        many shingles of its own, which has few left to share, meets nobody in a group of copies that it can't be linked with.

        Under a common shingle, one component may have most of the groups (the copies of one text). Its groups need not meet
        each other, so of two groups that meet, one at least is from another component: tag 0 holds those of other components
        on one side and all on the other, tag 1 those of the main one and those of others.
        """
        step, bands = 1.06, 5
        counts = crossing.where("f > 32").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_c")).where("_c > 16")
        main = saved(counts.groupBy("token").agg(F.max(F.struct("_c", "comp"))["comp"].alias("_main")), "main")
        top = Window.partitionBy("rep").orderBy(F.desc("f"), "token")
        rows = crossing.withColumn("_top", F.row_number().over(top)).join(self._few(main), "token", "left")
        rows = saved(rows.withColumn("_class", F.floor(F.log("n") / math.log(step))), "ranked")
        is_main = F.coalesce(F.col("comp") == F.col("_main"), F.lit(False))
        tags = {"a": F.array(is_main.cast("int")), "b": F.when(is_main | F.col("_main").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))}
        n, sides = F.col("n").cast("double"), {}
        for side, way in (("a", 1), ("b", -1)):
            options = []
            for d in range(bands + 1):
                # the partner's size is between these; a hair of slack guards against rounding of logarithms
                sizes = [n * step ** (way * e) for e in (max(d - 1, 0) - 0.001, d + 1.001)]
                musts = [F.floor(F.least((n + m) * 3 / 7 - n * 3 / 4, (n + m) * 3 / 7 - m * 3 / 4)) for m in sizes]
                options.append(
                    F.struct(F.lit(d).alias("d"), (F.col("_class") - (0 if way > 0 else d)).alias("low"), F.greatest(F.lit(1), F.least(*musts)).alias("must"))
                )
            banded = rows.select("token", "rep", "n", "comp", "_top", tags[side].alias("_tags"), F.explode(F.array(*options)).alias("o"))
            banded = banded.where(F.col("_top") >= F.col("o.must")).withColumn("_tag", F.explode("_tags"))
            sides[side] = banded.select(
                F.xxhash64("token", "o.d", "o.low", "_tag").alias("key"),
                *(F.col(c).alias(f"{side}_{c.strip('_')}") for c in ("rep", "n", "comp", "_top")),
            )
        ok = self.near_in_size("a_n", "b_n")
        order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_rep") < F.col("b_rep")))
        enough = F.least("a_top", "b_top") >= self.must_share("a_n", "b_n")
        meet = (F.col("a_comp") != F.col("b_comp")) & order & ok[0] & ok[1] & enough
        pairs = sides["a"].join(sides["b"], "key").where(meet).select("a_rep", "b_rep")
        pairs = saved(pairs.distinct(), "near")
        held = saved(crossing.groupBy("rep", "n").agg(F.collect_set("token").alias("held")), "held")
        for side in ("a", "b"):
            own = held.select(F.col("rep").alias(f"{side}_rep"), F.col("n").alias(f"{side}_n"), F.col("held").alias(f"{side}_held"))
            pairs = pairs.join(own, f"{side}_rep")
        shared = F.size(F.array_intersect("a_held", "b_held"))
        pairs = pairs.where(shared >= self.must_share("a_n", "b_n"))
        return pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct()

    def members(self, pairs: DataFrame) -> DataFrame:
        """Candidate groups, given by one class of each, as all pairs of their classes."""
        several = saved(self.mates.where("mate <> rep").select("rep", "mate"), "mates")
        if several.isEmpty():
            return pairs
        several = several.union(several.select("rep", F.col("rep").alias("mate")).distinct())
        for side in ("a", "b"):
            own = several.select(F.col("rep").alias(side), F.col("mate").alias("_mate"))
            pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("_mate", side)).drop("_mate")
        return pairs.distinct()

    def run(self, turns: int = 1) -> DataFrame:
        comps = self.spark.createDataFrame([], "node long, comp long")
        comps = self.merged(comps, self.first_links())
        crossing = self.crossing(comps)
        for turn in range(turns):
            links = self.verified(self.stars(crossing, turn))
            if links.isEmpty():
                break
            comps = self.merged(comps, links)
            crossing = saved(self.relabelled(crossing, comps), "crossing")
        comps = self.merged(comps, self.verified(self.members(self.rest(crossing))))
        named = self.classes.join(comps, F.col("rep") == F.col("node"), "left").withColumn("_comp", F.coalesce("comp", "rep"))
        lows = named.groupBy("_comp").agg(F.min("low").alias("component_id"))
        named = spread_join(named.withColumn("_salt", salt_of("rep", 64, run=1)), lows, ["_comp"], "_salt")
        return named.select("group_key", "set_key", "component_id")


def row_keys(docs: DataFrame, id_col: str, text_col: str, small: int) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with `_key`, which no two different texts share, and (_key, _id) of the keys that are no ids, if any.

    Rows that repeat an id with different texts are different documents: the text with the least digest has the id as its
    key, each other one a key above all ids; if ids reach so far up that there might be no room, all pairs of id and digest
    are numbered anew. Null ids have no key. Usually no id is repeated, and ids are their own keys.
    """

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= small else df

    own = docs.withColumn("_key", F.col(id_col).cast("long"))
    again = own.where("_key IS NOT NULL").groupBy("_key").count().where("count > 1").select("_key")
    again = saved(again, "again")
    if again.isEmpty():
        return own, None
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = own.join(few(again), "_key", "left_semi").select("_key", digest.alias("_digest")).distinct()
    texts = saved(texts, "texts")
    first = texts.groupBy("_key").agg(F.min("_digest").alias("_digest"))
    top = own.agg(F.max("_key")).first()[0]
    if top >= 1 << 62:
        pairs = own.where("_key IS NOT NULL").select("_key", digest.alias("_digest")).distinct()
        keys = saved(pairs.select(F.col("_key").alias("_id"), "_digest", F.monotonically_increasing_id().alias("_other")), "keys")
        keyed = own.withColumn("_digest", digest).join(few(keys.withColumnRenamed("_id", "_key")), ["_key", "_digest"], "left")
        return keyed.withColumn("_key", F.col("_other")).select(*docs.columns, "_key"), keys.select(F.col("_other").alias("_key"), "_id")
    more = texts.join(first, ["_key", "_digest"], "left_anti").withColumnRenamed("_key", "_id")
    keys = saved(more.withColumn("_other", F.monotonically_increasing_id() + (top + 1)), "keys")
    keyed = own.withColumn("_digest", digest).join(few(keys.withColumnRenamed("_id", "_key")), ["_key", "_digest"], "left")
    keyed = keyed.withColumn("_key", F.coalesce("_other", "_key")).select(*docs.columns, "_key")
    return keyed, keys.select(F.col("_other").alias("_key"), "_id")


def linked_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, common: int = 1_000_000, small: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """`docs` with a `_key` for each (id, text), and per row of it (_key, _id, n_shingles, component_id, stays).

    `component_id` is the least id of the component, and `stays` the key of the row that has it. See `near_duplicates`.
    """
    docs, others = row_keys(docs, id_col, text_col, small)
    join = GroupedPrefixJoin(docs, "_key", text_col, width, common, small)
    found = join.run()
    rows = join.sets.select("doc_id", "n_shingles", "group_key", "set_key").withColumn("_salt", salt_of("doc_id", 64))
    linked = spread_join(rows.where("n_shingles > 0"), found, ["group_key", "set_key"], "_salt", "left")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = linked.select("doc_id", "n_shingles", "component_id").union(alone).withColumnRenamed("doc_id", "_key")
    if others is None:
        return docs, rows.select("_key", F.col("_key").alias("_id"), "n_shingles", "component_id", F.col("component_id").alias("stays"))
    rows = rows.join(F.broadcast(others) if others.count() <= small else others, "_key", "left")
    rows = saved(rows.withColumn("_id", F.coalesce("_id", "_key")).withColumn("_salt", salt_of("_key", 64, run=1)), "rows")
    least = rows.where("_key IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("_low"))
    rows = spread_join(rows, least, ["component_id"], "_salt", "left")
    return docs, rows.select("_key", "_id", "n_shingles", F.col("_low._id").alias("component_id"), F.col("_low._key").alias("stays"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    common: int = 1_000_000,
    small: int = 1_000_000,
) -> DataFrame:
    """Per document: its id, `n_shingles` (distinct word shingles) and `component_id` (least id reachable by links).

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more. Sets are ordered
    by one global order, common shingles last; documents with the same size and the same prefix form one group, and only
    groups enter the index, so two groups are candidates only if they fit in size and share enough shingles of their prefixes.

    The result asks for components, so candidates that are already in one component need no check. First, each group meets
    only the least group under each of its six least hashes, and the classes of a group its first: a group of
    thousands of near copies becomes a star, not all its pairs. Then the whole prefixes are counted by shingle, and only
    shingles that groups of different components share go on: first as stars between components, last as all remaining
    pairs, expanded to the groups' members and verified on whole texts. So no link between two components is missed.

    `common` bounds the broadcast table of common shingles (it steers cost, not results); `small` is the most rows of
    an id table that is broadcast, beyond which the same join shuffles. Texts without words (null, empty) have an empty
    set and link with nothing; documents of fewer than five words have one shingle. Rows are documents: those that repeat
    an id each have the set and the component of their own text. Null ids get the component of an equal set, or null.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    _, found = linked_rows(docs, "_doc", "_text", width, common, small)
    return found.select(F.col("_id").alias(id_col), "n_shingles", "component_id")
