"""Token-id files: documents encoded in id order, stored as blocks of directly addressable codes.

A token file is a Parquet dataset, so Spark writes, commits and reads it on any store. A row is a block of whole
documents: `shard` and `block` give its place, `first` the ids before it in its shard, `n` its ids, `payload` the packed
ids (see `dac`), and `doc_ids`, `doc_starts`, `doc_sizes` say where each document lies in it. Shards follow one another
in id order. `doc_places` has each document's place in the order in which it is to be read, if the writer was given one.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, kept, saved
from siteloom.llm.dac import Packed, pack

#: Folder of a token file's directory of shards; Spark passes over names that begin so when it reads the blocks.
_SHARDS = "_shards"
_CACHE_WORDS = 400_000
_BATCH_BYTES = 2_000_000
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class CachedEncoder:
    """Ids of UTF-8 texts as little-endian u32 bytes, from the tokenizers library, each distinct word encoded once.

    For tokenizers that lower-case, drop white space, and never join across it, as word_bpe_49k does: texts are folded in
    A-Z and cut at spaces and line feeds, ASCII marks (no apostrophes) after a Latin letter are a word of their own, as the
    tokenizer cuts there whatever follows, and words of letters only are encoded many at a time, told apart by the word-end mark that their last token carries. A text that holds the
    opening of a special token goes to the library as it is.
    """

    def __init__(self, tokenizer_json: str, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(word_end)]] = True
        self.special = [x.content[:2].encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        #: what was known before the cache filled up last; words in use move back from there
        self.older: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        stem: dict[bytes, tuple[bytes, bytes]] = {}
        ends = set(_MARKS)
        marked = [w for w in words if w and w[-1] in ends]
        parts = words.difference(marked)
        for w in marked:
            bare = w.rstrip(_MARKS)
            last = bare[-2:].decode("utf-8", "ignore")[-1:]
            if last.isalpha() and last < "\u0250" and last != "\u0130":
                stem[w] = (bare, w[len(bare) :])
                parts.update(stem[w])
            else:
                parts.add(w)
        new = list(parts - self.known.keys())
        texts = [w.decode("utf-8", "replace") for w in new]
        only = [t.isalpha() for t in texts]
        letters, names = list(compress(texts, only)), list(compress(new, only))
        runs = [(letters[i : i + 500], names[i : i + 500]) for i in range(0, len(letters), 500)]
        for (run, words_of_run), code in zip(runs, self._plain([" ".join(r) for r, _ in runs])):
            cuts = [0, *(4 * (np.flatnonzero(self.ends[np.frombuffer(code, "<u4")]) + 1)).tolist()]
            codes = [code[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(run) + 1 else self._plain(run)
            self.known.update(zip(words_of_run, codes))
        others = [not x for x in only]
        self.known.update(zip(compress(new, others), self._plain(list(compress(texts, others)))))
        for w, (bare, marks) in stem.items():
            self.known[w] = self.known[bare] + self.known[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > _CACHE_WORDS:
            self.known, self.older = {}, self.known
        own = [any(x in text for x in self.special) for text in texts]
        cut = [[] if o else text.translate(_FOLD).replace(b"\n", b" ").split(b" ") for text, o in zip(texts, own)]
        if new := set().union(*cut) - self.known.keys():
            back = new & self.older.keys()
            self.known.update((w, self.older[w]) for w in back)
            if new := new - back:
                self._learn(new)
        known = self.known.__getitem__
        codes = [b"".join(map(known, words)) for words in cut]
        for k, o in enumerate(own):
            if o:
                codes[k] = self._plain([texts[k].decode()])[0]
        return codes


def encoder_of(tokenizer_json: str) -> CachedEncoder:
    """One encoder for a tokenizer in a worker process, so that what one task learnt serves the next."""
    return kept(hashlib.sha256(tokenizer_json.encode()).hexdigest(), lambda: CachedEncoder(tokenizer_json))


_BLOCK_SCHEMA = (
    "shard int, block int, first long, n long, doc_ids array<long>, doc_starts array<long>, doc_sizes array<long>, "
    "doc_places array<long>, payload binary"
)


def _encode_blocks(tokenizer_json, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = None, np.array([end_id], "<u4").tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        places: list = []
        codes: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            sizes = [len(c) // 4 for c in codes]
            starts = np.cumsum([0, *sizes])[:-1].tolist()
            values = [shard, block, first, held, ids, starts, sizes, places, pack(np.frombuffer(b"".join(codes), "<u4"))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            names = [x.split()[0] for x in _BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        def pieces():
            for batch in batches:
                some, chars = [], 0
                for row_of in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    some.append(row_of)
                    chars += len(row_of[1])
                    if chars > _BATCH_BYTES:
                        yield some
                        some, chars = [], 0
                if some:
                    yield some

        for some in pieces():
            encoder = encoder or encoder_of(tokenizer_json.value)
            for (doc_id, _, place), code in zip(some, encoder.encode([text for _, text, _ in some])):
                ids.append(doc_id)
                places.append(place)
                codes.append(code + end)
                held += len(code) // 4 + 1
                if held >= block_tokens:
                    yield row()
                    block, first, held, ids, places, codes = block + 1, first + held, 0, [], [], []
        if ids:
            yield row()

    return run


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    block_tokens: int = 1 << 18,
    place_col: str | None = None,
) -> None:
    """Encode whole texts in ascending id order into the token file `path`; every document ends with `end_id`.

    Documents are range-partitioned by id, so each task encodes one stretch of the order and holds one block at a time;
    a document longer than a block makes a block of its own. Null texts give the end id alone; null ids come first; rows
    that repeat an id lie side by side. The tokenizer travels as a broadcast of its file, read on the driver. `place_col` gives
    each document's place in the order of reading, which the file keeps beside its ids; see `digests_in_reading_order`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    # as many as the input has splits, so that a shard's size does not grow with the data
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    place = F.col(place_col) if place_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), place.cast("long").alias("_place"))
    rows = rows.repartitionByRange(shards, "_id", F.xxhash64("_text")).sortWithinPartitions("_id", "_text")
    blocks = rows.mapInArrow(_encode_blocks(tokenizer, end_id, block_tokens), _BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(path)
    # a row for each shard: as many as the writer had tasks
    sizes = spark.read.schema(_BLOCK_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases.coalesce(1).write.parquet(f"{path}/{_SHARDS}")


def open_token_file(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file, with `start`: the number of ids in the whole file before the block."""
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(path)
    bases = _shards(spark, path).select("shard", F.col("base").alias("_base"))
    blocks = blocks.join(F.broadcast(bases), "shard")
    return blocks.withColumn("start", F.col("_base") + F.col("first")).drop("_base")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The directory of a token file: of each shard, its ids and those in shards before it."""
    return spark.read.schema("shard int, n long, base long").parquet(f"{path}/{_SHARDS}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, doc_ids, starts, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
            ids = Packed(payload).all().astype("<u4")
            sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
            columns = [doc_ids, [start + a for a in starts], sizes, sums]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file, read back from it: doc_id, start, n_tokens, ids_crc32."""
    blocks = open_token_file(spark, path).select("start", "doc_ids", "doc_starts", "doc_sizes", "payload")
    return blocks.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digests_in_reading_order(spark: SparkSession, path: str) -> DataFrame:
    """`document_digests`, its rows by the places that the file keeps: range by range, so one task never has all of them."""
    blocks = open_token_file(spark, path).select("start", "doc_starts", "doc_places")
    pair = F.explode(F.arrays_zip("doc_starts", "doc_places")).alias("_at")
    places = blocks.select("start", pair).select((F.col("start") + F.col("_at.doc_starts")).alias("start"), F.col("_at.doc_places").alias("_place"))
    # every document has its end id at least, so its start tells it from all others
    found = saved(document_digests(spark, path), "digests")
    return found.join(places, "start").orderBy("_place").select(found.columns)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """One id by its place in the whole file: the directory gives the shard, the shard's statistics its block; only that is
    fetched, and no other id of it is decoded."""
    home = _shards(spark, path).where((F.col("base") <= position) & (F.col("base") + F.col("n") > position)).head()
    if home is None:
        return None
    at = position - home["base"]
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(path).where((F.col("shard") == home["shard"]) & (F.col("first") <= at))
    found = blocks.where(F.col("first") + F.col("n") > at).select("first", "payload").head()
    return Packed(bytes(found["payload"]))[at - found["first"]]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start and its ids, in the order of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, starts, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = Packed(payload).all()
                lists = [ids[a : a + n].astype(np.int64) for a, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([start + a for a in starts], pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "start", "ids"],
                )

    blocks = open_token_file(spark, path).select("start", "doc_ids", "doc_starts", "doc_sizes", "payload")
    return blocks.mapInArrow(run, "doc_id long, start long, ids array<long>")
