"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of `documents`;
the last writes the token file and returns its digest of each document. Null texts count as empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import queries as corpus
from siteloom.llm.common import placed, saved, scratch_path
from siteloom.llm.decontaminate import decontaminate
from siteloom.llm.mixing import mixed_rows
from siteloom.llm.ngram_join import linked_rows
from siteloom.llm.quality import accepted, train_quality
from siteloom.llm.token_files import digests_in_reading_order, write_token_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest grade is probable enough; junk and toxic documents go. The fit takes a bounded sample."""
    model = train_quality(docs, corpus.table(spark, sf_dir, "labels"))
    return accepted(docs, model, corpus.LEAST_P_TOP)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that with the least id. Documents without words all stay.

    Rows that repeat an id with different texts are different documents; rows that repeat id and text are one.
    """
    keyed, found = linked_rows(docs)
    gone = saved(found.where("_key <> stays").select("_key").distinct(), "gone")
    # few ids are broadcast; more are joined by a shuffle
    kept = keyed.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, "_key", "left_anti")
    again = saved(found.where("_key IS NOT NULL").groupBy("_key").count().where("count > 1").select("_key"), "twice")
    if again.isEmpty():
        return kept.select(docs.columns)
    single = kept.join(again, "_key", "left_anti").select(docs.columns)
    return single.union(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate(docs, corpus.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in Pfair order by target weights; those of sources that last longer follow to the end."""
    return mixed_rows(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the token file written from `docs`, read back: doc_id, start, n_tokens, ids_crc32.

    Ids lie in ascending order of documents, whose places in the mixture the file keeps; the rows follow the mixture.
    """
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_file(placed(docs, "_place"), path, str(public_tokenizers.path(corpus.WORD_TOKENIZER)), place_col="_place")
    return digests_in_reading_order(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate_groups),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_file),
]

#: The classifier's weights and the tokenizer are no SQL; a test holds the run against plain Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and reread."""
    docs = corpus.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
