"""Token counts without tokens: a count-only Viterbi over Aho-Corasick matches of a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_batches

SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
#: Characters of words whose counts are kept, and the longest word that is.
_CACHE_CHARS, _CACHE_WORD = 8_000_000, 100
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def load_pieces(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece vocabulary file, in id order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts the pieces of the best segmentation under a unigram model with byte fallback.

    The rules are those of the tokenizers library's Unigram model: a character that no one-character piece covers may be
    taken as unknown, at the lowest score less 10, and counts as many pieces as it has UTF-8 bytes; of segmentations with
    equal scores ending at one place, the one whose last piece is longest stays, as it is met first and only a strictly
    better score replaces it.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        crossing = [p for p, _ in pieces if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces across word ends are not supported: {crossing[:3]}")
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - _UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.room = _CACHE_CHARS

    def viterbi(self, run: str) -> int:
        """Pieces of one run, by a dynamic programme that carries only the best score and its count for each end."""
        n = len(run)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        found: list[list] = [[] for _ in run]
        for end, match in self.matches.iter(run):
            found[end].append(match)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for size, score in sorted(found[end - 1], reverse=True):
                single = single or size == 1
                score += best[end - size]
                if top is None or score > top:
                    top, pieces = score, count[end - size] + 1
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[end - 1] + len(run[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of a text, spaces as U+2581 and one put before it. No piece spans a word's end, so words add up."""
        if not text:
            return 0
        if "  " in text or SPACE in text or text[-1] == " " or text[0] == " ":
            text = text.replace(" ", SPACE)
            runs = _RUNS.findall(text if text[0] == SPACE else SPACE + text)
        else:
            runs = text.split(" ")
            runs = [SPACE + run for run in runs]
        known = self.known
        total = 0
        for run in runs:
            size = known.get(run)
            if size is None:
                size = self.viterbi(run)
                if len(run) <= _CACHE_WORD:
                    if self.room < len(run):
                        known.clear()
                        self.room = _CACHE_CHARS
                    known[run] = size
                    self.room -= len(run)
            total += size
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], text_col: str = "text", out: str = "n_pieces") -> DataFrame:
    """`docs` without its text but with `out`: the number of unigram pieces of each whole text.

    One narrow pass, no shuffle. The vocabulary is broadcast: its size is that of the tokenizer, not of the data. Null and
    empty texts count 0; repeated rows are counted each for itself; other columns pass through by position.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)
    text_at = docs.columns.index(text_col)
    others = [i for i in range(len(docs.columns)) if i != text_at]
    counter: list[PieceCounter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not counter:
                counter.append(PieceCounter(vocabulary.value))
            sizes = [counter[0].count(text or "") for text in batch.column(text_at).to_pylist()]
            columns = [*(batch.column(i) for i in others), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    fields = [docs.schema.fields[i] for i in others] + [T.StructField(out, T.LongType())]
    return docs.mapInArrow(run, T.StructType(fields))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_pieces, and n_chars (code points of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.length(text).cast("long").alias("_chars"), text.alias("_text"))
    counted = token_counts(rows, load_pieces(model_path), "_text")
    return counted.select(id_col, F.col("n_pieces"), F.col("_chars").alias("n_chars"))
