"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_batches, saved

_WORD = re.compile(r"[^\W\d_]+")
_SIZES = (4, 5)
#: Words kept with their n-grams, and n-grams counted before the counts are handed on; both bound a task's memory.
_KEPT_WORDS, _KEPT_GRAMS = 200_000, 1_000_000


def grams_of(word: str) -> set[str]:
    """The character n-grams of a word between two marks for its ends; a shorter word is one n-gram by itself."""
    marked = f"<{word}>"
    return {marked[i : i + n] for n in _SIZES for i in range(len(marked) - n + 1)} or {marked}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class GramFinder:
    """Which of the wanted n-grams whole texts have; words met before are kept, up to a bounded number."""

    def __init__(self, wanted: dict[str, float]):
        self.wanted, self.kept = wanted, {}

    def __call__(self, text: str | None) -> set[str]:
        found: set[str] = set()
        for word in words_of(text):
            own = self.kept.get(word)
            if own is None:
                if len(self.kept) >= _KEPT_WORDS:
                    self.kept = {}
                own = self.kept[word] = tuple(g for g in grams_of(word) if g in self.wanted)
            if own:
                found.update(own)
        return found


class GramCounter:
    """In how many texts of each label n-grams stand; a text counts an n-gram once. `take` hands the counts on."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.kept: dict[str, np.ndarray] = {}
        self.counts = np.zeros((2, 2 * _KEPT_GRAMS), dtype=np.int32)

    def add(self, label: int, text: str | None) -> None:
        own = []
        for word in words_of(text):
            numbers = self.kept.get(word)
            if numbers is None:
                if len(self.kept) >= _KEPT_WORDS:
                    self.kept = {}
                numbers = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in grams_of(word)], dtype=np.int32)
                self.kept[word] = numbers
            own.append(numbers)
        if not own:
            return
        found = np.unique(np.concatenate(own))
        if found[-1] >= self.counts.shape[1]:
            self.counts = np.pad(self.counts, ((0, 0), (0, int(found[-1]) + 1)))
        self.counts[label, found] += 1

    def take(self) -> pa.RecordBatch:
        n = len(self.numbers)
        columns = [pa.array(list(self.numbers), pa.string()), *(pa.array(self.counts[k, :n].astype(np.int64)) for k in (1, 0))]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, ["gram", "toxic", "clean"])


@dataclass
class ToxicityModel:
    """P(toxic | x) = logistic(bias + the sum of weights of the n-grams that a text has); a weight is w r, with r the
    log-count ratio of the n-gram and w what the regression fits."""

    bias: float
    weights: dict[str, float]

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(sorted(self.weights[g] for g in found))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def remainder(key: Column, folds: int = 5) -> Column:
    """crc32 of an id as text modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, clean) sums over the texts of a task, in parts of bounded size."""
    counter = GramCounter()
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counter.add(label, text)
            if len(counter.numbers) >= _KEPT_GRAMS:
                yield counter.take()
    yield counter.take()


def fit_linear(x: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratios: np.ndarray, ridge: float, steps: int = 60) -> tuple[float, np.ndarray]:
    """(bias, weights of the unscaled features) of the ridge-penalised logistic regression on features scaled by `ratios`.

    `x` has the columns present in each row. Steps are Newton's with a line search, so the minimum does not depend on a rate.
    """
    n, d = len(x), len(ratios)
    dense = np.zeros((n, d + 1), dtype=np.float32)
    dense[:, d] = 1.0
    for i, columns in enumerate(x):
        dense[i, columns] = ratios[columns]
    penalty = np.full(d + 1, ridge)
    penalty[d] = 0.0
    total = max(weight.sum(), 1e-9)
    w = np.zeros(d + 1)
    sign = np.where(toxic > 0, 1.0, -1.0)

    def loss(v: np.ndarray) -> float:
        margin = sign * (dense @ v.astype(np.float32)).astype(float)
        return float((weight * np.logaddexp(0, -margin)).sum() / total + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(steps if n else 0):
        p = 1 / (1 + np.exp(-np.clip((dense @ w.astype(np.float32)).astype(float), -35, 35)))
        slope = dense.T @ ((weight * (p - (toxic > 0))) / total).astype(np.float32) + penalty * w
        curve = np.sqrt(weight * np.maximum(p * (1 - p), 1e-6) / total).astype(np.float32)
        scaled = dense * curve[:, None]
        hessian = (scaled.T @ scaled).astype(float) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, slope)
        rate = 1.0
        while rate > 1e-4 and (then := loss(w - rate * step)) > now - 1e-4 * rate * float(slope @ step):
            rate /= 2
        if rate <= 1e-4:
            break
        w, before, now = w - rate * step, now, then
        if before - now < 1e-7:
            break
    return float(w[d]), w[:d] * ratios


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int | None = 0,
    sample: int = 12_000, features: int = 1024, least_z: float = 4.0, alpha: float = 1.0, ridge: float = 1e-5, small: int = 1_000_000,
) -> ToxicityModel:
    """The model of `labels` (doc_id, toxic), learnt from rows whose id has another remainder than `held_out_fold` (None: all).

    Document counts of n-grams by label cover all labelled rows and whole texts; they are summed by Spark and give the
    log-count ratios r = log((toxic + alpha) / (T + 2 alpha)) - log((clean + alpha) / (C + 2 alpha)). The regression takes
    the `features` n-grams whose share of toxic texts is farthest from the overall share, at least `least_z` standard
    deviations (equal ones by name), and at most half of `sample` rows of each label, those with the least hash of their
    id, weighted by the size of their label. Only these features and rows reach the driver.

    Labels with a null id or label are left out, those above zero count as toxic; labels that repeat an id or documents that
    do are learnt each; null texts count as empty; other columns are ignored. Without any row of one of the labels the model
    gives the share of toxic labels, 0.5 without labels.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("_toxic"))
    if held_out_fold is not None:
        marked = marked.where(remainder(F.col("_id")) != held_out_fold)
    marked = saved(marked.withColumn("_hash", F.xxhash64("_id")), "labels")
    sizes = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = min(max((n_toxic + 0.5) / (n_toxic + n_clean + 1), 1e-6), 1 - 1e-6)
        return ToxicityModel(float(np.log(share / (1 - share))), {})
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    near = F.broadcast(marked) if n_toxic + n_clean <= small else marked
    labelled = rows.join(near, "_id").select("_toxic", "_text")
    counts = labelled.mapInArrow(_counted, "gram string, toxic long, clean long")
    counts = counts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share, seen = F.lit(n_toxic / (n_toxic + n_clean)), F.col("toxic") + F.col("clean")
    z = F.abs(F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    chosen = counts.withColumn("z", F.round(z, 9)).where(F.col("z") >= least_z).orderBy(F.desc("z"), "gram").limit(features).collect()
    column = {r["gram"]: k for k, r in enumerate(chosen)}
    ratios = np.array(
        [np.log((r["toxic"] + alpha) / (n_toxic + 2 * alpha)) - np.log((r["clean"] + alpha) / (n_clean + 2 * alpha)) for r in chosen]
    )
    parts = [marked.where(f"_toxic = {k}").orderBy("_hash", "_id").limit(sample // 2) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = GramFinder(shared.value)
        for batch in batches:
            found = [sorted(shared.value[g] for g in finder(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "x"])

    taken = rows.join(F.broadcast(parts[0].union(parts[1])), "_id").select("_toxic", "_text").mapInArrow(present, "toxic int, x array<int>")
    found = sorted((r["toxic"], r["x"]) for r in taken.toLocalIterator())
    toxic = np.array([t for t, _ in found], dtype=np.int64)
    got = np.bincount(toxic, minlength=2)
    weight = np.where(toxic > 0, n_toxic / max(got[1], 1), n_clean / max(got[0], 1))
    bias, weights = fit_linear([np.array(x, dtype=np.int64) for _, x in found], toxic, weight, ratios, ridge)
    return ToxicityModel(bias, {g: float(weights[k]) for g, k in column.items()})


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with a last column `toxicity`: the probability that a whole text is toxic.

    One narrow pass; only the text is read for it. Null texts count as empty, which have the model's bias; repeated rows are
    scored each; long texts have the distinct n-grams of all their words; columns pass through by position, whatever their
    names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    fields, text_at = docs.schema.fields, docs.columns.index(text_col)
    kept = [i for i in range(len(fields)) if keep_text or i != text_at]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = GramFinder(model.weights)
        for batch in batches:
            scores = [model.score(finder(t)) for t in batch.column(text_at).to_pylist()]
            columns = [*(batch.column(i) for i in kept), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return docs.mapInArrow(run, T.StructType([*(fields[i] for i in kept), T.StructField("toxicity", T.DoubleType())]))
