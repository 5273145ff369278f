"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_batches, forget

_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]{2,}")


def features_of(text: str) -> set[str]:
    """What a text shows: its words, their first letters, runs of marks, and coarse measures of repetition and case."""
    raw = text.split()
    words = set(_WORD.findall(text.lower()))
    found = words | {f"^{w[:k]}" for w in words for k in (4, 5) if len(w) > k}
    found.update(f"!{m[:3]}" for m in set(_MARKS.findall(text)))
    n = len(raw)
    if n >= 8:
        upper = sum(w.isupper() for w in raw) / n
        bare = sum(not any(c.isalnum() for c in w) for w in raw) / n
        marked = sum(not w[-1].isalnum() for w in raw) / n
        found.update((f"~distinct{int(10 * len(set(raw)) / n)}", f"~upper{int(5 * upper)}", f"~bare{int(5 * bare)}", f"~marked{int(5 * marked)}"))
        same = sum(a == b for a, b in zip(raw, raw[1:])) / n
        found.add(f"~same{int(10 * same)}")
    return found


def hashed(names: set[str], size: int) -> np.ndarray:
    from xxhash import xxh32_intdigest

    return np.unique(np.array([xxh32_intdigest(n) % size for n in names], dtype=np.int64))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """P(grade <= k | x) = logistic(threshold_k - x . weights): one weight vector, ordered thresholds."""

    size: int
    weights: dict[int, float]
    thresholds: list[float]

    def score(self, names: set[str]) -> float:
        from xxhash import xxh32_intdigest

        slots = {xxh32_intdigest(n) % self.size for n in names}
        return sum(self.weights[s] for s in sorted(slots & self.weights.keys()))

    def below(self, score: float) -> np.ndarray:
        return _logistic(np.array(self.thresholds) - score)

    def graded(self, score: float) -> tuple[float, float]:
        """Expected grade, and the tail probability of the highest grade."""
        below = self.below(score)
        return float(len(below) - below.sum()), float(1 - below[-1])


def fit_ordinal(x: list[np.ndarray], grades: np.ndarray, size: int, features: int = 512, ridge: float = 1e-4, steps: int = 400, shift: float = 0.3) -> OrdinalModel:
    """Fit by gradient steps (Adam) on the features whose presence moves a cumulative share of grades by `shift` or more,
    with a z statistic above 4.

    The bound on the shift leaves out words that most texts have: many of them, each with a small weight, would make a long
    text look good whatever else it says.
    """
    levels = int(grades.max()) + 1 if len(grades) else 1
    lengths = [len(v) for v in x]
    flat = np.concatenate(x) if x else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(x), dtype=np.int32), lengths)
    count = np.bincount(flat, minlength=size)
    z, moved = np.zeros(size), np.zeros(size)
    for k in range(levels - 1):
        low = (grades <= k).astype(float)
        share = min(max(low.mean(), 1e-6), 1 - 1e-6)
        more = np.bincount(flat, weights=low[of], minlength=size) - count * share
        z = np.maximum(z, np.abs(more) / np.sqrt(np.maximum(count, 1) * share * (1 - share)))
        moved = np.maximum(moved, np.abs(more) / np.maximum(count, 1))
    chosen = np.flatnonzero((count >= 5) & (z > 4) & (moved >= shift))
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")][:features])
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    dense = np.zeros((len(x), len(chosen)), dtype=np.float32)
    keep = column[flat] >= 0
    dense[of[keep], column[flat[keep]]] = 1.0
    shares = np.cumsum(np.bincount(grades, minlength=levels) + 1.0)
    first = np.log(shares[:-1] / (shares[-1] - shares[:-1]))
    # ordered by construction: the first threshold, then logarithms of the gaps
    free = np.concatenate([np.zeros(len(chosen)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m = np.zeros_like(free)
    v = np.zeros_like(free)
    d = len(chosen)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])])) if levels > 1 else np.zeros(0)

    rows = np.arange(len(x))
    for t in range(1, steps + 1 if levels > 1 and len(x) else 1):
        cuts = thresholds(free)
        score = (dense @ free[:d].astype(np.float32)).astype(float)
        cumulative = np.hstack([np.zeros((len(x), 1)), _logistic(cuts[None, :] - score[:, None]), np.ones((len(x), 1))])
        slope = cumulative * (1 - cumulative)
        p = np.maximum(cumulative[rows, grades + 1] - cumulative[rows, grades], 1e-12)
        d_score = (slope[rows, grades + 1] - slope[rows, grades]) / p
        g = np.zeros_like(free)
        g[:d] = dense.T @ d_score.astype(np.float32) / len(x) + ridge * free[:d]
        d_cut = np.zeros(levels - 1)
        for k in range(levels - 1):
            d_cut[k] = (-(slope[grades == k, k + 1] / p[grades == k]).sum() + (slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum()) / len(x)
        g[d] = d_cut.sum()
        for k in range(1, levels - 1):
            g[d + k] = d_cut[k:].sum() * np.exp(free[d + k])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        free = free - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(size, {int(c): float(w) for c, w in zip(chosen, free[:d]) if w}, thresholds(free).tolist())


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000,
    size: int = 1 << 18, features: int = 512,
) -> OrdinalModel:
    """Fit on at most `sample` labelled rows, those with the least hash of their id; grade 0 is low quality, 1 toxic, 2 clean.

    Labels with a null quality or id are left out, a null toxic counts as 0; rows that repeat a label, or a document's id, are
    fitted each; a table without labels gives a model that knows one grade. Only the sample's hashed features reach the driver.
    """
    bounded_batches(docs.sparkSession)
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    rated = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), grade.alias("_grade"))
    rated = rated.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(rated), "_id").select("_id", "_grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(features_of(t), size) for t in batch.column(2).to_pylist()]
            ids = batch.column(0).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array([f.astype("<i4").tobytes() for f in found], pa.binary())], ["id", "grade", "x"]
            )

    rows = sorted((r["id"], r["grade"], bytes(r["x"])) for r in rows.mapInArrow(run, "id string, grade int, x binary").toLocalIterator())
    x = [np.frombuffer(b, "<i4") for *_, b in rows]
    return fit_ordinal(x, np.array([g for _, g, _ in rows], dtype=np.int64), size, features)


_GRADED = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "expected_grade", "p_top")])


def graded(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` with a last column `quality`: score, expected grade, tail probability of the highest grade.

    One narrow pass over whole texts. Null texts count as empty; repeated rows are graded each; columns pass through by
    position, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    fields = docs.schema.fields
    text_at = docs.columns.index(text_col)
    kept = [i for i in range(len(fields)) if keep_text or i != text_at]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            scores = [shared.value.score(features_of(t or "")) for t in batch.column(text_at).to_pylist()]
            pairs = [shared.value.graded(s) for s in scores]
            found = pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), *(pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1))],
                [f.name for f in _GRADED.fields],
            )
            columns = [*(batch.column(i) for i in kept), found]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return docs.mapInArrow(run, T.StructType([*(fields[i] for i in kept), T.StructField("quality", _GRADED)]))


def accepted(docs: DataFrame, model: OrdinalModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, whose highest grade has a tail probability of `least` or more."""
    names = docs.columns
    found = graded(docs, model, text_col).toDF(*(f"_{i}" for i in range(len(names))), "_quality")
    return found.where(F.col("_quality.p_top") >= least).drop("_quality").toDF(*names)
