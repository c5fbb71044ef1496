"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, text_bytes

FEATURES = (
    "words", "word_length", "symbols", "upper", "shouts", "bars", "digits", "foreign",
    "short_words", "same_next", "distinct", "distinct_pairs", "same_sentences", "longest",
)
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"*#$%&@^~<>{}[]\\_+=/", bytes(range(65, 91)), b"!?", b"|", b"0123456789", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _i


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text: logarithms of counts and of small shares, plain larger shares."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    size = float(lengths.sum())
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = [float(kinds[_CLASS == i].sum()) / size for i in range(1, 7)]
    small = lambda x: float(np.log(x + 0.003))
    same = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    sentences = [s for s in text.replace(b"\n", b". ").split(b". ") if s.strip()]
    repeated = 1 - len(set(sentences)) / max(1, len(sentences))
    return [
        float(np.log1p(n)), float(np.log(size / n)), small(share[0]), small(share[1]), small(share[2]), small(share[3]), small(share[4]), share[5],
        float((lengths <= 3).mean()), small(same), float(np.log(len(set(words)) / n)), small(1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0), small(repeated), float(np.log(lengths.max())),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t) for t in text_bytes(b.column(1))]
        x = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for each row; a null text counts as empty and has zero statistics."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_measure, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Gaussian for each class; the inverse Cholesky factors are computed once."""

    mean: np.ndarray  #: of all rows, to centre the statistics
    scale: np.ndarray
    centres: np.ndarray  #: (2, d)
    factors: np.ndarray  #: (2, d, d): x -> L^-1 x whitens the class
    offset: np.ndarray  #: (2,): log prior less log sqrt det
    temper: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        log = [self.offset[k] - 0.5 * (((z - self.centres[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temper, -40, 40)))


def fit(examples: DataFrame, shrink: float = 0.1, ridge: float = 0.02, temper: float = 4.0) -> Discriminant | None:
    """Fit from all rows ``x, label``.

    Only class counts, sums and products of statistics reach the driver, summed
    by Spark, so there is no sample.  A class covariance is shrunk towards the
    pooled one by ``shrink`` and both towards the mean variance by ``ridge``.
    None if a class has no rows: scores are then the share of label 1, or 0.5.
    """
    d = len(FEATURES)
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    found = {r["label"]: r for r in examples.where("label in (0, 1)").groupBy("label").agg(*sums).collect()}
    if set(found) != {0, 1}:
        return None
    n = np.array([found[k]["n"] for k in (0, 1)], float)
    s = np.array([[found[k][f"s{i}"] for i in range(d)] for k in (0, 1)])
    p = np.array([[[found[k][f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)] for k in (0, 1)])
    mean = s.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(p.sum(0)) / n.sum() - mean**2, 1e-9))
    centres, covs = [], []
    for k in (0, 1):
        m = s[k] / n[k]
        covs.append((p[k] / n[k] - np.outer(m, m)) / np.outer(spread, spread))
        centres.append((m - mean) / spread)
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    factors, offset = [], []
    for k in (0, 1):
        c = (1 - shrink) * covs[k] + shrink * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offset.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(mean, spread, np.array(centres), np.array(factors), np.array(offset), temper)


def score(measured: DataFrame, model: Discriminant | None, default: float = 0.5) -> DataFrame:
    """``doc_id, score`` of measured rows."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            got = model.scores(x) if model else np.full(len(x), default)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(mapper, "doc_id long, score double")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """One label for each document; of repeated rows the largest counts, nulls don't."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(name).cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Labels are learnt only from documents outside the held-out fold of
    crc32(doc_id).  Null and empty texts get a score like any other; rows with a
    null doc_id are never held out; repeated rows count once each; without
    labels of both classes all scores are 0.5.
    """
    measured = cut(measure(docs), "statistics")
    known = measured.join(one_label(labels, "quality"), "doc_id").where(~held_out(F.col("doc_id"), folds, fold))
    scored = score(measured, fit(known))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """Rows of ``docs``, unchanged, that the classifier accepts.

    The decision is made row by row where the text is, so nothing is joined or
    shuffled; without labels of both classes every row stays.
    """
    known = cut(measure(docs), "statistics").join(one_label(labels, "quality"), "doc_id").where(~held_out(F.col("doc_id"), folds, fold))
    model = fit(known)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in text_bytes(b.column(at))])
                yield b.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(mapper, docs.schema)
