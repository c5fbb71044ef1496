"""Toxicity: a support vector machine with a gapped subsequence string kernel on Nyström landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .quality import held_out, one_label

#: Kernel: subsequences of this many characters; each character spanned in either string counts this factor.
ORDER, DECAY = 3, 0.5
#: Characters of a piece of a token and of a landmark, start mark included; longer tokens give overlapping pieces.
PIECE, STEM = 21, 13
START = "^^"
#: The normalised kernel is raised to this power, which keeps it a kernel and sharpens it.
POWER = 3
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_EDGE = re.compile(r"^\W+|\W+$")


def strings_of(sentence: str) -> set[str]:
    """Strings in which an insult may hide: tokens without punctuation at their ends, and runs of single letters as one."""
    out: set[str] = set()
    run: list[str] = []
    for token in sentence.lower().split() + [""]:
        if len(token) == 1 and token.isalnum():
            run.append(token)
            continue
        if len(run) > 2:
            out.add("".join(run))
        run = []
        if not token.isalnum():
            token = _EDGE.sub("", token)
        if len(token) > 2:
            out.add(token)
            if not token.isalnum() and len(bare := "".join(filter(str.isalnum, token))) > 2:
                out.add(bare)
    return out


def pieces(token: str) -> list[str]:
    if len(token) <= PIECE - len(START):
        return [START + token]
    return [START + token[: PIECE - len(START)]] + [token[i : i + PIECE] for i in range(PIECE // 2, len(token) - PIECE // 2, PIECE // 2)]


def _codes(strings: list[str], width: int) -> np.ndarray:
    padded = "".join([s[:width].ljust(width, "\0") for s in strings])
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(strings), width)


def raw_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of two code matrices (0: padding), by dynamic programming over the rows of ``a``."""
    n, z, m = len(a), len(b), b.shape[1]
    step = np.arange(m)[None, :] - np.arange(m)[:, None] - 1
    spread = np.where(step >= 0, float(decay) ** np.maximum(step, 0), 0).astype(np.float32)
    sums = [np.zeros((n, z, m), np.float32) for _ in range(order - 1)]
    total = np.zeros((n, z), np.float32)
    for i in range(a.shape[1]):
        column = a[:, i]
        if not column.any():
            break
        match = ((column[:, None, None] == b[None]) & (column != 0)[:, None, None]).astype(np.float32) * np.float32(decay * decay)
        new = match
        grown = []
        for q in range(order):
            if q:
                new = match * (sums[q - 1] @ spread)
            grown.append(new)
        for q in range(order - 1):
            sums[q] = sums[q] * np.float32(decay) + grown[q]
        total += grown[-1].sum(2)
    return total


def self_kernel(a: np.ndarray) -> np.ndarray:
    return np.array([raw_kernel(r[None], r[None])[0, 0] for r in a], np.float32) if len(a) < 200 else _self_many(a)


def _self_many(a: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    n, m = a.shape
    step = np.arange(m)[None, :] - np.arange(m)[:, None] - 1
    spread = np.where(step >= 0, float(decay) ** np.maximum(step, 0), 0).astype(np.float32)
    sums = [np.zeros((n, m), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for i in range(m):
        match = ((a[:, i : i + 1] == a) & (a[:, i : i + 1] != 0)).astype(np.float32) * np.float32(decay * decay)
        grown = [match]
        for q in range(1, order):
            grown.append(match * (sums[q - 1] @ spread))
        for q in range(order - 1):
            sums[q] = sums[q] * np.float32(decay) + grown[q]
        total += grown[-1].sum(1)
    return total


#: Characters up to which a string is compared by its subsequences, and different letters of landmarks up to which their table is kept.
SHORT, MOST_LETTERS = 18, 64


def _subsequences(m: int) -> list[tuple[tuple[int, ...], float]]:
    """Places of all subsequences of a string of m characters, with their weights."""
    return [(at, DECAY ** (at[-1] - at[0] + 1)) for at in combinations(range(m), ORDER)]


class Landmarks:
    """Landmark strings; the first ``n_toxic`` come from toxic text."""

    def __init__(self, toxic: list[str], other: list[str]):
        self.strings = [(START + s)[:STEM] for s in toxic + other]
        self.n_toxic = len(toxic)
        self.codes = _codes(self.strings, STEM)
        self.norm = np.sqrt(np.maximum(self_kernel(self.codes), 1e-12))
        self.letters = np.unique(self.codes[self.codes > 0])
        n = len(self.letters) + 1
        self.weights = np.zeros((n**ORDER if n <= MOST_LETTERS else 0, len(self.strings)), np.float32)
        if len(self.weights):  # the landmarks' own subsequences
            for k, s in enumerate(self.strings):
                code = np.searchsorted(self.letters, [ord(c) for c in s]) + 1
                for at, value in _subsequences(len(s)):
                    self.weights[self._place(code, at), k] += value

    def _place(self, code: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
        out = 0
        for i in at:
            out = out * (len(self.letters) + 1) + code[..., i]
        return out

    def raw(self, codes: np.ndarray) -> np.ndarray:
        """Kernel of rows of codes to each landmark: by their subsequences if they are short, else by dynamic programming."""
        size = (codes != 0).sum(1)
        out = np.zeros((len(codes), len(self.strings)), np.float32)
        short = size <= SHORT if len(self.weights) else size < 0
        for m in np.unique(size[short]).tolist():
            own = np.flatnonzero(size == m)
            x = codes[own, :m]
            code = np.searchsorted(self.letters, x)
            code = np.where(np.append(self.letters, 0)[code] == x, code + 1, 0)
            base = len(self.letters) + 1
            scaled = [np.ascontiguousarray(code.T) * base ** (ORDER - 1 - q) for q in range(ORDER)]
            for a in range(0, len(own), 2000):  # rows whose sums stay in the processor's cache
                total = np.zeros((min(2000, len(own) - a), len(self.strings)), np.float32)
                part, row, before = [c[:, a : a + 2000] for c in scaled], np.empty_like(total), None
                for at, value in _subsequences(m):
                    if at[:-1] != before:
                        before, front = at[:-1], sum(c[i] for c, i in zip(part, at[:-1]))
                    np.take(self.weights, front + part[-1][at[-1]], axis=0, out=row, mode="clip")
                    row *= np.float32(value)
                    total += row
                out[own[a : a + 2000]] = total
        if not short.all():
            out[~short] = raw_kernel(codes[~short], self.codes)
        return out

    def similarity(self, strings: list[str]) -> np.ndarray:
        """Kernel to each landmark."""
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        for i in range(0, len(strings), 8000):
            codes = _codes(strings[i : i + 8000], PIECE)
            codes = codes[:, : max(1, int((codes != 0).sum(1).max()))]
            norm = np.sqrt(np.maximum(_self_many(codes), 1e-12))
            out[i : i + 8000] = (self.raw(codes) / norm[:, None] / self.norm) ** POWER
        return out


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray  #: of the similarities, Nyström map included
    bias: float
    calibration: np.ndarray  #: weights of the signs of a text, last their offset

    def decisions(self, strings: list[str]) -> np.ndarray:
        return self.landmarks.similarity(strings) @ self.weights + self.bias

    def probability(self, signs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(signs @ self.calibration[:-1] + self.calibration[-1], -40, 40)))


_LETTERS = re.compile(r"(?:(?<=\s)|^)\w(?:\s\w){2,}(?=\s|$)")
SIGNS = 5


class Scorer:
    """Signs of toxicity of whole texts, from the decision values of all their words.

    A word's value is the largest of its strings'; a run of single letters is a
    word more.  Signs: the three largest values, and the number of words above
    zero, as such and for each word.  Values of words seen before are kept, up
    to a bound.
    """

    def __init__(self, model: Model, bound: int = 400_000):
        self.model, self.bound, self.known = model, bound, {}

    def _learn(self, words: set[str]) -> None:
        known, bias = self.known, self.model.bias
        held: dict[str, list[str]] = {}  # a piece is compared once, in however many words it occurs
        for w in words:
            known[w] = bias
            for s in (w,) if w.isalnum() and len(w) > 2 else strings_of(w):
                for p in pieces(s):
                    held.setdefault(p, []).append(w)
        if held:
            for owners, f in zip(held.values(), self.model.decisions(list(held)).tolist()):
                for w in owners:
                    if f > known[w]:
                        known[w] = f

    def __call__(self, texts: list[str]) -> np.ndarray:
        known, bias = self.known, self.model.bias
        if len(known) > self.bound:
            known.clear()
        split = []
        for t in texts:
            t = t.lower()
            split.append(t.split() + ["".join(r.split()) for r in _LETTERS.findall(t)])
        if split:
            self._learn(set().union(*split).difference(known))
        out = np.empty((len(texts), SIGNS))
        for i, words in enumerate(split):
            f = np.fromiter(map(known.__getitem__, words), float, len(words))
            top = np.sort(f)[-3:] if len(f) < 500 else np.sort(np.partition(f, -3)[-3:])
            hits = int((f > 0).sum())
            out[i, :3] = np.append(np.full(3 - len(top), bias), top)
            out[i, 3:] = np.log1p(hits), np.log((hits + 0.2) / (len(f) + 5))
        return out


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 600, caution: float = 4.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps over all rows; label 0 weighs ``caution`` times label 1."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, weight / max(weight[y > 0].sum(), 1e-9), caution * weight / max(weight[y <= 0].sum(), 1e-9)) / (1 + caution)
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    rate = 1 / (2 * np.linalg.norm(z * np.sqrt(share)[:, None], 2) ** 2 + penalty)
    w = v = np.zeros(z.shape[1])
    for k in range(rounds):
        margin = np.maximum(0, 1 - sign * (z @ v))
        grad = -2 * z.T @ (share * sign * margin) + penalty * np.append(v[:-1], 0)
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    keep = np.append(np.full(x.shape[1], ridge), 1e-3)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
    return w


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def _diverse(strings: list[str], count: int, most: float = 0.5) -> list[str]:
    """The first strings that aren't close to one already taken."""
    if not strings:
        return []
    all_ = Landmarks(strings, [])
    close = all_.similarity([START + s for s in strings])
    taken: list[int] = []
    for i in range(len(strings)):
        if len(taken) < count and all(close[i, j] < most for j in taken):
            taken.append(i)
    return [strings[i] for i in taken]


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 4000, n_toxic: int = 24, n_other: int = 16, n_strings: int = 10_000, n_bad: int = 5_000) -> Model | None:
    """Train on at most ``per_class`` labelled documents of each class, taken by a hash of their id.

    The ids (at most 2 * per_class) are broadcast, so that no text is shuffled.
    Landmarks: up to ``n_toxic`` strings that are many times likelier in toxic
    documents, and up to ``n_other`` strings of other documents that the kernel
    finds closest to them.  A sentence counts as toxic if its document is and it
    holds a string likelier there; sentences of other documents are negative;
    each stands for its string closest to a landmark, at most ``n_strings``
    distinct ones a class; of the strings likelier in toxic documents the
    ``n_bad`` most frequent count.  None without labels of both classes or landmarks.
    """
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    picked = labels.where("label = 1").orderBy(*by_hash).limit(per_class).union(labels.where("label = 0").orderBy(*by_hash).limit(per_class))
    sample = cut(docs.join(F.broadcast(picked), "doc_id").select("text", "label"), "toxic-sample")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(size) != {0, 1}:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [strings_of(t) for t in _texts(b, 0)]
            label = np.repeat(b.column(1).to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array([s for f in found for s in f], pa.string()), pa.array(label, pa.int32())], names=["s", "label"])

    counts = sample.mapInArrow(words, "s string, label int").groupBy("s").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    counts = cut(counts, "toxic-strings")
    ratio = (F.col("pos") / size[1]) / ((F.col("neg") + 0.5) / size[0])
    likelier = (ratio >= 12) & (F.col("pos") >= (3 if size[1] > 30 else 2))
    toxic = [r["s"] for r in counts.where(likelier).orderBy(F.desc("pos"), F.desc(ratio), "s").limit(8 * n_toxic).collect()]
    toxic = _diverse(toxic, n_toxic)
    if not toxic:
        return None
    first = Landmarks(toxic, [])

    def closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(s, p) for s in b.column(0).to_pylist() for p in pieces(s)]
            if own:
                best = first.similarity([p for _, p in own]).max(1)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own]), pa.array(best.astype(np.float64))], names=["s", "close"])

    plain = counts.where((ratio < 1) & (F.col("neg") > 1)).select("s").mapInArrow(closeness, "s string, close double")
    close = [r["s"] for r in plain.groupBy("s").agg(F.max("close").alias("close")).orderBy(F.desc(F.round("close", 4)), "s").limit(8 * n_other).collect()]
    marks = Landmarks(toxic, _diverse(close, n_other))
    bad = {r["s"] for r in counts.where(likelier).orderBy(F.desc("pos"), "s").limit(n_bad).collect()}

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[str, int], int] = {}
            cache: dict[str, tuple[float, str]] = {}
            held = []
            for text, label in zip(_texts(b, 0), b.column(1).to_pylist()):
                for sentence in _SENTENCE.split(text):
                    found = strings_of(sentence)
                    if label and not found & bad:
                        continue
                    held.append((found & bad if label else found, label))
            fresh = [(s, p) for s in set().union(*(f for f, _ in held)) for p in pieces(s)] if held else []
            if fresh:
                for (s, p), v in zip(fresh, marks.similarity([p for _, p in fresh])[:, : marks.n_toxic].max(1).tolist()):
                    cache[s] = max(cache.get(s, (0.0, "")), (v, p))
            for found, label in held:
                value, piece = max((cache[s] for s in found if s in cache), default=(0.0, ""))
                if value > 0:
                    out[piece, label] = out.get((piece, label), 0) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.int64())], names=["s", "label", "n"])

    rows = sample.mapInArrow(sentences, "s string, label int, n long").groupBy("s", "label").agg(F.sum("n").alias("n"))
    rows = [r for k in (0, 1) for r in rows.where(F.col("label") == k).orderBy(F.xxhash64("s"), "s").limit(n_strings).collect()]
    strings = [r["s"] for r in rows] + [START]
    y, weight = np.array([r["label"] for r in rows] + [0]), np.sqrt(np.array([r["n"] for r in rows] + [1], float))
    value, vector = np.linalg.eigh(((raw_kernel(marks.codes, marks.codes) / marks.norm[:, None] / marks.norm) ** POWER).astype(float))
    root = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    w, bias = train_machine(marks.similarity(strings).astype(float) @ root, y, weight)
    model = Model(marks, root @ w, bias, np.zeros(SIGNS + 1))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer(_texts(b, 0)).tolist(), pa.list_(pa.float64())), b.column(1)], names=["signs", "label"])

    got = sample.mapInArrow(values, "signs array<double>, label int").collect()  # at most 2 * per_class rows
    model.calibration = _logistic(np.array([r["signs"] for r in got]), np.array([r["label"] for r in got], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1, **limits: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Labels are learnt only from documents outside the held-out fold of
    crc32(doc_id).  Null and empty texts have no strings and get the lowest
    score; repeated rows stay; rows with a null doc_id are never held out;
    without labels of both classes all scores are 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    model = fit(texts, one_label(labels, "toxic").where(~held_out(F.col("doc_id"), folds, fold) & F.col("label").isin(0, 1)), **limits)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = model.probability(scorer(_texts(part, 1))) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=["doc_id", "score"])

    scored = texts.mapInArrow(mapper, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
