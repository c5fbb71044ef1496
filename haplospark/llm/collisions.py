"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut
from .whitening import finite_vectors

#: Single projections; half a window's width at radius 1; a vector at the radius collides in fewer projections than the threshold with the chance of so many standard deviations.
PROJECTIONS, HALF_WIDTH, DEVIATIONS = 96, 0.93, 2.25
#: Radii on the unit sphere, 2 the largest distance there: virtual rehashing widens the windows from one to the next.
RADII = np.array([0.3, 0.6, 0.8, 0.92, 1.0, *np.arange(1.04, 1.42, 0.04), 1.5, 1.6, 1.8, 2.0])
#: Vectors a block holds in the mean, and queries that meet it in one task.
BLOCK, GROUP = 8_192, 1_024


class SortedProjections:
    """Index of the rows of ``unit`` (vectors of length 1): each projection's values in order."""

    def __init__(self, unit: np.ndarray, projections: int = PROJECTIONS, seed: int = 11):
        self.unit = unit
        self.lines = np.random.default_rng(seed).standard_normal((projections, unit.shape[1]))
        values = self.lines @ unit.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        p = erf(HALF_WIDTH / sqrt(2))
        self.threshold = int(projections * p - DEVIATIONS * sqrt(projections * p * (1 - p)))

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each query's window at each radius in each projection: [query, radius, projection]."""
        centre = self.lines @ queries.T
        half = HALF_WIDTH * RADII
        low = np.stack([np.searchsorted(v, c[:, None] - half, "left") for v, c in zip(self.values, centre)], -1)
        high = np.stack([np.searchsorted(v, c[:, None] + half, "right") for v, c in zip(self.values, centre)], -1)
        return low, high

    def search(self, low: np.ndarray, high: np.ndarray, score, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and scores of one query, the ``k`` nearest among them; ``score(rows)`` is their cosine.

        Windows grow from radius to radius.  A row is verified once it has
        collided ``threshold`` times; the search ends when the k-th verified one
        is no further than the radius, for rows at that distance have been found
        with the probability that the threshold stands for.  If the largest
        radius leaves fewer than k, all others are verified.
        """
        n = len(self.unit)
        counts = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        found, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        total, kth = 0, np.inf
        a, b = low[0], low[0]
        for r, radius in enumerate(RADII):
            lo, hi = low[r], high[r]
            ring = [o[s:e] for o, s, e in zip(self.order, lo, a) if s < e] + [o[s:e] for o, s, e in zip(self.order, b, hi) if s < e]
            a, b = lo, hi
            if ring:
                counts += np.bincount(np.concatenate(ring), minlength=n)
                new = np.flatnonzero((counts >= self.threshold) & ~seen)
                if len(new):
                    seen[new] = True
                    found.append(new), scores.append(score(new))
                    total += len(new)
                    if total >= k:
                        best = np.partition(np.concatenate(scores), total - k)[total - k]
                        kth = sqrt(max(0.0, 2 - 2 * best))
            if kth <= radius:
                break
        else:
            if total < k:
                rest = np.flatnonzero(~seen)
                found.append(rest), scores.append(score(rest))
        return np.concatenate(found), np.concatenate(scores)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two if their squares could leave the range of doubles."""
    top = np.abs(v).max(1)
    odd = (top > 1e100) | (top < 1e-100)
    if odd.any():
        v = v.copy()
        v[odd] = np.ldexp(v[odd], -np.frexp(top[odd])[1][:, None])
    return v


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def _search_cell(queries: tuple, block: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a block for each query: exact cosines; row by row, so that equal vectors have equal scores."""
    (q_row, q_id, q), (row, ids, v) = queries, block
    size, q_size = _lengths(v), _lengths(q)
    index = SortedProjections(v / size[:, None])
    for at in range(0, len(q), 64):
        low, high = index.windows(q[at : at + 64] / q_size[at : at + 64, None])
        out = []
        for i in range(low.shape[0]):
            vec, length, own = q[at + i], q_size[at + i], q_row[at + i]

            def score(rows):
                s = (v[rows] * vec).sum(1) / (size[rows] * length)
                return np.where(row[rows] == own, -np.inf, s)

            found, scores = index.search(low[i], high[i], score, k + 1)
            keep = scores > -np.inf
            found, scores = found[keep], scores[keep]
            best = np.lexsort((ids[found], -scores))[:k]
            out.append((np.full(len(best), own), np.full(len(best), q_id[at + i]), found[best], scores[best]))
        a, b, c, s = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[c]), pa.array(s)], names=["query_row", "query_id", "vec_id", "score"])


#: Stands for a null id in a task; the largest long, so that it comes last.
_NULL_ID = np.iinfo(np.int64).max


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, queries first; one cell is held at a time."""
        held: list[tuple] = []
        now = None

        def parts():
            kind, row, ids, flat = (np.concatenate(x) for x in zip(*held))
            v = _scaled(flat)
            return tuple((row[m], ids[m], v[m]) for m in (kind == 0, kind == 1))

        for b in batches:
            cell, kind, row, ids = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
            if not len(cell):
                continue
            flat = np.asarray(b.column(4).flatten().to_numpy(zero_copy_only=False)).reshape(len(cell), -1)
            edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for s, e in zip(edges, np.append(edges[1:], len(cell))):
                if cell[s] != now and held:
                    queries, block = parts()
                    if len(queries[0]) and len(block[0]):
                        yield from _search_cell(queries, block, k)
                    held = []
                now = cell[s]
                held.append((kind[s:e], row[s:e], ids[s:e], flat[s:e]))
        if held:
            queries, block = parts()
            if len(queries[0]) and len(block[0]):
                yield from _search_cell(queries, block, k)

    return run


def nearest(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest by cosine to each row whose id ``every`` divides.

    Every row is indexed: rows are dealt to blocks of about ``block``, queries
    to groups of about ``group``, and each block meets each group in one task,
    which sorts the block's projections, searches and returns k rows a query.
    Scores are exact cosines in double precision; ties go to the smaller id.  A
    row within the k-th distance of a block is missed with a probability of
    about 1 % (``DEVIATIONS``; measured recall in the README).

    Vectors that are null, zero, have a null or non-finite entry or another
    length than most rows take no part.  A query's own row is no candidate, but
    other rows with its id are; repeated query rows are ranked each by itself.
    Null ids are candidates and come last among ties.  With fewer than k other
    rows all are returned.  Other columns are ignored; no rows give no rows.
    """
    clean = finite_vectors(embeddings, id_col, vector_col).where(F.exists("v", lambda c: c != 0))
    rows = cut(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, q = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, groups = max(1, -(-n // block)), max(1, -(-q // group))
    dealt = rows.withColumn("block", F.floor(F.rand(5) * blocks)).withColumn("group", F.floor(F.rand(6) * groups))
    ids = F.coalesce("vec_id", F.lit(int(_NULL_ID))).alias("id")
    base = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block", "row", ids, "v").select((F.col("g") * blocks + F.col("block")).alias("cell"), F.lit(1).alias("kind"), "row", "id", "v")
    asked = dealt.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "group", "row", ids, "v").select((F.col("group") * blocks + F.col("b")).alias("cell"), F.lit(0).alias("kind"), "row", "id", "v")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks * groups, 100_000))
    found = asked.unionByName(base).repartition(parts, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_cells(k), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(int(_NULL_ID))).alias("vec_id"), "score")
