"""Benchmark decontamination by greedy string tiling with running Karp-Rabin."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, drop

SEED, MIN_MATCH, COVERAGE = 5, 4, 0.8
#: Characters of benchmark text that one pass over the documents takes along.
BLOCK_CHARS = 16_000_000
_EDGE = re.compile(r"^\W+|\W+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(token: str) -> str:
    return _EDGE.sub("", token) or token


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [normal(t) for t in (text or "").lower().split()]


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin value of every window of ``size`` tokens (Horner's rule mod 2**64)."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * _BASE + ids[k : k + n]
    return h


class _Rolled:
    """Window values of any size from one pass, and whether a window is free of marked tokens."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        power = np.full(self.n + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        terms = ids * self.power[: self.n]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def values(self, at: np.ndarray, size: int, top: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _power(top, at)


def _power(top: int, at: np.ndarray) -> np.ndarray:
    out = _POWERS.get(top)
    if out is None:
        out = np.full(top + 1, _BASE, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if len(_POWERS) > 64:
            _POWERS.clear()
        _POWERS[top] = out
    return out[top - at]


_POWERS: dict[int, np.ndarray] = {}


def tile(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, text start, length) of non-overlapping tiles, longest first.

    The search length falls from the item's length to ``min_match``; at each,
    unmarked windows of both sides are compared by Karp-Rabin value, hits are
    checked and extended token by token, and the longest are marked first.  The
    free parts of a match that a longer tile cuts queue again, so that no match
    of the search length is left.  A match that turns out longer than twice the
    search length restarts the scan at its length.  Token 0 matches nothing.
    """
    n, m = len(item), len(text)
    free_item, free_text = item != 0, np.isin(text, item) & (text != 0)
    tiles: list[tuple[int, int, int]] = []
    rolled_item, rolled_text = _Rolled(item), _Rolled(text)
    top = max(n, m)
    length = n
    min_match = max(1, min(min_match, n))
    while length >= min_match:
        blocked_i, blocked_t = np.concatenate([[0], np.cumsum(~free_item)]), np.concatenate([[0], np.cumsum(~free_text)])
        at_i = np.flatnonzero(blocked_i[length:] == blocked_i[: n - length + 1])
        at_t = np.flatnonzero(blocked_t[length:] == blocked_t[: m - length + 1]) if m >= length else np.zeros(0, np.int64)
        matches: list[tuple[int, int, int]] = []
        longer = 0
        if len(at_i) and len(at_t):
            table: dict[int, list[int]] = {}
            for i, h in zip(at_i.tolist(), rolled_item.values(at_i, length, top).tolist()):
                table.setdefault(h, []).append(i)
            value = rolled_text.values(at_t, length, top)
            hit = np.isin(value, np.fromiter(table, np.uint64, len(table)))
            for t, h in zip(at_t[hit].tolist(), value[hit].tolist()):
                for i in table[h]:
                    if i and t and item[i - 1] == text[t - 1] and free_item[i - 1] and free_text[t - 1]:
                        continue  # part of the match that starts before it
                    if not np.array_equal(item[i : i + length], text[t : t + length]):
                        continue
                    size = length
                    while i + size < n and t + size < m and item[i + size] == text[t + size] and free_item[i + size] and free_text[t + size]:
                        size += 1
                    longer = max(longer, size)
                    matches.append((i, t, size))
        if longer > 2 * length:
            length = longer
            continue
        queue = [(-size, i, t) for i, t, size in matches]
        heapify(queue)
        while queue:
            size, i, t = heappop(queue)
            size = -size
            free = free_item[i : i + size] & free_text[t : t + size]
            if free.all():
                free_item[i : i + size] = free_text[t : t + size] = False
                tiles.append((i, t, size))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= length:
                    heappush(queue, (a - b, i + a, t + a))
        if length == min_match:
            break
        length = max(min_match, length // 2 if length > 2 * min_match else min_match)
    return tiles


class Matcher:
    """One block of benchmark items, ready to be looked for in texts."""

    def __init__(self, items: list[tuple[int, str]], seed: int, min_match: int, coverage: float):
        self.seed, self.min_match, self.coverage = seed, min_match, coverage
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        seeds: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.uint64)
            if not len(ids):
                continue
            size = min(seed, len(ids))
            for h in set(window_hashes(ids, size).tolist()):
                seeds.setdefault(size, {}).setdefault(h, []).append(len(self.items))
            self.items.append((item_id, ids))
        self.seeds = seeds
        self.sorted = {size: np.sort(np.fromiter(s, np.uint64, len(s))) for size, s in seeds.items()}
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> list[dict]:
        known, vocabulary = self.known, self.vocabulary
        words = text.lower().split()
        if len(known) > 500_000:
            known.clear()
        try:
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = vocabulary.get(normal(w), 0)
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        found: set[int] = set()
        for size, values in self.sorted.items():
            if len(ids) < size:
                continue
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h = h * _BASE + ids[at + k]
            pos = np.searchsorted(values, h)
            pos[pos == len(values)] = 0
            for v in set(h[values[pos] == h].tolist()):
                found.update(self.seeds[size][v])
        out = []
        for k in sorted(found):
            item_id, item = self.items[k]
            tiles = tile(item, ids, self.min_match)
            covered = sum(size for _, _, size in tiles)
            if covered >= self.coverage * len(item):
                out.append({"item_id": item_id, "item_tokens": len(item), "covered": covered, "tiles": len(tiles)})
        return out


MATCHES = "array<struct<item_id: long, item_tokens: int, covered: int, tiles: int>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int32()), ("covered", pa.int32()), ("tiles", pa.int32())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out_col: str = "matches", seed: int = SEED, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column of the benchmark items each text contains.

    An item is contained if non-overlapping tiles of at least ``min_match`` words,
    in any order, cover ``coverage`` of its words, and one run of ``seed`` words
    (the whole item if shorter) is shared.  No text is shuffled: the benchmark is
    carried to the tasks in blocks of about ``block_chars`` characters, one pass
    over the documents and one written table for each block; the driver holds one
    block at a time, so the benchmark's size has no limit.  Null and empty
    texts contain nothing, null and empty items are in nothing; repeated items
    are reported each.
    """
    docs = docs.drop(out_col)
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    out = docs.withColumn(out_col, F.expr(f"cast(array() as {MATCHES})"))
    at, slot = docs.columns.index(text_col), len(docs.columns)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.where("text is not null").where(part == k).select(F.col("item_id").cast("long"), "text")
        matcher = Matcher([tuple(r) for r in rows.collect()], seed, min_match, coverage)

        def mapper(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(old or []) + (matcher(t) if t else []) for t, old in zip(b.column(at).to_pylist(), b.column(slot).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:slot], pa.array(got, _MATCHES)], names=b.schema.names)

        before, out = out, out.mapInArrow(mapper, out.schema)
        if k < blocks - 1:
            out = cut(out, "tiling")
            if k:
                drop(before)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each text and item it contains: ``doc_id, item_id, item_tokens, covered, tiles, coverage``."""
    found = with_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, **options)
    rows = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    return rows.withColumn("coverage", F.col("covered") / F.col("item_tokens"))
