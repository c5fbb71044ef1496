"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucket_runs, text_bytes
from .repeats import Block, Spec, keyed, merged, repeated_spans

LENGTH = 400
#: Period of the difference cover, and suffixes that are sorted at once.
PERIOD, AT_ONCE = 13, 1 << 18


def difference_cover(v: int) -> np.ndarray:
    """A small set D with {a - b mod v} complete, grown greedily."""
    cover, seen = [0, 1], {0, 1, v - 1}
    while len(seen) < v:
        best = max(range(2, v), key=lambda x: len({(x - c) % v for c in cover} | {(c - x) % v for c in cover} | seen))
        cover.append(best)
        seen |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
    return np.array(sorted(cover))


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def _widened(rank: np.ndarray, width: int, target: int) -> np.ndarray:
    """Ranks by the first ``target`` bytes from those by ``width``, by doubling."""
    while width < target:
        step = min(width, target - width)
        rank = _rank((rank[:-step] << np.uint64(32)) | rank[step:])
        width += step
    return rank


def sort_block(block: Block, spec: Spec, period: int = PERIOD, at_once: int = AT_ONCE) -> Iterator[tuple[int, np.ndarray]]:
    """Mark the repeated windows of a block: suffixes that tie over ``length`` bytes.

    1. The suffixes at sampled positions, whose residue lies in the difference
       cover, are ranked once for the whole block by doubling: steps are multiples
       of the period, so they stay inside the sample.
    2. Suffixes are dealt to buckets by their first ``period`` bytes; one bucket,
       or few, of at most about ``at_once`` suffixes is sorted at a time.
    3. Ties go by the sample ranks: for any two suffixes there is a shift below
       the period that takes both to sampled positions.  So each tie of equal
       windows is seen at one shift at least, and at each shift suffixes with
       equal front, sample rank behind the shift, and tail are equal whole.
    """
    length = spec.length
    v = min(period, max(2, length // 3))
    cover = np.zeros(v, bool)
    cover[difference_cover(v)] = True
    sizes = np.array([len(c) for c in block.content])
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join([*block.content, bytes(length + 2 * v + 8)]), np.uint8)
    total = int(sizes.sum())
    if v >= 8:
        words = np.lib.stride_tricks.sliding_window_view(text, 8)
        front = _widened(_rank(np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)), 8, v)
    else:
        front = _widened(text.astype(np.uint64), 1, v)
    tail = _widened(front, v, 2 * v)
    sample = np.flatnonzero(cover[np.arange(total) % v])
    number = np.cumsum(cover[np.arange(total) % v]) - 1  # of the sampled position at or before each one
    depth, width, rank = (length - v) // v * v, v, front[sample]
    while width < depth:
        step = min(width, depth - width)
        rank = _rank((rank << np.uint64(32)) | rank[number[np.minimum(sample + step, sample[-1])]])
        width += step
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(starts)), counts)
    head = starts[owner] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.zeros(len(head), bool)
    order = np.argsort(front[head], kind="stable")
    edges = np.append(bucket_runs([front[head[order]]]), len(order))
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + at_once, "right")) - 1)
        own = order[edges[at] : edges[to]]
        at = to
        weight = block.many[owner[own]]
        group = _rank((front[head[own]] << np.uint64(32)) | tail[head[own] + length - 2 * v])
        for shift in range(v):
            open_ = np.bincount(group.astype(np.int64), weight * ~hit[own]) > 0
            more = (np.bincount(group.astype(np.int64), weight) > 1) & open_
            left = more[group.astype(np.int64)]
            own, weight, group = own[left], weight[left], group[left]
            if not len(own):
                break
            here = np.flatnonzero(cover[(head[own] + shift) % v])
            _, tie = np.unique((group[here] << np.uint64(32)) | rank[number[head[own[here]] + shift]], return_inverse=True)
            hit[own[here[np.bincount(tie, weight[here])[tie] > 1]]] = True
    ends = np.cumsum(counts)
    for i in range(len(starts)):
        mine = hit[ends[i] - counts[i] : ends[i]]
        if mine.any():
            yield i, mine


def _byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def spec(length: int = LENGTH, hot: int = 4096) -> Spec:
    return Spec(length, max(2, length // 4), _byte_units, hot)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, runs, digest = [], [], [], []
        for text, spans in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
            cuts = merged(spans, len(text))
            kept, at = hashlib.sha256(), 0
            for x, y in cuts:
                kept.update(text[at:x])
                at = y
            kept.update(text[at:])
            n.append(len(text)), removed.append(sum(y - x for x, y in cuts)), runs.append(len(cuts)), digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, length: int, hot: int, *cols: str) -> DataFrame:
    rows = keyed(docs, *cols)
    spans = repeated_spans(rows, spec(length, hot), sort_block, np.uint8)
    return rows.join(spans, ["t1", "t2"], "left")


def removal_report(docs: DataFrame, length: int = LENGTH, hot: int = 4096) -> DataFrame:
    """Bytes that a ``length``-byte string occurring elsewhere covers, removed from each text.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for
    each input row.  Repeats are judged on the input; matches stay inside one
    document; overlaps count.  Null and empty texts have no bytes; repeated rows
    are copies of each other, hence removed whole from ``length`` bytes on; other
    columns are ignored; an empty table gives no rows.
    """
    rows = _with_spans(docs, length, hot, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(text: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without the cuts, each narrowed to whole characters."""
    out, at = [], 0
    for x, y in cuts:
        while x < y and text[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
            y -= 1
        out.append(text[at:x])
        at = y
    out.append(text[at:])
    return b"".join(out).decode("utf-8", "replace")


def _rewrite(columns: list[str]):
    text_at, chars_at, spans_at = columns.index("text"), columns.index("n_chars"), len(columns)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [cut_text(raw, merged(spans, len(raw))) if spans else raw.decode() for raw, spans in zip(text_bytes(b.column(text_at)), b.column(spans_at).to_pylist())]
            out = list(b.columns[:spans_at])
            out[text_at], out[chars_at] = pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return mapper


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = 4096) -> DataFrame:
    """``docs`` with texts rewritten: repeated bytes go, cuts narrowed to whole characters; ``n_chars`` follows.

    All rows stay, a text that is repeated whole becomes empty, a null text too.
    """
    cols = docs.columns
    rows = _with_spans(docs, length, hot, *(c for c in cols if c != "text")).select(*cols, "spans")
    return rows.mapInArrow(_rewrite(cols), docs.schema)
