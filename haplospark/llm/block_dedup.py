"""Removal of repeated word sequences through fixed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes
from .repeats import Block, Rolling, Spec, keyed, merged, repeated_spans

WORDS = 35


def word_units(text: bytes) -> np.ndarray:
    """Hashes of the words, runs of bytes other than space and 0x09-0x0D."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def block_size(length: int) -> int:
    """Largest block that every window holds whole wherever it starts."""
    return (length + 1) // 2


def _split(group: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Groups (-1: none) by one word more; a group of one occurrence ends."""
    out = np.full(len(group), -1)
    own = np.flatnonzero(group >= 0)
    if len(own):
        _, new = np.unique((group[own].astype(np.uint64) << np.uint64(32)) | word[own], return_inverse=True)
        out[own] = np.where(np.bincount(new, weight[own])[new] > 1, new, -1)
    return out


def extend_blocks(block: Block, spec: Spec, indexed: Callable[[np.ndarray], np.ndarray] = lambda aligned: aligned) -> Iterator[tuple[int, np.ndarray]]:
    """Mark the repeated windows of a block of buckets.

    1. Index: each segment's non-overlapping reference blocks, the word positions
       in its document that are multiples of the block size.  Every window holds
       one of its own document whole.  ``indexed`` may leave some out.
    2. Probe: every rolling window of block size.  Those that hit a reference
       block, with another occurrence than the reference itself, go on.
    3. Extension: hits of one block are extended word by word, all at once: to
       the left and to the right they split into groups by the next word, and a
       group that is down to one occurrence ends.  Where left and right reach the
       window's length together, in two occurrences of which one is a reference,
       the window is part of an exact repeat; runs of such windows are the
       maximal ones.
    """
    length, size = spec.length, block_size(spec.length)
    more = length - size
    parts = [np.frombuffer(c, np.uint64) for c in block.content]
    units = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(units)) - starts[owner]
    at = np.flatnonzero(place + size <= sizes[owner])
    grams = Rolling(units).grams(size)[at]
    reference = indexed((block.lo[owner[at]] + place[at]) % size == 0)
    index = np.unique(grams[reference])
    if not len(index):
        return
    entry = np.minimum(np.searchsorted(index, grams), len(index) - 1)
    weight = block.many[owner[at]]
    hit = index[entry] == grams
    hit[hit] = np.bincount(entry[hit], weight[hit])[entry[hit]] > 1
    at, reference, weight, group = at[hit], reference[hit], weight[hit], entry[hit]
    if not len(at):
        return
    _, word = np.unique(units, return_inverse=True)
    word = word.astype(np.uint64)
    before, after = place[at], sizes[owner[at]] - place[at] - size  # words that the segment has on either side
    left, right = [group], [group]
    for k in range(more):
        left.append(_split(np.where(before > k, left[k], -1), word[at - np.minimum(k + 1, before)], weight))
        right.append(_split(np.where(after > k, right[k], -1), word[at + size - 1 + np.minimum(k + 1, after)], weight))
    mark = np.zeros(len(units), bool)
    for k in range(more + 1):
        own = np.flatnonzero((left[k] >= 0) & (right[more - k] >= 0))
        if not len(own):
            continue
        _, same = np.unique((left[k][own].astype(np.uint64) << np.uint64(32)) | right[more - k][own].astype(np.uint64), return_inverse=True)
        repeat = (np.bincount(same, weight[own]) > 1) & (np.bincount(same, reference[own]) > 0)
        mark[at[own[repeat[same]]] - k] = True
    for i in np.unique(owner[mark]).tolist():
        yield i, mark[starts[i] : starts[i] + sizes[i] - length + 1]


def spec(length: int = WORDS, hot: int = 4096) -> Spec:
    return Spec(length, max(1, length // 4), word_units, hot)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, digest = [], [], []
        for text, spans in zip(text_bytes(b.column(1)), b.column(2).to_pylist()):
            words = text.split()
            kept, at = [], 0
            for x, y in merged(spans, len(words)):
                kept += words[at:x]
                at = y
            kept += words[at:]
            n.append(len(words)), removed.append(len(words) - len(kept)), digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_report(docs: DataFrame, length: int = WORDS, hot: int = 4096) -> DataFrame:
    """Words that a window of ``length`` words occurring elsewhere covers, removed from each text.

    Returns ``doc_id, n_words, n_removed, kept_sha256``, one row for each input
    row.  Repeats are judged on the input, inside one document at a time;
    overlaps count.  Null and empty texts have no words; repeated rows are
    copies of each other; other columns are ignored; an empty table gives no rows.
    """
    rows = keyed(docs, "doc_id")
    spans = repeated_spans(rows, spec(length, hot), extend_blocks, np.uint64)
    rows = rows.join(spans, ["t1", "t2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def sql(length: int = WORDS) -> str:
    """The report in SQL over ``documents``: every window spelt out, counted, and its words left out."""
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    windows AS (SELECT r, i, array_to_string(ws[i : i + {length - 1}], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM d WHERE len(ws) >= {length}) AS x),
    twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {length})) AS j FROM windows JOIN twice USING (s)),
    words AS (SELECT doc_id, r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (r, j) GROUP BY r),
    removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
    SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)"""
