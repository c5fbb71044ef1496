"""SimHash near-duplicate groups through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_int64, bucket_runs, connected_components, cut, text_bytes

#: The 64 bits are cut into five blocks; each table keys on three of them.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Sub-buckets of a bucket that is larger than this are joined instead of it.
BUCKET_LIMIT = 20_000
FANOUT = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text.

    A-Z become a-z, words are runs of bytes other than space and 0x09-0x0D, a
    shingle is ``words_per_shingle`` words joined by a space (the whole sequence
    if there are fewer), hashed by XXH64 with seed 42.  A bit is 1 if it is set
    in more than half the shingles.  A text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n, k = len(words), words_per_shingle
    if n <= k:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        lo = [0, *ends[: n - k].tolist()]
        hi = (ends[k - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(lo, hi)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = (np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(x) for x in text_bytes(b.column(1))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_int64(fp))], names=["doc_id", "fp"])


def _gray_rank(c: Column) -> Column:
    """Rank of a bit pattern in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c


def _bits(c: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _tables() -> list[tuple[int, int]]:
    return [(i, j) for i in range(5) for j in range(i + 1, 5)]


class GrayIndex:
    """Tree over fingerprints in Gray order.

    Neighbours in Gray order share most bits.  A node holds the bits on which
    all fingerprints below it agree and which no node above it holds already;
    a search adds up the differences on the way down and leaves a whole group
    as soon as the sum exceeds the radius.
    """

    def __init__(self, fps: np.ndarray, fanout: int = FANOUT):
        self.fps, self.fanout, self.levels = fps, fanout, []
        ones, anys = fps, fps
        while len(ones) > 1:
            at = np.arange(0, len(ones), fanout)
            ones, anys = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(anys, at)
            self.levels.append((ones, ones | ~anys))  # pattern, mask of agreed bits

    def pairs(self, queries: np.ndarray, first: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i the number of a query from ``first``, j > i a fingerprint within the radius."""
        n, fan = len(self.fps), self.fanout
        if not self.levels:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        acc = np.zeros(len(queries), np.int64)
        above = np.zeros(len(queries), np.uint64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            own = mask[node] & ~above
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & own)
            keep = acc <= radius
            if depth == 0:
                keep &= (node + 1) * fan > first + q
            q, node, acc, above = q[keep], node[keep], acc[keep], (above | own)[keep]
            size = n if depth == 0 else len(self.levels[depth - 1][0])
            child = (node[:, None] * fan + np.arange(fan)).ravel()
            q, acc, above = np.repeat(q, fan), np.repeat(acc, fan), np.repeat(above, fan)
            there = child < size
            q, node, acc, above = q[there], child[there], acc[there], above[there]
        far = acc + np.bitwise_count((queries[q] ^ self.fps[node]) & ~above)
        keep = (far <= radius) & (node > first + q)
        return first + q[keep], node[keep]


def forest(fps: np.ndarray, radius: int, chunk: int = 512) -> np.ndarray:
    """Label (smallest index linked to it) of each of the Gray-sorted fingerprints."""
    n = len(fps)
    label = np.arange(n)
    index = GrayIndex(fps)
    for a in range(0, n, chunk):
        i, j = index.pairs(fps[a : a + chunk], a, radius)
        while len(i):
            li, lj = label[i], label[j]
            differ = li != lj
            i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
            low = np.minimum(li, lj)
            np.minimum.at(label, li, low)
            np.minimum.at(label, lj, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def _linker(radius: int, limit: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (t, key, sub, gray).  Gives links (a, b) inside each bucket, or the rows of too large ones with b null."""
        held: list[tuple[np.ndarray, ...]] = []
        count, spilled = 0, None

        def out(a, b, t, key):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t, pa.int32()), pa.array(key, pa.int64())], names=["a", "b", "t", "key"])

        def flush(t, key, sub, fp):
            at = bucket_runs([t, key, sub])
            sizes = np.diff(np.append(at, len(t)))
            a, b = [], []
            pair = at[sizes == 2]
            if len(pair):
                near = np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius
                a.append(fp[pair[near]]), b.append(fp[pair[near] + 1])
            for s, m in zip(at[sizes > 2], sizes[sizes > 2]):
                part = fp[s : s + m]
                root = forest(part, radius)
                own = root != np.arange(m)
                a.append(part[own]), b.append(part[root[own]])
            if a:
                x, y = as_int64(np.concatenate(a)), as_int64(np.concatenate(b))
                yield out(x, y, np.zeros(len(x), np.int32), np.zeros(len(x), np.int64))

        for batch in batches:
            t, key, sub, fp = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
            fp = fp.view(np.uint64)
            if not len(t):
                continue
            if held:
                t, key, sub, fp = (np.concatenate([h[k] for h in held] + [x]) for k, x in enumerate((t, key, sub, fp)))
            last = bucket_runs([t, key, sub])[-1]
            if spilled is not None:
                own = (t == spilled[0]) & (key == spilled[1]) & (sub == spilled[2])
                m = int(own.sum())
                if m:
                    yield out(as_int64(fp[:m]), pa.nulls(m, pa.int64()), t[:m], key[:m])
                    t, key, sub, fp = t[m:], key[m:], sub[m:], fp[m:]
                    held = []
                    if not len(t):
                        continue
                    last -= m
                spilled = None
            yield from flush(t[:last], key[:last], sub[:last], fp[:last])
            t, key, sub, fp = t[last:], key[last:], sub[last:], fp[last:]
            if limit and len(t) > limit:
                spilled = (t[0], key[0], sub[0])
                yield out(as_int64(fp), pa.nulls(len(fp), pa.int64()), t, key)
                held = []
            else:
                held = [(t, key, sub, fp)]
        if held:
            yield from flush(*held[0])

    return links


LINK_SCHEMA = "a long, b long, t int, key long"


def _join(rows: DataFrame, radius: int, limit: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "t", "key", "sub").sortWithinPartitions("t", "key", "sub", "rank")
    return cut(dealt.select("t", "key", "sub", "fp").mapInArrow(_linker(radius, limit), LINK_SCHEMA), "links")


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links that connect all distinct fingerprints ``fp`` (long) at most ``radius`` (<= 2) bits apart.

    Two fingerprints that differ in two bits agree on three of five blocks, so
    they meet in a bucket of one of ten tables.  A bucket is sorted by Gray rank
    and joined through a :class:`GrayIndex`; it returns a spanning forest, not
    all pairs.  A bucket over ``bucket_limit`` is dealt anew by 15 sub-keys (one
    of its two free blocks, or the first one without one bit): those buckets
    hold at most 2 * 2**13 fingerprints and still meet every pair.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    fp = F.col("fp")
    keys = []
    for t, free in enumerate(_tables()):
        key, used = F.lit(0).cast("long"), 0
        for i, (lo, hi) in enumerate(BLOCKS):
            if i not in free:
                key = key.bitwiseOR(F.shiftleft(_bits(fp, lo, hi), used))
                used += hi - lo
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key"), F.lit(0).cast("long").alias("sub")))
    rows = fps.select(fp, _gray_rank(fp).alias("rank"), F.explode(F.array(*keys)).alias("k")).select("k.*", "fp", "rank")
    first = _join(rows, radius, bucket_limit)
    over = first.where("b is null")
    subs = F.lit(None)
    for t, (i, j) in enumerate(_tables()):
        (alo, ahi), (blo, bhi) = BLOCKS[i], BLOCKS[j]
        a, b = _bits(fp, alo, ahi), _bits(fp, blo, bhi)
        tag = [F.shiftleft(F.lit(0).cast("long"), 20).bitwiseOR(a), F.lit(1 << 20).cast("long").bitwiseOR(b)]
        tag += [F.lit((2 + x) << 20).cast("long").bitwiseOR(a.bitwiseAND(F.lit(~(1 << x)).cast("long"))) for x in range(ahi - alo)]
        subs = F.when(F.col("t") == t, F.array(*tag)).otherwise(subs)
    again = over.select(F.col("a").alias("fp"), "t", "key").select("t", "key", "fp", _gray_rank(fp).alias("rank"), F.explode(subs).alias("sub"))
    return first.where("b is not null").select("a", "b").union(_join(again, radius, 0).select("a", "b"))


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that a chain of links reaches.  Null and
    empty texts have fingerprint 0 and link like any other; repeated rows keep
    their rows; rows whose id is null get a component of the others they link
    to, or null.  Other columns are ignored; an empty table gives no rows.
    """
    if words_per_shingle != 3:
        def mapper(batches):
            for b in batches:
                fp = np.fromiter((fingerprint(x, words_per_shingle) for x in text_bytes(b.column(1))), np.uint64, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_int64(fp))], names=["doc_id", "fp"])
    else:
        mapper = _fingerprints
    marked = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(mapper, "doc_id long, fp long"), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    labels = connected_components(fingerprint_links(distinct.select("fp"), radius, bucket_limit))
    known = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    known = known.checkpoint()
    lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
    by_fp = known.join(lowest, "label").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, unchanged, one of each near-duplicate group: that with the smallest doc_id.

    Of repeated rows with that id one stays; a group without ids keeps one row.
    """
    groups = near_duplicate_groups(docs, **options)
    kept = groups.groupBy("component_id").agg(F.max(F.when(F.col("doc_id") == F.col("component_id"), F.col("doc_id"))).alias("__id")).select("__id").distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["doc_id"])
