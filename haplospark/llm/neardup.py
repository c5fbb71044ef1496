"""Near-duplicate removal by SimHash at a similarity of word shingles.

The fixed radius of :mod:`simhash` suits fingerprints that hardly differ.  Texts
whose five-word shingles agree to 0.8 differ in about an eighth of the bits, so
here the Gray-ordered index searches a wider radius, inside buckets of sampled
bits, and every candidate is checked by the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_int64, bucket_runs, connected_components, cut, drop, text_bytes
from .simhash import GrayIndex, _gray_rank, fingerprint

SHINGLE, SIMILARITY = 5, 0.8
#: Share of differing bits that the tables are laid out for (the mean is 0.118 at a five-word similarity of 0.8; short texts spread), and the radius that holds nearly all such pairs.
DIFFER, RADIUS = 0.15, 14
#: Neighbours that a text proposes in a bucket at first; fingerprints of a bucket that are searched together; 64-bit words of the largest bitmap.
NEAREST, BLOCK, MOST_WORDS = 3, 16_384, 512
#: Tables in which texts with more neighbours than that propose at once; in the others they wait until the first ones' pairs are merged.
AHEAD = 3


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of word shingles; of fewer words, the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) <= size:
        return as_int64(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64))
    units = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(units) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + units[k : k + len(h)]
    h ^= h >> np.uint64(31)
    return np.unique(as_int64(h * np.uint64(0xBF58476D1CE4E5B9)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b.column(2))
        fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        n = np.array([len(shingles(t)) for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(as_int64(fp)), pa.array(n)], names=["doc_id", "t", "fp", "n"])


def tables(nodes: int, recall: float) -> np.ndarray:
    """Sampled bit positions (tables x bits): as many bits as there are texts to tell apart, and tables for the recall."""
    bits = min(44, max(12, math.ceil(math.log2(max(nodes, 2))) - 2))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - DIFFER) ** bits))
    rng = np.random.default_rng(11)
    return np.stack([np.sort(rng.permutation(64)[:bits]) for _ in range(count)])


def _deal(picked: np.ndarray):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                fp = part.column(1).to_numpy().view(np.uint64)
                cols = [part.column(i).to_numpy() for i in (0, 2, 3)]
                for t, bits in enumerate(picked):
                    key = np.zeros(len(fp), np.uint64)
                    for k, bit in enumerate(bits.tolist()):
                        key |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(as_int64(key)), *map(pa.array, cols)], names=["table", "key", "t", "n", "rank"])

    return mapper


def bitmap(shingle: np.ndarray) -> np.ndarray:
    """Words of a bit set with at least eight bits a shingle, up to :data:`MOST_WORDS`; half of it, folded, is the next smaller one."""
    words = 1
    while words * 8 < len(shingle) and words < MOST_WORDS:
        words *= 2
    at = shingle.view(np.uint64) & np.uint64(words * 64 - 1)
    flags = np.zeros(words * 64, np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Bound:
    """Upper bounds of the shingle similarity of pairs, from bitmaps.

    Every bit that A has and B lacks stands for at least one shingle of A
    outside B, so the bounds never fall below the similarity itself: no pair is
    lost by them.
    """

    def __init__(self, n: np.ndarray, bitmaps: list[bytes]):
        self.n = n
        size = np.array([len(x) // 8 for x in bitmaps])
        self.size, self.rows, self.at = size, {}, np.zeros(len(n), np.int64)
        for w in np.unique(size).tolist():
            own = np.flatnonzero(size == w)
            self.rows[w] = np.frombuffer(b"".join(bitmaps[k] for k in own.tolist()), np.uint64).reshape(len(own), w)
            self.at[own] = np.arange(len(own))

    def _bits(self, k: np.ndarray, w: int) -> np.ndarray:
        out = np.empty((len(k), w), np.uint64)
        for own in np.unique(self.size[k]).tolist():
            mine = self.size[k] == own
            x = self.rows[own][self.at[k[mine]]]
            while x.shape[1] > w:
                x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
            out[mine] = x
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        small = np.minimum(self.size[i], self.size[j])
        for w in np.unique(small).tolist():
            own = np.flatnonzero(small == w)
            step = max(1, 2_000_000 // w)
            for x in range(0, len(own), step):
                k = own[x : x + step]
                a, b = self._bits(i[k], w), self._bits(j[k], w)
                both = np.minimum(self.n[i[k]] - np.bitwise_count(a & ~b).sum(1), self.n[j[k]] - np.bitwise_count(b & ~a).sum(1))
                out[k] = both / (self.n[i[k]] + self.n[j[k]] - both)
        return out


#: Rows of a bucket as they are dealt, sorted by (table, key, sub, Gray rank); label null: each text its own.
DEALT = ("table", "key", "sub", "t", "rank", "n", "label", "bits")
PROPOSED = "table int, key long, sub long, a long, b long"


def _propose(radius: int, ratio: float, nearest: int, limit: int, ahead: int | None = None):
    """Links of each text to its nearest neighbours of like length and another label in its bucket.

    Where bitmaps are there, pairs that they prove to be below the similarity go,
    the rest is nearest by them, and of two labels that meet the best pairs are
    taken only.  Of neighbours beyond these the texts are given back, a null; all
    of a bucket over ``limit`` (if not 0) likewise, b null.  From table ``ahead``
    on no pair is proposed whose texts are both given back.
    """

    def links(fp, label):
        """Chunks of directed pairs (i, j) with another label: all of them."""
        index = GrayIndex(fp)
        names, counts = np.unique(label, return_counts=True)
        if counts.max() * 2 <= len(fp):
            for x in range(0, len(fp), 256):
                i, j = index.pairs(fp[x : x + 256], x, radius)
                yield np.concatenate([i, j]), np.concatenate([j, i])
        else:  # only the texts outside the largest group are looked for
            large = label == names[counts.argmax()]
            rest = np.flatnonzero(~large)
            for x in range(0, len(rest), 256):
                own = rest[x : x + 256]
                q, j = index.pairs(fp[own], -len(own), radius)
                i = own[q + len(own)]
                yield np.concatenate([i, j[large[j]]]), np.concatenate([j, i[large[j]]])

    def first(keys: list[np.ndarray], far: np.ndarray) -> np.ndarray:
        """Which rows are among the ``nearest`` of their keys."""
        order = np.lexsort((far, *keys[::-1]))
        at = bucket_runs([k[order] for k in keys])
        place = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
        own = np.zeros(len(order), bool)
        own[order] = place < nearest
        return own

    def keep(i, j, far, label, grouped, over):
        own = first([i], far)
        if grouped:
            x, y = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            own &= first([x, y], far)
        over[i[~own]] = over[j[~own]] = True
        return i[own], j[own], far[own]

    def out(table, fp, n, label, bits):
        held, size, over = [], 0, np.zeros(len(fp), bool)
        bound = Bound(n, bits) if bits is not None else None
        for i, j in links(fp, label):
            fit = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
            i, j = i[fit], j[fit]
            if bound is None:
                far = np.bitwise_count(fp[i] ^ fp[j]).astype(float)
            else:
                most = bound(i, j)
                fit = most >= ratio - 1e-9
                i, j, far = i[fit], j[fit], -most[fit]
            held.append((i, j, far))
            size += len(i)
            if size > 2_000_000:
                held = [keep(*(np.concatenate(x) for x in zip(*held)), label, bound is not None, over)]
                size = len(held[0][0])
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), over
        i, j, _ = keep(*(np.concatenate(x) for x in zip(*held)), label, bound is not None, over)
        if ahead is not None and table >= ahead:
            now = ~(over[i] & over[j])
            i, j = i[now], j[now]
        return i, j, over

    def rows(cols, a, b):
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["table", "key", "sub", "a", "b"])

    def work(cols, at):
        t, rank, n, label, bits = cols[3], cols[4].view(np.uint64), cols[5], cols[6], cols[7]
        fp = rank ^ (rank >> np.uint64(1))
        a, b, unfinished = [], [], []
        for x, y in zip(at, at[1:]):
            if y - x == 2:
                like = label[x] != label[x + 1] and min(n[x], n[x + 1]) >= ratio * max(n[x], n[x + 1])
                if like and int(fp[x] ^ fp[x + 1]).bit_count() <= radius:
                    a.append(t[x : x + 1]), b.append(t[x + 1 : x + 2])
            elif y - x > 2:
                i, j, over = out(cols[0][x], fp[x:y], n[x:y], label[x:y], None if bits[x] is None else bits[x:y].tolist())
                a.append(t[x + i]), b.append(t[x + j])
                unfinished.append(x + np.flatnonzero(over))
        own = np.concatenate(unfinished) if unfinished else np.zeros(0, np.int64)
        if len(own):
            yield rows([c[own] for c in cols[:3]], pa.nulls(len(own)), t[own])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            zero = np.zeros(len(a), np.int64)
            yield rows([zero.astype(np.int32), zero, zero], a, b)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = spilled = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            if batch.column(6).null_count:
                cols[6] = cols[3]
            if spilled is not None:
                own = (cols[0] == spilled[0]) & (cols[1] == spilled[1]) & (cols[2] == spilled[2])
                if own.any():
                    yield rows([c[own] for c in cols[:3]], cols[3][own], pa.nulls(int(own.sum())))
                    cols = [c[~own] for c in cols]
            if not len(cols[0]):
                continue
            spilled = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            at = bucket_runs(cols[:3]).tolist()
            yield from work(cols, at)
            held = [c[at[-1] :] for c in cols]
            if limit and len(held[0]) > limit:
                yield rows(held[:3], held[3], pa.nulls(len(held[0])))
                held, spilled = None, [c[0] for c in held[:3]]
        if held is not None:
            yield from work(held, [0, len(held[0])])

    return mapper


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            found = [shingles(t) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["t", "s"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = b.column(1)
        values, at = s.values.to_numpy(), s.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bitmap(values[x:y]).tobytes() for x, y in zip(at, at[1:])], pa.binary())], names=["t", "bits"])


def _proposals(dealt: DataFrame, radius: int, similarity: float, nearest: int, limit: int, ahead: int | None = None) -> DataFrame:
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*DEALT).repartition(parts, "table", "key", "sub").sortWithinPartitions("table", "key", "sub", "rank")
    return cut(dealt.mapInArrow(_propose(radius, similarity, nearest, limit, ahead), PROPOSED), "proposals")


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose texts have the similarity."""
    edges = cut(edges.distinct(), "edges")
    pairs = edges.join(sets.select(F.col("t").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("t").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    verified = cut(pairs.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "verified")
    drop(edges)
    return verified


def _merged(known: DataFrame, linked: DataFrame) -> DataFrame:
    """``known`` with the labels that the links join made one."""
    of = known.select("t", "label")
    ends = linked.join(of.withColumnsRenamed({"t": "a", "label": "x"}), "a").join(of.withColumnsRenamed({"t": "b", "label": "y"}), "b")
    labels = cut(connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "labels")
    joined = known.join(labels.withColumnRenamed("label", "lowest"), F.col("label") == F.col("node"), "left")
    return cut(joined.withColumn("label", F.coalesce("lowest", "label")).select(*known.columns), "known")


def _known(docs: DataFrame, similarity: float, radius: int, recall: float, limit: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``doc_id, t`` of each row, and ``t, fp, n, low, label`` of each distinct text.

    A first search proposes each text's nearest neighbours by fingerprint, which
    are verified and merged; texts of a crowd propose in the first tables only
    and wait in the others, where most are of one label by then.  Where a text has more neighbours of another label
    the bucket is searched again, now with bitmaps, for four times as many, until
    none is left over: then each pair within the radius in any bucket is merged,
    was tested, or is proven to be below the similarity.  A bucket over the limit
    is searched in parts first, and again with each part against each other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    marked = cut(rows.mapInArrow(_features, "doc_id long, t long, fp long, n long"), "features")
    known = cut(marked.groupBy("t").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("doc_id").alias("low")).withColumn("label", F.col("t")), "nodes")
    rank = _gray_rank(F.col("fp")).alias("rank")
    none = {"label": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")}
    dealt = known.where("n > 0").select("t", "fp", "n", rank).mapInArrow(_deal(tables(known.count(), recall)), "table int, key long, t long, n long, rank long")
    found = [_proposals(dealt.withColumns({"sub": F.lit(0).cast("long"), **none}), radius, similarity, NEAREST, limit, AHEAD)]
    left = found[0].where("a is null").select("table", "key", "sub", F.col("b").alias("t"))
    over = found[0].where("b is null").select("table", "key", F.col("a").alias("t"))
    if not over.isEmpty():
        of = over.groupBy("table", "key").agg(F.ceil(F.count("t") * 2 / limit).alias("m"))
        split = cut(over.join(of, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("t"), F.col("m"))), "parts")
        alone = split.withColumn("sub", F.col("own")).join(known.select("t", "n", rank), "t")
        found.append(_proposals(alone.withColumns(none), radius, similarity, NEAREST, 0, AHEAD))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        split = split.withColumn("sub", 1 + F.least("own", "other") * F.col("m") + F.greatest("own", "other"))
        left = left.union(split.select("table", "key", "sub", "t"))
    edges = [f.where("a is not null and b is not null").select("a", "b") for f in found]
    edges = edges[0] if len(edges) == 1 else edges[0].union(edges[1])
    wanted = edges.select(F.col("a").alias("t")).union(edges.select("b")).union(left.select("t")).distinct()
    sets = cut(rows.select("t", "text").join(wanted, "t", "left_semi").dropDuplicates(["t"]).mapInArrow(_sets, "t long, s array<long>"), "shingles")
    bits, nearest = None, NEAREST
    while True:
        verified = _verified(edges, sets, similarity)
        before, known = known, _merged(known, verified)
        drop(before, verified)
        if left.isEmpty():
            break
        if bits is None:  # later rounds search among these texts only
            bits = cut(sets.join(left.select("t").distinct(), "t", "left_semi").mapInArrow(_bitmaps, "t long, bits binary"), "bitmaps")
        nearest *= 4
        before, found = found, [_proposals(left.join(known.select("t", "label", "n", rank).join(bits, "t"), "t"), radius, similarity, nearest, 0)]
        drop(*before)
        left = found[0].where("a is null").select("table", "key", "sub", F.col("b").alias("t"))
        edges = found[0].where("a is not null and b is not null").select("a", "b")
    drop(sets, *found)
    return marked.select("doc_id", "t"), known


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, recall: float = 0.97) -> DataFrame:
    """``doc_id, group_id`` for each row: the smallest doc_id among the texts that links of ``similarity`` or more connect.

    Equal texts are one node.  Distinct texts are dealt by sampled fingerprint
    bits into enough tables to meet a pair at the threshold with chance
    ``recall``; in a bucket the Gray-ordered index finds the neighbours within
    ``radius`` bits and of like length; the share of common five-word shingles
    decides.  Null and empty texts are equal to each other; repeated rows share
    their group; other columns are ignored.
    """
    marked, known = _known(docs, similarity, radius, recall)
    lowest = known.groupBy("label").agg(F.min("low").alias("group_id"))
    return marked.join(known.join(lowest, "label").select("t", "group_id"), "t").select("doc_id", "group_id")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, recall: float = 0.97) -> DataFrame:
    """Rows of ``docs``, unchanged, one of each group: that with the smallest doc_id, once.

    Groups are told apart by their texts: a group without ids keeps one row, and
    different texts that share a doc_id, or have none, stay if their groups differ.
    A text's identity in the search is a hash of 64 bits; different texts that
    share one (told apart by another 64) are all kept, once each.
    """
    _, known = _known(docs, similarity, radius, recall)
    first = known.groupBy("label").agg(F.min(F.struct(F.col("low").isNull(), "low", "t")).alias("x")).select(F.col("x.t").alias("__t"), F.col("x.low").alias("__low"))
    marked = _identified(docs)
    shared = marked.groupBy("__t").agg(F.min("__u").alias("__a"), F.max("__u").alias("__b")).where("__a <> __b").select("__t")
    own = (marked["__t"] == first["__t"]) & marked["doc_id"].cast("long").eqNullSafe(first["__low"])
    return _once(marked.join(first, own, "left_semi"), marked, shared).select(*docs.columns)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__t": F.xxhash64(text), "__u": F.xxhash64(F.lit(1), text)})


def _once(chosen: DataFrame, marked: DataFrame, shared: DataFrame) -> DataFrame:
    """``chosen``, and of the texts that share a hash all, one row of each text."""
    also = marked.join(shared, "__t", "left_semi")
    return chosen.unionByName(also).dropDuplicates(["__t", "__u"])
