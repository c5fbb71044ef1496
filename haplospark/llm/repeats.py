"""Exact repeated windows of fixed length over all documents.

Shared by the suffix-array and the fixed-block operators.  A window is ``length``
consecutive units (bytes, or words as 64-bit hashes).  It is repeated if its
content starts anywhere else, in the same document too.

1. Winnowing: the smallest of the ``gram``-unit hashes inside a window is its
   anchor.  Equal windows have equal anchors at equal offsets, so windows are
   dealt to buckets by anchor hash.  Consecutive windows with one anchor make a
   segment of fewer than ``2 * length`` units.
2. An anchor hash that occurs once can't belong to a repeated window: dropped
   by a count that is combined before the shuffle.
3. Equal segments are merged with their number of occurrences, again before
   the shuffle, so a passage shared by a third of all documents is one row.
4. Each bucket's distinct segments go through the operator's own solver.  A
   bucket with more than ``hot`` of them is dealt anew in pieces: windows whose
   anchor lies in one range of offsets, by what all of these hold of the text.
   The pieces go through the same solver; in the last deal a piece is a window,
   and all that meet are equal, so that every bucket comes below the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_int64, bucket_runs, cut, drop, hub_join, text_bytes

#: Window starts that are worked on at once; bounds the memory for a very long text.
CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Rolling:
    """Polynomial hashes mod 2**64 of any slice of a sequence of 64-bit units."""

    up = down = np.zeros(0, np.uint64)

    def __init__(self, units: np.ndarray):
        n = len(units)
        if len(Rolling.up) < n + 1:
            size = max(n + 1, 1 << 16)
            Rolling.up, Rolling.down = _powers(_BASE, size), _powers(_INVERSE, size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * Rolling.up[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        h = self.sums[k:] - self.sums[:-k]
        h *= Rolling.down[: len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    size = -(-n // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


@dataclass(frozen=True)
class Spec:
    length: int  #: units in a window
    gram: int  #: units in an anchor
    units: Callable[[bytes], np.ndarray]  #: text to 64-bit units
    hot: int = 4096  #: distinct segments of a bucket that one task may hold


def segments(units: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, first window, number of windows, offset of the anchor) of a document's segments."""
    n = len(units)
    for at in range(0, n - spec.length + 1, CHUNK):
        part = units[at : at + CHUNK + spec.length - 1]
        h = Rolling(part).grams(spec.gram)
        pos = np.arange(len(h), dtype=np.uint64)
        low = (sliding_min((h & ~_LOW) | pos, spec.length - spec.gram + 1) & _LOW).astype(np.int64)
        first = bucket_runs([low])
        yield h[low[first]], at + first, np.diff(np.append(first, len(low))), low[first] - first


ANCHORS = "akey long, seg long, t1 long, t2 int, packs array<long>"


def _grouped(akey: np.ndarray, seg: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, ...]:
    """A document's segments, equal ones as one row: keys, places, and where each row's places begin."""
    order = np.lexsort((pack, seg, akey))
    akey, seg, pack = akey[order], seg[order], pack[order]
    at = bucket_runs([akey, seg])
    return akey[at], seg[at], pack, at


def _pack(lo, n, off):
    return (lo.astype(np.int64) << 24) | (n.astype(np.int64) << 12) | off.astype(np.int64)


def _anchors(spec: Spec):
    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2 = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            size = 0

            def flush():
                akey, seg, one, two, pack = (np.concatenate(c) for c in list(zip(*out))[:5])
                sizes = np.concatenate([np.diff(np.append(o[5], len(o[4]))) for o in out])
                packs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(pack))
                return pa.RecordBatch.from_arrays([pa.array(as_int64(akey)), pa.array(as_int64(seg)), pa.array(one), pa.array(two.astype(np.int32)), packs], names=["akey", "seg", "t1", "t2", "packs"])

            for i, text in enumerate(text_bytes(b.column(0))):
                units = spec.units(text)
                if len(units) < spec.length:
                    continue
                raw, width = units.tobytes(), units.itemsize
                wide = _BYTES[units] if width == 1 else units
                mine = []
                for akey, lo, n, off in segments(wide, spec):
                    ends = lo + n + spec.length - 1
                    seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[x * width : y * width]) for x, y in zip(lo.tolist(), ends.tolist())), np.uint64, len(lo))
                    mine.append((akey, seg, _pack(lo, n, off)))
                akey, seg, pack, at = _grouped(*(np.concatenate(c) for c in zip(*mine)))
                out.append((akey, seg, np.full(len(at), t1[i]), np.full(len(at), t2[i]), pack, at))
                size += len(pack)
                if size > 100_000:
                    yield flush()
                    out, size = [], 0
            if out:
                yield flush()

    return mapper


_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FETCHED = "akey long, seg long, off int, lo long, many long, hot boolean, content binary"
PIECES = "akey long, seg long, shift int, bkey long, piece long, off int, lo long, many long, content binary"


def _fetch(spec: Spec):
    """Rows (text, want): the units of the segments that ``want`` lists."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text, want in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                units = spec.units(text)
                raw, width = units.tobytes(), units.itemsize
                for w in want:
                    lo, n, off = w["pack"] >> 24, (w["pack"] >> 12) & 4095, w["pack"] & 4095
                    rows.append((w["akey"], w["seg"], off, lo, w["many"], w["hot"], raw[lo * width : (lo + n + spec.length - 1) * width]))
                if len(rows) > 4000:
                    yield _rows(rows, FETCHED_TYPES)
                    rows = []
            if rows:
                yield _rows(rows, FETCHED_TYPES)

    return mapper


FETCHED_TYPES = [("akey", pa.int64()), ("seg", pa.int64()), ("off", pa.int32()), ("lo", pa.int64()), ("many", pa.int64()), ("hot", pa.bool_()), ("content", pa.binary())]
PIECE_TYPES = [("akey", pa.int64()), ("seg", pa.int64()), ("shift", pa.int32()), ("bkey", pa.int64()), ("piece", pa.int64()), ("off", pa.int32()), ("lo", pa.int64()), ("many", pa.int64()), ("content", pa.binary())]
FOUND_TYPES = [("akey", pa.int64()), ("seg", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]
FOUND = "akey long, seg long, a int, b int"


def _rows(rows: list[tuple], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])


@dataclass
class Block:
    """Distinct segments of whole buckets, laid out one after another."""

    akey: np.ndarray
    seg: np.ndarray
    off: np.ndarray
    lo: np.ndarray  #: number of the first window in its document
    many: np.ndarray  #: occurrences of the segment
    content: list[bytes]


def _solved(spec: Spec, solver: Callable[[Block, Spec], Iterator[tuple[int, np.ndarray]]], block_bytes: int):
    """Feeds whole buckets, sorted by anchor, to the solver in blocks of bounded size."""

    def work(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        cols = {k: [x for p in parts for x in p[k]] for k in parts[0]}
        block = Block(*(np.array(cols[k], np.int64) for k in ("akey", "seg", "off", "lo", "many")), cols["content"])
        rows = []
        for i, hit in solver(block, spec):
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                rows.append((int(block.akey[i]), int(block.seg[i]), a, b))
        if rows:
            yield _rows(rows, FOUND_TYPES)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for b in batches:
            d = b.to_pydict()
            starts = bucket_runs([np.array(d["akey"], np.int64)]).tolist() + [b.num_rows]
            for x, y in zip(starts, starts[1:]):
                part = {k: v[x:y] for k, v in d.items()}
                if size > block_bytes and d["akey"][x] != last:
                    yield from work(held)
                    held, size = [], 0
                held.append(part)
                size += sum(map(len, part["content"]))
                last = d["akey"][x]
        if held:
            yield from work(held)

    return mapper


def _pieces(spec: Spec, width: int, item: int):
    """Segments cut into pieces: windows whose anchor offsets fall in one range of ``width``, dealt by what every window of the range holds."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for akey, seg, off, lo, many, content in zip(*(b.column(i).to_pylist() for i in range(6))):
                n = len(content) // item - spec.length + 1
                last = off  # anchor offset of the first window; it falls by one a window
                while last > off - n:
                    low = last // width * width
                    i, j = off - last, min(n, off - low + 1)
                    core = content[(off - low) * item : (off - low - width + 1 + spec.length) * item]
                    part = content[i * item : (j - 1 + spec.length) * item]
                    bkey = xxhash.xxh3_64_intdigest(core, (akey ^ low) & 0xFFFFFFFFFFFFFFFF)
                    rows.append((akey, seg, i, bkey - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), off - i, lo + i, many, part))
                    last = low - 1
                if len(rows) > 2000:
                    yield _rows(rows, PIECE_TYPES)
                    rows = []
            if rows:
                yield _rows(rows, PIECE_TYPES)

    return mapper


def _runs(rows: DataFrame, spec: Spec, solver, block_bytes: int, item: int, widths: list[int]) -> DataFrame:
    """``akey, seg, a, b``: runs of repeated windows of distinct segments (akey, seg, off, lo, many, hot, content)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.where("not hot").repartition(parts, "akey").sortWithinPartitions("akey", "seg").drop("hot")
    found = own.mapInArrow(_solved(spec, solver, block_bytes), FOUND)
    hot = rows.where("hot")
    if not widths or hot.isEmpty():
        return found
    pieces = cut(hot.drop("hot").mapInArrow(_pieces(spec, widths[0], item), PIECES), "pieces")
    same = cut(pieces.groupBy("bkey", "piece").agg(F.sum("many").alias("many"), F.min(F.struct("lo", "off", "content")).alias("x")), "pieces-distinct")
    over = same.groupBy("bkey").agg((F.count(F.lit(1)) > spec.hot).alias("hot"))
    again = cut(same.join(over, "bkey").select(F.col("bkey").alias("akey"), F.col("piece").alias("seg"), "x.off", "x.lo", "many", "hot", "x.content"), "pieces-dealt")
    deeper = _runs(again, spec, solver, block_bytes, item, widths[1:])
    back = pieces.select("akey", "seg", "shift", "bkey", "piece").join(deeper.select(F.col("akey").alias("bkey"), F.col("seg").alias("piece"), "a", "b"), ["bkey", "piece"])
    return found.union(back.select("akey", "seg", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))


def repeated_spans(docs: DataFrame, spec: Spec, solver, dtype, block_bytes: int = 1 << 20) -> DataFrame:
    """Spans of repeated windows for each text of ``docs`` (columns text, t1, t2).

    Returns ``t1, t2, spans``: an array of (first unit, end unit), covering every
    unit inside a repeated window of the text.  t1, t2 are the text's key, so
    equal texts share one row.  Texts without repeats have no row.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(docs.select("text", "t1", "t2").mapInArrow(_anchors(spec), ANCHORS), "anchors")
    repeated = cut(found.groupBy("akey").agg(F.sum(F.size("packs")).alias("c"), F.count(F.lit(1)).alias("rows")).where("c > 1").select("akey", "rows"), "repeated")
    # dealt anew for the count: a join right below an aggregate on its key could not split a common anchor
    dealt = hub_join(found, repeated, ["akey"], "left_semi").repartition(parts, "akey", "seg", "t1", "t2")
    kept = cut(dealt.groupBy("akey", "seg", "t1", "t2").agg(F.first("packs").alias("packs"), F.count(F.lit(1)).alias("copies")), "kept")
    drop(found, repeated)
    many = F.sum(F.col("copies") * F.size("packs"))
    at = F.min(F.struct("t1", "t2", F.col("packs")[0].alias("pack")))
    distinct = cut(kept.groupBy("akey", "seg").agg(many.alias("many"), F.count(F.lit(1)).alias("rows"), at.alias("at")), "distinct")
    over = cut(distinct.groupBy("akey").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > spec.hot).select("akey", F.lit(True).alias("hot")), "over")
    want = (
        distinct.join(over, "akey", "left")
        .groupBy("at.t1", "at.t2")
        .agg(F.collect_list(F.struct("akey", "seg", "many", F.coalesce("hot", F.lit(False)).alias("hot"), F.col("at.pack").alias("pack"))).alias("want"))
    )
    want = cut(want, "want")
    texts = docs.select("text", "t1", "t2").join(want, ["t1", "t2"]).select("text", "want")
    fetched = cut(texts.mapInArrow(_fetch(spec), FETCHED).dropDuplicates(["akey", "seg"]), "segments")
    widths = list(dict.fromkeys((max(1, (spec.length - spec.gram + 1) // 16), 1)))
    runs = _runs(fetched.select("akey", "seg", "off", "lo", "many", "hot", "content"), spec, solver, block_bytes, np.dtype(dtype).itemsize, widths)
    runs = runs.groupBy("akey", "seg").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("r"))
    runs = cut(runs.join(distinct.select("akey", "seg", "rows"), ["akey", "seg"]), "runs")
    drop(fetched, want, distinct, over)
    shift = lambda p, x: F.struct((F.shiftright(p, 24) + x["a"]).alias("a"), (F.shiftright(p, 24) + x["b"] + (spec.length - 1)).alias("b"))
    spans = hub_join(kept, runs, ["akey", "seg"]).select("t1", "t2", F.flatten(F.transform("packs", lambda p: F.transform("r", lambda x: shift(p, x)))).alias("r"))
    spans = cut(spans.groupBy("t1", "t2").agg(F.flatten(F.collect_list("r")).alias("spans")), "spans")
    drop(kept, runs)
    return spans


def keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """Adds a 96-bit key of the text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*cols, text.alias("text"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))


def merged(spans, total: int) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, total)) for a, b in out]
