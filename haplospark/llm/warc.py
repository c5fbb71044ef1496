"""WARC archives of pages and a globally ordered capture index."""

from __future__ import annotations

import datetime
import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: A payload below this size is never a revisit.
REVISIT_FROM = 1000
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 2 << 20
#: The pages carry no fetch time: page n is taken to be fetched n seconds after this.
EPOCH = datetime.datetime(2020, 1, 1)
_SPAN = 3_000_000_000


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query in lower case; no scheme, ``www.``, fragment."""
    rest = (url or "").split("#", 1)[0].split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    labels = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + slash + path.lower()


def _timestamp(page_id: int | None) -> datetime.datetime:
    return EPOCH + datetime.timedelta(seconds=abs(page_id or 0) % _SPAN)


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_timestamp(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = number = 0
    part = TaskContext.get().partitionId()

    def close():
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            packer = zlib.compressobj(4, zlib.DEFLATED, 31)
            held.append(packer.compress(_record(*row)) + packer.flush())
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size, number = [], 0, number + 1
    if held:
        yield close()


def write_archives(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Archives of all pages, ``archive, content``: each content is a whole ``.warc.gz`` file, a gzip member per record.

    Of pages with equal payloads of at least ``revisit_from`` bytes, the one with
    the largest ``page_id`` is a response and the others are revisits of it.  A
    null html is an empty payload, a null page_id ranks below all others,
    repeated rows with the largest page_id are all responses.  Digests are
    grouped with a combine before the shuffle, so one payload on a third of the
    pages is no hot key.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    last = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1 and last is not null").select("digest", "last")
    old = F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))
    marked = rows.join(last, "digest", "left").select("page_id", "url", "payload", "digest", F.when(old, F.col("last")).alias("refers_to"))
    return marked.mapInArrow(_write, "archive string, content binary")


def read_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, compressed length, headers, block) of each record of an archive."""
    at, view = 0, memoryview(content)
    while at < len(view):
        unpack, out, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[pos : pos + 65536]
            if not piece:
                raise ValueError("archive ends inside a record")
            out.append(unpack.decompress(piece))
            pos += len(piece)
        end = pos - len(unpack.unused_data)
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield at, end - at, headers, rest[: int(headers["Content-Length"])]
        at = end


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return None if name in ("", "null") else int(name)


CAPTURE = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
_CAPTURE_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_CAPTURE_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _order(row):
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for archive, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            run = []
            for offset, length, headers, block in read_records(content):
                http, _, body = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response":
                    if hashlib.sha1(body).hexdigest() != digest or len(body) != size:
                        raise ValueError(f"damaged record at {archive}:{offset}")
                date = headers["WARC-Date"].translate({ord(c): None for c in "-:TZ"})
                run.append((url_key(headers["WARC-Target-URI"]), date, _page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers.get("WARC-Refers-To")), archive, offset, length))
            run.sort(key=_order)
            cols = list(zip(*run))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CAPTURE_TYPES)] + [pa.array(range(len(run)), pa.int64())], names=[*_CAPTURE_NAMES, "place"])


#: Captures of a range.
RANGE_ROWS = 100_000


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs] or [None]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._climb(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and self.heads[a] is not None
        return (self.heads[a], a) < (self.heads[b], b)

    def _climb(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:  # first match at this node: wait for the opponent
                self.loser[node] = i
                return
            if self._beats(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while (i := self.loser[0]) >= 0 and self.heads[i] is not None:
            run = self.runs[i]
            yield run[self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(run[self.at[i]]) if self.at[i] < len(run) else None
            self._climb(i)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(10)))]
    runs = [list(g) for _, g in groupby(rows, key=lambda r: r[7])]
    part, place, out = TaskContext.get().partitionId(), 0, []

    def batch():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CAPTURE_TYPES)] + [pa.array([part] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64())], names=[*_CAPTURE_NAMES, "range_no", "position"])

    for row in LoserTree(runs, _order):
        out.append(row)
        if len(out) == 5000:
            yield batch()
            place, out = place + len(out), []
    if out:
        yield batch()


def capture_index(archives: DataFrame) -> DataFrame:
    """Capture histories of all records, read back from the archives.

    A task reads an archive and sorts its captures into a run.  Runs are dealt by
    ranges of (URL key, timestamp, page), so one host or URL may span many
    ranges; each range merges its slices of the runs by a loser tree.  There are
    as many ranges as keep each at about ``RANGE_ROWS`` captures, which is what a
    task holds.  Ordered by ``range_no, position`` the result is in global order.
    """
    runs = cut(archives.mapInArrow(_read, CAPTURE + ", place long"), "captures")
    parts = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(parts, "urlkey", "timestamp", "page_id").sortWithinPartitions("archive", "place")
    return dealt.mapInArrow(_merge, CAPTURE + ", range_no int, position long")


def archive_and_index(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write archives to the shared folder, read them back, merge the index."""
    return capture_index(cut(write_archives(pages, revisit_from), "archives"))
