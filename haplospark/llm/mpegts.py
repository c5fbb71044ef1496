"""Texts as media columns: MPEG transport streams with program tables, clocks and random-access points."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, text_bytes

# Fixed values of the transport stream format.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CRC_POLY = 0x04C11DB7

#: Bytes of an access unit, ticks of the 90 kHz clock between units, units from one random-access point to the next.
UNIT, TICKS, GROUP = 16_384, 3_600, 8
PAD = 64


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


PAT = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = _section(0x02, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _clock(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 14, (pts >> 22) & 255, 1 | (pts >> 14) & 254, (pts >> 7) & 255, 1 | (pts << 1) & 254])


def _pcr(base: int) -> bytes:
    return bytes([(base >> 25) & 255, (base >> 17) & 255, (base >> 9) & 255, (base >> 1) & 255, (base & 1) << 7 | 0x7E, 0])


def mux(payload: bytes) -> bytes:
    """A single-program stream of the payload, in access units of ``UNIT`` bytes."""
    out: list[bytes] = []
    counter = 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _clock(pts) + unit
        adaptation = b""
        if k % GROUP == 0:
            group = k // GROUP
            out += [_table_packet(PAT_PID, PAT, group), _table_packet(PMT_PID, PMT, group)]
            adaptation = bytes([0x50]) + _pcr(pts)
        first, at = True, 0
        while first or at < len(pes):
            rest = len(pes) - at
            if not adaptation and not first and rest >= 184:
                whole = rest // 184
                block = np.empty((whole, PACKET), np.uint8)
                block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
                block[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
                block[:, 4:] = np.frombuffer(pes, np.uint8, whole * 184, at).reshape(whole, 184)
                out.append(block.tobytes())
                at, counter = at + whole * 184, counter + whole
                continue
            room = 184 - (len(adaptation) + 1 if adaptation else 0)
            if rest < room:  # stuffing fills the packet
                fill = 183 - rest - len(adaptation)
                adaptation = (adaptation or (b"\0" if fill else b"")) + b"\xff" * (fill if adaptation else max(0, fill - 1))
                field_ = bytes([len(adaptation)]) + adaptation
            else:
                field_ = bytes([len(adaptation)]) + adaptation if adaptation else b""
            body = pes[at : at + 184 - len(field_)]
            out.append(bytes([SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 255, (0x30 if field_ else 0x10) | counter & 15]) + field_ + body)
            at, counter, first, adaptation = at + len(body), counter + 1, False, b""
    return b"".join(out)


@dataclass
class Stream:
    """What a demultiplexer found."""

    payload: bytes
    packets: int
    continuity_errors: int
    timestamps: list[int] = field(default_factory=list)  #: of each unit, 90 kHz
    random_access: list[tuple[int, int]] = field(default_factory=list)  #: (timestamp, first packet)


def _sections(rows: np.ndarray, pid: int, pids: np.ndarray) -> Iterator[bytes]:
    for row in rows[pids == pid]:
        raw = row.tobytes()
        start = 5 + raw[4]
        size = 3 + ((raw[start + 1] & 15) << 8 | raw[start + 2])
        if section_crc(section := raw[start : start + size]):
            raise ValueError(f"bad checksum in a table of PID {pid}")
        yield section


def demux(media: bytes) -> Stream:
    """Find the program's stream through its tables and put its packets together again."""
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    pat = next(_sections(rows, PAT_PID, pids))
    pmt_pid = (pat[10] & 31) << 8 | pat[11]
    pmt = next(_sections(rows, pmt_pid, pids))
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    pid = (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    where = np.flatnonzero(pids == pid)
    data = rows[where]
    control = data[:, 3]
    errors = int((((np.diff(control.astype(np.int64) & 15)) & 15) != 1).sum())
    plain = (control & 0x20) == 0
    starts = (data[:, 1] & 0x40) != 0
    special = np.flatnonzero(~plain | starts)
    stream, parts, pts, points = Stream(b"", len(rows), errors), [], [], []
    for i, k in enumerate(special.tolist()):
        raw = data[k].tobytes()
        body = 4 + (raw[4] + 1 if raw[3] & 0x20 else 0)
        if raw[1] & 0x40:
            pes = raw[body:]
            if pes[:3] != b"\0\0\1":
                raise ValueError("no start code")
            c = pes[9:14]
            pts.append((c[0] & 14) << 29 | c[1] << 22 | (c[2] & 254) << 14 | c[3] << 7 | c[4] >> 1)
            if raw[3] & 0x20 and raw[4] and raw[5] & 0x40:
                points.append((pts[-1], int(where[k])))
            body += 9 + pes[8]
        parts.append(raw[body:])
        end = int(special[i + 1]) if i + 1 < len(special) else len(data)
        if end > k + 1:
            parts.append(data[k + 1 : end, 4:].tobytes())
    stream.payload, stream.timestamps, stream.random_access = b"".join(parts), pts, points
    return stream


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sizes, media, held = [], [], [], 0
        names = ["doc_id", "n_bytes", "media"]
        for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            size = max(PAD, -(-len(text) // PAD) * PAD)
            ids.append(doc_id), sizes.append(len(text)), media.append(mux(text.ljust(size, b"\0")))
            held += size
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=names)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=names)


def encode_texts(docs: DataFrame) -> DataFrame:
    """Media column of whole texts: ``doc_id, n_bytes, media``.

    The UTF-8 text (null: empty) is padded with zero bytes to a positive
    multiple of 64 and multiplexed.  Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "timestamps array<long>, random_access array<struct<pts: long, packet: long>>, continuity_errors int"
)
_DECODED_TYPES = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())])), pa.int32()]
_DECODED_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access", "continuity_errors"]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, size, media in zip(*(b.column(i).to_pylist() for i in range(3))):
            s = demux(media)
            level = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
            feature = f"packets={s.packets};units={len(s.timestamps)};errors={s.continuity_errors};last_pts={s.timestamps[-1]};points={len(s.random_access)};sum={int(level @ np.arange(256))};levels={int((level > 0).sum())}"
            rows.append((doc_id, size, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.timestamps, [{"pts": p, "packet": k} for p, k in s.random_access], s.continuity_errors))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _DECODED_TYPES)], names=_DECODED_NAMES)


def decode_media(media: DataFrame) -> DataFrame:
    """Demultiplex a stored media column; timestamps, random-access points and the number of gaps in the counters come with the digests: a stream with gaps has lost payload."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, DECODED)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Encode, write the media column to the shared folder, read it back and decode it."""
    return decode_media(cut(encode_texts(docs), "media"))
