import hashlib
import zlib

import numpy as np
import pytest

from haplospark.llm import mpegts


@pytest.mark.parametrize("size", [64, 128, 160, 164, 168, 170, 176, 184, 192, 16_384, 16_448, 16_320, 200_000, 1_000_000])
def test_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    media = mpegts.mux(payload)
    s = mpegts.demux(media)
    assert s.payload == payload and not s.continuity_errors and len(media) == 188 * s.packets
    assert len(s.timestamps) == -(-size // mpegts.UNIT) and s.timestamps[-1] == (len(s.timestamps) - 1) * mpegts.TICKS
    assert len(s.random_access) == -(-len(s.timestamps) // mpegts.GROUP)


def test_all_tails_round_trip():
    for size in range(1, 800):
        assert mpegts.demux(mpegts.mux(bytes(range(256)) * 4)[:0] + mpegts.mux((b"\xff\x00G" * 300)[:size])).payload == (b"\xff\x00G" * 300)[:size]


def test_lost_packet_is_noticed():
    media = mpegts.mux(b"x" * 5000)
    assert mpegts.demux(media[: 188 * 5] + media[188 * 6 :]).continuity_errors == 1


def test_table_checksum():
    media = bytearray(mpegts.mux(b"x" * 64))
    media[20] ^= 1
    with pytest.raises(ValueError):
        mpegts.demux(bytes(media))


def test_query(spark):
    rows = [(1, "abc", "m"), (2, None, "m"), (3, "", None), (4, "é" * 40000, "m"), (4, "é" * 40000, "m"), (None, "x" * 64, "m")]
    got = mpegts.store_and_read(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(got) == 6
    for doc_id, text, _ in rows:
        raw = (text or "").encode()
        pad = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = next(r for r in got if r.doc_id == doc_id)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert mpegts.store_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0
