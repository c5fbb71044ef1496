import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from haplospark.llm import block_dedup, repeats, suffix_dedup


def brute(rows, split, join, length):
    units = [split(t) for _, t in rows]
    counts = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for (d, _), u in zip(rows, units):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if counts[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = [x for x, g in zip(u, gone) if not g]
        out.append((d, len(u), sum(gone), runs, hashlib.sha256(join(kept)).hexdigest()))
    return sorted(out, key=repr)


def as_bytes(t):
    return list((t or "").encode())


def words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w]


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = ["wé%d" % i for i in range(40)]
    text = lambda n: " ".join(vocab[i] for i in rng.integers(0, 40, n))
    shared = [text(40), text(15), text(9)]
    rows = [(i, text(30) + " " + shared[i % 3] + "\n " + text(int(rng.integers(1, 60)))) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, "x"), (105, "ab " * 300), (106, "a" * 500), (None, text(80))]
    rows += [(200 + i, text(3) + " " + shared[0] + " " + text(3)) for i in range(60)]
    return rows


@pytest.mark.parametrize("hot", [4096, 5])
def test_bytes(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, t1 int")
    got = suffix_dedup.removal_report(df, length=40, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, as_bytes, bytes, 40)


@pytest.mark.parametrize("hot", [4096, 5])
def test_words(spark, hot):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, t1 int")
    got = block_dedup.removal_report(df, length=9, hot=hot).collect()
    want = sorted(((d, n, r, h) for d, n, r, _, h in brute(rows, words, b" ".join, 9)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removal_report(df).count() == 0 and block_dedup.removal_report(df).count() == 0


def test_index_decides(spark):
    """Without reference blocks nothing is found; one reference of two is enough."""
    units = np.arange(1, 61, dtype=np.uint64)
    text = [np.concatenate([units[:k], units[10:50], units[:9] + np.uint64(100 + k)]).tobytes() for k in (3, 7)]
    block = repeats.Block(np.zeros(2, np.int64), np.arange(2), np.zeros(2, np.int64), np.zeros(2, np.int64), np.ones(2, np.int64), text)
    spec = block_dedup.spec(20)
    found = {i: np.flatnonzero(x).tolist() for i, x in block_dedup.extend_blocks(block, spec)}
    assert found == {0: list(range(3, 24)), 1: list(range(7, 28))}
    assert not list(block_dedup.extend_blocks(block, spec, lambda aligned: aligned & False))
    half = lambda aligned: aligned & (np.arange(len(aligned)) < 43)  # noqa: E731  those of the first text
    assert {i: np.flatnonzero(x).tolist() for i, x in block_dedup.extend_blocks(block, spec, half)} == found


@pytest.mark.parametrize("at_once", [1 << 18, 7])
def test_suffix_buckets_and_cover_ranks(at_once):
    """Windows of a block that tie, at all residues and one bucket at a time."""
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 101, 90).tolist())
    content = [bytes(rng.integers(97, 101, int(n)).tolist()) + shared[k % 5 :] + b"ab" * int(n) for k, n in enumerate(rng.integers(0, 40, 30))]
    n = len(content)
    block = repeats.Block(np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), content)
    for length in (20, 41, 60):
        seen = Counter(c[i : i + length] for c in content for i in range(len(c) - length + 1))
        want = {k: w for k, c in enumerate(content) if any(w := [seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)])}
        got = {k: m.tolist() for k, m in suffix_dedup.sort_block(block, suffix_dedup.spec(length), at_once=at_once) if len(content[k]) >= length}
        assert got == want


def test_difference_cover():
    for v in (2, 8, 13, 32, 64):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v))


def test_cut_text_keeps_characters():
    t = "aéü b".encode()
    assert suffix_dedup.cut_text(t, [(2, 4)]) == "aéü b"
    assert suffix_dedup.cut_text(t, [(1, 5)]) == "a b"
