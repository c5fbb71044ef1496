import numpy as np
import xxhash

from haplospark.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_fingerprint():
    for t in (b"", b"  \n", b"One", b"one TWO", b"a b c", "É a\tb\x0bc É A b c".encode(), b"x " * 5000):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(20)] + [base]))
    i, j = simhash.GrayIndex(fps).pairs(fps, 0, 2)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["w%d" % i for i in range(50)]
    rows = []
    for i in range(40):
        t = [words[k] for k in rng.integers(0, 50, 60)]
        rows.append((i, " ".join(t), "x", i))
        t[5] = "Zz"
        rows.append((100 + i, " ".join(t), "x", i))
    rows += [(200, None, None, None), (201, "", "y", 1), (202, "one", "y", 1), (203, "ONE", "y", 1), (203, "ONE", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    ids, fps = zip(*{(r[0], brute_fingerprint((r[1] or "").encode())) for r in rows})
    want = brute_components(ids, fps)
    for limit in (20_000, 2):
        got = simhash.near_duplicate_groups(df, bucket_limit=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want[r.doc_id]
            assert int(r.fingerprint, 16) == dict(zip(ids, fps))[r.doc_id]


def test_dense_bucket_over_limit(spark):
    fps = [x for x in range(0, 4000)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.fingerprint_links(df, 2, bucket_limit=500)
    assert links.count() and simhash.connected_components(links).select("label").distinct().count() == 1


def test_empty(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
