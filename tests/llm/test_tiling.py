import random

import numpy as np

from haplospark.llm import tiling


def brute_tiles(item, text, min_match):
    """Longest unmarked match first, by trying all pairs of positions."""
    used_i, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and i + k not in used_i and t + k not in used_t:
                    k += 1
                best = max(best, (k, -i, -t))
        k, i, t = best[0], -best[1], -best[2]
        if k < min_match:
            return total
        used_i |= set(range(i, i + k))
        used_t |= set(range(t, t + k))
        total += k


def test_tiles_against_brute_force():
    r = random.Random(0)
    for _ in range(60):
        item = [r.randrange(1, 8) for _ in range(r.randrange(1, 25))]
        text = [r.randrange(1, 8) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.5 and len(item) > 8:
            text = text[:9] + item[len(item) // 2 :] + text[9:20] + item[: len(item) // 2] + text[20:]
        tiles = tiling.tile(np.array(item, np.uint64), np.array(text, np.uint64), 4)
        marks = [x for i, _, k in tiles for x in range(i, i + k)]
        assert len(marks) == len(set(marks))
        assert all(item[i : i + k] == text[t : t + k] for i, t, k in tiles)
        assert sum(k for *_, k in tiles) == brute_tiles(item, text, min(4, len(item)))


def test_tiles_cover_as_much_as_brute_force():
    r = random.Random(5)
    w = list(range(1, 17))
    cut = w[:6] + [90] + w[4:11] + [91] + w[11:]
    assert sum(k for *_, k in tiling.tile(np.array(w, np.uint64), np.array(cut, np.uint64), 4)) == 16
    for _ in range(150):
        item = [r.randrange(1, 30) for _ in range(r.randrange(8, 40))]
        text = []
        for _ in range(r.randrange(1, 6)):  # pieces of the item that overlap
            a = r.randrange(len(item))
            text += [r.randrange(1, 40), *item[a : a + r.randrange(2, 16)]]
        if r.random() < 0.3:
            item, text = [x % 4 + 1 for x in item], [x % 4 + 1 for x in text]
        tiles = tiling.tile(np.array(item, np.uint64), np.array(text, np.uint64), 4)
        assert sum(k for *_, k in tiles) == brute_tiles(item, text, 4)


def test_contamination(spark):
    r = random.Random(1)
    word = lambda: "w%d" % r.randrange(5000)
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(20, "three short words"), (21, None), (22, ""), (0, "dup of nothing here at all")]
    filler = lambda n: " ".join(word() for _ in range(n))
    whole = items[3][1]
    half = items[4][1].split()
    rows = [
        (1, filler(50) + " " + whole.upper() + ". " + filler(50)),
        (2, " ".join(half[15:]) + " " + filler(20) + " " + " ".join(half[:15])),
        (3, filler(400)), (4, None), (5, ""), (6, " ".join(half[:20])), (7, "say three short words now"), (1, whole), (None, whole),
    ]
    docs = spark.createDataFrame([(*x, "m") for x in rows], "doc_id long, text string, matches string").drop("matches")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 3), (2, 4), (7, 20), (1, 3), (None, 3)], key=repr)
    for block in (16_000_000, 200):
        got = tiling.contaminated(docs, bench, block_chars=block).collect()
        assert sorted(((g.doc_id, g.item_id) for g in got), key=repr) == want
    assert tiling.contaminated(docs.limit(0), bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0
