from math import inf, nan

import numpy as np
import pytest

from haplospark.llm import collisions

SCHEMA = "vec_id long, embedding array<double>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 0) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, every=50, k=5):
    v = np.array(vectors)
    size = np.sqrt((v * v).sum(1))
    out = {}
    for q in range(0, len(v), every):
        s = (v * v[q]).sum(1) / (size * size[q])
        s[q] = -inf
        best = np.lexsort((np.arange(len(v)), -s))[: min(k, len(v) - 1)]
        out[q] = [(int(b), s[b]) for b in best]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, rows in out.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


@pytest.mark.parametrize("block, group", [(8_192, 1_024), (300, 7)])
def test_recall(spark, block, group):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 32))
    v[100:140] = v[50] + 0.05 * rng.standard_normal((40, 32))
    want, got = brute(v), found(collisions.nearest(table(spark, v.tolist()), block=block, group=group))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.97
    scores = {(q, i): s for q, rows in got.items() for i, s in rows}
    size = np.sqrt((v * v).sum(1))
    for (q, i), s in scores.items():
        assert abs(s - v[q] @ v[i] / (size[q] * size[i])) < 1e-12
    assert all(len(rows) == 5 for rows in got.values())


def test_copies_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 8))
    v[::3] = v[0]  # a third of all rows
    got = found(collisions.nearest(table(spark, v.tolist()), block=50, group=3))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and len({s for _, s in got[0]}) == 1
    assert [i for i, _ in got[150]] == [0, 3, 6, 9, 12]


def test_few_and_opposite_vectors(spark):
    v = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]]
    assert [i for i, _ in found(collisions.nearest(table(spark, v)))[0]] == [2, 1]
    assert found(collisions.nearest(table(spark, v[:1]))) == {}
    assert found(collisions.nearest(table(spark, []))) == {}
    assert found(collisions.nearest(table(spark, v, [1, 2, 3]))) == {}


def test_what_takes_no_part(spark):
    v = [[1.0, 2.0], None, [], [0.0, 0.0], [nan, 1.0], [None, 1.0], [inf, 1.0], [1.0], [2.0, 1.0]]
    df = table(spark, v).selectExpr("*", "1 AS row", "2 AS score", "3 AS cell", "4 AS v")
    assert [i for i, _ in found(collisions.nearest(df))[0]] == [8]


def test_null_and_repeated_ids(spark):
    v = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.1], [0.0, 1.0]]
    out = collisions.nearest(table(spark, v, [50, None, 7, 50])).collect()
    first = sorted((r["rank"], r.vec_id) for r in out if r.query_id == 50 and abs(r.score) > 0.5)
    assert (1, 7) in first and (2, None) in first
    assert len(out) == 6  # both rows with id 50, each with the three others


def test_large_and_small_numbers(spark):
    v = [[1e200, 1e200], [1e-200, 2e-200], [1.0, -1.0]]
    got = found(collisions.nearest(table(spark, v)))[0]
    assert [i for i, _ in got] == [1, 2] and abs(got[0][1] - 3 / np.sqrt(10)) < 1e-12


def test_threshold_counts_collisions():
    """A row is verified only after it has collided often enough."""
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((2000, 16))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    index = collisions.SortedProjections(unit)
    low, high = index.windows(unit[:1])
    asked = []
    rows, _ = index.search(low[0], high[0], lambda r: (asked.append(r), unit[r] @ unit[0])[1], 5)
    lo, hi = np.array(index.values).min(), np.array(index.values).max()
    values = index.lines @ unit.T
    last = next(r for r in range(len(collisions.RADII)) if set(np.flatnonzero((np.abs(values - values[:, :1]) <= collisions.HALF_WIDTH * collisions.RADII[r]).sum(0) >= index.threshold)) == set(rows))
    assert len(rows) < len(unit) and lo < hi and last > 0
