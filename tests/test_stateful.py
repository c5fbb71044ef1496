from itertools import product

import numpy as np
import pandas as pd
import pytest

from haplospark.operators import stateful as st


def frags(seed, sites=7, reads=20, noise=0.1):
    rng = np.random.default_rng(seed)
    truth = rng.choice([1, -1], sites)
    rows = []
    for r in range(reads):
        at = np.sort(rng.choice(sites, rng.integers(2, min(5, sites) + 1), replace=False))
        side = rng.choice([1, -1])
        for k in at:
            rows.append((0, r, 1000 + 100 * int(k), int(truth[k] * side * (1 if rng.random() > noise else -1)), float(rng.integers(1, 9)) / 4))
    return pd.DataFrame(rows, columns=["w", "read_id", "pos", "allele", "weight"]), truth


@pytest.mark.parametrize("seed", range(5))
def test_exact_against_enumeration_and_greedy(seed):
    f, _ = frags(seed)
    _, m = st._matrix(f)
    x, value, margin = st.solve_exact(m)
    costs = sorted(sum(min(abs(r[r * np.array(y) < 0]).sum(), abs(r[r * np.array(y) > 0]).sum()) for r in m) for y in product((1, -1), repeat=m.shape[1]) if y[0] == 1)
    assert abs(value - costs[0]) < 1e-6 and abs(margin - (costs[1] - costs[0])) < 1e-6
    g, gv = st.solve_greedy(m)
    assert gv >= value - 1e-9
    assert np.allclose(st.cost(m, -x), st.cost(m, x))  # a global flip costs the same


def test_noise_free_reads_give_the_truth():
    f, truth = frags(1, sites=24, reads=120, noise=0)
    got = st.solve_window(f)
    for _, b in got.groupby("block_id"):
        s = b["state"].to_numpy() * truth[(b["pos"].to_numpy() - 1000) // 100]
        assert abs(s.sum()) == len(s)
    assert (got["objective"] == 0).all() and (got["conf"] == 1).all()
    assert st.solve_window(f.sample(frac=1, random_state=0)).equals(got)


def test_signed_sets():
    s = st.SignedSets()
    assert s.union(1, 2, -1) and s.union(2, 3, -1) and s.union(4, 5, 1) and s.union(3, 5, -1)
    assert s.union(1, 3, 1) is False and s.union(1, 3, -1) is None
    rel = {n: s.find(n)[1] for n in range(1, 6)}
    assert rel[1] * rel[2] == -1 and rel[2] * rel[3] == -1 and rel[4] * rel[5] == 1 and rel[3] * rel[5] == -1


def test_conflicted_bridge_component_is_left_alone():
    e = pd.DataFrame([(0, 1, 2, 5.0, 0.0), (0, 2, 3, 5.0, 0.0), (0, 1, 3, 0.0, 5.0), (0, 7, 8, 0.0, 4.0)], columns=["w", "a", "b", "pw", "mw"])
    got = st.two_colour(e).set_index("comp")
    assert got["block"].to_dict() == {1: 1, 2: 2, 3: 3, 7: 7, 8: 7} and got["orientation"][8] == -1
    stitched = st.stitch_components(e).set_index("comp")
    assert set(stitched["block"].loc[[1, 2, 3]]) == {1}


def test_component_split_counts_from_the_chunk_start():
    p = pd.DataFrame({"w": 0, "pos": [0, 100, 200, 1700, 1800, 5000]})
    assert st.split_component(p, max_sites=2, max_span=1500)["piece"].tolist() == [0, 0, 1, 1, 2, 3]


def test_limits_of_the_reference():
    rng = np.random.default_rng(8)
    chain = lambda n: pd.DataFrame([(0, r, 100 * p, int(rng.choice([-1, 1])), float(rng.integers(1, 9))) for r in range(3 * n) for p in (r % (n - 1), r % (n - 1) + 1)], columns=["w", "read_id", "pos", "allele", "weight"])
    f = chain(16)
    got = st.solve_window(f)
    _, m = st._matrix(f)
    masks = np.arange(1 << 15)
    x = np.where(masks[:, None] >> np.arange(15) & 1, -1.0, 1.0)
    c = np.round(st.cost(m, np.c_[np.ones(len(x)), x]), 9)
    assert set(got["solver"]) == {"exact"} and got["objective"].iloc[0] == c.min() and got["margin"].iloc[0] == np.sort(c)[1] - c.min()
    assert set(st.solve_with_priors(f.assign(donor_bias=0.0, top_state=0, margin=0.0, lft=0, rgt=0))["solver"]) == {"exact"}
    assert set(st.solve_window(chain(18))["solver"]) == {"exact"} and set(st.solve_window(chain(19))["solver"]) == {"greedy"}


def test_informative_reads_equal_a_scan_of_all():
    rng = np.random.default_rng(11)
    rows = pd.DataFrame([(0, r, float(rng.integers(-30, 80)) / 10, sorted(rng.choice(9, rng.integers(2, 5), replace=False).tolist())) for r in range(40)], columns=["w", "read_id", "base", "sites"])
    cover, left, want = {}, dict(zip(rows["read_id"], zip(rows["base"], rows["sites"]))), []
    while left and len(want) < 30:
        now = {r: round(b - sum(min(3.0, 0.4 * cover.get(p, 0)) for p in s), 9) for r, (b, s) in left.items()}
        best = min(now, key=lambda r: (-now[r], r))
        want.append((best, now[best]))
        for p in left.pop(best)[1]:
            cover[p] = cover.get(p, 0) + 1
    got = st.informative_reads(rows, most=30)
    assert list(zip(got["read_id"], got["score"])) == want and min(s for _, s in want) < 0  # no stop at 0
    assert len(st.informative_reads(rows)) == 40


def test_priors_against_enumeration():
    """Ends, donor bias, ranker and switches count as stated, wherever the sites lie."""
    for seed in range(6):
        f, _ = frags(seed, sites=6, reads=12, noise=0.3)
        f["pos"] = 7_000_000 + 37 * (f["pos"] // 100)
        rng = np.random.default_rng(seed)
        sites = sorted(f["pos"].unique())
        meta = pd.DataFrame({"pos": sites, "donor_bias": rng.uniform(-2, 2, len(sites)), "top_state": rng.integers(-1, 2, len(sites)), "margin": rng.uniform(-1, 3, len(sites)), "lft": rng.integers(-1, 2, len(sites)), "rgt": rng.integers(-1, 2, len(sites))})
        meta.loc[0, "donor_bias"] = None
        f = f.merge(meta, on="pos")
        _, m = st._matrix(f)
        costs = []
        for x in product((1, -1), repeat=len(sites)):
            c = sum(min(sum(abs(v) for v, y in zip(r, x) if v and np.sign(v) != y), sum(abs(v) for v, y in zip(r, x) if v and np.sign(v) == y)) for r in m)
            for k, s in enumerate(x):
                q = meta.iloc[k]
                if q.donor_bias and q.donor_bias == q.donor_bias and s != np.sign(q.donor_bias):
                    c += 0.05 * min(abs(q.donor_bias), 1)
                if q.top_state and s != q.top_state:
                    c += 0.04 * min(max(q.margin, 0), 2)
            c += 0.75 * (meta["lft"].iloc[0] == -x[0]) + 0.75 * (meta["rgt"].iloc[-1] == -x[-1]) + 0.1 * sum(a != b for a, b in zip(x, x[1:]))
            costs.append((round(c, 9), x))
        costs.sort(key=lambda c: c[0])
        got = st.solve_with_priors(f)
        assert abs(got["margin"].iloc[0] - (costs[1][0] - costs[0][0])) < 1e-6
        assert tuple(got["state"]) in {x for c, x in costs if c == costs[0][0]}
        assert set(st.solve_with_priors(f, exact_sites=2)["solver"]) == {"beam"} and tuple(st.solve_with_priors(f, exact_sites=2)["state"]) in {x for c, x in costs if c == costs[0][0]}


def test_components_solved_apart_equal_the_window():
    f, _ = frags(4, sites=12, reads=9)
    comp = st.components(st.links(f))
    parts = [st.solve_component(g) for _, g in f.merge(comp, on=["w", "pos"]).groupby("comp")]
    assert pd.concat(parts, ignore_index=True).equals(st.solve_window(f))
    m = st._matrix(f)[1]
    x = np.ones(m.shape[1])
    y = st.refine(m, x)
    assert st.cost(m, y)[0] <= st.cost(m, x)[0] and all(st.cost(m, y * np.where(np.arange(len(y)) == k, -1, 1))[0] >= st.cost(m, y)[0] - 1e-9 for k in range(len(y)))


def bridges(rows):
    return pd.DataFrame([(0, a, b, s, p, c, mg, 100.0, gap, *sa, *sb) for a, b, s, p, c, mg, gap, sa, sb in rows], columns=["w", "a", "b", "sign", "prob", "conf", "margin", "total", "gap", "a_s", "a_e", "b_s", "b_e"])


def test_forest_orders_and_caps():
    at = {1: (0, 20_000), 2: (30_000, 31_000), 3: (40_000, 80_000), 4: (90_000, 200_000)}
    edge = lambda a, b, p, s=1: (a, b, s, p, 0.9, 60.0, at[b][0] - at[a][1], at[a], at[b])
    e = bridges([edge(1, 2, 0.999), edge(2, 3, 0.996, -1), edge(1, 3, 0.997), edge(3, 4, 0.998, -1)])
    joined = lambda f: {tuple(sorted(g["comp"])) for _, g in f.groupby("block") if len(g) > 1}
    assert joined(st.bridge_forest(e)) == {(1, 2)}  # 3 and 4 together span more than 150 kb
    assert joined(st.bridge_forest(e, span=10**6)) == {(1, 2), (3, 4)}
    wide = st.utility_forest(e, gain=10_000, degree=2)
    by = {m: g for m, g in wide.groupby("mode")}
    assert joined(by["prob_first"]) == {(1, 2, 3, 4)} and set(by) == {"prob_first", "utility_first", "hybrid"}
    assert by["prob_first"].set_index("comp")["orientation"].to_dict() == {1: 1, 2: 1, 3: 1, 4: -1}
    one = st.utility_forest(e, gain=15_000, degree=1)
    assert joined(one[one["mode"] == "utility_first"]) == {(3, 4)} and joined(st.bridge_forest(e, "hybrid", gain=10**6)) == set()


