"""Region operators on small hand-made tables; expected numbers are worked out by hand or by enumeration."""

from itertools import product

import numpy as np
import pandas as pd

from haplospark.operators import regions as rg

OBS = "w long, read_id long, pos long, allele int, baseq long, mapq long, amb int, delta double, conf double, w2 double, idx long"


def observations(spark, rows, **fixed):
    """Rows (read, pos, allele[, weight])."""
    of = {"baseq": 20, "mapq": 60, "amb": 0, "delta": 1.0, "conf": 0.5} | fixed
    return spark.createDataFrame([(0, r[0], r[1], r[2], of["baseq"], of["mapq"], of["amb"], of["delta"], of["conf"], float(r[3]) if len(r) > 3 else None, i) for i, r in enumerate(rows)], OBS)


def calls(spark, states, block="b1", conf=0.8):
    return spark.createDataFrame([(0, p, block, s, conf) for p, s in states.items()], "w long, pos long, block_id string, state int, conf double")


def scores(spark, rows):
    return spark.createDataFrame([(0, p, c, s, x) for p, c, s, x in rows], "w long, pos long, cand string, cstate int, score double")


def regions(spark, *sites):
    return spark.createDataFrame([(0, i + 1, list(s), s[0], s[-1], None, None, None, None) for i, s in enumerate(sites)], "w long, region_id long, ps array<long>, first long, last long, left_anchor_pos long, left_anchor_state int, right_anchor_pos long, right_anchor_state int")


def wanting(*sites):
    """Scores by which each site is a candidate."""
    return [x for p in sites for x in ((p, "A", 1, 0.9), (p, "B", -1, 0.1), (p, "ABSTAIN", 0, 0.0))]


def test_interleaved_components_a_bridge_and_a_singleton(spark):
    # reads 1, 2 join 100-300-500 through 300, which is no candidate; read 3 joins 200-400 between them; 900 is in no read
    obs = observations(spark, [(1, 100, 1), (1, 300, 1), (2, 300, 1), (2, 500, 1), (3, 200, 1), (3, 400, -1), (4, 700, 1)])
    local = {p: -1 for p in (100, 200, 300, 400, 500, 700, 900)}
    local[300] = 1  # the ranker agrees there, with a small lead
    sc = scores(spark, [*wanting(100, 200, 400, 500, 700, 900), (300, "A", 1, 0.50), (300, "B", -1, 0.49)])
    anchors = calls(spark, {50: 1, 250: -1, 450: 0, 600: 1, 1000: -1})
    found = rg.connectivity_regions(obs, sc, calls(spark, local), anchors).orderBy("region_id").collect()
    assert [(r.region_id, list(r.ps)) for r in found] == [(1, [100, 500]), (2, [200, 400]), (3, [700]), (4, [900])]
    assert [(r.left_anchor_pos, r.left_anchor_state, r.right_anchor_pos, r.right_anchor_state) for r in found] == [(50, 1, 600, 1), (50, 1, 600, 1), (600, 1, 1000, -1), (600, 1, 1000, -1)]


def test_gaps_limits_and_unclean_observations_cut_links(spark):
    sc, none = scores(spark, wanting(100, 200, 300, 9000)), calls(spark, {})
    obs = observations(spark, [(1, 100, 1), (1, 200, 1), (1, 300, 1), (1, 9000, 1)])
    sites = lambda df: [list(r.ps) for r in df.orderBy("region_id").collect()]
    assert sites(rg.connectivity_regions(obs, sc, none, none)) == [[100, 200, 300, 9000]]
    assert sites(rg.connectivity_regions(obs, sc, none, none, max_gap=500)) == [[100, 200, 300], [9000]]
    assert sites(rg.connectivity_regions(obs, sc, none, none, max_sites=2)) == [[100, 200], [300, 9000]]
    assert sites(rg.connectivity_regions(obs, sc, none, none, max_span=150)) == [[100, 200], [300], [9000]]
    weak = observations(spark, [(1, 100, 1), (1, 200, 1)], conf=0.0, delta=0.1)
    assert sites(rg.connectivity_regions(weak, sc, none, none))[:2] == [[100], [200]]
    assert rg.connectivity_regions(obs.limit(0), sc.limit(0), none, none).collect() == []


def test_split_counts_from_the_start_of_each_component(spark):
    df = spark.createDataFrame([(0, c, p) for c, p in ((1, 0), (1, 60), (1, 101), (1, 102), (1, 150), (2, 10), (2, 20))], "w long, comp long, pos long")
    got = {(r.comp, r.pos): r.piece for r in rg.split_runs(df, ["w", "comp"], 3, 100).collect()}
    assert got == {(1, 0): 0, (1, 60): 0, (1, 101): 1, (1, 102): 1, (1, 150): 1, (2, 10): 0, (2, 20): 0}


def test_two_agreeing_sites_merge():
    read = lambda *x: {p: (a, wt) for p, a, wt in x}
    a = read((1, 1, 2.0), (2, 1, 2.0))
    assert [n for n, _ in rg.merge_reads([a, a])] == [2]  # 2 * 3.476 = 6.952 > 6
    assert [n for n, _ in rg.merge_reads([a, read((1, 1, 1.0))])] == [1, 1]  # one shared site
    assert [n for n, _ in rg.merge_reads([a, read((1, 1, 1.0), (2, -1, 1.0))])] == [1, 1]  # odds 0
    three = read((1, 1, 2.0), (2, 1, 2.0), (3, 1, 2.0), (4, 1, 5.0))
    (n, held), = rg.merge_reads([three, read((1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, -1, 3.0))])  # 3 - 1 = 2 sites
    assert n == 2 and held == {1: (1, 3.0), 2: (1, 3.0), 3: (1, 3.0), 4: (1, 2.0)}
    (_, held), = rg.merge_reads([read((1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)), read((1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, -1, 4.0))])
    assert held[4] == (-1, 3.0)
    (_, held), = rg.merge_reads([read((1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 1.0)), read((1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, -1, 1.0))])
    assert held[4] == (1, 0.01)


def brute_merge(reads):
    """Every cluster is compared with every read."""
    clusters = []
    for mine in reads:
        best, top = None, 6.0
        for c in clusters:
            shared = mine.keys() & c.keys()
            odds = sum(1 if mine[p][0] == c[p][0] else -1 for p in shared) * rg.AGREE
            if len(shared) >= 2 and odds > top:
                best, top = c, odds
        if best is None:
            clusters.append(best := {})
        for p, (a, wt) in mine.items():
            if p not in best:
                best[p] = (a, wt)
            elif best[p][0] == a:
                best[p] = (a, best[p][1] + wt)
            else:
                best[p] = max(((a, wt), best[p]), key=lambda x: (x[1], x == best[p]))[0], max(0.01, abs(wt - best[p][1]))
    return clusters


def test_merge_equals_comparing_all_clusters():
    rng = np.random.default_rng(3)
    for _ in range(50):
        reads = [{int(p): (int(rng.choice([1, -1], p=[0.85, 0.15])), float(rng.integers(1, 9))) for p in rng.choice(8, rng.integers(1, 6), replace=False)} for _ in range(20)]
        assert [c for _, c in rg.merge_reads(reads)] == brute_merge(reads)


def scan(reads, depth, most):
    cover, out = {}, []
    for r, sites in reads:
        if len(out) < most and any(cover.get(p, 0) < depth for p in sites):
            out.append(r)
            for p in sites:
                cover[p] = cover.get(p, 0) + 1
    return out


def test_greedy_cover_equals_a_scan_in_order(spark):
    rng = np.random.default_rng(5)
    for depth, most in ((1, 1000), (3, 1000), (3, 11), (40, 1000)):
        reads = [(int(r), sorted(rng.choice(12, rng.integers(1, 5), replace=False).tolist())) for r in rng.permutation(60)]
        rows = spark.createDataFrame([(0, r, p, i) for i, (r, sites) in enumerate(reads) for p in sites], "w long, read_id long, pos long, i long")
        got = rg.cover_greedily(rows, ["w"], [rows["i"].asc()], depth, most).orderBy("rank").collect()
        assert [r.read_id for r in got] == scan(reads, depth, most) and [r["rank"] for r in got] == list(range(len(got)))


def test_bundle_score_and_superreads(spark):
    sites = spark.createDataFrame([(0, p) for p in range(100, 1000, 100)], "w long, pos long")
    obs = observations(spark, [(1, 100, 1), (1, 200, 1), (1, 300, 1), (2, 300, 1), (2, 400, -1), (2, 500, 1), (3, 300, -1), (3, 400, -1), (3, 500, 1), (4, 100, 1), (4, 950, 1), (5, 500, 1), (5, 600, 1), (5, 700, 1), (5, 800, 1)])
    got = {r.read_id: (r.n, r.score) for r in rg.coverage_selection(obs, sites).collect()}
    # 3 (n - 1) + n + 0.25 n (0.5 + 0.5 * 20/40 * 60/60); read 4 has one site only
    assert got == {1: (3, 9.5625), 2: (3, 9.5625), 3: (3, 9.5625), 5: (4, 13.75)}
    merged = {r.read_id: r.superread for r in rg.superread_merge(obs, sites).collect()}
    # in order 5, 1, 2, 3: 1 shares no site with 5; 2 fits 5 first (500); 3 contradicts neither 400 nor 500, but 300 of the first
    assert merged == {5: 0, 1: 1, 2: 0, 3: 2}


def test_superread_keeps_the_best_observation(spark):
    rows = [(0, 1, 100, 1, 20, 60), (0, 1, 200, 1, 20, 60), (0, 1, 300, 1, 20, 60), (0, 2, 300, 1, 40, 60), (0, 2, 400, -1, 5, 10), (0, 2, 500, 1, 20, 60), (0, 2, 500, -1, 21, 60)]
    obs = spark.createDataFrame([(*r, 0, 1.0, 0.5, None, i) for i, r in enumerate(rows)], OBS)
    out = rg.superread_merge(obs, obs.select("w", "pos")).collect()
    assert {(r.pos, r.allele, r.quality) for r in out} == {(100, 1, 80), (200, 1, 80), (300, 1, 100), (400, -1, 15), (500, -1, 81)}
    assert {r.superread for r in out} == {0}


def test_scaffold_fragments(spark):
    sc = calls(spark, {100: 1, 200: -1}, "x", 0.5).union(calls(spark, {300: 1}, "y", 1.5)).union(calls(spark, {400: 0}, "y", 1.0))
    got = {(r.fragment, r.pos, r.allele, r.weight) for r in rg.scaffold_fragments(regions(spark, [100, 200, 300, 400], [900]), sc).collect()}
    assert got == {("SCAFFOLD::x", 100, 1, 4.0), ("SCAFFOLD::x", 200, -1, 4.0), ("SCAFFOLD::y", 300, 1, 6.0), ("SCAFFOLD::DIRECT", 100, 1, 2.0), ("SCAFFOLD::DIRECT", 200, -1, 2.0), ("SCAFFOLD::DIRECT", 300, 1, 4.5)}


def fragment_cost(own, state, sign):
    return min(sum(wt for p, r, a, wt in own if state[p] and a != h * state[p] * sign[r]) for h in (1, -1))


def test_orientation_equals_enumeration(spark):
    rng = np.random.default_rng(8)
    for trial in range(4):
        sites = {p: p // 300 + 1 for p in range(0, 1500, 100)}
        state = {p: int(rng.choice([1, -1])) for p in sites}
        rows = [(r, p, int(rng.choice([1, -1])), float(rng.integers(1, 30)) / 10) for r in range(25) for p in sorted(rng.choice(list(sites), 4, replace=False).tolist())]
        bias = {p: float(rng.integers(-9, 10)) / 10 for p in sites}
        local = {p: int(rng.choice([1, -1, 0])) for p in sites}
        solved = spark.createDataFrame([(0, r, p, state[p], 0, bias[p]) for p, r in sites.items()], "w long, region_id long, pos long, state int, anchor_ok int, donor_bias double")
        got = {r.region_id: r for r in rg.orient_regions(observations(spark, rows), regions(spark, *[[p for p in sites if sites[p] == r] for r in range(1, 6)]), solved, calls(spark, local)).collect()}
        reads = {}
        for r, p, a, wt in rows:
            reads.setdefault(r, []).append((p, sites[p], a, wt))

        def cost(signs):
            sign = dict(zip(range(1, 6), signs))
            own = sum(0.25 * sum(bool(local[p]) and state[p] * sign[r] != local[p] for p in sites if sites[p] == r) - sign[r] * np.mean([bias[p] for p in sites if sites[p] == r]) for r in sign)
            pairs = 0.0
            for obs in reads.values():
                order = sorted({x[1] for x in obs})
                pairs += sum(fragment_cost([x for x in obs if x[1] in (a, b)], state, sign) for a, b in zip(order, order[1:]) if b == a + 1)
            return own + pairs

        best = min(cost(s) for s in product((1, -1), repeat=5))
        assert abs(cost([got[r].raw for r in range(1, 6)]) - best) < 1e-6


def test_weak_flip_without_a_bridge_goes_back(spark):
    solved = spark.createDataFrame([(0, 1, 100, 1, 0, -0.2), (0, 2, 200, 1, 0, -0.6)], "w long, region_id long, pos long, state int, anchor_ok int, donor_bias double")
    out = {r.region_id: (r.orientation, r.raw, r.margin) for r in rg.orient_regions(observations(spark, [(1, 100, 1)]), regions(spark, [100], [200]), solved, calls(spark, {})).collect()}
    assert out == {1: (1, -1, 0.4), 2: (-1, -1, 1.2)}
    joined = {r.region_id: r.orientation for r in rg.orient_regions(observations(spark, [(1, 100, 1), (1, 200, 1)]), regions(spark, [100], [200]), solved, calls(spark, {})).collect()}
    assert joined == {1: -1, 2: -1}


def test_anchors_and_their_agreement(spark):
    reg = spark.createDataFrame([(0, 1, [100, 200], 100, 200, 50, -1, 300, -1)], "w long, region_id long, ps array<long>, first long, last long, left_anchor_pos long, left_anchor_state int, right_anchor_pos long, right_anchor_state int")
    solved = lambda ok: spark.createDataFrame([(0, 1, 100, 1, ok, 0.0), (0, 1, 200, 1, ok, 0.0)], "w long, region_id long, pos long, state int, anchor_ok int, donor_bias double")
    none = calls(spark, {100: 1, 200: -1})  # 0.25 for either sign
    first = rg.orient_regions(observations(spark, []), reg, solved(0), none).first()
    assert (first.orientation, first.margin) == (-1, 5.0)
    assert rg.orient_regions(observations(spark, []), reg, solved(1), none).first().margin == 2.5  # the flip pays 2.5 * 2 / 2


def test_resolve_equals_enumeration():
    rng = np.random.default_rng(9)
    for n in (1, 3, 8):
        for _ in range(10):
            sites = [(rng.choice([1.0, -1.0, 0.0], int(rng.integers(1, 4)), replace=False), rng.integers(0, 100, 3) / 100) for _ in range(n)]
            sites = [(s, x[: len(s)]) for s, x in sites]
            link = np.tril(rng.integers(-20, 20, (n, n)) / 10)
            totals = {}
            for picks in product(*[range(len(s)) for s, _ in sites]):
                v = [s[i] for (s, _), i in zip(sites, picks)]
                totals[picks] = round(sum(x[i] for (_, x), i in zip(sites, picks)) + 0.35 * sum(link[j, i] * v[i] * v[j] for j in range(n) for i in range(j + 1)), 9)
            picks, score, margin = rg.solve_region(sites, link)
            ranked = sorted(totals.values(), reverse=True)
            assert totals[tuple(picks)] == ranked[0] == score
            assert abs(margin - (ranked[0] - ranked[1] if len(ranked) > 1 else 0.0)) < 1e-9


def test_beam_beyond_eight_sites():
    sites = [(np.array([1.0, -1.0]), np.array([0.1, 0.0]))] * 12
    link = np.tril(np.ones((12, 12)), -1)
    link[6:, :6] *= -1
    picks, score, _ = rg.solve_region(sites, link)
    assert [1 - 2 * p for p in picks] in ([1] * 6 + [-1] * 6, [-1] * 6 + [1] * 6)
    assert abs(score - (0.6 + 0.35 * 66)) < 1e-9


def test_resolve_reads_inside_the_region(spark):
    # the scores prefer +1 at both sites; two reads say that they differ: 0.35 * 2 * 1.0 each way
    sc = scores(spark, [(100, "A", 1, 0.6), (100, "B", -1, 0.1), (200, "A", 1, 0.5), (200, "B", -1, 0.4), (200, "ABSTAIN", 0, 0.3)])
    obs = observations(spark, [(1, 100, 1, 1.0), (1, 200, -1, 1.0), (2, 100, -1, 1.0), (2, 200, 1, 2.0), (3, 900, 1, 1.0)])
    out = {r.pos: (r.state, r.score, r.margin) for r in rg.resolve_regions(obs, sc, regions(spark, [100, 200]), calls(spark, {})).collect()}
    # best +1 -1: 0.6 + 0.4 + 0.7; next +1 and abstain: 0.6 + 0.3 - 0.05, or -1 +1: 0.1 + 0.5 + 0.7
    assert out == {100: (1, 1.7, 0.4), 200: (-1, 1.7, 0.4)}
    # a scaffold fragment over both sites, half as much again: 1.5 * min(4, 4) * 0.35 against the reads, and twice (block and all: 2.4)
    out = {r.pos: r.state for r in rg.resolve_regions(obs, sc, regions(spark, [100, 200]), calls(spark, {100: 1, 200: 1})).collect()}
    assert out == {100: 1, 200: 1}


def test_only_the_two_best_states_and_the_abstention_are_options(spark):
    sc = scores(spark, [(100, "A", 1, 0.6), (100, "B", -1, 0.5), (100, "C", 1, 0.4), (100, "Z", 0, 0.9), (100, "Y", 0, 0.2)])
    got = [(r.cand, r.worth) for r in rg.region_options(sc, regions(spark, [100])).orderBy("option").collect()]
    assert got == [("A", 0.6), ("B", 0.5), ("Y", 0.15)]


def test_weights_between_regions(spark):
    obs = spark.createDataFrame([(0, 1, 1, 1, 20, 60, 0, 1.0, c, wt, 1) for c, wt in ((0.5, 9.0), (0.5, None), (0.0, None), (None, None), (0.5, 0.01))], OBS)
    assert [round(r[0], 6) for r in obs.select(rg.read_weight()).collect()] == [6.0, 4.0, 1.0, 2.0, 0.05]
