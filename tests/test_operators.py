import os

import duckdb
import pandas as pd
import pytest

from haplospark.operators import scaffolds
from haplospark.plans import stateful
from haplospark.plans.fixtures import sql_queries
from haplospark.plans.operator import REGISTRY, render

SF = "/root/testdata/sf0.001"
QUERIES, SQL = sql_queries()


def norm(x: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(x.columns)
    x = x[cols].copy()
    for c in cols:
        if x[c].dtype.kind in "fiu":
            x[c] = x[c].astype(float).round(5)
        x[c] = x[c].map(lambda v: "NULL" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else repr(v))
    return x.sort_values(cols).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = norm(QUERIES[name](spark, SF).toPandas()), norm(con.execute(SQL[name]).df())
    assert len(got) and got.equals(want)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_blocks_hold_across_sign_changes(spark):
    calls = frame(spark, [(0, p, "b", s, 1.0) for p, s in [(1, 1), (2, -1), (3, 0), (4, 1), (5, 0), (6, 0), (7, -1)]], "w long, pos long, block_id string, state int, conf double")
    got = {r.pos: r.block for r in REGISTRY["E1_blockify"].run(spark, {"calls": calls}).collect()}
    assert got == {1: 1, 2: 1, 4: 2, 7: 3}
    none = calls.where("state = 0")
    assert REGISTRY["E1_blockify"].run(spark, {"calls": none}).count() == 0


def test_hamming_flips_only_if_better_and_counts_switches(spark):
    rows = [(0, p, "b1", s, t) for p, s, t in [(1, 1, 1), (2, 1, -1), (3, -1, 1), (4, 1, -1), (5, 1, None)]] + [(0, 9, "b2", 1, -1), (0, 10, "b2", 1, 1)]
    got = {r.block_id: r for r in REGISTRY["D31b_block_metrics"].run(spark, {"cmp": frame(spark, rows, "w long, pos long, block_id string, state int, tstate int")}).collect()}
    assert (got["b1"].polarity, got["b1"].hamming, got["b1"].switches, got["b1"].n) == (-1, 1, 1, 4)
    assert (got["b2"].polarity, got["b2"].hamming) == (1, 1)


def test_nearest_counts_equal_side_and_limit(spark):
    fills = frame(spark, [(0, 1000, "b")], "w long, pos long, block_id string")
    calls = frame(spark, [(0, p, "b", 1, 1.0) for p in (400, 600, 900, 1000, 1100, 1499, 1501)], "w long, pos long, block_id string, state int, conf double")
    got = REGISTRY["C4_nearest_each_side"].run(spark, {"fills": fills, "calls": calls}, width=500, k=2).collect()
    assert sorted((r.side, r.rn, r.apos) for r in got) == [("L", 1, 900), ("L", 2, 600), ("R", 1, 1000), ("R", 2, 1100)]


def test_gate_reasons(spark):
    calls = frame(spark, [(0, p, "b", 0, 1.0) for p in (1, 2, 3, 4)], "w long, pos long, block_id string, state int, conf double")
    fills = frame(spark, [(0, 1, 1, 0.9), (0, 2, 1, 0.1), (0, 3, 1, None)], "w long, pos long, pred int, prob double")
    got = {r.pos: (r.state, r.reason) for r in REGISTRY["B12_probability_gate"].run(spark, {"calls": calls, "gated": fills}).collect()}
    assert got == {1: (1, "kept"), 2: (0, "below_threshold"), 3: (0, "no_oof_prediction"), 4: (0, "not_filled")}


def test_stitch_follows_the_decisions(spark):
    blocks = frame(spark, [(5, f"k{i}", 7_000_000 + 900 * i, 7_000_500 + 900 * i, 3) for i in range(6)], "w long, block_id string, s long, e long, n long")
    said = frame(spark, [(5, "k0", "k1", "Flip"), (5, "k1", "k2", "Join"), (5, "k2", "k3", "Abstain"), (5, "k3", "k4", "Flip"), (6, "k4", "k5", "Join")], "w long, a string, b string, decision string")
    got = {r.block_id: (r.seg, r.orientation, r.source) for r in REGISTRY["I14_stitch"].run(spark, {"blocks": blocks, "decisions": said}).collect()}
    assert got == {"k0": (1, 1, "seed"), "k1": (1, -1, "flip"), "k2": (1, -1, "join"), "k3": (2, 1, "reseed_after_abstain"), "k4": (2, -1, "flip"), "k5": (3, 1, "reseed_after_abstain")}
    calls = frame(spark, [(5, 7_000_950, "k1", 1, 0.9), (5, 7_000_700, "x", 1, 0.9), (5, 7_003_700, "k4", -1, 0.5)], "w long, pos long, block_id string, state int, conf double")
    out = {r.pos: (r.stitched, r.block_id) for r in REGISTRY["I15_project"].run(spark, {"blocks": blocks, "decisions": said, "calls": calls}).collect()}
    assert out == {7_000_950: (-1, "k1"), 7_000_700: (0, "unassigned"), 7_003_700: (1, "k4")}


def test_donor_bias_is_an_input(spark):
    sites = frame(spark, [(1, p, 0, "A", "C") for p in (5, 77, 900_001)], "w long, pos long, i long, ref string, alt string")
    obs = frame(spark, [(1, r, p, a, 40, 60, 0, 0.0, 0.0, None) for r, p, a in [(1, 5, 1), (1, 77, -1), (2, 5, 1), (2, 77, 1)]], "w long, read_id long, pos long, allele int, baseq long, mapq long, amb int, delta double, conf double, w2 double")
    bias = frame(spark, [(1, 900_001, -0.6), (1, 77, 0.9)], "w long, pos long, bias double")
    got = {r.pos: (r.state, r.conf) for r in REGISTRY["D4_read_donor_combine"].run(spark, {"sites": sites, "obs": obs, "bias": bias}).collect()}
    assert got == {5: (1, 1.0), 77: (1, 0.5), 900_001: (-1, 0.3)}


def test_panel_is_found_by_its_sites(spark):
    """Positions and panel columns are what the table of panel sites says."""
    calls = frame(spark, [(1, 123_457, "b", 1, 1.0), (1, 123_999, "b", -1, 1.0), (1, 5, "b", 1, 1.0)], "w long, pos long, block_id string, state int, conf double")
    psites = frame(spark, [(123_457, 40), (123_999, 7)], "pos long, k int")
    panel = frame(spark, [(h, h // 2, h % 2, "g9", k, 1 if (h + k) % 2 else -1) for h in range(4) for k in (7, 40)], "hap long, donor long, hap_id long, grp string, k int, allele int")
    got = {r.hap: (r.n, r.matched) for r in REGISTRY["I1_donor_score"].run(spark, {"calls": calls, "psites": psites, "panel": panel, "ancestry": frame(spark, [], "grp string, weight double")}).collect()}
    assert got == {0: (2, 0), 1: (2, 2), 2: (2, 0), 3: (2, 2)}
    fills = frame(spark, [(1, 123_999, "b")], "w long, pos long, block_id string")
    row = REGISTRY["D9_panel_ld_vote"].run(spark, {"calls": calls.where("pos <> 123457").union(frame(spark, [(1, 123_800, "b", 1, 1.0)], "w long, pos long, block_id string, state int, conf double")), "fills": fills, "psites": psites.union(frame(spark, [(123_800, 40)], "pos long, k int")), "panel": panel}, min_samples=1).collect()
    assert len(row) == 1 and (row[0].haps, row[0].samples, row[0].anchors) == (4, 2, 1) and row[0].plus == 0 and abs(row[0].minus - 4 / (1 + 199 / 5000)) < 1e-6


def test_wide_intervals_meet_their_positions(spark):
    sites = frame(spark, [(0, p, 0, "A", "C") for p in (10, 5_500, 99_000, 120_000)], "w long, pos long, i long, ref string, alt string")
    blocks = frame(spark, [(0, "a", 5, 100_000, 2), (0, "b", 5_500, 5_500, 1)], "w long, block_id string, s long, e long, n long")
    got = sorted((r.pos, r.block_id) for r in REGISTRY["C3_position_to_block"].run(spark, {"sites": sites, "blocks": blocks}).collect())
    assert got == [(10, "a"), (5_500, "a"), (5_500, "b"), (99_000, "a")]


def test_modes_are_merged_from_two_tables(spark):
    shape = "w long, pos long, block_id string, pred int, prob double"
    fills = frame(spark, [(0, 1, "b", 1, 0.9), (0, 2, "b", 1, 0.9), (0, 3, "b", 1, 0.2)], shape)
    other = frame(spark, [(0, 2, "b", -1, 0.8), (0, 3, "b", -1, 0.6)], shape)
    assert sorted(map(tuple, REGISTRY["I43_mode_merge"].run(spark, {"fills": fills, "hmmfills": other}).collect())) == [(0, 1, 1, "pbwt"), (0, 2, -1, "hmm")]


def test_boundary_evidence_by_hand(spark):
    """Two blocks of 4 sites with confidence 0.8: support 3.2, all terms by hand."""
    def calls(second):
        return frame(spark, [(0, 10 * b + i, f"b{b}", s, 0.8) for b, s in ((1, 1), (2, second)) for i in range(4)] + [(0, 99, "unassigned", 0, 0.0)], "w long, pos long, block_id string, state int, conf double")

    own = 0.22 + 0.18 * 0.8 + 0.16 + 0.16 * 0.8 + 0.18 + 0.10  # bias 1, 3.2 / 4, 4 / 4, 0.8, coherence 1, nothing abstained
    row = REGISTRY["I12_boundary_evidence"].run(spark, {"calls": calls(1)}).first()
    assert abs(row.rel - own) < 1e-6 and abs(row.same - (own + 0.5 * (1 - own))) < 1e-6 and abs(row.flip - 0.5 * (1 - own)) < 1e-6
    row = REGISTRY["I12_boundary_evidence"].run(spark, {"calls": calls(-1)}).first()
    assert abs(row.flip - (own + 0.5 * (1 - own))) < 1e-6 and abs(row.same - 0.5 * (1 - own)) < 1e-6
    said = lambda x, **p: tuple(REGISTRY["I13_boundary_decision"].run(spark, {"calls": calls(x)}, **p).first())[3:5]
    assert said(1) == ("Join", "same") and said(-1) == ("Abstain", "flip_suppressed_no_flip_ablation")
    assert said(1, min_inf=5) == ("Abstain", "insufficient_informative_sites") and said(1, min_conf=0.95) == ("Abstain", "low_confidence")


def test_weak_blocks_stay_close(spark):
    """One block with bias (0.9 - 0.6) / 1.5 = 0.2 and an abstained site, one of a single site."""
    rows = [(0, 1, "b1", 1, 0.9), (0, 2, "b1", -1, 0.6), (0, 3, "b1", 0, 0.0), (0, 7, "b2", 1, 0.5)]
    row = REGISTRY["I12_boundary_evidence"].run(spark, {"calls": frame(spark, rows, "w long, pos long, block_id string, state int, conf double")}).first()
    left = 0.22 * 0.2 + 0.18 * 1.5 / 4 + 0.16 * 2 / 4 + 0.16 * 0.75 + 0.18 * 0.2 + 0.10 * 2 / 3
    right = 0.22 + 0.18 * 0.5 / 4 + 0.16 / 4 + 0.16 * 0.5 + 0.18 + 0.10
    rel = (left * right) ** 0.5
    assert abs(row.rel - rel) < 1e-6 and abs(row.same - (rel * 0.2 + 0.5 * (1 - rel))) < 1e-6


def test_base_score_by_hand(spark):
    shape = "w long, read_id long, pos long, allele int, amb int, w2 double"
    rows = [(0, 1, 100, 1, 0, 0.8), (0, 1, 100, -1, 1, None), (0, 1, 600, 1, 0, 0.4), (0, 1, 700, 0, 1, 1.2), (0, 2, 100, 1, 0, 1.0)]
    got = REGISTRY["I11_informative_base_score"].run(spark, {"obs": frame(spark, rows, shape)}).collect()
    # 2 sites over 500 bases, 4 observations of mean weight 0.6, two of them ambiguous; read 2 has one site
    assert [(r.read_id, r.n, r.score) for r in got] == [(1, 2, 4 + 0.002 * 500 + 2 + 0.25 * 0.6 * 4 - 1.0)]


def test_all_starts_of_a_window_are_seen(spark):
    man = frame(spark, [(0, 1000, 13_501)], "w long, s long, e long")
    obs = frame(spark, [(0, 1, 13_200), (0, 1, 1_500)], "w long, read_id long, pos long")
    truth = frame(spark, [(0, 13_200)], "w long, pos long")
    got = sorted((r.start, r.variants, r.truth) for r in REGISTRY["D40_window_statistics"].run(spark, {"manifest": man, "obs": obs, "truth": truth}).collect())
    assert got == [(1000, 1, 0), (12_000, 1, 1), (13_000, 1, 1)]


def test_neighbours_use_all_sites_up_to_the_centre(spark):
    calls = frame(spark, [(0, p, "b", 1, 1.0) for p in (10, 20, 90_000)], "w long, pos long, block_id string, state int, conf double")
    psites = frame(spark, [(10, 0), (20, 1), (90_000, 2)], "pos long, k int")
    words = {0: "110", 1: "010", 2: "100", 3: "001"}
    panel = frame(spark, [(h, k, 1 if x == "1" else -1) for h, word in words.items() for k, x in enumerate(word)], "hap long, k int, allele int")
    got = lambda c: {(r.hap, r.dist) for r in REGISTRY["I36_neighbour_retrieval"].run(spark, {"calls": calls, "psites": psites, "panel": panel, "centres": frame(spark, [(0, c)], "w long, centre long"), "seeds": frame(spark, [(0, 1)], "w long, hap long")}, radius=1).collect()}
    # at 20 the words are read from site 20 back: 3 "00", 2 "01", 1 "10", 0 "11"; at 90,000: 2 "001", 1 "010", 0 "011", 3 "100"
    assert got(20) == {(2, 1), (0, 1)} and got(95_000) == {(2, 1), (0, 1)}
    assert got(10) == {(3, 1)}  # by site 10 alone: 1, 3, 0, 2; ties by haplotype


def test_population_prior_by_hand(spark):
    """Two populations over one anchor: the one whose haplotypes are known there gets the larger prior."""
    fills = frame(spark, [(0, 2_000)], "w long, pos long")
    calls = frame(spark, [(0, 1_000, "b", 1, 1.0), (0, 90_000, "b", 1, 1.0)], "w long, pos long, block_id string, state int, conf double")
    cm = frame(spark, [(1_000, 0.0), (2_000, 0.1), (90_000, 9.0)], "pos long, cm double")
    psites = frame(spark, [(1_000, 0), (2_000, 1), (90_000, 2)], "pos long, k int")
    alleles = {0: ("e", 1, 1), 1: ("e", 1, 1), 2: ("f", 1, -1), 3: ("f", 0, -1)}  # population, anchor, open site
    panel = frame(spark, [(h, h, 0, g, k, x) for h, (g, *xs) in alleles.items() for k, x in enumerate(xs)], "hap long, donor long, hap_id long, grp string, k int, allele int")
    row = REGISTRY["D16_ancestry_features"].run(spark, {"fills": fills, "calls": calls, "sitecm": cm, "psites": psites, "panel": panel}).first()
    import math

    wt = math.exp(-0.1 / 0.05)  # the anchor 9 centimorgans away is too far
    e, f = 1 / 1.5, 0.5 / 1.5  # shares wt * 2 / 2 and wt * 1 / 2
    assert abs(row.plus - 2 * wt * e) < 1e-6 and abs(row.minus - wt * f) < 1e-6 and abs(row.top_prior - e) < 1e-6
    conf = 2 * e / (2 * e + f)
    assert abs(row.confidence - conf) < 1e-6 and abs(row.plain_confidence - 2 / 3) < 1e-6 and abs(row.delta - (conf - 2 / 3)) < 1e-6
    assert abs(row.entropy + e * math.log(e) + f * math.log(f)) < 1e-6 and abs(row.effective - 1 / (e * e + f * f)) < 1e-6 and row.pops == 2


def test_every_gate_of_the_ladder(spark):
    shape = "w long, pos long, cand string, cstate int, score double, state int, anchor_agreement double, switch_risk int, donor_bias double, donor_entropy double, nearest_anchor double"
    top = lambda pos, **x: (0, pos, "A", *({"cstate": 1, "score": 0.9, "state": -1, "agree": 1.0, "risk": 0, "bias": 0.3, "entropy": 0.1, "near": 100.0} | x).values())
    tops = {
        "top_is_abstain": top(1, cstate=0), "weak_top": top(2, score=0.55), "weak_modify": top(3, score=0.7), "anchor_disagree": top(4, agree=-0.5), "switch_risk_guard": top(5, risk=1, score=0.78),
        "donor_disagree": top(6, bias=-0.1), "donor_uncertain": top(7, entropy=0.99, score=0.78), "accept": top(8),
    }
    more = [top(9, agree=-0.5, near=1e9), top(10, state=1, score=0.7, agree=-1.0, bias=-1.0), top(11, risk=1)]
    rows = [*tops.values(), *more] + [(*r[:2], "B", -1, 0.6 if r[1] in (5, 7) else 0.1, *r[5:]) for r in [*tops.values(), *more]]
    got = {r.pos: r.reason for r in REGISTRY["I52_acceptance_ladder"].run(spark, {"evidence": frame(spark, rows, shape)}).collect()}
    assert got == {r[1]: name for name, r in tops.items()} | {9: "accept", 10: "accept", 11: "accept"}


def test_noise_does_not_raise_the_pruned_measure(spark):
    import numpy as np

    from haplospark.operators import learning

    rng = np.random.default_rng(0)
    rows = [(i % 9, y := int(rng.random() < 0.5), float(y + rng.normal()), float(rng.normal()), float(i)) for i in range(240)]
    df = frame(spark, rows, "grp long, label int, signal double, noise double, id double")
    steps = learning.prune(df, {"signal": ["signal"], "noise": ["noise", "id"]}, "grp")
    assert [s[2] for s in steps][:2] == ["", "noise"] and steps[-1][5] == 1
    best = next(s for s in steps if s[-1])
    assert best[2] == "noise" and best[3] >= steps[0][3] and best[3] > 0.65


def test_map_is_held_at_its_ends_and_blocks_keep_their_anchors(spark):
    gmap = frame(spark, [(1_000, 2.0), (2_000, 2.1), (900_000, 2.5)], "bp long, cm double")
    sites = frame(spark, [(0, p) for p in (5, 1_000, 1_500, 900_000, 2_000_000)], "w long, pos long")
    assert {r.pos: r.cm for r in REGISTRY["H3_interpolate_cm"].run(spark, {"sites": sites, "gmap": gmap}).collect()} == {5: 2.0, 1_000: 2.0, 1_500: 2.05, 900_000: 2.5, 2_000_000: 2.5}
    fills = frame(spark, [(0, 1_500, "b"), (0, 1_500, "c"), (0, 1_500, "unassigned")], "w long, pos long, block_id string")
    rows = [("b", 5), ("b", 900), ("b", 1_400), ("b", 1_500), ("b", 1_600), ("b", 890_000), ("c", 1_700), ("unassigned", 1_450)]
    calls = frame(spark, [(0, p, b, 1) for b, p in rows], "w long, pos long, block_id string, state int")
    got = sorted((r.block_id, r.side, r.rn, r.apos) for r in REGISTRY["C6_nearest_in_centimorgan"].run(spark, {"fills": fills, "calls": calls, "gmap": gmap}, k=2).collect())
    # 5 and 900 lie 0.05 centimorgans away, before the map's start; 890,000 is too far
    assert got == [("b", "L", 1, 1_400), ("b", "L", 2, 900), ("b", "R", 1, 1_500), ("b", "R", 2, 1_600), ("c", "R", 1, 1_700)]


def _scaffold(spark, name, blocks, alleles, plain=False, **params):
    """Blocks as lists of (position, state); each haplotype's alleles at all positions in order."""
    calls = [(0, p, b, s) for b, xs in blocks.items() for p, s in xs]
    ends = [(0, b, xs[0][0], xs[-1][0], len(xs)) for b, xs in blocks.items()]
    at = sorted(p for _, p, _, _ in calls)
    tables = {
        "blocks": frame(spark, ends, "w long, block_id string, s long, e long, n long"), "calls": frame(spark, calls, "w long, pos long, block_id string, state int"),
        "psites": frame(spark, [(p, k) for k, p in enumerate(at)], "pos long, k int"), "gmap": frame(spark, [(0, 0.0), (10_000_000, 10.0)], "bp long, cm double"),
        "panel": frame(spark, [(h, h // 2, h % 2, "g", k, x) for h, xs in enumerate(alleles) for k, x in enumerate(xs)], "hap long, donor long, hap_id long, grp string, k int, allele int"),
    }
    if plain:
        return {r[1]: r for r in REGISTRY[name].run(spark, {n: tables[n] for n in REGISTRY[name].inputs}, **params).collect()}
    return {r[1]: r for r in scaffolds.scaffold(spark, tables, name, **params).collect()}


def test_panel_scaffold_by_hand(spark):
    """One centimorgan a megabase, the middle between the blocks at 150,000: anchors 0.05 away weigh 1/2, those 0.1 away 1/3."""
    blocks = {"a": [(50_000, 1), (100_000, -1)], "b": [(200_000, 1), (250_000, 1)]}
    near, far = 1 / 2, 1 / 3
    haps = [
        (1, -1, 1, 1),  # as called: kept, kept
        (-1, 1, -1, -1),  # both turned: another path of the same relation
        (1, -1, -1, -1),  # kept, turned: a flip
        (1, 1, 1, 1),  # a's near anchor contradicts: 1/3 - 1/8 kept; turned 1/2 - 1/12; b kept
        (1, 0, 0, 1),  # unknown alleles neither match nor oppose
    ]
    row = _scaffold(spark, "I44_panel_scaffold", blocks, haps, donors=1, margin=0.5)["a"]
    whole = near + far
    same = 2 * (2 * whole + 0.4) + (far - near / 4 + whole + 0.2) + (2 * far + 0.2)
    flip = (2 * whole + 0.4) + (near - far / 4 + whole + 0.2)
    assert abs(row.same - same) < 1e-5 and abs(row.flip - flip) < 1e-5 and (row.same_donors, row.flip_donors) == (4, 2)
    assert (row.decision, row.reason, row.gap_bp, round(row.gap_cm, 6), row.left_anchors, row.right_anchors) == ("same", "accepted", 100_000, 0.1, 2, 2)
    assert abs(row.confidence - same / (same + flip)) < 1e-6 and abs(row.margin - (same - flip)) < 1e-5
    best = _scaffold(spark, "I44_panel_scaffold", blocks, haps, donors=1, margin=0.5, top=1)["a"]
    assert abs(best.same - 2 * (2 * whole + 0.4)) < 1e-5 and (best.same_donors, best.flip_donors) == (2, 2)
    one = _scaffold(spark, "I44_panel_scaffold", blocks, haps, donors=1, most_anchors=1, least_anchors=1)["a"]
    assert (one.left_anchors, one.right_anchors) == (1, 1) and abs(one.same - 2 * 1.2) < 1e-5 and abs(one.flip - 2 * 1.2) < 1e-5  # the last haplotype is unknown at both
    said = lambda **p: _scaffold(spark, "I44_panel_scaffold", blocks, haps, **({"donors": 1, "margin": 0.5} | p))["a"].reason
    assert said(donors=5) == "insufficient_donors" and said(conf=0.9) == "low_confidence" and said(margin=8.0) == "low_margin"
    assert said(max_gap=99_999) == said(max_gap_cm=0.09) == "gap_exceeds_limit" and said(least_anchors=3) == "insufficient_panel_anchors"
    lost = _scaffold(spark, "I44_panel_scaffold", blocks, [(0, 0, 0, 0)], donors=1)["a"]
    assert (lost.reason, lost.decision, lost.same, lost.confidence) == ("no_panel_support", "abstain", 0.0, 0.0)


def test_scaffold_assignment_turns_and_restarts(spark):
    blocks = {"a": [(10_000, 1), (20_000, 1)], "b": [(30_000, 1), (40_000, 1)], "c": [(50_000, 1), (60_000, 1)], "d": [(5_000_000, 1), (5_010_000, 1)]}
    haps = [(1, 1, -1, -1, 1, 1, 1, 1)] * 3
    got = _scaffold(spark, "I45_scaffold_assignment", blocks, haps, donors=3, margin=0.5)
    assert {b: (r.scaffold, r.orientation, r.joined) for b, r in got.items()} == {"a": (1, 1, 0), "b": (1, -1, 1), "c": (1, 1, 1), "d": (2, 1, 0)}


def test_scaffold_with_many_anchors_equals_a_plain_loop(spark):
    """More anchors than one number holds, missing alleles, more haplotypes than are kept."""
    import numpy as np

    rng = np.random.default_rng(3)
    blocks = {"a": [(1_000 * i, int(s)) for i, s in enumerate(rng.choice([-1, 1], 40), 1)], "b": [(100_000 + 1_000 * i, int(s)) for i, s in enumerate(rng.choice([-1, 1], 35))]}
    states, at = np.array([s for b in "ab" for _, s in blocks[b]]), np.array([p for b in "ab" for p, _ in blocks[b]])
    haps = [tuple(int(x) for x in np.where(rng.random(75) < 0.1, 0, np.where(rng.random(75) < 0.2, -1, 1) * states * rng.choice([-1, 1]))) for _ in range(30)]
    row = _scaffold(spark, "I44_panel_scaffold", blocks, haps, donors=1, top=5)["a"]
    wt, want = 1 / (1 + np.abs(at - 70_000) / 1e6 / 0.05), {1: (0.0, 0), -1: (0.0, 0)}
    for turn in (1, -1):
        for relation in (1, -1):
            scores = []
            for h in haps:
                hit = np.array(h) * states * np.where(np.arange(75) < 40, turn, turn * relation)
                left, right = ((wt[x] * np.where(hit[x] > 0, 1, np.where(hit[x] < 0, -0.25, 0))).sum() for x in (slice(0, 40), slice(40, 75)))
                if left > 0 and right > 0:
                    scores.append(left + right + 0.2 * min((hit[:40] > 0).sum(), (hit[40:] > 0).sum()))
            best = sorted(scores, reverse=True)[:5]
            want[relation] = (want[relation][0] + sum(best), want[relation][1] + len(best))
    assert (row.left_anchors, row.right_anchors) == (40, 35) and abs(row.same - want[1][0]) < 1e-4 and abs(row.flip - want[-1][0]) < 1e-4
    assert (row.same_donors, row.flip_donors) == (want[1][1], want[-1][1])
    assert _scaffold(spark, "I44_panel_scaffold", blocks, haps, plain=True, donors=1, top=5)["a"] == row


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["I44_panel_scaffold", "I45_scaffold_assignment"])
def test_scaffold_query_equals_the_sql_by_haplotype(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = norm(stateful.queries()[name](spark, SF).toPandas()), norm(con.execute(SQL[name]).df())
    assert len(got) and got.equals(want)


def test_panel_records_and_genotypes(spark):
    sites = frame(spark, [(0, p, "A", "C") for p in (1, 2, 3, 4, 5)], "w long, pos long, ref string, alt string")
    records = frame(spark, [(1, "a", "c"), (2, "A", "C,G"), (3, "A", "G"), (5, "A", "C,G"), (5, "A", "C")], "pos long, ref string, alt string")
    tables = {"sites": sites, "panelrecords": records}
    assert tuple(REGISTRY["A9_panel_exact_match"].run(spark, tables).first()) == (0, 2, 1, 1, 2)
    assert {r.pos: r.status for r in REGISTRY["D37_panel_status"].run(spark, tables).collect()} == {1: "exact", 2: "nonbiallelic", 3: "mismatch", 4: "missing", 5: "exact"}
    gts = frame(spark, [(0, i, gt) for i, gt in enumerate(["0|1", "1|0", "0/1", "1|2", ".|0", "1", ""])], "w long, pos long, gt string")
    got = {r.gt: (r.h0, r.h1, r.state) for r in REGISTRY["A10_phased_genotype"].run(spark, {"genotypes": gts}).collect()}
    assert got == {"0|1": (0, 1, 1), "1|0": (1, 0, -1), "0/1": (-1, -1, 0), "1|2": (1, -1, 0), ".|0": (-1, 0, 0), "1": (-1, -1, 0), "": (-1, -1, 0)}


def test_each_guard_of_a_sweep_decides(spark):
    names = ("prob", "conf", "margin", "effective", "usable_a", "usable_b", "gap", "support")
    good = dict(zip(names, (0.9, 0.9, 5.0, 3.0, 2, 2, 100, 9.0)))
    rows = [good] + [good | {n: 101 if n == "gap" else v - 1} for n, v in good.items()]
    bridges = frame(spark, [(i % 2, *(float(x) for x in r.values())) for i, r in enumerate(rows)], "w long, " + ", ".join(f"{n} double" for n in names))
    guards = frame(spark, [("exact", 0.9, 0.9, 5.0, 3.0, 2.0, 100.0, 9.0), ("none", 0.0, 0.0, 0.0, 0.0, 0.0, 1e9, 0.0)], "cfg string, prob double, conf double, margin double, effective double, usable double, gap double, support double")
    got = {(r.cfg, r.w): (r.n, r.total) for r in REGISTRY["B16_guard_sweep"].run(spark, {"bridgefeatures": bridges, "guards": guards}).collect()}
    assert got[("exact", 0)] == (1, 5) and got[("exact", 1)] == (0, 4) and got[("none", 1)][1] == 4 and got[("none", 0)][0] >= 1


def test_read_decisions_equal_a_scan(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    obs = sorted({(0, int(r), int(p)) for r in range(40) for p in rng.choice(12, rng.integers(1, 5))})
    sites = frame(spark, [(0, p) for p in range(12)], "w long, pos long")
    df = frame(spark, [(*x, 1, 20, 30) for x in obs], "w long, read_id long, pos long, allele int, baseq long, mapq long")
    for most in (7, 1_000):
        got = {r.read_id: r.decision for r in REGISTRY["I55b_read_decisions"].run(spark, {"obs": df, "sites": sites}, depth=3, most=most).collect()}
        reads = {r: [p for _, x, p in obs if x == r] for r in {x for _, x, _ in obs}}
        cover, kept, want = dict.fromkeys(range(12), 0), 0, {}
        for r in sorted(reads, key=lambda r: (-len(reads[r]), r)):  # equal qualities: the score follows the sites
            if kept >= most:
                want[r] = "max_reads_reached"
            elif len(reads[r]) < 2:
                want[r] = "below_min_sites_per_read"
            elif all(cover[p] >= 3 for p in reads[r]):
                want[r] = "no_undercovered_site"
            else:
                want[r], kept = "kept", kept + 1
                cover |= {p: min(3, cover[p] + 1) for p in reads[r]}
        assert got == want


def test_calls_are_judged_after_their_block_is_turned(spark):
    rows = [(0, 1, "b", 1, -1), (0, 2, "b", -1, 1), (0, 3, "b", 1, 1), (0, 4, "c", 1, 1), (0, 5, "c", 1, -1), (0, 6, "b", 0, 1), (0, 7, "b", 1, None), (0, 8, "unassigned", 1, 1)]
    cmp = frame(spark, rows, "w long, pos long, block_id string, state int, tstate int")
    got = {r.pos: (r.orientation, r.oriented, r.verdict) for r in REGISTRY["I55d_oriented_comparison"].run(spark, {"cmp": cmp}).collect()}
    assert got == {1: (-1, -1, "correct"), 2: (-1, 1, "correct"), 3: (-1, -1, "wrong"), 4: (0, 0, "unknown_orientation"), 5: (0, 0, "unknown_orientation"), 6: (-1, 0, "not_comparable"), 7: (-1, -1, "not_comparable"), 8: (0, 0, "unknown_orientation")}
    assert tuple(REGISTRY["I55e_orientation_summary"].run(spark, {"cmp": cmp}).first()) == (0, 2, 1, 2, 3, round(2 / 3, 6))


def test_site_confidence_holds_out_whole_groups_and_sees_categories(spark):
    """The label is whether the category is one of two: no order of the categories' codes tells it by one threshold."""
    from haplospark.operators import learning

    rows = [(i, g, f"m{i % 4}", int(i % 4 in (0, 2)), 0.5) for g in range(10) for i in range(40 * g, 40 * g + 40)]
    df = frame(spark, rows, "id long, grp long, method string, label int, score double")
    got = learning.holdout_by_group(df, ["score"], "method", "grp", rounds=3).collect()
    held = {r.grp for r in got if r.held}
    assert len(held) == 3 and all(r.held == (r.grp in held) for r in got) and len(got) == 400
    assert all((r.prob > 0.5) == (r.label == 1) for r in got)


def test_panel_priors_count_each_panel_site_once(spark):
    """Equal to the join by haplotype, for sites outside the panel, two columns at a position, unknown alleles and columns without haplotypes; no join makes a row for each site and haplotype."""
    op = REGISTRY["A19_bootstrap_priors"]
    sites = frame(spark, [(w, p) for w in (1, 2) for p in (10, 20, 30, 40)] + [(2, 10)], "w long, pos long")
    psites = frame(spark, [(10, 0), (20, 1), (20, 2), (30, 9)], "pos long, k int")
    panel = frame(spark, [(h, k, (h + k) % 3 - 1) for h in range(5) for k in (0, 1, 2)], "hap long, k int, allele int")
    tables = {"sites": sites, "psites": psites, "panel": panel}
    got = op.run(spark, tables)
    assert norm(got.toPandas()).equals(norm(spark.sql(render(op.text(), True), **tables).toPandas()))
    assert {(r.w, r.pos): r.n for r in got.collect()}[2, 10] == 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate [k#")
