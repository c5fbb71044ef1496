"""Haplotypes against the calls of windows: by groups of windows, and by the join of all rows."""

import numpy as np
import pytest

from haplospark.operators import matching
from haplospark.plans.operator import REGISTRY, render
from test_operators import frame, norm

NAMES = ("I1_donor_score", "I1b_stub_score", "F1_donor_ranking", "F2_composite_pairs", "F4_hap_ranking", "I37_path_match", "I55c_candidate_ranks", "I2_window_states", "F3_top_states", "D21_local_donor_prior")


def tables(spark, seed=5):
    """Windows on both sides of zero and far apart, one without phased calls, one outside the panel; a site under two columns; haplotypes with gaps and unknown alleles, one with a single row."""
    rng = np.random.default_rng(seed)
    windows = [-70, -1, 0, 1, 31, 32, 33, 900]
    calls = [(w, 100 * i, int(rng.choice([-1, 0, 1]))) for w in windows for i in range(40) if rng.random() < 0.6] + [(5, 100 * i, 0) for i in range(5)] + [(6, 9_999, 1)]
    psites = [(100 * i, i % 20) for i in range(40)] + [(300, 19), (700, 77)]
    panel = [(h, h // 2, h % 2, f"g{h % 3}", k, int(rng.choice([-1, 0, 1]))) for h in range(40, 0, -1) for k in range(20) if h > 3 or rng.random() < 0.8] + [(99, 50, 0, "g9", 3, 1)]
    obs = [(w, p, int(rng.choice([-1, 0, 1]))) for w, p, _ in calls for _ in range(3) if rng.random() < 0.8]
    calls = [(*c, 0.05 * (i % 20)) for i, c in enumerate(calls)]
    return {
        "obs": frame(spark, obs, "w long, pos long, allele int"),
        "sites": frame(spark, [(w, p, 0) for w, p, *_ in calls] + [(0, 55, 0)], "w long, pos long, i long"),
        "calls": frame(spark, calls, "w long, pos long, state int, conf double"),
        "psites": frame(spark, psites, "pos long, k int"),
        "panel": frame(spark, panel, "hap long, donor long, hap_id long, grp string, k int, allele int"),
        "scores": frame(spark, [(w, p, c) for w, p, *_ in calls[::2] for c in "AB"] + [(0, 3_900, "A"), (5, 300, "A"), (8, 300, "A")], "w long, pos long, cand string"),
        "ancestry": frame(spark, [("g0", 0.7), ("g2", 1.3)], "grp string, weight double"),
        "centres": frame(spark, [(w, 1_550) for w in windows], "w long, centre long"),
    }


@pytest.mark.parametrize("name", NAMES)
def test_equals_the_join_by_haplotype(spark, name):
    op, t = REGISTRY[name], tables(spark)
    if name in ("F4_hap_ranking", "I37_path_match"):  # runs go by position, and the SQL leaves the order of two columns at one open
        t["psites"] = t["psites"].where("NOT (pos = 300 AND k = 19)")
    own = {n: t[n] for n in op.inputs}
    want = norm(spark.sql(render(op.text(), True), **own).toPandas())
    assert len(want) and norm(op.run(spark, own).toPandas()).equals(want)


@pytest.mark.parametrize("name", NAMES)
def test_windows_are_scored_in_groups(spark, name):
    """The plan goes by groups of windows, not by the join of all rows."""
    op, t = REGISTRY[name], tables(spark)
    called = []
    kept, matching.per_group = matching.per_group, lambda *a: called.append(1) or kept(*a)
    try:
        op.run(spark, {n: t[n] for n in op.inputs})
    finally:
        matching.per_group = kept
    assert called


def test_parameters_reach_the_plan(spark):
    t = tables(spark)
    op = REGISTRY["F1_donor_ranking"]
    assert {r.rn for r in op.run(spark, {n: t[n] for n in op.inputs}, top=3).collect()} == {1, 2, 3}
