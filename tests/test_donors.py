"""Features of candidates by panel donors: numbers worked by hand, and whole queries against the SQL by haplotype."""

import math
import os

import duckdb
import pytest

from haplospark.operators import donors, learning, stateful as st
from haplospark.plans import stateful
from haplospark.plans.fixtures import sql_queries
from haplospark.plans.operator import REGISTRY
from test_operators import frame, norm

SF = "/root/testdata/sf0.001"
NAMES = ("D13_donor_features", "D14_match_features", "D15_copying_features", "D17_scaffold_block_choice")
W = math.exp(-1)  # 5,000 bases are 0.05 centimorgans in this map

#: Alleles at the candidate 10,000 and the anchors 5,000 (+1) and 15,000 (-1): a copy, its opposite, one that does both, one without the candidate.
HAPS = [(1, 1, -1), (-1, -1, 1), (-1, 1, 1), (0, 0, -1)]
CALLS = [(1, 5_000, "b", 1), (1, 15_000, "b", -1), (1, 10_000, "unassigned", 0), (1, 8_000, "c", 1), (1, 9_000, "c", 1), (1, 9_500, "unassigned", 1)]


def tables(spark, haps=HAPS, calls=CALLS, fills=((1, 10_000, "b"),), places=(10_000, 5_000, 15_000)):
    return {
        "calls": frame(spark, list(calls), "w long, pos long, block_id string, state int"),
        "fills": frame(spark, list(fills), "w long, pos long, block_id string"),
        "gmap": frame(spark, [(0, 0.0), (100_000, 1.0)], "bp long, cm double"),
        "psites": frame(spark, [(p, k) for k, p in enumerate(places)], "pos long, k int"),
        "panel": frame(spark, [(h, h // 2, h % 2, "g", k, a) for h, alleles in enumerate(haps) for k, a in enumerate(alleles)], "hap long, donor long, hap_id long, grp string, k int, allele int"),
    }


def both(spark, name, t, **params):
    """The rows of both forms, which are the same."""
    got = norm(donors.features(spark, t, name, **params).toPandas())
    assert got.equals(norm(REGISTRY[name].run(spark, {n: t[n] for n in REGISTRY[name].inputs}, **params).toPandas()))
    return donors.features(spark, t, name, **params).collect()


def near(got, **want):
    assert {k: (round(got[k], 6) if isinstance(v, float) else got[k]) for k, v in want.items()} == {k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()}


def test_donors_that_are_heterozygous_at_both_sites(spark):
    """Of two donors the second is not heterozygous at any of the sites; the first one relates both anchors in the same sense."""
    (row,) = both(spark, "D13_donor_features", tables(spark))
    w = math.exp(-0.1)
    near(row, in_panel=1, anchors=2, usable=2, plus=2 * w, minus=0.0, total=2 * w, margin=2 * w, confidence=1.0, entropy=0.0, top1=2 * w, top2=0.0, top_margin=2 * w, effective=1.0, left_plus=w, left_minus=0.0, right_plus=w, right_minus=0.0)
    near(row, left_confidence=1.0, right_confidence=1.0, agree=1, two_sided=1, mean_d=5_000.0, min_d=5_000, max_d=5_000, log_margin=math.log(2 * w + 1))
    (far,) = both(spark, "D13_donor_features", tables(spark), max_bp=4_999)
    near(far, in_panel=1, anchors=0, usable=0, plus=0.0, mean_d=-1.0, min_d=-1, agree=0, log_margin=0.0)
    (out,) = both(spark, "D13_donor_features", tables(spark, places=(1, 5_000, 15_000)))
    near(out, in_panel=0, anchors=0, usable=0, total=0.0)


def test_two_donors_against_each_other(spark):
    haps = [(1, 1, -1), (-1, -1, 1), (1, -1, -1), (-1, 1, 1)]  # donor 1 says the other way on the left
    (row,) = both(spark, "D13_donor_features", tables(spark, haps))
    w = math.exp(-0.1)
    near(row, plus=3 * w, minus=w, confidence=0.75, top1=2 * w, top2=w, effective=9 / 5, left_plus=w, left_minus=w, left_confidence=0.5, right_plus=2 * w, agree=1)
    near(row, entropy=-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def test_haplotypes_that_copy_the_anchors(spark):
    (row,) = both(spark, "D14_match_features", tables(spark))
    near(row, in_panel=1, anchors=2, usable=2, cm_span=0.1, plus=5 * W, minus=W, total=6 * W, margin=4 * W, confidence=5 / 6, top_plus=2 * W, top_minus=2 * W, top_margin=0.0, effective=3.6, log_margin=math.log((5 * W + 1) / (W + 1)))
    (one,) = both(spark, "D14_match_features", tables(spark), top=1)
    near(one, plus=4 * W, minus=0.0, effective=2.0, entropy=0.0)
    (none,) = both(spark, "D14_match_features", tables(spark, fills=((1, 10_000, "x"),)))
    near(none, in_panel=1, anchors=0, total=0.0, confidence=0.0, effective=0.0)
    (out,) = both(spark, "D14_match_features", tables(spark, places=(1, 5_000, 15_000)))
    near(out, in_panel=0, anchors=2, usable=0, cm_span=0.0, total=0.0)


def test_copying_by_softmax_on_each_side(spark):
    (row,) = both(spark, "D15_copying_features", tables(spark))
    p = 1 / (1 + math.exp(-W))
    near(row, anchors=2, left_anchors=1, right_anchors=1, two_sided=1, plus_prob=(1 + p) / 2, minus_prob=(1 - p) / 2, confidence=(1 + p) / 2, margin=p, effective=3.6, top_plus=2 * W, left_plus=0.75, right_plus=1.0, agree=1)
    near(row, left_confidence=0.75, right_confidence=1.0, mean_cm=0.05, min_cm=0.05, max_cm=0.05, mean_bp=5_000.0, max_bp=5_000.0)
    (left,) = both(spark, "D15_copying_features", tables(spark, calls=CALLS[:1]))
    near(left, two_sided=0, agree=0, plus_prob=0.75, left_plus=0.75, right_plus=0.0, right_confidence=0.0)


def test_the_call_at_the_candidate_itself_is_on_no_side(spark):
    calls = [(1, 10_000, "b", 1), (1, 5_000, "b", 1)]
    (row,) = both(spark, "D15_copying_features", tables(spark, calls=calls))
    near(row, anchors=2, left_anchors=1, right_anchors=0, two_sided=0, min_cm=0.0)
    (row,) = both(spark, "D13_donor_features", tables(spark, calls=calls))
    w = math.exp(-0.1)
    near(row, usable=2, plus=1 + w, left_plus=w, right_plus=0.0, two_sided=0, min_d=0)


def test_block_with_anchors_on_both_sides_is_projected(spark):
    """Block c is nearer, but on one side; the call without a block is no anchor."""
    places = (10_000, 5_000, 15_000)
    (row,) = both(spark, "D17_scaffold_block_choice", tables(spark, places=places))
    near(row, pos=10_000, block_id="b", anchors=2, left_anchors=1, right_anchors=1, two_sided=1, mean_cm=0.05, mean_bp=5_000.0, block_anchors=2, block_span=10_001, block_density=2 / 10.001, plus=5 * W, minus=W, pred=1, accept=0)
    (row,) = both(spark, "D17_scaffold_block_choice", tables(spark), min_confidence=0.8, min_margin=1.0)
    assert row.accept == 1
    (row,) = both(spark, "D17_scaffold_block_choice", tables(spark, calls=CALLS[1:]))
    near(row, block_id="c", anchors=2, two_sided=0, usable=0, pred=0, accept=0)
    assert both(spark, "D17_scaffold_block_choice", tables(spark, calls=CALLS[1:4])) == []


def test_nulls_ties_and_empty_tables(spark):
    for name in NAMES:
        assert both(spark, name, tables(spark, calls=[], fills=[])) == []
    haps = [(1, 1, -1)] * 3 + [(-1, 1, -1)]  # of four equal haplotypes the first ones are taken
    (row,) = both(spark, "D14_match_features", tables(spark, haps), top=3)
    near(row, plus=6 * W, minus=0.0)
    (row,) = both(spark, "D14_match_features", tables(spark, fills=[(1, 10_000, "b")] * 3))
    near(row, plus=5 * W)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_the_sql_by_haplotype(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = norm(stateful.queries()[name](spark, SF).toPandas())
    assert len(got) and got.equals(norm(con.execute(sql_queries()[1][name]).df()))


def test_ancestry_weights_come_from_a_table(spark):
    t = tables(spark, haps=[(1, 1, -1), (0, 0, -1), (1, -1, -1)])
    t["panel"] = frame(spark, [(h, h, 0, g, k, a) for h, (g, alleles) in enumerate([("x", (1, 1, -1)), ("y", (0, 0, -1)), ("z", (1, -1, -1))]) for k, a in enumerate(alleles)], "hap long, donor long, hap_id long, grp string, k int, allele int")
    t["ancestry"] = frame(spark, [("x", 0.4), ("z", 2.0)], "grp string, weight double")
    got = {r.hap: (r.n, r.matched, r.raw, r.score) for r in REGISTRY["I1_donor_score"].run(spark, {n: t[n] for n in ("calls", "psites", "panel", "ancestry")}).collect()}
    assert got == {0: (2, 2, 2, 2.95), 1: (1, 1, 1, 1.75), 2: (2, 1, 0, 1.375)}


def test_stratified_folds_keep_groups_whole_and_shares_alike(spark):
    rows = [(g, int(i < ones)) for g, (n, ones) in enumerate([(10, 9), (10, 8), (10, 7), (10, 6), (10, 3), (10, 2), (10, 1), (10, 0)]) for i in range(n)]
    folds = learning.group_folds(frame(spark, rows, "grp long, label int"), "grp", 2, "label")
    assert folds.select("grp", "fold").distinct().count() == 8
    share = {r.fold: (r["count(1)"], r["sum(label)"]) for r in folds.groupBy("fold").agg({"*": "count", "label": "sum"}).collect()}
    assert share == {0: (40, 18), 1: (40, 18)}


def test_bridge_model_needs_groups_and_both_classes(spark):
    shape = "id long, grp long, x double, flat double, label int"
    for rows in ([(i, 1, float(i), 1.0, i % 2) for i in range(6)], [(i, i, float(i), 1.0, 1) for i in range(6)]):
        with pytest.raises(ValueError, match="two groups and both classes"):
            learning.bridge_model(frame(spark, rows, shape), ["x", "flat"], "grp", set())
    rows = [(i, i % 3, float(i % 2), 1.0, i % 2) for i in range(60)]
    got = learning.bridge_model(frame(spark, rows, shape), ["x", "flat", "label"], "grp", {"label"}).collect()
    assert len(got) == 60 and {r.fold for r in got} == {0, 1, 2} and all((r.prob > 0.5) == bool(r.label) for r in got)


def test_legacy_solver_leaves_long_fragments_out_of_the_start(spark):
    import numpy as np
    import pandas as pd

    n = 22
    rows = [(0, 0, p, 1 if p % 2 else -1, 0.3) for p in range(n)] + [(0, 1 + p, q, 1, 1.0) for p in range(n - 1) for q in (p, p + 1)]
    frags = pd.DataFrame(rows, columns=["w", "read_id", "pos", "allele", "weight"]).assign(comp=3)
    got = st.solve_legacy(frags)
    assert set(got["solver"]) == {"greedy_refine"} and set(got["state"]) == {1} and set(got["fragments"]) == {n} and set(got["sites"]) == {n}
    assert got["objective"].iloc[0] == pytest.approx(0.3 * n / 2)
    few = frags[(frags["pos"] < 5) & (frags["read_id"] > 0)]
    exact = st.solve_legacy(few)
    assert set(exact["solver"]) == {"exact"} and exact["objective"].iloc[0] == 0 and exact["margin"].iloc[0] == 1.0 and set(exact["block_id"]) == {"c3_0"}
    assert list(exact["support"]) == [1.0, 2.0, 2.0, 2.0, 1.0] and set(exact["conflict"]) == {0.0} and set(exact["conf"]) == {1.0}
    pieces = st.solve_legacy(few, chunk=3)
    assert list(pieces["block_id"]) == ["c3_0"] * 3 + ["c3_1"] * 2 and len(st.solve_legacy(few, chunk=4)) == 4
    m = np.zeros((1, 21)) + 1
    assert st.solve_greedy(m)[1] == st.solve_greedy(m, skip=True)[1] == 0
