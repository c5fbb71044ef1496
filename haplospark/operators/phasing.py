"""Donor scoring, decision ladders, boundaries, panel retrieval, gates and scoring metrics that are relational (I)."""

from ..plans.operator import define
from . import matching
from .aggregates import COMBINE, SUMMARY

_READ = "(SELECT w, pos, CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END AS rs, abs(v) AS rc FROM (SELECT w, pos, sum(allele * coalesce(w2, 0.5)) / sum(coalesce(w2, 0.5)) AS v FROM {obs} WHERE allele <> 0 GROUP BY w, pos) AS q)"
define("I4_decision_ladder", "w long, pos long, state int, conf double, source string", f"""
SELECT w, pos, CASE WHEN source = 'forced_abstain' THEN 0 WHEN source IN ('donor_only') THEN ds ELSE rs END AS state, CASE source WHEN 'forced_abstain' THEN 0.0 WHEN 'conflict' THEN least(0.30, rc * 0.35) WHEN 'donor_only' THEN least(0.49, dc) WHEN 'weak_read' THEN least(0.70, rc * 0.75 + 0.15 * dc) ELSE least(1.0, rc + 0.08 * dc) END AS conf, source FROM (
SELECT *, CASE WHEN rs = 0 AND ds = 0 THEN 'forced_abstain' WHEN rs = 0 THEN 'donor_only' WHEN ds = -rs AND dc >= 0.5 THEN 'conflict' WHEN rc < 0.5 THEN 'weak_read' ELSE 'read' END AS source FROM (SELECT r.w, r.pos, CASE WHEN round(r.rc, 9) = 0 THEN 0 ELSE r.rs END AS rs, r.rc, d.state AS ds, d.conf AS dc FROM {_READ} AS r JOIN ({COMBINE}) d ON d.w = r.w AND d.pos = r.pos) AS x) AS y""")
define("I5_two_pass", "w long, pos long, first int, second int", """
SELECT c.w, c.pos, c.state AS first, CASE WHEN s.v > 0 THEN 1 WHEN s.v < 0 THEN -1 ELSE c.state END AS second FROM {calls} c LEFT JOIN {psites} vc ON vc.pos = c.pos LEFT JOIN (SELECT r.w, k, sum(p.allele * r.raw) AS v FROM (SELECT * FROM (SELECT w, hap, raw, row_number() OVER (PARTITION BY w ORDER BY raw DESC, hap) AS rn FROM (SELECT c.w, p.hap, sum(p.allele * c.state) AS raw FROM {calls} c JOIN {psites} vp ON vp.pos = c.pos JOIN {panel} p ON p.k = vp.k GROUP BY c.w, p.hap) AS d) AS e WHERE rn <= :top) r
JOIN {panel} p ON p.hap = r.hap GROUP BY r.w, k) s ON s.w = c.w AND s.k = vc.k""", top=8)
define("I8_window_donor_support", "w long, win long, support long, oppose long", "SELECT c.w, IDIV(c.pos|1000) AS win, sum(CASE WHEN p.allele = c.state THEN 1 ELSE 0 END) AS support, sum(CASE WHEN p.allele = -c.state THEN 1 ELSE 0 END) AS oppose FROM {calls} c JOIN {psites} vp ON vp.pos = c.pos JOIN {panel} p ON p.k = vp.k WHERE c.state <> 0 GROUP BY c.w, IDIV(c.pos|1000)")
#: Of all observations of a read with ``least`` sites; a missing weight is 0.
BASE_SCORE = """
SELECT w, read_id, n, n * n + 0.002 * (hi - lo) + 2.0 * (n - 1) + 0.25 * mean_w * obs - 0.5 * ambiguous AS score
FROM (
    SELECT w, read_id, count(DISTINCT CASE WHEN allele <> 0 THEN pos END) AS n, min(CASE WHEN allele <> 0 THEN pos END) AS lo, max(CASE WHEN allele <> 0 THEN pos END) AS hi,
        count(*) AS obs, sum(amb) AS ambiguous, avg(coalesce(w2, 0.0)) AS mean_w
    FROM {obs}
    GROUP BY w, read_id
) AS r
WHERE n >= :least"""
_BASE_OTHERWISE = """
SELECT s.w, s.read_id, s.n, s.n * s.n + 0.002 * s.span + 2.0 * (s.n - 1) + 0.25 * o.total - 0.5 * o.ambiguous AS score
FROM (SELECT w, read_id, count(*) AS n, max(pos) - min(pos) AS span FROM (SELECT DISTINCT w, read_id, pos FROM {obs} WHERE allele IN (-1, 1)) AS d GROUP BY w, read_id HAVING count(*) >= :least) AS s
JOIN (SELECT w, read_id, sum(CASE WHEN w2 IS NULL THEN 0.0 ELSE w2 END) AS total, sum(amb) AS ambiguous FROM {obs} GROUP BY w, read_id) AS o ON o.w = s.w AND o.read_id = s.read_id"""
define("I11_informative_base_score", "w long, read_id long, n long, score double", _BASE_OTHERWISE, BASE_SCORE, least=2)


def _held(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


#: How far one block can be trusted: bias, support, informative sites, confidence, coherence and the share of sites that aren't abstained.
RELIABILITY = " + ".join(
    f"{weight} * {_held(term)}"
    for weight, term in (
        ("0.22", "abs(bias)"), ("0.18", "total / 4.0"), ("0.16", "informative / 4.0"), ("0.16", "mean_conf"), ("0.18", "coherence"),
        ("0.10", "1.0 - abstained * 1.0 / greatest(informative + abstained, 1)"),
    )
)
#: Two blocks next to each other: the pair's reliability is the root of the product; what they agree on counts by it, and half of what is uncertain counts for both.
EVIDENCE = f"""
SELECT w, a, b, inf, rel, rel * greatest(0.0, agree) + 0.5 * (1.0 - rel) AS same, rel * greatest(0.0, -agree) + 0.5 * (1.0 - rel) AS flip
FROM (
    SELECT w, a, b, least(informative, n_inf) AS inf, sqrt(own * n_own) AS rel, greatest(-1.0, least(1.0, bias * n_bias)) AS agree
    FROM (
        SELECT w, block_id AS a, informative, bias, own, lead(block_id) OVER (PARTITION BY w ORDER BY s) AS b, lead(informative) OVER (PARTITION BY w ORDER BY s) AS n_inf,
            lead(bias) OVER (PARTITION BY w ORDER BY s) AS n_bias, lead(own) OVER (PARTITION BY w ORDER BY s) AS n_own
        FROM (SELECT *, {RELIABILITY} AS own FROM ({{SUMMARY}}) AS b0) AS b1
    ) AS b2
    WHERE b IS NOT NULL
) AS b3""".replace("{SUMMARY}", SUMMARY)
#: The same from the calls themselves: sums of each block, joined with those of the next one.
_BLOCK = """(SELECT w, block_id, row_number() OVER (PARTITION BY w ORDER BY min(pos)) AS nr, count(CASE WHEN state <> 0 THEN 1 END) AS i, count(CASE WHEN state = 0 THEN 1 END) AS z,
    coalesce(sum(CASE WHEN state <> 0 THEN conf END), 0.0) AS t, coalesce(sum(CASE WHEN state > 0 THEN conf WHEN state < 0 THEN -conf END), 0.0) AS g FROM {calls} WHERE block_id <> 'unassigned' GROUP BY w, block_id)"""
_TRUST = "(0.40 * CASE WHEN {0}.t > 0 THEN abs({0}.g) / {0}.t ELSE 0.0 END + 0.045 * least(4.0, {0}.t) + 0.04 * least(4, {0}.i) + 0.16 * CASE WHEN {0}.i > 0 THEN least(1.0, {0}.t / {0}.i) ELSE 0.0 END + 0.1 * CASE WHEN {0}.i + {0}.z > 0 THEN {0}.i * 1.0 / ({0}.i + {0}.z) ELSE 1.0 END)"
_EVIDENCE_OTHERWISE = f"""
SELECT w, a, b, inf, rel, 0.5 - 0.5 * rel + CASE WHEN p > 0 THEN rel * p ELSE 0.0 END AS same, 0.5 - 0.5 * rel + CASE WHEN p < 0 THEN -rel * p ELSE 0.0 END AS flip
FROM (SELECT x.w, x.block_id AS a, y.block_id AS b, CASE WHEN x.i < y.i THEN x.i ELSE y.i END AS inf, sqrt({_TRUST.format("x")}) * sqrt({_TRUST.format("y")}) AS rel, CASE WHEN x.t > 0 AND y.t > 0 THEN x.g / x.t * (y.g / y.t) ELSE 0.0 END AS p
    FROM {_BLOCK} AS x JOIN {_BLOCK} AS y ON y.w = x.w AND y.nr = x.nr + 1) AS q"""
define("I12_boundary_evidence", "w long, a string, b string, rel double, same double, flip double", _EVIDENCE_OTHERWISE, EVIDENCE)


def _decide(evidence: str) -> str:
    """A flip that wins is an abstention too."""
    few, weak = "inf < :min_inf", "round(conf, 9) < :min_conf"
    return f"""
SELECT w, a, b, CASE WHEN {few} OR {weak} OR round(same - flip, 9) < 0 THEN 'Abstain' ELSE 'Join' END AS decision,
    CASE WHEN {few} THEN 'insufficient_informative_sites' WHEN {weak} THEN 'low_confidence' WHEN round(same - flip, 9) < 0 THEN 'flip_suppressed_no_flip_ablation' ELSE 'same' END AS reason,
    CASE WHEN {few} THEN 0.0 ELSE conf END AS confidence
FROM (SELECT *, CASE WHEN same + flip > 0 THEN abs(same - flip) / (same + flip) ELSE 0.0 END AS conf FROM ({evidence}) AS e) AS ev"""


DECIDE = _decide(EVIDENCE)
define("I13_boundary_decision", "w long, a string, b string, decision string, reason string, confidence double", _decide(_EVIDENCE_OTHERWISE), DECIDE, min_inf=4, min_conf=0.6)
#: A block follows its predecessor's orientation by the decision at their boundary; without one, or an abstention, it starts anew.
STITCH = """SELECT w, block_id, s, e, seg, CASE WHEN sum(flip) OVER (PARTITION BY w, seg ORDER BY s) % 2 = 1 THEN -1 ELSE 1 END AS orientation, source FROM (SELECT w, block_id, s, e, CASE WHEN decision = 'Flip' THEN 1 ELSE 0 END AS flip, sum(CASE WHEN decision IN ('Join', 'Keep', 'Flip') THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY s) AS seg,
CASE WHEN prev IS NULL THEN 'seed' WHEN decision IN ('Join', 'Keep') THEN 'join' WHEN decision = 'Flip' THEN 'flip' ELSE 'reseed_after_abstain' END AS source FROM (SELECT x.w, x.block_id, x.s, x.e, x.prev, d.decision FROM (SELECT *, lag(block_id) OVER (PARTITION BY w ORDER BY s) AS prev FROM {blocks}) AS x LEFT JOIN {decisions} d ON d.w = x.w AND d.a = x.prev AND d.b = x.block_id) AS y) AS z"""
define("I14_stitch", "w long, block_id string, seg long, orientation int, source string", STITCH)
define("I15_project", "w long, pos long, local int, stitched int, conf double, block_id string", f"SELECT c.w, c.pos, c.state AS local, CASE WHEN s.block_id IS NULL THEN 0 ELSE c.state * s.orientation END AS stitched, CASE WHEN s.block_id IS NULL THEN 0.0 ELSE c.conf END AS conf, coalesce(s.block_id, 'unassigned') AS block_id FROM (SELECT *, IDIV(pos|:width) AS bucket FROM {{calls}}) c LEFT JOIN (SELECT *, SERIES[IDIV(s|:width)|IDIV(e|:width)] AS bucket FROM ({STITCH}) AS st) s ON s.w = c.w AND s.bucket = c.bucket AND c.pos BETWEEN s.s AND s.e", width=1000)
define("I19_site_confidence", "w long, pos long, support double, conflict double, conf double", """
SELECT w, pos, support, conflict, CASE WHEN support + conflict > 0 THEN support / (support + conflict) ELSE 0.0 END AS conf FROM (SELECT f.w, f.pos, sum(CASE WHEN f.allele * r.o = c.state THEN f.weight ELSE 0.0 END) AS support, sum(CASE WHEN f.allele * r.o = -c.state THEN f.weight ELSE 0.0 END) AS conflict FROM {frags} f JOIN {comps} c ON c.w = f.w AND c.pos = f.pos
JOIN (SELECT f.w, f.read_id, CASE WHEN round(sum(f.weight * f.allele * c.state), 9) >= 0 THEN 1 ELSE -1 END AS o FROM {frags} f JOIN {comps} c ON c.w = f.w AND c.pos = f.pos GROUP BY f.w, f.read_id) r ON r.w = f.w AND r.read_id = f.read_id GROUP BY f.w, f.pos) AS x""")
define("I20_fragment_projection", "w long, comp long, read_id long, n long, positions string", "SELECT f.w, c.comp, f.read_id, count(*) AS n, LAGG(f.pos|f.pos) AS positions FROM {frags} f JOIN {comps} c ON c.w = f.w AND c.pos = f.pos GROUP BY f.w, c.comp, f.read_id HAVING count(*) >= 2")
define("I29_apply_regions", "w long, pos long, state int, applied int", """
SELECT c.w, c.pos, CASE WHEN f.pos IS NOT NULL AND round(abs(f.plus - f.minus), 6) >= :margin AND f.anchors >= 1 AND (f.orient_sites > 0 OR f.prob >= 0.5) THEN f.pred ELSE c.state END AS state, CASE WHEN f.pos IS NOT NULL AND round(abs(f.plus - f.minus), 6) >= :margin AND f.anchors >= 1 AND (f.orient_sites > 0 OR f.prob >= 0.5) THEN 1 ELSE 0 END AS applied FROM {calls} c LEFT JOIN {fills} f ON f.w = c.w AND f.pos = c.pos""", margin=5.0)
define("I30_bridge_gated_flips", "w long, pos long, state int, action string", """
SELECT c.w, c.pos, CASE WHEN action = 'flip' THEN -c.state ELSE c.state END AS state, action FROM (SELECT c.w, c.pos, c.state, CASE WHEN f.pos IS NULL THEN 'keep' WHEN f.pred = c.state THEN 'agree' WHEN f.orient_margin >= 1 AND f.anchors >= 2 AND abs(f.plus - f.minus) >= 0.05 THEN 'flip' ELSE 'blocked' END AS action FROM {calls} c LEFT JOIN {fills} f ON f.w = c.w AND f.pos = c.pos) AS c""")
define("I34a_bridge_candidates", "w long, a long, b long, prob double, gain long, rn int", """
SELECT w, a, b, prob, gain, row_number() OVER (PARTITION BY w ORDER BY prob DESC, gain DESC, a, b) AS rn FROM (SELECT e.w, e.a, e.b, round(greatest(e.pw, e.mw) / (e.pw + e.mw), 6) AS prob, least(x.span, y.span) AS gain FROM {obsedges} e JOIN (SELECT w, comp, max(pos) - min(pos) + 100 AS span FROM {comps} GROUP BY w, comp) x ON x.w = e.w AND x.comp = e.a JOIN (SELECT w, comp, max(pos) - min(pos) + 100 AS span FROM {comps} GROUP BY w, comp) y ON y.w = e.w AND y.comp = e.b) AS z WHERE prob >= :prob AND gain >= :gain""", prob=0.6, gain=200)
#: The order of the haplotypes at each window's centre: by their alleles at all panel sites up to it, the last one first.
_ORDERED = """(
    SELECT w, hap, row_number() OVER (PARTITION BY w ORDER BY word, hap) AS rk
    FROM (
        SELECT c.w, p.hap, LAGG(CASE WHEN p.allele > 0 THEN 1 ELSE 0 END|c.pos DESC) AS word
        FROM {calls} c
        JOIN {centres} g ON g.w = c.w AND c.pos <= g.centre
        JOIN {psites} v ON v.pos = c.pos
        JOIN {panel} p ON p.k = v.k
        GROUP BY c.w, p.hap
    ) AS words
)"""
define("I36_neighbour_retrieval", "w long, seed long, hap long, dist long", f"""
SELECT x.w, x.hap AS seed, y.hap, abs(y.rk - x.rk) AS dist
FROM {_ORDERED} AS x
JOIN {{seeds}} d ON d.w = x.w AND d.hap = x.hap
JOIN {_ORDERED} AS y ON y.w = x.w AND y.rk BETWEEN x.rk - :radius AND x.rk + :radius AND y.hap <> x.hap""", radius=24)
define("I37_path_match", "w long, hap long, score double, left_run long, right_run long, total double", """
SELECT w, hap, score, left_run, right_run, score + 0.75 * (left_run + right_run) + 0.10 * matched AS total FROM (SELECT w, hap, sum(CASE WHEN ok THEN wt ELSE -0.25 * wt END) AS score, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS matched, coalesce(min(CASE WHEN NOT ok AND d < 0 THEN lr END) - 1, max(CASE WHEN d < 0 THEN lr END), 0) AS left_run, coalesce(min(CASE WHEN NOT ok AND d >= 0 THEN rr END) - 1, max(CASE WHEN d >= 0 THEN rr END), 0) AS right_run FROM (
SELECT c.w, p.hap, c.pos - g.centre AS d, p.allele = c.state AS ok, 1.0 / (1.0 + abs(c.pos - g.centre) / 1000.0) AS wt, row_number() OVER (PARTITION BY c.w, p.hap, c.pos < g.centre ORDER BY c.pos DESC) AS lr, row_number() OVER (PARTITION BY c.w, p.hap, c.pos < g.centre ORDER BY c.pos) AS rr FROM {calls} c JOIN {centres} g ON g.w = c.w JOIN {psites} vp ON vp.pos = c.pos JOIN {panel} p ON p.k = vp.k WHERE c.state <> 0) AS x GROUP BY w, hap) AS y""", matching.path_match)
define("I40_fill_candidates", "w long, pos long, block_id string, anchors long", "SELECT f.w, f.pos, c.block_id, count(*) AS anchors FROM (SELECT *, IDIV(pos|:width) + d AS bucket FROM {fills} CROSS JOIN (VALUES (-1), (0), (1)) AS n(d)) f JOIN (SELECT *, IDIV(pos|:width) AS bucket FROM {calls} WHERE state <> 0) c ON c.w = f.w AND c.bucket = f.bucket AND abs(c.pos - f.pos) <= :width AND c.pos <> f.pos GROUP BY f.w, f.pos, c.block_id HAVING count(*) >= 2", width=500)
define("I43_mode_merge", "w long, pos long, pred int, source string", "SELECT w, pos, pred, source FROM (SELECT *, row_number() OVER (PARTITION BY w, pos ORDER BY pri, prob DESC, block_id) AS rn FROM (SELECT w, pos, block_id, pred, prob, 'pbwt' AS source, 2 AS pri FROM {fills} WHERE prob >= :pbwt UNION ALL SELECT w, pos, block_id, pred, prob, 'hmm' AS source, 1 AS pri FROM {hmmfills} WHERE prob >= :hmm) AS u) AS x WHERE rn = 1", hmm=0.7, pbwt=0.3)
define("I51_ranking_metrics", "method string, n long, auc double, ap double, accuracy double, f1 double", """
SELECT a.method, a.n, (a.ranks - a.p * (a.p + 1) / 2.0) / (a.p * (a.n - a.p) * 1.0) AS auc, b.ap, a.accuracy, a.f1 FROM (SELECT method, count(*) AS n, sum(label) AS p, sum(CASE WHEN label = 1 THEN rk ELSE 0.0 END) AS ranks, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, 2.0 * sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) + sum(label)) AS f1
FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rk FROM {labelled}) AS x GROUP BY method) a JOIN (SELECT method, sum(CASE WHEN label = 1 THEN tp / (r * 1.0) ELSE 0.0 END) / sum(label) AS ap FROM (SELECT method, label, row_number() OVER (PARTITION BY method ORDER BY score DESC, id) AS r, sum(label) OVER (PARTITION BY method ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS tp FROM {labelled}) AS y GROUP BY method) b ON b.method = a.method""")
#: Gates in order; the first that holds is the reason.  ``modifies``: the candidate isn't the call.
_GATES = (
    ("top_is_abstain", "cstate = 0"),
    ("weak_top", "score < :best OR margin < :margin"),
    ("weak_modify", "modifies AND (score < :mod_score OR margin < :mod_margin)"),
    ("anchor_disagree", "modifies AND anchor_agreement < :agreement AND nearest_anchor < 1000000000.0"),
    ("switch_risk_guard", "modifies AND switch_risk = 1 AND margin < greatest(:mod_margin, 0.20)"),
    ("donor_disagree", "modifies AND donor_bias < -0.05"),
    ("donor_uncertain", "modifies AND donor_entropy > 0.95 AND margin < 0.20"),
)
_LADDER_PARAMS = dict(best=0.6, margin=0.05, mod_score=0.72, mod_margin=0.15, agreement=0.0)
define("I52_acceptance_ladder", "w long, pos long, cand string, proposed int, score double, margin double, reason string", f"""
SELECT b.w, b.pos, b.cand, b.cstate AS proposed, b.score, b.margin, CASE WHEN count(g.nr) = 0 THEN 'accept' ELSE min(g.nr || g.name) END AS reason
FROM (SELECT *, cstate <> state AS modifies FROM (SELECT e.*, round(e.score - (SELECT coalesce(max(o.score), 0.0) FROM {{evidence}} o WHERE o.w = e.w AND o.pos = e.pos AND (o.score < e.score OR (o.score = e.score AND o.cand > e.cand))), 9) AS margin
    FROM {{evidence}} e WHERE NOT EXISTS (SELECT 1 FROM {{evidence}} o WHERE o.w = e.w AND o.pos = e.pos AND (o.score > e.score OR (o.score = e.score AND o.cand < e.cand)))) AS t) AS b
LEFT JOIN (VALUES {", ".join(f"('{i} ', '{name}')" for i, (name, _) in enumerate(_GATES))}) AS g(nr, name) ON CASE g.name {" ".join(f"WHEN '{name}' THEN {gate}" for name, gate in _GATES)} END
GROUP BY b.w, b.pos, b.cand, b.cstate, b.score, b.margin""".replace("min(g.nr || g.name)", "substr(min(g.nr || g.name), 3)"), f"""
SELECT w, pos, cand, cstate AS proposed, score, margin, CASE {" ".join(f"WHEN {gate} THEN '{name}'" for name, gate in _GATES)} ELSE 'accept' END AS reason
FROM (
    SELECT *, round(score - coalesce(nxt, 0.0), 9) AS margin, cstate <> state AS modifies
    FROM (SELECT *, row_number() OVER (PARTITION BY w, pos ORDER BY score DESC, cand) AS rn, lead(score) OVER (PARTITION BY w, pos ORDER BY score DESC, cand) AS nxt FROM {{evidence}}) AS r
    WHERE rn = 1
) AS x""", **_LADDER_PARAMS)
define("I53_candidate_features", "w long, qid string, cand string, left_agree int, right_agree int, hp_imbalance double", """
SELECT q.w, q.qid, q.cand, CASE WHEN l.state = q.cstate THEN 1 ELSE 0 END AS left_agree, CASE WHEN r.state = q.cstate THEN 1 ELSE 0 END AS right_agree, coalesce(h.imb, 0.0) AS hp_imbalance FROM {scores} q JOIN (SELECT w, pos, max(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM {calls}) a ON a.w = q.w AND a.pos = q.pos
LEFT JOIN {calls} l ON l.w = q.w AND l.pos = a.p LEFT JOIN {calls} r ON r.w = q.w AND r.pos = a.n LEFT JOIN (SELECT o.w, o.pos, abs(sum(CASE t.hp WHEN '1' THEN 1 WHEN '2' THEN -1 ELSE 0 END)) / (count(*) * 1.0) AS imb FROM {obs} o JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id GROUP BY o.w, o.pos) h ON h.w = q.w AND h.pos = q.pos""")
define("I54_oracle_orientation", "w long, pos long, state int, orientation int", "SELECT c.w, c.pos, c.state * coalesce(o.o, 1) AS state, coalesce(o.o, 1) AS orientation FROM {calls} c LEFT JOIN (SELECT w, block_id, CASE WHEN sum(CASE WHEN state = tstate THEN 1 ELSE 0 END) - sum(CASE WHEN state = -tstate THEN 1 ELSE 0 END) <= -:margin THEN -1 ELSE 1 END AS o FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL GROUP BY w, block_id HAVING count(*) >= :sites) o ON o.w = c.w AND o.block_id = c.block_id", margin=1, sites=2)
define("I55_read_summary", "w long, reads long, obs long, mean_sites double, max_span long, mean_weight double", "SELECT w, count(*) AS reads, sum(n) AS obs, avg(n) AS mean_sites, max(span) AS max_span, avg(wt) AS mean_weight FROM (SELECT o.w, o.read_id, count(*) AS n, max(o.pos) - min(o.pos) AS span, avg(coalesce(o.w2, 0.5)) AS wt FROM {obs} o JOIN {selected} s ON s.w = o.w AND s.read_id = o.read_id GROUP BY o.w, o.read_id) AS x GROUP BY w")
define("flagship_benchmark", "w long, blocks long, joined long, called long, mean_conf double", f"""
SELECT b.w, b.blocks, coalesce(d.joined, 0) AS joined, c.called, c.mean_conf FROM (SELECT w, count(*) AS blocks FROM {{blocks}} GROUP BY w) b LEFT JOIN (SELECT w, sum(CASE WHEN decision = 'Join' THEN 1 ELSE 0 END) AS joined FROM ({DECIDE}) AS x GROUP BY w) d ON d.w = b.w JOIN (SELECT w, sum(CASE WHEN state <> 0 THEN 1 ELSE 0 END) AS called, avg(conf) AS mean_conf FROM ({COMBINE}) AS y GROUP BY w) c ON c.w = b.w""", min_inf=2, min_conf=0.3)
