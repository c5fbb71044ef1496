"""Analytic windows (E), ranking and top-k (F), set operations (G), scalar families (H)."""

from ..plans.operator import define
from . import matching
from .joins import in_centimorgans

define("E1_blockify", "w long, pos long, block long", """
SELECT w, pos, dense_rank() OVER (PARTITION BY w ORDER BY brk) AS block FROM (SELECT w, pos, state, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS brk FROM {calls}) AS x WHERE state <> 0""")
define("E2_boundary_pairs", "w long, a string, b string", "SELECT w, block_id AS a, nxt AS b FROM (SELECT w, block_id, lead(block_id) OVER (PARTITION BY w ORDER BY s) AS nxt FROM {blocks}) AS x WHERE nxt IS NOT NULL")
define("E3_scaffold_blocks", "w long, pos long, block long", """
SELECT w, pos, 1 + sum(brk) OVER (PARTITION BY w ORDER BY pos) AS block FROM (SELECT x.w, x.pos, CASE WHEN x.p IS NULL THEN 0 WHEN x.pos - x.p > :max_gap OR (x.state <> x.ps AND coalesce(b.n, 0) < 1) THEN 1 ELSE 0 END AS brk
FROM (SELECT w, pos, state, lag(pos) OVER (PARTITION BY w ORDER BY pos) AS p, lag(state) OVER (PARTITION BY w ORDER BY pos) AS ps FROM {calls} WHERE state <> 0 AND conf >= 0.45) x
LEFT JOIN (SELECT k.w, k.pos, count(*) AS n FROM (SELECT w, pos, lag(pos) OVER (PARTITION BY w ORDER BY pos) AS p FROM {calls} WHERE state <> 0 AND conf >= 0.45) k JOIN {tags} t ON t.w = k.w AND t.hp <> 'UNK' JOIN {obs} o ON o.w = t.w AND o.read_id = t.read_id AND o.pos > k.p AND o.pos < k.pos GROUP BY k.w, k.pos) b ON b.w = x.w AND b.pos = x.pos) AS y""", max_gap=300)
define("E4_switch_segments", "w long, block_id string, segment long, s long, e long, n long", """
SELECT w, block_id, segment, min(pos) AS s, max(pos) AS e, count(*) AS n FROM (SELECT *, sum(CASE WHEN rel <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY w, block_id ORDER BY pos) AS segment FROM (SELECT *, lag(rel) OVER (PARTITION BY w, block_id ORDER BY pos) AS prev FROM (SELECT w, block_id, pos, state * tstate AS rel FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL) AS x) AS y) AS z GROUP BY w, block_id, segment""")
define("E5_best_vs_second", "w long, qid string, cand string, score double, margin double, n long", "SELECT w, qid, cand, score, score - coalesce(nxt, 0.0) AS margin, n FROM (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY score DESC, cand) AS rn, lead(score) OVER (PARTITION BY w, qid ORDER BY score DESC, cand) AS nxt, count(*) OVER (PARTITION BY w, qid) AS n FROM {scores}) AS x WHERE rn = 1")
define("E6_query_rank", "w long, qid string, cand string, rn int, best string, margin double", "SELECT w, qid, cand, rn, first_value(cand) OVER (PARTITION BY w, qid ORDER BY rn) AS best, max(CASE WHEN rn = 1 THEN score END) OVER (PARTITION BY w, qid) - coalesce(max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY w, qid), 0.0) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY score DESC, cand) AS rn FROM {scores}) AS x")
define("E7_region_queries", "w long, region long, piece long, n long, s long, e long", """
SELECT w, region, piece, count(*) AS n, min(pos) AS s, max(pos) AS e FROM (SELECT w, pos, region, IDIV(row_number() OVER (PARTITION BY w, region ORDER BY pos) - 1|:size) AS piece FROM (SELECT w, pos, sum(brk) OVER (PARTITION BY w ORDER BY pos) AS region FROM (SELECT w, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY w ORDER BY pos) > :max_gap THEN 1 ELSE 0 END AS brk FROM {calls} WHERE conf < :uncertain) AS x) AS y) AS z GROUP BY w, region, piece""", size=8, max_gap=200, uncertain=0.7)
define("E9_component_chunks", "w long, chunk long, n long, s long, e long", "SELECT w, chunk, count(*) AS n, min(pos) AS s, max(pos) AS e FROM (SELECT w, pos, IDIV(row_number() OVER (PARTITION BY w ORDER BY pos) - 1|:size) AS chunk FROM {comps}) AS x GROUP BY w, chunk HAVING count(*) >= 2", size=16)
define("E10_neighbor_distance", "w long, pos long, dist long", "SELECT w, pos, least(coalesce(pos - lag(pos) OVER (PARTITION BY w ORDER BY pos), 1000000000), coalesce(lead(pos) OVER (PARTITION BY w ORDER BY pos) - pos, 1000000000)) AS dist FROM {sites}")
define("E11_anchor_counts", "w long, pos long, near_left long, near_right long, far_left long, far_right long", """
SELECT w, pos, coalesce(sum(a) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING), 0) AS near_left, coalesce(sum(a) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 300 FOLLOWING), 0) AS near_right,
coalesce(sum(a) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING), 0) AS far_left, coalesce(sum(a) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1000 FOLLOWING), 0) AS far_right FROM (SELECT w, pos, CASE WHEN state <> 0 THEN 1 ELSE 0 END AS a FROM {calls}) AS x""")
define("E12_isolated_flips", "w long, pos long, pred int, kept int", """
SELECT w, pos, pred, CASE WHEN n = 1 AND prob >= 0.85 AND m >= 5.0 THEN 1 WHEN n > 1 AND avg_m >= 4.0 THEN 1 ELSE 0 END AS kept FROM (SELECT *, count(*) OVER (PARTITION BY w, run) AS n, avg(m) OVER (PARTITION BY w, run) AS avg_m FROM (SELECT *, sum(brk) OVER (PARTITION BY w ORDER BY pos) AS run FROM (
SELECT w, pos, pred, prob, abs(plus - minus) AS m, CASE WHEN pred = lag(pred) OVER (PARTITION BY w ORDER BY pos) AND pos - lag(pos) OVER (PARTITION BY w ORDER BY pos) <= :max_gap THEN 0 ELSE 1 END AS brk FROM {fills}) AS x) AS y) AS z""", max_gap=600)
define("E13_site_windows", "w long, win long, n long, s long, e long", "SELECT w, win, count(*) AS n, min(pos) AS s, max(pos) AS e FROM (SELECT w, pos, IDIV(row_number() OVER (PARTITION BY w ORDER BY pos) - 1|:size) AS win FROM {sites}) AS x GROUP BY w, win", size=4)
define("E14_posterior_margins", "w long, qid string, weight double, margin double", "SELECT w, qid, max(p) AS weight, greatest(-1.0, least(1.0, sum(p * cstate))) AS margin FROM (SELECT w, qid, cstate, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY w, qid) AS p FROM (SELECT *, max(score) OVER (PARTITION BY w, qid) AS mx FROM {scores}) AS x) AS y GROUP BY w, qid")

#: What the ancestry of a haplotype's group counts: ``ancestry`` has one weight a group, others have none.
_DONOR = """
SELECT w, hap, donor, hap_id, grp, n, matched, raw, raw + 0.75 * coalesce(matched * 1.0 / nullif(n, 0), 0.0) + 0.5 * anc AS score
FROM (
    SELECT c.w, p.hap, p.donor, p.hap_id, p.grp, coalesce(max(y.weight), 0.0) AS anc, sum(CASE WHEN p.allele <> 0 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN p.allele = c.state THEN 1 ELSE 0 END) AS matched, sum(p.allele * c.state) AS raw
    FROM {calls} c
    JOIN {psites} vp ON vp.pos = c.pos
    JOIN {panel} p ON p.k = vp.k
    LEFT JOIN {ancestry} y ON y.grp = p.grp
    WHERE c.state <> 0
    GROUP BY c.w, p.hap, p.donor, p.hap_id, p.grp
) AS m"""
define("I1_donor_score", "w long, hap long, n long, matched long, raw long, score double", _DONOR, matching.donors)
define("I1b_stub_score", "w long, hap long, score double, n long", """
SELECT c.w, p.hap, sum(c.state * p.allele) * (0.5 + coalesce(max(y.weight), 0.0)) AS score, count(*) AS n
FROM {calls} c
JOIN {psites} vp ON vp.pos = c.pos
JOIN {panel} p ON p.k = vp.k
LEFT JOIN {ancestry} y ON y.grp = p.grp
GROUP BY c.w, p.hap""", matching.stubs)
_RANK = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY round(score, 9) DESC, raw DESC, matched DESC, donor, hap_id) AS rn FROM ({_DONOR}) AS d) AS r WHERE rn <= :top)"
define("F1_donor_ranking", "w long, rn int, donor long, hap_id long, score double", f"SELECT w, rn, donor, hap_id, score FROM {_RANK} AS r", matching.donors, top=32)
define("F2_composite_pairs", "w long, a long, b long, mean double, comp double, score double, rn int", f"""
SELECT w, a, b, mean, comp, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY round(score, 9) DESC, a, b) AS rn FROM (SELECT w, a, b, mean, comp, 0.7 * mean + 0.3 * comp AS score FROM (
SELECT x.w, x.hap AS a, y.hap AS b, max((x.score + y.score) / 2.0) AS mean, avg(CASE WHEN p.allele <> q.allele THEN 1.0 ELSE 0.0 END) AS comp FROM {_RANK} AS x JOIN {_RANK} AS y ON x.w = y.w AND x.rn < y.rn JOIN {{panel}} p ON p.hap = x.hap JOIN {{panel}} q ON q.hap = y.hap AND q.k = p.k GROUP BY x.w, x.hap, y.hap) AS m) AS s) AS z WHERE rn <= 16""", matching.composite_pairs, top=8)
_STATES = """SELECT w, win, hap, donor, grp, r, h, r + 0.5 * h + 0.25 * ln(1.0 + greatest(0.0, anc)) AS emission FROM (SELECT s.w, s.win, p.hap, p.donor, p.grp, sum(p.allele * (s.alt - s.ref)) AS r, sum(p.allele * s.state * 1.0) AS h, coalesce(max(y.weight), 0.0) AS anc FROM (
SELECT v.w, v.pos, v.i, IDIV(row_number() OVER (PARTITION BY v.w ORDER BY v.pos) - 1|4) AS win, coalesce(o.alt, 0) AS alt, coalesce(o.ref, 0) AS ref, c.state FROM {sites} v JOIN {calls} c ON c.w = v.w AND c.pos = v.pos LEFT JOIN (SELECT w, pos, sum(CASE WHEN allele > 0 THEN 1 ELSE 0 END) AS alt, sum(CASE WHEN allele < 0 THEN 1 ELSE 0 END) AS ref FROM {obs} GROUP BY w, pos) o ON o.w = v.w AND o.pos = v.pos) s
JOIN {psites} vp ON vp.pos = s.pos JOIN {panel} p ON p.k = vp.k LEFT JOIN {ancestry} y ON y.grp = p.grp GROUP BY s.w, s.win, p.hap, p.donor, p.grp) AS x"""
define("I2_window_states", "w long, win long, hap long, r double, h double, emission double", _STATES, matching.window_states)
define("F3_top_states", "w long, win long, rn int, hap long, emission double", f"SELECT w, win, rn, hap, emission FROM (SELECT *, row_number() OVER (PARTITION BY w, win ORDER BY round(emission, 9) DESC, hap) AS rn FROM ({_STATES}) AS s) AS x WHERE rn <= :top", matching.top_states, top=4)
define("F4_hap_ranking", "w long, rn int, hap long, run long, matched long", """
SELECT w, rn, hap, run, matched FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY run DESC, matched DESC, hap) AS rn FROM (SELECT w, hap, coalesce(min(CASE WHEN NOT ok THEN r END) - 1, max(r)) AS run, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS matched FROM (
SELECT c.w, p.hap, p.allele = c.state AS ok, row_number() OVER (PARTITION BY c.w, p.hap ORDER BY c.pos) AS r FROM {calls} c JOIN {psites} vp ON vp.pos = c.pos JOIN {panel} p ON p.k = vp.k WHERE c.state <> 0) AS x GROUP BY w, hap) AS y) AS z WHERE rn <= :top""", matching.prefix_runs, top=16)
define("F5_window_shortlist", "w long, reads long, snps long, rn int", "SELECT w, reads, snps, rn FROM (SELECT *, row_number() OVER (ORDER BY snps DESC, reads DESC, w) AS rn FROM {manifest}) AS x WHERE rn <= :top", top=10)

define("G1_union_windows", "source string, w long, pos long, state int, prob double", "SELECT 'calls' AS source, w, pos, state, NULL AS prob FROM {calls} UNION ALL SELECT 'fills' AS source, w, pos, pred AS state, prob FROM {fills}")
define("G2_hybrid_readset", "w long, source string, read string, pos long, allele int, weight double", """
SELECT o.w, 'obs' AS source, CAST(o.read_id AS STRING) AS read, o.pos, o.allele, CASE WHEN t.hp IN ('1', '2') THEN least(1.5, coalesce(o.w2, 0.5) * 1.2) ELSE coalesce(o.w2, 0.5) END AS weight FROM {obs} o JOIN {selected} s ON s.w = o.w AND s.read_id = o.read_id JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id WHERE o.allele <> 0
UNION ALL SELECT w, 'super' AS source, 'sr_' || ps || '_' || hp AS read, pos, CASE WHEN v >= 0 THEN 1 ELSE -1 END AS allele, least(1.35, 0.90 + 0.08 * n) AS weight FROM (SELECT o.w, t.ps, t.hp, o.pos, sum(o.allele) AS v, count(DISTINCT o.read_id) AS n FROM {obs} o JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id WHERE t.hp <> 'UNK' AND o.allele <> 0 GROUP BY o.w, t.ps, t.hp, o.pos) AS x WHERE n >= 2""")
define("G3_readsets", "w long, readset string, n long, weight double", """
SELECT w, readset, count(*) AS n, sum(weight) AS weight FROM (SELECT o.w, 'selected' AS readset, coalesce(o.w2, 0.5) AS weight FROM {obs} o JOIN {selected} s ON s.w = o.w AND s.read_id = o.read_id UNION ALL SELECT o.w, 'tagged' AS readset, coalesce(o.w2, 0.5) AS weight FROM {obs} o JOIN {selected} s ON s.w = o.w AND s.read_id = o.read_id JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id WHERE t.hp <> 'UNK'
UNION ALL SELECT w, 'superreads' AS readset, least(1.25, 0.5 + 0.1 * n) AS weight FROM (SELECT o.w, t.ps, t.hp, o.pos, count(DISTINCT o.read_id) AS n FROM {obs} o JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id WHERE t.hp <> 'UNK' GROUP BY o.w, t.ps, t.hp, o.pos) AS z) AS x GROUP BY w, readset""")
define("G4_candidate_queries", "w long, qid string, cand string, cstate int", "SELECT w, 'q' || CAST(pos AS STRING) AS qid, cand, cstate FROM {calls} CROSS JOIN (VALUES ('A', 1), ('B', -1), ('ABSTAIN', 0)) AS t(cand, cstate) WHERE state = 0 OR conf < :min_conf", min_conf=0.7)
define("G5_scaffold_reads", "w long, read string, pos long, allele int, weight double", "SELECT w, 'scaffold_' || block_id AS read, pos, state AS allele, greatest(0.1, :scale * conf) AS weight FROM {calls} WHERE state <> 0 AND conf >= :min_conf", min_conf=0.65, scale=8.0)
define("G6_run_comparison", "w long, n long, changed long, gained long, lost long, delta_conf double", "SELECT a.w, count(*) AS n, sum(CASE WHEN a.state <> b.state AND a.state <> 0 AND b.state <> 0 THEN 1 ELSE 0 END) AS changed, sum(CASE WHEN a.state = 0 AND b.state <> 0 THEN 1 ELSE 0 END) AS gained, sum(CASE WHEN a.state <> 0 AND b.state = 0 THEN 1 ELSE 0 END) AS lost, sum(b.conf - a.conf) AS delta_conf FROM {calls} a JOIN {calls2} b ON a.w = b.w AND a.pos = b.pos GROUP BY a.w")
define("G7_bridge_damage", "w long, kind string, n long", """
SELECT w, kind, count(*) AS n FROM (SELECT a.w, CASE WHEN t.tstate IS NULL THEN 'no_truth' WHEN a.state = t.tstate AND b.state = -t.tstate THEN 'hurt' WHEN a.state = -t.tstate AND b.state = t.tstate THEN 'helped' WHEN a.state <> 0 AND b.state = 0 THEN 'lost' WHEN a.state = 0 AND b.state <> 0 THEN 'recovered' WHEN a.state = t.tstate THEN 'same_correct' WHEN a.state = 0 THEN 'both_abstain' ELSE 'same_wrong' END AS kind
FROM {calls} a JOIN {calls2} b ON a.w = b.w AND a.pos = b.pos LEFT JOIN {truth} t ON t.w = a.w AND t.pos = a.pos) AS x GROUP BY w, kind""")
define("G8_truth_labels", "w long, qid string, cand string, label int", "SELECT q.w, q.qid, q.cand, CASE WHEN t.tstate IS NULL THEN NULL WHEN t.tstate = q.cstate THEN 1 ELSE 0 END AS label FROM {scores} q JOIN {sites} s ON s.w = q.w AND s.pos = q.pos LEFT JOIN {truth} t ON t.w = s.w AND t.pos = s.pos AND t.ref = s.ref AND t.alt = s.alt")
define("G9_training_sites", "w long, pos long, state int, conf double, n long, delta double, label int", "SELECT c.w, c.pos, c.state, c.conf, o.n, o.delta, CASE WHEN c.tstate IS NULL THEN NULL WHEN c.state = c.tstate THEN 1 ELSE 0 END AS label FROM (SELECT m.*, k.conf FROM {cmp} m JOIN {calls} k ON k.w = m.w AND k.pos = m.pos) c JOIN (SELECT w, pos, count(*) AS n, avg(delta) AS delta FROM {obs} GROUP BY w, pos) o ON o.w = c.w AND o.pos = c.pos")
define("G10_fill_training_table", "w long, pos long, pred int, ratio double, margin double, label int", """
SELECT f.w, f.pos, f.pred, (f.plus + 1.0) / (f.minus + 1.0) AS ratio, abs(f.plus - f.minus) AS margin, CASE WHEN t.tstate IS NULL OR o.orientation IS NULL THEN NULL WHEN f.pred * o.orientation = t.tstate THEN 1 ELSE 0 END AS label FROM {fills} f LEFT JOIN {truth} t ON t.w = f.w AND t.pos = f.pos
LEFT JOIN (SELECT w, block_id, CASE WHEN sum(state * tstate) >= 0 THEN 1 ELSE -1 END AS orientation FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL GROUP BY w, block_id) o ON o.w = f.w AND o.block_id = f.block_id""")
define("G11_region_matrix", "w long, win long, sites long, fragments long, positions string", """
SELECT w, win, count(DISTINCT pos) AS sites, max(frs) AS fragments, LAGG(pos|pos) AS positions FROM (SELECT DISTINCT s.w, s.win, s.pos, count(*) OVER (PARTITION BY s.w, s.win) AS frs FROM (SELECT w, pos, IDIV(row_number() OVER (PARTITION BY w ORDER BY pos) - 1|4) AS win FROM {sites}) s JOIN {frags} f ON f.w = s.w AND f.pos = s.pos) AS x GROUP BY w, win""")

define("H1_math_family", "id long, clamped double, log1p_pos double, entropy_e double, entropy_2 double", "SELECT id, greatest(0.1, least(0.9, score)) AS clamped, ln(1.0 + greatest(0.0, score - 0.3)) AS log1p_pos, CASE WHEN score <= 0.0 OR score >= 1.0 THEN 0.0 ELSE -(score * ln(score) + (1.0 - score) * ln(1.0 - score)) END AS entropy_e, CASE WHEN score <= 0.0 OR score >= 1.0 THEN 0.0 ELSE -(score * log2(score) + (1.0 - score) * log2(1.0 - score)) END AS entropy_2 FROM {labelled}")
define("H2_logsumexp", "method string, lse double, effn double, entropy double", "SELECT method, max(mx) + ln(sum(exp(score - mx))) AS lse, sum(score) * sum(score) / sum(score * score) AS effn, -sum(score / tot * ln(score / tot + 0.000000001)) AS entropy FROM (SELECT *, max(score) OVER (PARTITION BY method) AS mx, sum(score) OVER (PARTITION BY method) AS tot FROM {labelled}) AS x GROUP BY method")
define("H3_interpolate_cm", "w long, pos long, cm double", """
SELECT s.w, s.pos, CASE WHEN m.bp IS NULL THEN CASE WHEN s.pos < lim.b0 THEN lim.c0 ELSE lim.c1 END ELSE m.cm + (m.ncm - m.cm) * (s.pos - m.bp) / (m.nbp - m.bp) END AS cm FROM {sites} s CROSS JOIN (SELECT min(bp) AS b0, min(cm) AS c0, max(cm) AS c1 FROM {gmap}) lim
LEFT JOIN (SELECT bp, cm, lead(bp) OVER (ORDER BY bp) AS nbp, lead(cm) OVER (ORDER BY bp) AS ncm FROM {gmap}) m ON s.pos >= m.bp AND s.pos < m.nbp""", in_centimorgans("SELECT w, pos FROM {sites}", "w"), map_width=100_000)
define("H4_decay_weights", "w long, pos long, hyper double, expo double, excm double, hypercm double", "SELECT w, pos, 1.0 / (1.0 + d / 5000.0) AS hyper, exp(-d / 50000.0) AS expo, exp(-d / 1000000.0 / 0.05) AS excm, 1.0 / (1.0 + d / 1000000.0 / 0.05) AS hypercm FROM (SELECT w, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY w ORDER BY pos) AS d FROM {sites}) AS x")
define("H5_sequence_context", "key long, gc double, entropy double", """
SELECT key, (length(s) - length(replace(replace(s, 'g', ''), 'c', ''))) / (length(s) * 1.0) AS gc, (SELECT 0.0) - (CASE WHEN a > 0 THEN a / n * log2(a / n) ELSE 0.0 END + CASE WHEN c > 0 THEN c / n * log2(c / n) ELSE 0.0 END + CASE WHEN g > 0 THEN g / n * log2(g / n) ELSE 0.0 END + CASE WHEN t > 0 THEN t / n * log2(t / n) ELSE 0.0 END) AS entropy
FROM (SELECT key, s, length(s) * 1.0 AS n, (length(s) - length(replace(s, 'a', ''))) * 1.0 AS a, (length(s) - length(replace(s, 'c', ''))) * 1.0 AS c, (length(s) - length(replace(s, 'g', ''))) * 1.0 AS g, (length(s) - length(replace(s, 't', ''))) * 1.0 AS t FROM (SELECT p_partkey AS key, lower(p_name || p_type) AS s FROM {part}) AS x) AS y""")
define("H6_array_match", "a long, b long, same long, first int", "SELECT x.vec_id AS a, y.vec_id AS b, SUMSAME AS same, CASE WHEN ELEM(x.embedding, 1) > ELEM(y.embedding, 1) THEN 1 ELSE 0 END AS first FROM {embeddings} x JOIN {embeddings} y ON x.label = y.label AND y.vec_id > x.vec_id AND y.vec_id < x.vec_id + 60".replace("SUMSAME", " + ".join(f"CASE WHEN (ELEM(x.embedding, {i}) > 0) = (ELEM(y.embedding, {i}) > 0) THEN 1 ELSE 0 END" for i in range(1, 17))))
define("H7_bins", "bin string, n long", "SELECT CASE WHEN score < 0.25 THEN 'q1' WHEN score < 0.5 THEN 'q2' WHEN score < 0.75 THEN 'q3' ELSE 'q4' END AS bin, count(*) AS n FROM {labelled} GROUP BY 1")
define("H8_lenient_casts", "id long, i long, f double, truthy int", "SELECT event_id AS id, coalesce(TRY_CAST(split_part(event_type, '_', 2) AS BIGINT), -1) AS i, coalesce(TRY_CAST(CAST(user_id AS STRING) || '.5' AS DOUBLE), 0.0) AS f, CASE WHEN lower(trim(event_type)) IN ('1', 'true', 'yes') THEN 1 ELSE 0 END AS truthy FROM {events}")
