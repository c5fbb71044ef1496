"""Aggregations (D): evidence, panel votes, features, truth metrics, reports."""

from ..plans.operator import define
from . import matching
from .filters import _PANEL_RECORDS

_VOTE = "greatest(0.1, coalesce(w2, 0.0)) * greatest(1, baseq) / 40.0"
define("D1_fragment_collapse", "w long, read_id long, n long, positions string, alleles string, score double", """
SELECT w, read_id, count(*) AS n, LAGG(pos|pos) AS positions, LAGG(allele|pos) AS alleles, sum(weight) AS score FROM (SELECT w, read_id, pos, CASE WHEN plus > minus THEN 1 ELSE -1 END AS allele, greatest(:lo, least(:hi, round(abs(plus - minus), 6))) AS weight FROM (
SELECT w, read_id, pos, sum(CASE WHEN allele > 0 THEN coalesce(w2, 0.5) ELSE 0.0 END) AS plus, sum(CASE WHEN allele < 0 THEN coalesce(w2, 0.5) ELSE 0.0 END) AS minus FROM {obs} WHERE allele <> 0 GROUP BY w, read_id, pos) AS x WHERE abs(plus - minus) > 0.000001) AS y
GROUP BY w, read_id HAVING count(*) >= :min_sites""", lo=0.05, hi=10.0, min_sites=2)
define("D2_best_observation", "w long, read_id long, pos long, idx long, allele int", "SELECT w, read_id, pos, idx, allele FROM (SELECT *, row_number() OVER (PARTITION BY w, read_id, pos ORDER BY baseq + mapq DESC, idx, baseq, allele, delta, conf, amb) AS rn FROM {obs}) AS x WHERE rn = 1")
#: Sums of exact decimals: the same in any order.
SUPPORT = """SELECT w, pos, CAST(round(sum(CASE WHEN allele > 0 THEN wt ELSE CAST(0 AS DECIMAL(24, 12)) END), 6) AS DOUBLE) AS alt, CAST(round(sum(CASE WHEN allele < 0 THEN wt ELSE CAST(0 AS DECIMAL(24, 12)) END), 6) AS DOUBLE) AS ref, count(*) AS n FROM (
SELECT w, pos, allele, CAST(coalesce(w2, greatest(0.0, least(1.0, baseq / 40.0)) * greatest(0.0, least(1.0, mapq / 60.0))) * (1.0 + 0.2 * conf) * (CASE WHEN abs(delta) >= 0.75 THEN 1.05 ELSE 1.0 END) AS DECIMAL(24, 12)) AS wt
FROM (SELECT *, count(*) OVER (PARTITION BY w, read_id) AS linked FROM {obs}) AS o WHERE linked >= 2 AND amb = 0 AND allele <> 0 AND NOT (abs(delta) >= 0.75 AND delta * allele < 0)) AS x GROUP BY w, pos"""
define("D3_site_support", "w long, pos long, alt double, ref double, n long", SUPPORT)
COMBINE = f"""SELECT w, pos, CASE WHEN total <= 0 THEN CASE WHEN bias > 0.2 THEN 1 WHEN bias < -0.2 THEN -1 ELSE 0 END WHEN comb > 0.05 THEN 1 WHEN comb < -0.05 THEN -1 ELSE 0 END AS state,
CASE WHEN total <= 0 THEN 0.5 * abs(bias) WHEN abs(comb) > 0.05 THEN greatest(0.5, least(1.0, abs(comb))) ELSE 0.0 END AS conf FROM (
SELECT w, pos, total, bias, CASE WHEN total > 0 THEN (alt - ref) / total + 0.2 * bias ELSE bias END AS comb FROM (
SELECT s.w, s.pos, coalesce(x.alt, 0.0) AS alt, coalesce(x.ref, 0.0) AS ref, coalesce(x.alt + x.ref, 0.0) AS total, coalesce(d.bias, 0.0) AS bias FROM {{sites}} s LEFT JOIN ({SUPPORT}) x ON x.w = s.w AND x.pos = s.pos LEFT JOIN {{bias}} d ON d.w = s.w AND d.pos = s.pos) AS y) AS z"""
define("D4_read_donor_combine", "w long, pos long, state int, conf double", COMBINE)
define("D5_bundle_score", "w long, read_id long, n long, score double", """
SELECT w, read_id, count(*) AS n, 3.0 * (count(*) - 1) + count(*) + 0.25 * sum(0.5 + 0.5 * least(1.0, baseq / 40.0) * least(1.0, mapq / 60.0)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY w, read_id, pos ORDER BY baseq + mapq DESC, idx, baseq, allele, delta, conf, amb) AS rn FROM {obs}) AS x WHERE rn = 1 GROUP BY w, read_id""")
SUMMARY = """SELECT w, block_id, s, e, informative, abstained, signed, total, CASE WHEN total > 0 THEN signed / total ELSE 0.0 END AS bias, CASE WHEN informative > 0 THEN total / informative ELSE 0.0 END AS mean_conf,
CASE WHEN total > 0 THEN abs(signed) / total ELSE 0.0 END AS coherence FROM (SELECT w, block_id, min(pos) AS s, max(pos) AS e, sum(CASE WHEN state <> 0 THEN 1 ELSE 0 END) AS informative, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) AS abstained,
sum(state * conf) AS signed, sum(CASE WHEN state <> 0 THEN conf ELSE 0.0 END) AS total FROM {calls} WHERE block_id <> 'unassigned' GROUP BY w, block_id) AS x"""
define("D6_block_summary", "w long, block_id string, informative long, abstained long, signed double, total double, bias double, mean_conf double, coherence double", SUMMARY)
define("D7_superread_consensus", "w long, ps string, hp string, pos long, allele int, n long, margin double", f"""
SELECT w, ps, hp, pos, CASE WHEN alt >= ref THEN 1 ELSE -1 END AS allele, n, abs(alt - ref) AS margin FROM (SELECT o.w, t.ps, t.hp, o.pos, count(DISTINCT o.read_id) AS n, sum(CASE WHEN allele > 0 THEN {_VOTE} ELSE 0.0 END) AS alt, sum(CASE WHEN allele < 0 THEN {_VOTE} ELSE 0.0 END) AS ref
FROM {{obs}} o JOIN {{tags}} t ON o.w = t.w AND o.read_id = t.read_id WHERE t.hp <> 'UNK' AND o.allele <> 0 GROUP BY o.w, t.ps, t.hp, o.pos) AS x WHERE n >= :min_support""", min_support=2)
TAGGED = """SELECT w, read_id, block_id, n, c1, c2, abs(c1 - c2) AS margin, CASE WHEN abs(c1 - c2) < :min_margin THEN 'UNK' WHEN c1 < c2 THEN '1' ELSE '2' END AS hp FROM (
SELECT *, row_number() OVER (PARTITION BY w, read_id ORDER BY abs(c1 - c2) DESC, first_pos) AS rn FROM (SELECT o.w, o.read_id, c.block_id, count(*) AS n, min(o.pos) AS first_pos, sum(CASE WHEN o.allele <> c.state THEN o.baseq ELSE 0 END) AS c1, sum(CASE WHEN o.allele = c.state THEN o.baseq ELSE 0 END) AS c2
FROM {obs} o JOIN {calls} c ON o.w = c.w AND o.pos = c.pos WHERE o.allele <> 0 AND c.state <> 0 GROUP BY o.w, o.read_id, c.block_id) AS x) AS y WHERE rn = 1"""
define("D8_haplotag", "w long, read_id long, block_id string, n long, c1 long, c2 long, margin long, hp string", TAGGED, min_margin=5)
_ANCHORED = """(SELECT w, pos, apos, state, block_id, abs(apos - pos) AS d, CASE WHEN apos < pos THEN 'L' ELSE 'R' END AS side FROM (
SELECT *, row_number() OVER (PARTITION BY w, pos, CASE WHEN apos < pos THEN 'L' ELSE 'R' END ORDER BY abs(apos - pos), apos) AS rn FROM (SELECT f.w, f.pos, c.pos AS apos, c.state, c.block_id FROM (SELECT DISTINCT w, pos, IDIV(pos|500) + d AS bucket FROM {fills} CROSS JOIN (VALUES (-1), (0), (1)) AS n(d)) f
JOIN (SELECT w, pos, state, block_id, IDIV(pos|500) AS bucket FROM {calls} WHERE state <> 0) c ON f.w = c.w AND f.bucket = c.bucket AND abs(c.pos - f.pos) <= 500 AND c.pos <> f.pos) AS q) AS t WHERE rn <= 4)"""
_HAPS = f"""(SELECT n.w, n.pos, n.apos, n.block_id, n.state, n.d, n.side, x.hap, x.donor, x.grp, x.allele AS target, y.allele AS anchor FROM {_ANCHORED} n JOIN {{psites}} vx ON vx.pos = n.pos JOIN {{panel}} x ON x.k = vx.k JOIN {{psites}} vy ON vy.pos = n.apos JOIN {{panel}} y ON y.k = vy.k AND y.hap = x.hap)"""
#: On Spark the panel is one array of alleles a site (al, 0: none), in the order of haplotypes; a pair of sites or an anchor costs one array expression.
_ARRAYS = """hj AS (SELECT hap, donor, grp, CAST(row_number() OVER (ORDER BY hap) - 1 AS INT) AS j FROM (SELECT DISTINCT hap, donor, grp FROM {panel}) AS u),
P AS (SELECT k, a.hap AS hs, a.donor AS dn, a.grp AS gn, transform(a.hap, h -> CAST(coalesce(element_at(m, h), 0) AS TINYINT)) AS al FROM (SELECT k, map_from_entries(collect_list(struct(hap, allele))) AS m FROM {panel} GROUP BY k) AS e CROSS JOIN (SELECT array_sort(collect_list(struct(j, hap, donor, grp))) AS a FROM hj) AS names)"""
_PLACED = f"""n AS (SELECT n.*, vx.k, vy.k AS ka FROM {_ANCHORED} n JOIN {{psites}} vx ON vx.pos = n.pos JOIN {{psites}} vy ON vy.pos = n.apos), {_ARRAYS}"""
_SITED = f"""{_PLACED}, Z AS (SELECT q.k, q.ka, x.dn, zip_with(x.al, y.al, (a, b) -> CAST(a * b AS INT)) AS z FROM (SELECT DISTINCT k, ka FROM n) q JOIN P x ON x.k = q.k JOIN P y ON y.k = q.ka)"""
define("D9_panel_ld_vote", "w long, pos long, block_id string, plus double, minus double, haps long, samples long, anchors long", f"""
SELECT w, pos, block_id, sum(CASE WHEN target * anchor * state > 0 THEN 1.0 / (1.0 + d / 5000.0) ELSE 0.0 END) AS plus, sum(CASE WHEN target * anchor * state < 0 THEN 1.0 / (1.0 + d / 5000.0) ELSE 0.0 END) AS minus,
count(*) AS haps, count(DISTINCT donor) AS samples, count(DISTINCT apos) AS anchors FROM {_HAPS} AS h GROUP BY w, pos, block_id HAVING count(DISTINCT donor) >= :min_samples""", f"""WITH {_SITED}, ld AS (SELECT k, ka, size(filter(z, v -> v > 0)) AS up, size(filter(z, v -> v < 0)) AS down, size(array_distinct(filter(zip_with(z, dn, (v, d) -> CASE WHEN v <> 0 THEN d END), d -> d IS NOT NULL))) AS samples FROM Z)
SELECT w, pos, block_id, sum((CASE WHEN state > 0 THEN up ELSE down END) / (1.0 + d / 5000.0)) AS plus, sum((CASE WHEN state > 0 THEN down ELSE up END) / (1.0 + d / 5000.0)) AS minus,
sum(up + down) AS haps, max(samples) AS samples, count(DISTINCT apos) AS anchors FROM n JOIN ld ON ld.k = n.k AND ld.ka = n.ka GROUP BY w, pos, block_id HAVING max(samples) >= :min_samples""", min_samples=5)
define("D10_template_fill", "w long, pos long, comp long, plus double, minus double, templates long", """
SELECT f.w, f.pos, o.comp, sum(CASE WHEN f.allele * o.orient > 0 THEN f.weight ELSE 0.0 END) AS plus, sum(CASE WHEN f.allele * o.orient < 0 THEN f.weight ELSE 0.0 END) AS minus, count(DISTINCT f.read_id) AS templates
FROM {frags} f JOIN (SELECT f.w, f.read_id, c.comp, CASE WHEN sum(f.weight * f.allele * c.state) > 0 THEN 1 ELSE -1 END AS orient FROM {frags} f JOIN {comps} c ON f.w = c.w AND f.pos = c.pos GROUP BY f.w, f.read_id, c.comp HAVING round(abs(sum(f.weight * f.allele * c.state)), 6) >= :margin) o ON o.w = f.w AND o.read_id = f.read_id
LEFT JOIN {comps} own ON own.w = f.w AND own.pos = f.pos WHERE own.pos IS NULL GROUP BY f.w, f.pos, o.comp""", margin=0.1)
BRIDGES = """SELECT w, a, b, CASE WHEN plus >= minus THEN 1 ELSE -1 END AS sgn, pw, mw, plus, minus, abs(pw - mw) AS margin FROM (SELECT w, a, b, sum(CASE WHEN sg > 0 THEN wt ELSE 0.0 END) AS pw, sum(CASE WHEN sg < 0 THEN wt ELSE 0.0 END) AS mw,
sum(CASE WHEN sg > 0 THEN 1 ELSE 0 END) AS plus, sum(CASE WHEN sg < 0 THEN 1 ELSE 0 END) AS minus FROM (SELECT x.w, x.comp AS a, y.comp AS b, sign(x.v) * sign(y.v) AS sg, least(abs(x.v), abs(y.v)) AS wt FROM VOTES x JOIN VOTES y ON x.w = y.w AND x.read_id = y.read_id AND x.comp < y.comp) AS p GROUP BY w, a, b) AS q""".replace("VOTES", """(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY w, read_id) AS comps FROM (SELECT f.w, f.read_id, c.comp, sum(f.weight * f.allele * c.state) AS v FROM {frags} f JOIN {comps} c ON f.w = c.w AND f.pos = c.pos GROUP BY f.w, f.read_id, c.comp) AS v0 WHERE round(abs(v), 6) >= :min_vote) AS v1 WHERE comps <= :max_comps)""")
define("D11_component_bridges", "w long, a long, b long, sgn int, pw double, mw double, plus long, minus long", BRIDGES, min_vote=0.02, max_comps=8)
define("D12_interval_orientation", "w long, lo long, hi long, pairs long, keep double, flip double, accepted int", """
SELECT w, lo, hi, count(*) AS pairs, sum(CASE WHEN sg > 0 THEN wt ELSE 0.0 END) AS keep, sum(CASE WHEN sg < 0 THEN wt ELSE 0.0 END) AS flip, CASE WHEN count(*) >= :pairs AND round(abs(sum(sg * wt)), 6) >= :margin THEN 1 ELSE 0 END AS accepted
FROM (SELECT x.w, a.pos AS lo, a.nxt AS hi, x.allele * a.state * y.allele * a.nstate AS sg, least(x.weight, y.weight) AS wt FROM (SELECT w, pos, state, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS nxt, lead(state) OVER (PARTITION BY w ORDER BY pos) AS nstate FROM {calls} WHERE state <> 0) a
JOIN {frags} x ON x.w = a.w AND x.pos = a.pos JOIN {frags} y ON y.w = a.w AND y.pos = a.nxt AND y.read_id = x.read_id) AS z GROUP BY w, lo, hi""", pairs=2, margin=0.5)
#: Each open site with its anchors (nearest ones of each side within the map distance) and what a centimorgan takes off.
_NEAR_IN_CM = """(
    SELECT w, pos, apos, state, exp(-dcm / :decay_cm) AS wt
    FROM (
        SELECT f.w, f.pos, c.pos AS apos, c.state, abs(x.cm - y.cm) AS dcm, row_number() OVER (PARTITION BY f.w, f.pos, CASE WHEN c.pos < f.pos THEN 0 ELSE 1 END ORDER BY abs(c.pos - f.pos)) AS rn
        FROM (SELECT DISTINCT w, pos FROM {fills}) f
        JOIN {calls} c ON c.w = f.w AND c.pos <> f.pos AND c.state <> 0
        JOIN {sitecm} x ON x.pos = f.pos
        JOIN {sitecm} y ON y.pos = c.pos
        WHERE abs(x.cm - y.cm) <= :max_cm
    ) AS q
    WHERE rn <= :each_side
)"""
#: Per haplotype, as the words go: a prior for each population, and support from haplotypes that copy the anchors (or their opposites) by what they carry at the site.
_ANCESTRY_BY_HAPLOTYPE = f"""
WITH n AS {_NEAR_IN_CM},
size AS (SELECT grp, count(DISTINCT hap) AS haps FROM {{panel}} GROUP BY grp),
seen AS (SELECT n.w, n.pos, n.wt, n.state, n.apos, p.hap, p.grp, p.allele FROM n JOIN {{psites}} v ON v.pos = n.apos JOIN {{panel}} p ON p.k = v.k WHERE p.allele <> 0),
prior AS (SELECT w, pos, grp, share / sum(share) OVER (PARTITION BY w, pos) AS prior FROM (SELECT s.w, s.pos, s.grp, sum(s.wt) / max(z.haps) AS share FROM seen s JOIN size z ON z.grp = s.grp GROUP BY s.w, s.pos, s.grp) AS q),
hap AS (SELECT w, pos, hap, grp, sum(CASE WHEN allele = state THEN wt ELSE 0.0 END) AS copies, sum(CASE WHEN allele = -state THEN wt ELSE 0.0 END) AS opposes FROM seen GROUP BY w, pos, hap, grp),
vote AS (SELECT h.w, h.pos, h.grp, CASE WHEN t.allele > 0 THEN h.copies ELSE h.opposes END AS plus, CASE WHEN t.allele > 0 THEN h.opposes ELSE h.copies END AS minus FROM hap h JOIN {{psites}} v ON v.pos = h.pos JOIN {{panel}} t ON t.k = v.k AND t.hap = h.hap WHERE t.allele <> 0),
total AS (SELECT v.w, v.pos, sum(v.plus * p.prior) AS wp, sum(v.minus * p.prior) AS wm, sum(v.plus) AS up, sum(v.minus) AS um FROM vote v JOIN prior p ON p.w = v.w AND p.pos = v.pos AND p.grp = v.grp GROUP BY v.w, v.pos),
spread AS (SELECT w, pos, max(prior) AS top, sum(CASE WHEN prior > 0 THEN -prior * ln(prior) ELSE 0.0 END) AS entropy, sum(prior) * sum(prior) / sum(prior * prior) AS effective, sum(CASE WHEN prior > 0.001 THEN 1 ELSE 0 END) AS pops FROM prior GROUP BY w, pos)
"""
#: On Spark a pair of sites is counted once for each population; a site then costs a row for each anchor and population, whatever the number of haplotypes.
_ANCESTRY_BY_PAIR = f"""
WITH n AS (SELECT a.*, vx.k, vy.k AS ka FROM {_NEAR_IN_CM} AS a JOIN {{psites}} vx ON vx.pos = a.pos JOIN {{psites}} vy ON vy.pos = a.apos), {_ARRAYS},
members AS (SELECT grp, collect_list(j) AS js FROM hj GROUP BY grp),
pairs AS (SELECT q.k, q.ka, x.al AS target, y.al AS anchor FROM (SELECT DISTINCT k, ka FROM n) q JOIN P x ON x.k = q.k JOIN P y ON y.k = q.ka),
ld AS (SELECT k, ka, grp, size(js) AS haps, size(filter(js, j -> target[j] * anchor[j] > 0)) AS same, size(filter(js, j -> target[j] * anchor[j] < 0)) AS other, size(filter(js, j -> anchor[j] <> 0)) AS known FROM pairs CROSS JOIN members),
vote AS (SELECT n.w, n.pos, ld.grp, sum(n.wt * CASE WHEN n.state > 0 THEN same ELSE other END) AS plus, sum(n.wt * CASE WHEN n.state > 0 THEN other ELSE same END) AS minus, sum(n.wt * known) / max(haps) AS share FROM n JOIN ld ON ld.k = n.k AND ld.ka = n.ka GROUP BY n.w, n.pos, ld.grp),
prior AS (SELECT *, share / sum(share) OVER (PARTITION BY w, pos) AS prior FROM vote),
total AS (SELECT w, pos, sum(plus * prior) AS wp, sum(minus * prior) AS wm, sum(plus) AS up, sum(minus) AS um FROM prior GROUP BY w, pos),
spread AS (SELECT w, pos, max(prior) AS top, sum(CASE WHEN prior > 0 THEN -prior * ln(prior) ELSE 0.0 END) AS entropy, sum(prior) * sum(prior) / sum(prior * prior) AS effective, sum(CASE WHEN prior > 0.001 THEN 1 ELSE 0 END) AS pops FROM prior GROUP BY w, pos)
"""
_ANCESTRY = """
SELECT t.w, t.pos, wp AS plus, wm AS minus, c AS confidence, u AS plain_confidence, c - u AS delta, ln((wp + 1.0) / (wm + 1.0)) AS log_margin, s.top AS top_prior, s.entropy, s.effective, s.pops
FROM (SELECT *, CASE WHEN wp + wm > 0 THEN greatest(wp, wm) / (wp + wm) ELSE 0.0 END AS c, CASE WHEN up + um > 0 THEN greatest(up, um) / (up + um) ELSE 0.0 END AS u FROM total) AS t
JOIN spread s ON s.w = t.w AND s.pos = t.pos"""
define(
    "D16_ancestry_features", "w long, pos long, plus double, minus double, confidence double, plain_confidence double, delta double, log_margin double, top_prior double, entropy double, effective double, pops long",
    _ANCESTRY_BY_HAPLOTYPE + _ANCESTRY, _ANCESTRY_BY_PAIR + _ANCESTRY, decay_cm=0.05, max_cm=0.25, each_side=16,
)
_PAIR = """(SELECT a.w, a.block_id AS a, b.block_id AS b, b.s - a.e AS gap FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s) AS r FROM {blocks}) a JOIN (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s) AS r FROM {blocks}) b ON a.w = b.w AND b.r = a.r + 1)"""
_EDGE = """(SELECT w, block_id, pos, state, row_number() OVER (PARTITION BY w, block_id ORDER BY pos DESC) AS last_rn, row_number() OVER (PARTITION BY w, block_id ORDER BY pos) AS first_rn FROM {calls} WHERE state <> 0)"""
define("D19_edge_anchors", "w long, a string, b string, side string, pos long, state int", f"""
SELECT p.w, p.a, p.b, 'a' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.a AND x.last_rn <= :n UNION ALL SELECT p.w, p.a, p.b, 'b' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.b AND x.first_rn <= :n""", n=12)
define("D18_bridge_score", "w long, a string, b string, same double, flip double, relation int, confidence double, margin double, effn double", f"""
SELECT w, a, b, same, flip, CASE WHEN same >= flip THEN 1 ELSE -1 END AS relation, greatest(same, flip) / (same + flip + 0.000001) AS confidence, abs(same - flip) AS margin, effn FROM (
SELECT w, a, b, sum(s) AS same, sum(f) AS flip, sum(s + f) * sum(s + f) / (sum((s + f) * (s + f)) + 0.000001) AS effn FROM (SELECT *, row_number() OVER (PARTITION BY w, a, b ORDER BY round(s + f, 9) DESC, hap) AS rn FROM (SELECT w, a, b, hap, least(ap, bp) + least(am, bm) AS s, least(ap, bm) + least(am, bp) AS f FROM (
SELECT e.w, e.a, e.b, h.hap, sum(CASE WHEN e.side = 'a' AND h.allele = e.state THEN 1.0 ELSE 0.0 END) AS ap, sum(CASE WHEN e.side = 'a' AND h.allele <> e.state THEN 1.0 ELSE 0.0 END) AS am, sum(CASE WHEN e.side = 'b' AND h.allele = e.state THEN 1.0 ELSE 0.0 END) AS bp, sum(CASE WHEN e.side = 'b' AND h.allele <> e.state THEN 1.0 ELSE 0.0 END) AS bm
FROM (SELECT p.w, p.a, p.b, 'a' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.a AND x.last_rn <= 12 UNION ALL SELECT p.w, p.a, p.b, 'b' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.b AND x.first_rn <= 12) AS e
JOIN {{psites}} vh ON vh.pos = e.pos JOIN {{panel}} h ON h.k = vh.k GROUP BY e.w, e.a, e.b, h.hap) AS m) AS n) AS o WHERE rn <= :top GROUP BY w, a, b) AS z""", f"""WITH {_ARRAYS}, e AS (SELECT p.w, p.a, p.b, 'a' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.a AND x.last_rn <= 12 UNION ALL SELECT p.w, p.a, p.b, 'b' AS side, x.pos, x.state FROM {_PAIR} AS p JOIN {_EDGE} AS x ON x.w = p.w AND x.block_id = p.b AND x.first_rn <= 12),
ex AS (SELECT e.w, e.a, e.b, collect_list(struct(e.side, e.state, y.al)) AS xs FROM e JOIN {{psites}} v ON v.pos = e.pos JOIN P y ON y.k = v.k GROUP BY e.w, e.a, e.b),
m AS (SELECT w, a, b, size(filter(xs, x -> x.side = 'a')) AS na, size(filter(xs, x -> x.side = 'b')) AS nb, aggregate(filter(xs, x -> x.side = 'a'), transform(xs[0].al, c -> 0), (s, x) -> zip_with(s, x.al, (u, c) -> CASE WHEN c = x.state THEN u + 1 ELSE u END)) AS ap,
aggregate(filter(xs, x -> x.side = 'b'), transform(xs[0].al, c -> 0), (s, x) -> zip_with(s, x.al, (u, c) -> CASE WHEN c = x.state THEN u + 1 ELSE u END)) AS bp FROM ex),
sf AS (SELECT w, a, b, zip_with(ap, bp, (x, y) -> struct(least(x, y) + least(na - x, nb - y) AS s, least(x, nb - y) + least(na - x, y) AS f)) AS q FROM m),
o AS (SELECT w, a, b, slice(array_sort(transform(q, (x, i) -> struct(-(x.s + x.f) AS o, i, x.s, x.f))), 1, :top) AS t FROM sf)
SELECT w, a, b, same, flip, CASE WHEN same >= flip THEN 1 ELSE -1 END AS relation, greatest(same, flip) / (same + flip + 0.000001) AS confidence, abs(same - flip) AS margin, effn FROM (
SELECT w, a, b, aggregate(t, 0.0, (u, x) -> u + x.s) AS same, aggregate(t, 0.0, (u, x) -> u + x.f) AS flip, aggregate(t, 0.0, (u, x) -> u - x.o) * aggregate(t, 0.0, (u, x) -> u - x.o) / (aggregate(t, 0.0, (u, x) -> u + x.o * x.o) + 0.000001) AS effn FROM o) AS z""", top=64)
define("D20_group_donor_prior", "w long, pos long, grp string, score double, rn int", """
SELECT w, pos, grp, score, rn FROM (SELECT w, pos, grp, score, row_number() OVER (PARTITION BY w, pos ORDER BY round(score, 9) DESC, grp) AS rn FROM (SELECT q.w, q.pos, p.grp, sum(a.conf / (1.0 + abs(a.pos - q.pos) / 100.0) * ln((p.pl + 1.0) / (p.mi + 1.0)) * a.state) AS score
FROM (SELECT DISTINCT w, pos, IDIV(pos|1200) + d AS bucket FROM {scores} CROSS JOIN (VALUES (-1), (0), (1)) AS n(d)) q JOIN (SELECT *, IDIV(pos|1200) AS bucket FROM {calls} WHERE state <> 0) a ON a.w = q.w AND a.bucket = q.bucket AND abs(a.pos - q.pos) <= 1200 AND a.pos <> q.pos
JOIN {psites} va ON va.pos = a.pos JOIN (SELECT grp, k, sum(CASE WHEN allele > 0 THEN 1.0 ELSE 0.0 END) AS pl, sum(CASE WHEN allele < 0 THEN 1.0 ELSE 0.0 END) AS mi FROM {panel} GROUP BY grp, k) p ON p.k = va.k GROUP BY q.w, q.pos, p.grp) AS x) AS y WHERE rn <= :top""", top=2)
define("D21_local_donor_prior", "w long, pos long, support double, oppose double, donors long", """
SELECT w, pos, sum(CASE WHEN target > 0 THEN greatest(score, 0.0) ELSE 0.0 END) AS support, sum(CASE WHEN target < 0 THEN greatest(score, 0.0) ELSE 0.0 END) AS oppose, count(*) AS donors FROM (SELECT *, row_number() OVER (PARTITION BY w, pos ORDER BY round(score, 9) DESC, agree DESC, hap) AS rn FROM (
SELECT q.w, q.pos, h.hap, max(t.allele) AS target, sum(CASE WHEN h.allele = a.state THEN 1 ELSE -1 END * greatest(0.1, a.conf)) AS score, sum(CASE WHEN h.allele = a.state THEN 1 ELSE 0 END) AS agree FROM (SELECT DISTINCT w, pos, IDIV(pos|800) + d AS bucket FROM {scores} CROSS JOIN (VALUES (-1), (0), (1)) AS n(d)) q JOIN (SELECT *, IDIV(pos|800) AS bucket FROM {calls} WHERE state <> 0) a ON a.w = q.w AND a.bucket = q.bucket AND abs(a.pos - q.pos) <= 800 AND a.pos <> q.pos
JOIN {psites} vh ON vh.pos = a.pos JOIN {panel} h ON h.k = vh.k JOIN {psites} vt ON vt.pos = q.pos JOIN {panel} t ON t.k = vt.k AND t.hap = h.hap GROUP BY q.w, q.pos, h.hap) AS x) AS y WHERE rn <= :top GROUP BY w, pos""", matching.local_prior, top=16)
define("D22_realign_features", "w long, qid string, cand string, support double, oppose double", """
SELECT q.w, q.qid, q.cand, sum(CASE WHEN (t.hp = '1' AND o.allele = q.cstate) OR (t.hp = '2' AND o.allele = -q.cstate) THEN greatest(0.01, abs(o.delta) * greatest(0.01, o.conf)) ELSE 0.0 END) AS support,
sum(CASE WHEN (t.hp = '1' AND o.allele = q.cstate) OR (t.hp = '2' AND o.allele = -q.cstate) THEN 0.0 ELSE greatest(0.01, abs(o.delta) * greatest(0.01, o.conf)) END) AS oppose FROM {scores} q JOIN {obs} o ON o.w = q.w AND o.pos = q.pos LEFT JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id WHERE o.allele <> 0 GROUP BY q.w, q.qid, q.cand""")
define("D23_scaffold_support", "w long, pos long, sel long, hp1 long, hp2 long, conf double, reasons string", """
SELECT c.w, c.pos, coalesce(x.sel, 0) AS sel, coalesce(x.hp1, 0) AS hp1, coalesce(x.hp2, 0) AS hp2, least(1.0, c.conf + (CASE WHEN coalesce(x.sel, 0) >= 2 THEN 0.05 ELSE 0.0 END) + (CASE WHEN coalesce(x.hp1, 0) > 0 AND coalesce(x.hp2, 0) > 0 THEN 0.05 ELSE 0.0 END)) AS conf,
concat_ws(',', CASE WHEN c.state = 0 THEN 'no_state' END, CASE WHEN c.conf < 0.45 THEN 'low_conf' END, CASE WHEN coalesce(x.sel, 0) < 1 THEN 'no_selected' END) AS reasons FROM {calls} c LEFT JOIN (SELECT o.w, o.pos, count(DISTINCT s.read_id) AS sel, count(DISTINCT CASE WHEN t.hp = '1' THEN o.read_id END) AS hp1,
count(DISTINCT CASE WHEN t.hp = '2' THEN o.read_id END) AS hp2 FROM {obs} o LEFT JOIN {selected} s ON s.w = o.w AND s.read_id = o.read_id LEFT JOIN {tags} t ON t.w = o.w AND t.read_id = o.read_id GROUP BY o.w, o.pos) x ON x.w = c.w AND x.pos = c.pos""")
define("D24_pileup_summary", "w long, pos long, n long, alt long, ref long, other long, amb long, baseq double, delta double, tag string", """
SELECT w, pos, n, alt, ref, other, amb, baseq, delta, CASE WHEN delta > 0.2 THEN '1' WHEN delta < -0.2 THEN '2' ELSE 'UNK' END AS tag FROM (SELECT w, pos, count(*) AS n, sum(CASE WHEN allele > 0 THEN 1 ELSE 0 END) AS alt, sum(CASE WHEN allele < 0 THEN 1 ELSE 0 END) AS ref, sum(CASE WHEN allele = 0 THEN 1 ELSE 0 END) AS other, sum(amb) AS amb, avg(baseq) AS baseq, avg(delta) AS delta FROM {obs} GROUP BY w, pos) AS x""")
ORIENT = """SELECT w, block_id, same, opp, CASE WHEN same + opp < :min_sites THEN 0 WHEN same > opp THEN 1 WHEN same < opp THEN -1 ELSE :tie END AS orientation FROM (SELECT w, block_id, sum(CASE WHEN state = tstate THEN 1 ELSE 0 END) AS same, sum(CASE WHEN state = -tstate THEN 1 ELSE 0 END) AS opp FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL GROUP BY w, block_id) AS x"""
define("D25_block_orientation", "w long, block_id string, same long, opp long, orientation int", ORIENT, min_sites=2, tie=1)
define("D26_filled_audit", "w long, pos long, block_id string, orientation int, correct int", """
SELECT f.w, f.pos, c.block_id, o.orientation, CASE WHEN t.tstate IS NULL OR o.orientation IS NULL OR o.orientation = 0 THEN NULL WHEN f.pred * o.orientation = t.tstate THEN 1 ELSE 0 END AS correct FROM {fills} f JOIN {calls} c ON c.w = f.w AND c.pos = f.pos LEFT JOIN {truth} t ON t.w = f.w AND t.pos = f.pos
LEFT JOIN (SELECT c.w, c.block_id, CASE WHEN sum(c.state * t.tstate) > 0 THEN 1 WHEN sum(c.state * t.tstate) < 0 THEN -1 ELSE 0 END AS orientation FROM {calls} c JOIN {truth} t ON t.w = c.w AND t.pos = c.pos WHERE NOT EXISTS (SELECT 1 FROM {fills} g WHERE g.w = c.w AND g.pos = c.pos) GROUP BY c.w, c.block_id HAVING count(*) >= :min_sites) o ON o.w = f.w AND o.block_id = c.block_id""", min_sites=2)
define("D27_graft_audit", "bin string, n long, correct long", """
SELECT bin, count(*) AS n, sum(CASE WHEN f.pred = t.tstate THEN 1 ELSE 0 END) AS correct FROM (SELECT f.w, f.pos, max(f.pred) AS pred, CASE WHEN min(abs(c.pos - f.pos)) <= 100 THEN '<=100' WHEN min(abs(c.pos - f.pos)) <= 200 THEN '<=200' WHEN min(abs(c.pos - f.pos)) <= 500 THEN '<=500' ELSE '>500' END AS bin
FROM {fills} f JOIN {calls} c ON c.w = f.w AND c.pos BETWEEN f.pos - 2000 AND f.pos + 2000 AND c.state <> 0 AND c.pos <> f.pos GROUP BY f.w, f.pos) f JOIN {truth} t ON t.w = f.w AND t.pos = f.pos GROUP BY bin""")
define("D28_block_mixing", "w long, block_id string, n long, residual long, kind string, breaks long", """
SELECT w, block_id, count(*) AS n, least(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END), sum(CASE WHEN rel < 0 THEN 1 ELSE 0 END)) AS residual, CASE WHEN least(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END), sum(CASE WHEN rel < 0 THEN 1 ELSE 0 END)) = 0 THEN 'pure' ELSE 'mixed' END AS kind, sum(CASE WHEN rel <> prev THEN 1 ELSE 0 END) AS breaks
FROM (SELECT *, lag(rel) OVER (PARTITION BY w, block_id ORDER BY pos) AS prev FROM (SELECT w, block_id, pos, state * tstate AS rel FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL) AS x) AS y GROUP BY w, block_id HAVING count(*) >= 2""")
define("D29_block_membership", "size_bin string, near_bin string, n long", """
SELECT size_bin, near_bin, count(*) AS n FROM (SELECT CASE WHEN b.n IS NULL THEN 'none' WHEN b.n = 1 THEN '1' WHEN b.n <= 3 THEN '2-3' WHEN b.n <= 10 THEN '4-10' ELSE '>10' END AS size_bin, CASE WHEN least(c.pos - c.p, c.q - c.pos) <= 100 THEN '<=100' WHEN coalesce(c.p, c.q) IS NULL THEN 'none' ELSE '>100' END AS near_bin
FROM (SELECT *, lag(pos) OVER (PARTITION BY w ORDER BY pos) AS p, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS q FROM {calls}) c LEFT JOIN {blocks} b ON b.w = c.w AND b.block_id = c.block_id) AS x GROUP BY size_bin, near_bin""")
define("D30_recall_gap", "w long, only_ref long, shared long, only_own long, obs_at_missed double", """
SELECT w, sum(CASE WHEN a = 0 AND b = 1 THEN 1 ELSE 0 END) AS only_ref, sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END) AS shared, sum(CASE WHEN a = 1 AND b = 0 THEN 1 ELSE 0 END) AS only_own, avg(CASE WHEN a = 0 AND b = 1 THEN n END) AS obs_at_missed
FROM (SELECT s.w, s.pos, CASE WHEN c.state <> 0 THEN 1 ELSE 0 END AS a, CASE WHEN t.pos IS NOT NULL THEN 1 ELSE 0 END AS b, o.n FROM {sites} s JOIN {calls} c ON c.w = s.w AND c.pos = s.pos LEFT JOIN {truth} t ON t.w = s.w AND t.pos = s.pos JOIN (SELECT w, pos, count(*) AS n FROM {obs} GROUP BY w, pos) o ON o.w = s.w AND o.pos = s.pos) AS x GROUP BY w""")
TRUTH = """SELECT w, block_id, count(*) AS n, min(pos) AS s, max(pos) AS e, max(pos) - min(pos) + 1 AS span, CASE WHEN sum(CASE WHEN rel < 0 THEN 1 ELSE 0 END) > sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) THEN -1 ELSE 1 END AS polarity,
least(sum(CASE WHEN rel < 0 THEN 1 ELSE 0 END), sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)) AS hamming, sum(CASE WHEN rel <> prev THEN 1 ELSE 0 END) AS switches FROM (SELECT *, lag(rel) OVER (PARTITION BY w, block_id ORDER BY pos) AS prev FROM (SELECT w, block_id, pos, state * tstate AS rel FROM {cmp} WHERE state <> 0 AND tstate IS NOT NULL) AS x) AS y GROUP BY w, block_id"""
define("D31_truth_metrics", "w long, sites long, phased long, hamming long, switches long, opportunities long, coverage double, hamming_rate double, switch_rate double", f"""
SELECT t.w, t.sites, coalesce(m.phased, 0) AS phased, coalesce(m.hamming, 0) AS hamming, coalesce(m.switches, 0) AS switches, coalesce(m.opp, 0) AS opportunities, coalesce(m.phased, 0) / (t.sites * 1.0) AS coverage, coalesce(m.hamming / (m.phased * 1.0), 0.0) AS hamming_rate, CASE WHEN m.opp > 0 THEN m.switches / (m.opp * 1.0) ELSE 0.0 END AS switch_rate
FROM (SELECT w, count(*) AS sites FROM {{cmp}} WHERE tstate IS NOT NULL GROUP BY w) t LEFT JOIN (SELECT w, sum(n) AS phased, sum(hamming) AS hamming, sum(switches) AS switches, sum(n - 1) AS opp FROM ({TRUTH}) AS b GROUP BY w) m ON m.w = t.w""")
define("D31b_block_metrics", "w long, block_id string, n long, s long, e long, span long, polarity int, hamming long, switches long", TRUTH)
define("D32_n50", "w long, n50 long, l50 long, ng50 long", """
SELECT w, coalesce(max(CASE WHEN run * 2 >= total THEN len END), 0) AS n50, coalesce(min(CASE WHEN run * 2 >= total THEN rk END), 0) AS l50, coalesce(max(CASE WHEN run * 2 >= callable THEN len END), 0) AS ng50
FROM (SELECT w, len, sum(len) OVER (PARTITION BY w ORDER BY len DESC, block_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY w ORDER BY len DESC, block_id) AS rk, sum(len) OVER (PARTITION BY w) AS total, callable FROM (SELECT b.w, b.block_id, b.e - b.s + 1 AS len, m.e - m.s AS callable FROM {blocks} b JOIN {manifest} m ON m.w = b.w) AS x) AS y GROUP BY w""")
define("D33_medians", "w long, upper_median long, true_median double, sd double", """
SELECT w, max(CASE WHEN rn = IDIV(n|2) + 1 THEN len END) AS upper_median, median(len) AS true_median, stddev_pop(len) AS sd FROM (SELECT w, e - s + 1 AS len, row_number() OVER (PARTITION BY w ORDER BY e - s, block_id) AS rn, count(*) OVER (PARTITION BY w) AS n FROM {blocks}) AS x GROUP BY w""")
define("D34_method_summary", "cmp string, method string, windows long, rate double, mean_rate double, switch_rate double, mean_n50 double", """
SELECT cmp, method, count(*) AS windows, sum(errors) / sum(truth * 1.0) AS rate, avg(errors / (truth * 1.0)) AS mean_rate, sum(switches) / sum(truth * 1.0) AS switch_rate, avg(n50) AS mean_n50 FROM (SELECT m.*, c.cmp FROM {metrics} m
JOIN (SELECT 'all' AS cmp, win FROM {metrics} GROUP BY win UNION ALL SELECT 'common' AS cmp, win FROM {metrics} GROUP BY win HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM {metrics})) c ON c.win = m.win) AS x GROUP BY cmp, method""")
define("D35_calibration", "method string, feature string, bin string, n long, accuracy double, error double", """
SELECT method, feature, bin, n, accuracy, abs(accuracy - conf) AS error FROM (SELECT method, feature, CASE feature WHEN 'all' THEN 'all' WHEN 'score' THEN CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.7 THEN 'mid' ELSE 'high' END WHEN 'support' THEN CASE WHEN support < 10 THEN '<10' ELSE '>=10' END ELSE CASE WHEN anchors < 4 THEN '<4' ELSE '>=4' END END AS bin,
count(*) AS n, avg(label * 1.0) AS accuracy, avg(score) AS conf FROM {labelled} CROSS JOIN (VALUES ('all'), ('score'), ('support'), ('anchors')) AS f(feature) GROUP BY 1, 2, 3) AS x""")
define("D35b_calibration_sets", "method string, scope string, n long, accuracy double", "SELECT coalesce(method, 'all') AS method, coalesce(scope, 'all') AS scope, n, accuracy FROM (SELECT method, scope, count(*) AS n, avg(label * 1.0) AS accuracy FROM (SELECT *, CASE WHEN grp < 5 THEN 'train' ELSE 'test' END AS scope FROM {labelled}) AS y GROUP BY GROUPING SETS ((method, scope), (method), (scope), ())) AS x")
define("D36_panel_reliance", "w long, read_phased long, method_phased long, filled long, preserved long, changed long, lost long", """
SELECT w, sum(CASE WHEN a <> 0 THEN 1 ELSE 0 END) AS read_phased, sum(CASE WHEN b <> 0 THEN 1 ELSE 0 END) AS method_phased, sum(CASE WHEN a = 0 AND b <> 0 THEN 1 ELSE 0 END) AS filled, sum(CASE WHEN a <> 0 AND b = a THEN 1 ELSE 0 END) AS preserved, sum(CASE WHEN a <> 0 AND b = -a THEN 1 ELSE 0 END) AS changed, sum(CASE WHEN a <> 0 AND b = 0 THEN 1 ELSE 0 END) AS lost
FROM (SELECT coalesce(x.w, y.w) AS w, coalesce(x.state, 0) AS a, coalesce(y.state, 0) AS b FROM {calls} x FULL OUTER JOIN {calls2} y ON x.w = y.w AND x.pos = y.pos) AS z GROUP BY w""")
define("D37_panel_status", "w long, pos long, status string", f"""
SELECT w, pos, CASE max(kind) WHEN 3 THEN 'exact' WHEN 2 THEN 'nonbiallelic' WHEN 1 THEN 'mismatch' ELSE 'missing' END AS status
FROM ({_PANEL_RECORDS}) AS x
GROUP BY w, pos""")
define("D38_feature_bins", "feature string, bin long, n long, accuracy double, mean double", "SELECT feature, CAST(floor(v * 5) AS BIGINT) AS bin, count(*) AS n, avg(label * 1.0) AS accuracy, avg(v) AS mean FROM (SELECT label, feature, CASE feature WHEN 'score' THEN score WHEN 'support' THEN support / 40.0 ELSE anchors / 13.0 END AS v FROM {labelled} CROSS JOIN (VALUES ('score'), ('support'), ('anchors')) AS f(feature)) AS x GROUP BY 1, 2")
define("D39_bad_window_triage", "w long, win long, wrong long, abstain long, correct long, mean_pos double", "SELECT w, IDIV(pos|1000) AS win, sum(CASE WHEN state = -tstate THEN 1 ELSE 0 END) AS wrong, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) AS abstain, sum(CASE WHEN state = tstate THEN 1 ELSE 0 END) AS correct, avg(pos) AS mean_pos FROM {cmp} GROUP BY w, IDIV(pos|1000)")
define("D40_window_statistics", "w long, start long, variants long, reads long, truth long, score double, pass int, rn int", """
SELECT w, start, variants, reads, truth, score, CASE WHEN variants >= :variants AND truth >= :truth THEN 1 ELSE 0 END AS pass, row_number() OVER (PARTITION BY w ORDER BY score DESC, start) AS rn
FROM (
    SELECT b.w, b.start, count(DISTINCT o.pos) AS variants, count(DISTINCT o.read_id) AS reads, count(DISTINCT t.pos) AS truth, count(DISTINCT o.pos) + 0.1 * count(DISTINCT o.read_id) AS score
    FROM (SELECT w, s + k * :step AS start FROM (SELECT w, s, SERIES[0|IDIV(e - s - 1|:step)] AS k FROM {manifest}) AS m) b
    JOIN {obs} o ON o.w = b.w AND o.pos >= b.start AND o.pos < b.start + :size
    LEFT JOIN {truth} t ON t.w = o.w AND t.pos = o.pos
    GROUP BY b.w, b.start
) AS x""", step=1000, size=2000, variants=15, truth=12)
define("D41_sweep_best", "method string, errors double, switches double, d_errors double, d_switches double, pick int", """
SELECT m.method, m.errors, m.switches, m.errors - b.errors AS d_errors, m.switches - b.switches AS d_switches, CASE WHEN m.errors <= 1.05 * b.errors AND m.switches <= 1.10 * b.switches AND m.n50 = max(CASE WHEN m.errors <= 1.05 * b.errors AND m.switches <= 1.10 * b.switches THEN m.n50 END) OVER (PARTITION BY b.method) THEN 1 ELSE 0 END AS pick
FROM (SELECT method, avg(errors) AS errors, avg(switches) AS switches, round(avg(n50), 6) AS n50 FROM {metrics} GROUP BY method) m CROSS JOIN (SELECT method, avg(errors) AS errors, avg(switches) AS switches FROM {metrics} WHERE method = (SELECT min(method) FROM {metrics}) GROUP BY method) b""")
