"""Scans after extraction, filters and projections (A, B)."""

from ..plans.operator import define

# Scans: window filters are inclusive; positions are 1-based.
define("A1_variant_window", "w long, pos long, ref string, alt string", "SELECT w, pos, ref, alt FROM {sites} WHERE pos BETWEEN :lo AND :hi", lo=2000, hi=9000)
define("A2_observation_window", "w long, read_id long, pos long, allele int, baseq long, mapq long", "SELECT w, read_id, pos, allele, baseq, mapq FROM {obs} WHERE pos BETWEEN :lo AND :hi", lo=2000, hi=9000)
define("A3_site_prior_lookup", "w long, pos long, bias double", "SELECT s.w, s.pos, coalesce(p.bias, 0.0) AS bias FROM {sites} s LEFT JOIN (SELECT w, pos, 2.0 * avg(CASE WHEN allele > 0 THEN 1.0 ELSE 0.0 END) - 1.0 AS bias FROM {obs} WHERE allele <> 0 GROUP BY w, pos) p ON s.w = p.w AND s.pos = p.pos")
define("A4_panel_scan", "hap long, donor long, hap_id long, grp string, n long, alt long", "SELECT hap, donor, hap_id, grp, count(*) AS n, sum(CASE WHEN allele > 0 THEN 1 ELSE 0 END) AS alt FROM {panel} GROUP BY hap, donor, hap_id, grp")
define("A5_block_summary_scan", "w long, block_id string, s long, e long, n long", "SELECT w, block_id, s, e, n FROM {blocks}")
define("A7_region_parse", "region string, chrom string, s long, e long", """
SELECT region, split_part(region, ':', 1) AS chrom, CAST(replace(split_part(split_part(region, ':', 2), '-', 1), ',', '') AS BIGINT) AS s, CAST(replace(split_part(split_part(region, ':', 2), '-', 2), ',', '') AS BIGINT) AS e
FROM (SELECT chrom || ':' || CAST(IDIV(s|1000) AS STRING) || ',000-' || CAST(e AS STRING) AS region FROM {manifest}) AS x""")
define("A8_lenient_table_scan", "id long, value double, flag int", "SELECT event_id AS id, coalesce(TRY_CAST(event_type AS DOUBLE), value, 0.0) AS value, CASE WHEN lower(trim(event_type)) IN ('1', 'true', 'yes', 'y', 't', 'click') THEN 1 ELSE 0 END AS flag FROM {events}")
#: The panel's records at a site's position: one with several alternatives counts as such, and only an equal one is used (upper case on both sides).
_PANEL_RECORDS = """SELECT s.w, s.pos, r.pos AS rpos, CASE WHEN r.pos IS NULL THEN 0 WHEN r.alt LIKE '%,%' THEN 2 WHEN upper(r.ref) = upper(s.ref) AND upper(r.alt) = upper(s.alt) THEN 3 ELSE 1 END AS kind FROM {sites} s LEFT JOIN {panelrecords} r ON r.pos = s.pos"""
define("A9_panel_exact_match", "w long, found long, missing long, mismatched long, nonbiallelic long", f"""
SELECT w, count(DISTINCT CASE WHEN kind = 3 THEN pos END) AS found, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS mismatched, sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS nonbiallelic
FROM ({_PANEL_RECORDS}) AS x
GROUP BY w""")
_ALLELE = "CASE WHEN gt LIKE '%|%' THEN CASE split_part(gt, '|', {}) WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE -1 END ELSE -1 END"
#: Only phased calls have alleles; one that is neither 0 nor 1 is missing by itself.
define("A10_phased_genotype", "w long, pos long, gt string, h0 int, h1 int, state int", f"""
SELECT w, pos, gt, {_ALLELE.format(1)} AS h0, {_ALLELE.format(2)} AS h1, CASE gt WHEN '0|1' THEN 1 WHEN '1|0' THEN -1 ELSE 0 END AS state
FROM {{genotypes}}""")
define("A11_pileup_filter", "w long, read_id long, pos long, allele int, baseq long, mapq long", "SELECT w, read_id, pos, allele, baseq, mapq FROM {obs} WHERE mapq >= :min_mapq AND baseq >= :min_baseq AND allele <> 0", min_mapq=20, min_baseq=20)
define("A12_template_fragments", "w long, read_id long, n long, positions string, alleles string", """
SELECT w, read_id, count(*) AS n, LAGG(pos|pos) AS positions, LAGG(a|pos) AS alleles FROM (SELECT w, read_id, pos, CASE WHEN sum(allele) > 0 THEN 1 ELSE -1 END AS a FROM {obs} WHERE mapq >= :min_mapq AND baseq >= :min_baseq AND allele <> 0 GROUP BY w, read_id, pos HAVING sum(allele) <> 0) AS x
GROUP BY w, read_id HAVING count(*) >= 2""", min_mapq=20, min_baseq=15)
define("A13_genetic_map", "bp long, cm double, next_bp long, next_cm double", "SELECT bp, cm, lead(bp) OVER (ORDER BY bp) AS next_bp, lead(cm) OVER (ORDER BY bp) AS next_cm FROM {gmap}")
define("A14_bed_span", "n long, span long", "SELECT count(*) AS n, sum(e - s) AS span FROM {bed}")
define("A15_truth_in_bed", "w long, pos long, tstate int", "SELECT w, pos, tstate FROM (SELECT *, IDIV(pos - 1|1000) AS bucket FROM {truth}) t WHERE EXISTS (SELECT 1 FROM (SELECT s, e, SERIES[IDIV(s|1000)|IDIV(e|1000)] AS bucket FROM {bed}) b WHERE b.bucket = t.bucket AND b.s <= t.pos - 1 AND t.pos - 1 < b.e) AND length(ref) = 1 AND length(alt) = 1")
define("A16_leakfree_variants", "w long, pos long, ref string, alt string, gt string", "SELECT w, pos, ref, alt, '0/1' AS gt FROM {truth} WHERE length(ref) = 1 AND length(alt) = 1 AND alt <> 'X'")
define("A17_external_calls", "w long, pos long, block_id string, state int, confidence double", """
SELECT s.w, s.pos, coalesce('whatshap_' || CAST(t.ps AS STRING), 'unassigned') AS block_id, coalesce(t.tstate, 0) AS state, CASE WHEN t.ps IS NULL THEN 0.0 ELSE 1.0 END AS confidence
FROM {sites} s
LEFT JOIN {external} t ON s.w = t.w AND s.pos = t.pos AND s.ref = t.ref AND s.alt = t.alt""")
define("A18_unphase", "w long, pos long, gt string", "SELECT w, pos, replace(CASE tstate WHEN 1 THEN '0|1' ELSE '1|0' END, CASE tstate WHEN 1 THEN '0|1' ELSE '1|0' END, '0/1') AS gt FROM {truth}")
#: On Spark the panel is counted once a site; a site outside it counts as one row without an allele, as in the join by haplotype.
define("A19_bootstrap_priors", "w long, pos long, n long, bias double", """
SELECT s.w, s.pos, count(p.hap) AS n, coalesce(2.0 * avg(CASE WHEN p.allele > 0 THEN 1.0 ELSE 0.0 END) - 1.0, 0.0) AS bias FROM {sites} s LEFT JOIN {psites} v ON v.pos = s.pos LEFT JOIN {panel} p ON p.k = v.k GROUP BY s.w, s.pos""", """
SELECT s.w, s.pos, s.copies * coalesce(b.n, 0) AS n, coalesce(2.0 * (b.up * 1.0 / b.total) - 1.0, -1.0) AS bias
FROM (SELECT w, pos, count(*) AS copies FROM {sites} GROUP BY w, pos) s
LEFT JOIN (
    SELECT v.pos, sum(q.n) AS n, sum(coalesce(q.up, 0)) AS up, sum(coalesce(q.total, 1)) AS total
    FROM {psites} v
    LEFT JOIN (SELECT k, count(hap) AS n, count(*) AS total, sum(CASE WHEN allele > 0 THEN 1 ELSE 0 END) AS up FROM {panel} GROUP BY k) q ON q.k = v.k
    GROUP BY v.pos
) b ON b.pos = s.pos""")
define("A20_bed_clip", "s long, e long", "SELECT s, e FROM (SELECT greatest(s, :lo) AS s, least(e, :hi) AS e FROM {bed}) AS x WHERE s < e", lo=1500, hi=8000)
define("A22_manifest_select", "w long, label string, state string", "SELECT w, label, CASE WHEN label NOT LIKE '%phase7a' THEN 'bad_path' WHEN reads = 0 THEN 'no_reads' WHEN e <= s THEN 'empty' ELSE 'ok' END AS state FROM {manifest} WHERE chrom = :chrom", chrom="chr20")

define("B1_quality_gate", "w long, read_id long, pos long, allele int, conf double, delta double", "SELECT w, read_id, pos, allele, conf, delta FROM {obs} WHERE allele IN (1, -1) AND amb = 0 AND (conf >= :min_conf OR abs(delta) >= :min_delta)", min_conf=0.025, min_delta=0.45)
define("B2_base_weight", "idx long, weight double", "SELECT idx, greatest(0.0, least(:max_weight, least(1.0, (baseq - :min_baseq + 1) / 30.0) * least(1.0, mapq / 60.0))) AS weight FROM {obs} WHERE baseq >= :min_baseq", min_baseq=15, max_weight=1.0)
define("B3_penalty", "idx long, penalty double, eff_baseq long, flags string", """
SELECT idx, penalty, greatest(1, CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2.0) ELSE floor(x + 0.5) END) AS eff_baseq, flags FROM (SELECT *, baseq * penalty AS x FROM (SELECT idx, baseq,
(CASE WHEN near THEN 0.65 ELSE 1.0 END) * (CASE WHEN clip THEN 0.5 ELSE 1.0 END) * (CASE WHEN nm THEN 0.8 ELSE 1.0 END) * (CASE WHEN dense THEN 0.8 ELSE 1.0 END) AS penalty,
concat_ws(',', CASE WHEN near THEN 'near_end' END, CASE WHEN clip THEN 'softclip' END, CASE WHEN nm THEN 'high_nm' END, CASE WHEN dense THEN 'dense' END) AS flags
FROM (SELECT idx, baseq, near_end = 1 AS near, softclip = 1 AS clip, high_nm = 1 AS nm, dense = 1 AS dense FROM {obs}) AS f) AS g) AS h""")
define("B4_context_score", "w long, read_id long, pos long, compared long, delta double, confidence double, ambiguous int", """
SELECT w, read_id, pos, compared, alt - ref AS delta, CASE WHEN alt + ref = 0 THEN 0.0 ELSE abs(alt - ref) / (abs(alt) + abs(ref)) END AS confidence, CASE WHEN compared < 3 OR abs(alt - ref) < 0.20 THEN 1 ELSE 0 END AS ambiguous FROM (
SELECT a.w, a.read_id, a.pos, count(*) AS compared, sum(CASE WHEN b.allele > 0 THEN wt ELSE -0.35 * wt END) AS alt, sum(CASE WHEN b.allele < 0 THEN wt ELSE -0.35 * wt END) AS ref
FROM {obs} a JOIN (SELECT *, greatest(0.1, least(1.0, baseq / 40.0)) AS wt FROM {obs}) b ON a.w = b.w AND a.read_id = b.read_id AND b.pos BETWEEN a.pos - :radius AND a.pos + :radius GROUP BY a.w, a.read_id, a.pos) AS x""", radius=500)
define("B5_weight_v3", "idx long, weight double", "SELECT idx, greatest(0.01, coalesce(w2, 0.0) * (CASE WHEN amb = 1 THEN 0.5 ELSE 1.0 END) * (0.75 + 0.25 * conf)) AS weight FROM {obs}")
define("B6_block_size_mask", "w long, pos long, block_id string, state int", """
SELECT w, pos, block_id, CASE WHEN state <> 0 AND n < :min_sites THEN 0 ELSE state END AS state FROM (SELECT *, sum(CASE WHEN state <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w, block_id) AS n FROM {calls}) AS x""", min_sites=4)
define("B7_nonzero_mask", "w long, pos long, state int", "SELECT a.w, a.pos, CASE WHEN b.pos IS NULL THEN 0 ELSE a.state END AS state FROM {calls} a LEFT JOIN (SELECT w, pos FROM {calls2} WHERE state <> 0) b ON a.w = b.w AND a.pos = b.pos")
define("B8_obs_at_calls", "idx long", "SELECT idx FROM {obs} o WHERE EXISTS (SELECT 1 FROM {calls2} c WHERE o.w = c.w AND o.pos = c.pos)")
define("B9_priors_at_positions", "w long, pos long, bias double", "SELECT w, pos, bias FROM {bias} p WHERE EXISTS (SELECT 1 FROM {calls2} c WHERE c.w = p.w AND c.pos = p.pos)")
define("B10_common_scaffold", "w long, pos long, af double, reads long", """
SELECT s.w, s.pos, p.af, coalesce(o.reads, 0) AS reads
FROM {sites} s
JOIN {psites} v ON v.pos = s.pos
JOIN (SELECT k, avg(CASE WHEN allele > 0 THEN 1.0 ELSE 0.0 END) AS af FROM {panel} WHERE allele <> 0 GROUP BY k) p ON p.k = v.k
LEFT JOIN (SELECT w, pos, count(DISTINCT read_id) AS reads FROM {obs} GROUP BY w, pos) o ON o.w = s.w AND o.pos = s.pos
WHERE p.af BETWEEN :min_af AND :max_af AND length(s.ref) = 1 AND length(s.alt) = 1""", min_af=0.05, max_af=0.95)
define("B11_panel_conformity", "w long, status string, n long", """
SELECT w, status, count(*) AS n FROM (SELECT coalesce(s.w, t.w) AS w, CASE WHEN t.pos IS NULL THEN 'target_only' WHEN s.pos IS NULL THEN 'panel_only' WHEN s.ref = t.ref AND s.alt = t.alt THEN 'match' ELSE 'mismatch' END AS status
FROM {sites} s FULL OUTER JOIN {truth} t ON s.w = t.w AND s.pos = t.pos) AS x GROUP BY w, status""")
define("B12_probability_gate", "w long, pos long, state int, reason string", """
SELECT c.w, c.pos, CASE WHEN f.pos IS NULL THEN c.state WHEN f.prob IS NULL OR f.prob < :threshold THEN 0 ELSE f.pred END AS state,
    CASE WHEN f.pos IS NULL THEN 'not_filled' WHEN f.prob IS NULL THEN 'no_oof_prediction' WHEN f.prob < :threshold THEN 'below_threshold' ELSE 'kept' END AS reason
FROM {calls} c
LEFT JOIN {gated} f ON f.w = c.w AND f.pos = c.pos""", threshold=0.8)
define("B13_score_gate", "w long, pos long, state int", "SELECT c.w, c.pos, CASE WHEN coalesce(f.prob, 0.0) >= :threshold THEN c.state ELSE 0 END AS state FROM {calls} c LEFT JOIN {fills} f ON c.w = f.w AND c.pos = f.pos", threshold=0.5)
define("B14_audit_guard", "w long, pos long, kept int", """
SELECT w, pos, CASE WHEN orient_sites >= :sites AND orient_margin >= :omargin AND plus / (plus + minus + 1.0) >= :conf AND abs(plus - minus) >= :margin AND prob >= :second AND anchors >= :anchors THEN 1 ELSE 0 END AS kept FROM {fills}""", sites=2, omargin=1, conf=0.4, margin=2.0, second=0.1, anchors=2)
define("B15_scaffold_gate", "w long, pos long, state int, block_id string", """
SELECT c.w, c.pos, CASE WHEN c.state = 0 AND f.pos IS NOT NULL THEN f.pred ELSE c.state END AS state, CASE WHEN c.state = 0 AND f.pos IS NOT NULL THEN f.block_id ELSE c.block_id END AS block_id FROM {calls} c
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, pos ORDER BY prob DESC, block_id) AS rn FROM {fills} WHERE prob >= :threshold) AS x WHERE rn = 1) f ON c.w = f.w AND c.pos = f.pos""", threshold=0.6)
#: Each set of guards is a row of ``guards``; a bridge passes one if it passes all of its limits.
define("B16_guard_sweep", "cfg string, w long, n long, total long", """
SELECT g.cfg, b.w, sum(CASE WHEN b.prob >= g.prob AND b.conf >= g.conf AND b.margin >= g.margin AND b.effective >= g.effective AND b.usable_a >= g.usable AND b.usable_b >= g.usable AND b.gap <= g.gap AND b.support >= g.support THEN 1 ELSE 0 END) AS n,
    count(*) AS total
FROM {bridgefeatures} b
CROSS JOIN {guards} g
GROUP BY g.cfg, b.w""")
define("B17_split_assignment", "w long, split string", "SELECT m.w, CASE WHEN h.w IS NOT NULL THEN 'holdout' WHEN reads >= :reads AND snps >= :snps AND e > s THEN 'train' ELSE 'skip' END AS split FROM {manifest} m LEFT JOIN {holdout} h ON h.w = m.w", reads=40, snps=60)
# The suffixes of window labels that tell replicate depths apart.
define("B18_physical_group", "w long, grp string", "SELECT w, replace(replace(replace(label, '_illumina30x_phase7a', ''), '_illumina35x_phase7a', ''), '_phase7a', '') AS grp FROM {manifest}")
