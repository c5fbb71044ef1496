"""Joins (C): equi, interval, nearest and as-of, pairings.

Interval and nearest joins meet in buckets of fixed width: an equality that the
planner can hash, then the exact condition.
"""

from ..plans.operator import define

_NEAR = """SELECT * FROM (SELECT t.w, t.pos, a.pos AS apos, a.state AS astate, CASE WHEN a.pos < t.pos THEN 'L' ELSE 'R' END AS side, abs(a.pos - t.pos) AS dist,
row_number() OVER (PARTITION BY t.w, t.pos, CASE WHEN a.pos < t.pos THEN 'L' ELSE 'R' END ORDER BY abs(a.pos - t.pos), a.pos) AS rn
FROM (SELECT w, pos, block_id, IDIV(pos|:width) + d AS bucket FROM {fills} CROSS JOIN (VALUES (-1), (0), (1)) AS n(d)) t
JOIN (SELECT w, pos, block_id, state, IDIV(pos|:width) AS bucket FROM {calls} WHERE state <> 0) a ON t.w = a.w AND t.bucket = a.bucket AND abs(a.pos - t.pos) <= :width EXTRA) AS x WHERE rn <= :k"""

define("C1_truth_match", "w long, pos long, state int, tstate int, at_position int", """
SELECT c.w, c.pos, c.state, t.tstate, CASE WHEN t.pos IS NULL AND p.pos IS NOT NULL THEN 1 ELSE 0 END AS at_position FROM {calls} c JOIN {sites} s ON c.w = s.w AND c.pos = s.pos
LEFT JOIN {truth} t ON t.w = s.w AND t.pos = s.pos AND t.ref = s.ref AND t.alt = s.alt LEFT JOIN (SELECT DISTINCT w, pos FROM {truth}) p ON p.w = s.w AND p.pos = s.pos""")
define("C2_in_interval", "w long, pos long", "SELECT DISTINCT s.w, s.pos FROM {sites} s JOIN (SELECT s, e, SERIES[IDIV(s|1000)|IDIV(e|1000)] AS bucket FROM {bed}) b ON IDIV(s.pos - 1|1000) = b.bucket AND b.s <= s.pos - 1 AND s.pos - 1 < b.e")
define("C3_position_to_block", "w long, pos long, block_id string", "SELECT s.w, s.pos, b.block_id FROM (SELECT *, IDIV(pos|:width) AS bucket FROM {sites}) s JOIN (SELECT *, SERIES[IDIV(s|:width)|IDIV(e|:width)] AS bucket FROM {blocks}) b ON s.w = b.w AND s.bucket = b.bucket AND s.pos BETWEEN b.s AND b.e", width=1000)
define("C4_nearest_each_side", "w long, pos long, side string, rn int, apos long, astate int, dist long", _NEAR.replace("EXTRA", ""), width=500, k=4)
define("C5_nearest_same_block", "w long, pos long, side string, rn int, apos long, astate int, dist long", _NEAR.replace("EXTRA", "AND a.block_id = t.block_id"), width=2000, k=4)
#: Neighbouring points of the genetic map.
_SEGMENTS = "SELECT bp, cm, lead(bp) OVER (ORDER BY bp) AS nbp, lead(cm) OVER (ORDER BY bp) AS ncm FROM {gmap}"
#: Linear between two points of the map, held at its ends.
_INTERPOLATED = """CASE WHEN m.bp IS NOT NULL THEN m.cm + (m.ncm - m.cm) * (r.pos - m.bp) / (m.nbp - m.bp) WHEN r.pos < (SELECT min(bp) FROM {gmap}) THEN (SELECT min(cm) FROM {gmap}) ELSE (SELECT max(cm) FROM {gmap}) END AS cm"""


def in_centimorgans(rows: str, *also: str) -> str:
    """``rows`` (with ``pos``) and their place in the map: segments meet positions in buckets of ``:map_width`` bases."""
    columns = ", ".join(f"r.{c}" for c in ("pos", *also))
    return f"""SELECT {columns}, {_INTERPOLATED}
FROM (SELECT *, IDIV(pos|:map_width) AS bucket FROM ({rows}) AS r0) r
LEFT JOIN (SELECT *, SERIES[IDIV(bp|:map_width)|IDIV(nbp|:map_width)] AS bucket FROM ({_SEGMENTS}) AS m0 WHERE nbp > bp) m ON m.bucket = r.bucket AND r.pos >= m.bp AND r.pos < m.nbp"""


def in_centimorgans_by_range(rows: str, *also: str) -> str:
    """The same without buckets."""
    columns = ", ".join(f"r.{c}" for c in ("pos", *also))
    return f"SELECT {columns}, {_INTERPOLATED} FROM ({rows}) r LEFT JOIN ({_SEGMENTS}) m ON r.pos >= m.bp AND r.pos < m.nbp"


_TARGETS = "SELECT DISTINCT w, pos, block_id FROM {fills}"
_KNOWN = "SELECT w, pos, block_id, state FROM {calls} WHERE state <> 0 AND block_id NOT IN ('', '0', 'unassigned')"
#: Walking out from the position on each side, as long as the map distance allows; a call at the position itself is on the right.
_NEAR_CM = """
SELECT w, pos, block_id, side, rn, apos, state, dcm
FROM (
    SELECT *, row_number() OVER (PARTITION BY w, pos, block_id, side ORDER BY abs(apos - pos)) AS rn
    FROM (
        SELECT t.w, t.pos, t.block_id, a.pos AS apos, a.state, abs(a.cm - t.cm) AS dcm, CASE WHEN a.pos < t.pos THEN 'L' ELSE 'R' END AS side
        FROM TARGETS t
        JOIN ANCHORS a ON a.w = t.w AND a.block_id = t.block_id MEET AND round(abs(a.cm - t.cm), 9) <= :max_cm
    ) AS q
) AS x
WHERE rn <= :k"""


def _met(text: str, targets: str, *also: str, spark: bool) -> str:
    """Targets and called sites in centimorgans; on Spark both come in buckets of ``:max_cm``."""
    if not spark:
        return text.replace("MEET ", "").replace("TARGETS", f"({in_centimorgans_by_range(targets, 'w', *also)})").replace("ANCHORS", f"({in_centimorgans_by_range(_KNOWN, 'w', 'block_id', 'state')})")
    near = f"(SELECT *, CAST(floor(cm / :max_cm) AS BIGINT) + d AS near FROM ({in_centimorgans(targets, 'w', *also)}) AS t0 CROSS JOIN (VALUES (-1), (0), (1)) AS n(d))"
    return text.replace("MEET", "AND a.near = t.near").replace("TARGETS", near).replace("ANCHORS", f"(SELECT *, CAST(floor(cm / :max_cm) AS BIGINT) AS near FROM ({in_centimorgans(_KNOWN, 'w', 'block_id', 'state')}) AS a0)")


NEAR_CM_OTHERWISE = _met(_NEAR_CM, _TARGETS, "block_id", spark=False)
NEAR_CM = _met(_NEAR_CM, _TARGETS, "block_id", spark=True)


def near_any_block(spark: bool) -> str:
    """Anchors of every block around the sites without a call."""
    text = _NEAR_CM.replace("t.block_id, a.pos", "a.block_id, a.pos").replace(" AND a.block_id = t.block_id", "")
    return _met(text, "SELECT DISTINCT w, pos FROM {calls} WHERE state = 0", spark=spark)


define("C6_nearest_in_centimorgan", "w long, pos long, block_id string, side string, rn int, apos long, state int, dcm double", NEAR_CM_OTHERWISE, NEAR_CM, max_cm=0.25, k=16, map_width=100_000)
define("C7_asof_anchors", "w long, pos long, prev long, next long", """
SELECT w, pos, CASE WHEN pos - p <= :max_gap THEN p END AS prev, CASE WHEN n - pos <= :max_gap THEN n END AS next FROM (SELECT w, pos, state,
max(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
min(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM {calls}) AS x""", max_gap=300)
define("C8_nearest_by_mode", "w long, pos long, mode string, apos long", """
SELECT w, pos, mode, CASE mode WHEN 'left_prefer' THEN coalesce(p, n) WHEN 'nearest_block' THEN CASE WHEN n IS NULL OR pos - p <= n - pos THEN p ELSE n END ELSE CASE WHEN pb = nb THEN p END END AS apos
FROM (SELECT x.w, x.pos, p, n, a.block_id AS pb, b.block_id AS nb FROM (SELECT w, pos, state, max(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
min(CASE WHEN state <> 0 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM {calls}) x LEFT JOIN {calls} a ON a.w = x.w AND a.pos = p LEFT JOIN {calls} b ON b.w = x.w AND b.pos = n WHERE x.state = 0) AS y
CROSS JOIN (VALUES ('same_block_only'), ('nearest_block'), ('left_prefer')) AS m(mode)""")
define("C9_set_difference", "w long, side string, n long", """
SELECT w, side, count(*) AS n FROM (SELECT coalesce(a.w, b.w) AS w, CASE WHEN b.pos IS NULL THEN 'only_a' WHEN a.pos IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT w, pos FROM {calls} WHERE state <> 0) a
FULL OUTER JOIN (SELECT w, pos FROM {calls2} WHERE state <> 0) b ON a.w = b.w AND a.pos = b.pos) AS x GROUP BY w, side""")
define("C10_read_pairs", "w long, a long, b long, n long, agree long", "SELECT x.w, x.pos AS a, y.pos AS b, count(*) AS n, sum(CASE WHEN x.allele = y.allele THEN 1 ELSE 0 END) AS agree FROM {frags} x JOIN {frags} y ON x.w = y.w AND x.read_id = y.read_id AND x.pos < y.pos GROUP BY x.w, x.pos, y.pos")
define("C11_panel_sample_pairs", "a long, b long, shared long", "SELECT x.k AS a, y.k AS b, count(*) AS shared FROM {panel} x JOIN {panel} y ON x.donor = y.donor AND x.hap_id = y.hap_id AND x.k < y.k AND x.allele = y.allele GROUP BY x.k, y.k HAVING count(*) >= :least", least=25)
define("C12_feature_merge", "w long, qid string, cand string, score double, prior double, support long", """
SELECT q.w, q.qid, q.cand, q.score, coalesce(p.bias, 0.0) AS prior, coalesce(o.n, 0) AS support FROM {scores} q LEFT JOIN (SELECT w, pos, avg(allele) AS bias FROM {obs} WHERE allele <> 0 GROUP BY w, pos) p ON p.w = q.w AND p.pos = q.pos
LEFT JOIN (SELECT w, pos, allele, count(*) AS n FROM {obs} GROUP BY w, pos, allele) o ON o.w = q.w AND o.pos = q.pos AND o.allele = q.cstate""")
define("C13_hap_lookup", "w long, pos long, hap long, allele int", "SELECT q.w, q.pos, p.hap, p.allele FROM {lookups} q JOIN {psites} v ON v.pos = q.pos JOIN {panel} p ON p.donor = q.donor AND p.hap_id = q.hap_id AND p.k = v.k")
_PAIRS = """SELECT a.w, a.block_id AS a, b.block_id AS b, b.s - a.e AS gap, b.r - a.r AS step FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s, e) AS r FROM {blocks}) a
JOIN (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s, e) AS r FROM {blocks}) b ON a.w = b.w AND b.r BETWEEN a.r + 1 AND a.r + :ahead WHERE b.s - a.e BETWEEN 0 AND :max_gap"""
define("C14_next_blocks", "w long, a string, b string, gap long, step long", _PAIRS, ahead=3, max_gap=1500)
define("C15_config_cross", "cfg int, w long, kept long", "SELECT cfg, w, sum(CASE WHEN prob >= cfg / 10.0 THEN 1 ELSE 0 END) AS kept FROM {fills} CROSS JOIN (VALUES (5), (6), (7), (8), (9)) AS c(cfg) GROUP BY cfg, w")
