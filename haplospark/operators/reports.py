"""Reports on a run (I55): reads and why they were kept, ranked candidates, calls after each block's orientation."""

from ..plans.operator import REGISTRY, define
from . import matching
from .windows import _RANK

#: The best observation of each read and site (by the sum of its qualities, of equal ones that with the better base), and the read's score.
_BUNDLES = """
SELECT w, read_id, n, n - 1 AS bonus, 3.0 * (n - 1) + n + 0.25 * quality AS score
FROM (
    SELECT w, read_id, count(*) AS n, sum(0.5 + 0.5 * least(greatest(baseq / 40.0, 0.0), 1.0) * least(greatest(mapq / 60.0, 0.0), 1.0)) AS quality
    FROM (
        SELECT o.w, o.read_id, o.baseq, o.mapq, row_number() OVER (PARTITION BY o.w, o.read_id, o.pos ORDER BY o.baseq + o.mapq DESC, o.baseq DESC) AS rn
        FROM {obs} o
        JOIN {sites} s ON s.w = o.w AND s.pos = o.pos
        WHERE o.allele <> 0
    ) AS q
    WHERE rn = 1
    GROUP BY w, read_id
) AS r"""
_ORDERED = f"SELECT *, row_number() OVER (PARTITION BY w ORDER BY bonus DESC, n DESC, round(score, 9) DESC, read_id) AS rk FROM ({_BUNDLES}) AS b"
_AT = "SELECT DISTINCT o.w, o.read_id, o.pos FROM {obs} o JOIN {sites} s ON s.w = o.w AND s.pos = o.pos WHERE o.allele <> 0"
#: A read helps if it is among the first ``depth`` long enough ones at one of its sites; the first ``most`` that help are kept, and nothing after them.
_KEPT = """
SELECT w, read_id, n, bonus, score, CASE WHEN before >= :most THEN 'max_reads_reached' WHEN n < :least THEN 'below_min_sites_per_read' WHEN helps = 0 THEN 'no_undercovered_site' ELSE 'kept' END AS decision
FROM (SELECT r.*, coalesce(sum(r.helps) OVER (PARTITION BY r.w ORDER BY r.rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (HELPS) AS r) AS q"""
_BY_RANK = f"""
SELECT o.*, CASE WHEN h.read_id IS NULL THEN 0 ELSE 1 END AS helps
FROM ({_ORDERED}) AS o
LEFT JOIN (
    SELECT DISTINCT w, read_id
    FROM (SELECT a.w, a.read_id, row_number() OVER (PARTITION BY a.w, a.pos ORDER BY o.rk) AS at FROM ({_AT}) AS a JOIN ({_ORDERED}) AS o ON o.w = a.w AND o.read_id = a.read_id WHERE o.n >= :least) AS q
    WHERE at <= :depth
) AS h ON h.w = o.w AND h.read_id = o.read_id"""
#: For comparison: a site of the read with fewer than ``depth`` earlier ones.
_BY_COUNT = f"""
SELECT o.*, CASE WHEN o.n >= :least AND h.fewest < :depth THEN 1 ELSE 0 END AS helps
FROM ({_ORDERED}) AS o
LEFT JOIN (
    SELECT w, read_id, min(earlier) AS fewest
    FROM (
        SELECT a.w, a.read_id, a.pos, count(y.read_id) AS earlier
        FROM ({_AT}) AS a
        JOIN ({_ORDERED}) AS x ON x.w = a.w AND x.read_id = a.read_id
        LEFT JOIN (SELECT b.w, b.pos, b.read_id, z.rk FROM ({_AT}) AS b JOIN ({_ORDERED}) AS z ON z.w = b.w AND z.read_id = b.read_id WHERE z.n >= :least) AS y ON y.w = a.w AND y.pos = a.pos AND y.rk < x.rk
        GROUP BY a.w, a.read_id, a.pos
    ) AS c
    GROUP BY w, read_id
) AS h ON h.w = o.w AND h.read_id = o.read_id"""
define("I55b_read_decisions", "w long, read_id long, n long, bonus long, score double, decision string", _KEPT.replace("HELPS", _BY_COUNT), _KEPT.replace("HELPS", _BY_RANK), depth=8, most=150, least=2)

_PAIRS = REGISTRY["F2_composite_pairs"].sql.replace(":top", ":pool")
define("I55c_candidate_ranks", "w long, kind string, rn long, donor long, hap_id long, grp string, raw long, score double, matched long, total long, members string", f"""
SELECT w, 'donor' AS kind, rn, donor, hap_id, grp, raw, score, matched, n AS total, NULL AS members FROM {_RANK} AS d
UNION ALL SELECT w, 'composite' AS kind, rn, NULL AS donor, NULL AS hap_id, NULL AS grp, NULL AS raw, score, NULL AS matched, NULL AS total, CAST(a AS STRING) || ',' || CAST(b AS STRING) AS members FROM ({_PAIRS}) AS c""", matching.candidate_ranks, top=32, pool=8)

#: Each block is turned to the side that more of its calls agree with; an even split has no orientation, and its calls are not judged.
_ORIENTED = """
SELECT c.w, c.pos, c.block_id, coalesce(o.orientation, 0) AS orientation, CASE WHEN o.orientation IS NULL THEN 0 ELSE c.state * o.orientation END AS oriented,
    CASE WHEN c.state = 0 OR coalesce(c.tstate, 0) = 0 THEN 'not_comparable' WHEN coalesce(o.orientation, 0) = 0 THEN 'unknown_orientation' WHEN c.state * o.orientation = c.tstate THEN 'correct' ELSE 'wrong' END AS verdict,
    coalesce(o.same, 0) AS same, coalesce(o.opposite, 0) AS opposite, abs(coalesce(o.same, 0) - coalesce(o.opposite, 0)) AS margin
FROM {cmp} c
LEFT JOIN (
    SELECT *, CASE WHEN same > opposite THEN 1 WHEN opposite > same THEN -1 ELSE 0 END AS orientation
    FROM (
        SELECT w, block_id, sum(CASE WHEN state = tstate THEN 1 ELSE 0 END) AS same, sum(CASE WHEN state = -tstate THEN 1 ELSE 0 END) AS opposite
        FROM {cmp}
        WHERE state <> 0 AND tstate <> 0 AND block_id NOT IN ('', '0', 'unassigned')
        GROUP BY w, block_id
    ) AS q
) AS o ON o.w = c.w AND o.block_id = c.block_id"""
define("I55d_oriented_comparison", "w long, pos long, block_id string, orientation int, oriented int, verdict string, same long, opposite long, margin long", _ORIENTED)
define("I55e_orientation_summary", "w long, correct long, wrong long, not_comparable long, unknown_orientation long, accuracy double", f"""
SELECT *, CASE WHEN correct + wrong > 0 THEN correct / ((correct + wrong) * 1.0) END AS accuracy
FROM (
    SELECT w, {", ".join(f"sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) AS {v}" for v in ("correct", "wrong", "not_comparable", "unknown_orientation"))}
    FROM ({_ORIENTED}) AS x
    GROUP BY w
) AS s""")
