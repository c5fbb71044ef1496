"""Queries of the region operators, and SQL that states their results in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import regions as rg
from ..sources.readers import written
from .fixtures import FIXTURES, Tables, _INPUT, needed
from .operator import render

#: Limits of the queries: the windows of the test tables are 13,500 bases long.
GAP, SPAN, SITES = 300, 1_500, 5


def _regions(t: Tables, max_sites: int = SITES) -> DataFrame:
    return written(rg.connectivity_regions(t["obs"], t["scores"], t["calls"], t["calls2"], max_gap=GAP, max_span=SPAN, max_sites=max_sites))


def _solved(t: Tables, regions: DataFrame) -> DataFrame:
    """The best states of the sites in regions, with what speaks for them."""
    best = rg.ranked_candidates(t["scores"]).select("w", "pos", F.coalesce("best_state", F.lit(0)).alias("state"))
    sites = regions.select("w", "region_id", "left_anchor_state", F.explode("ps").alias("pos")).join(best, ["w", "pos"]).join(t["bias"].select("w", "pos", F.col("bias").alias("donor_bias")), ["w", "pos"], "left")
    return written(sites.withColumn("anchor_ok", F.when(F.col("left_anchor_state") == F.col("state"), 1).otherwise(0)))


def _oriented(t: Tables) -> DataFrame:
    regions = _regions(t)
    return rg.orient_regions(t["obs"], regions, _solved(t, regions), t["calls"])


def _candidates(t: Tables) -> DataFrame:
    """Candidates with whether the calls and the donors agree."""
    own = t["siteprior"].select("w", "pos", "donor_bias", "lft", "rgt")
    state = F.col("cstate")
    both = t["scores"].join(own, ["w", "pos"], "left").withColumn("left_match", (F.coalesce("lft", F.lit(0)) == state).cast("int")).withColumn("right_match", (F.coalesce("rgt", F.lit(0)) == state).cast("int"))
    return both.withColumn("anchor_conflict", ((F.coalesce("lft", F.lit(0)) == -state) & (state != 0)).cast("int")).withColumn("donor_match", ((F.signum(F.coalesce("donor_bias", F.lit(0.0))) == state) & (state != 0)).cast("int"))


def _query(fn: Callable[[Tables], DataFrame]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    return query


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "E8_component_split": _query(lambda t: rg.split_runs(t["comps"].withColumn("comp", F.floor(F.col("comp") / 10)), ["w", "comp"], 4, 700)),
        "I9_coverage_selection": _query(lambda t: _rounded(rg.coverage_selection(t["obs"], t["sites"], depth=4), "score")),
        "I10_superread_merge": _query(lambda t: rg.superread_merge(t["obs"], t["sites"])),
        "I22_connectivity_regions": _query(lambda t: rg.region_table(_regions(t, 24))),
        "I23_active_reads": _query(lambda t: _rounded(rg.active_reads(t["obs"], _regions(t), depth=3, most=12), "score")),
        "I24_probabilistic_merge": _query(lambda t: rg.probabilistic_merge(t["obs"], _regions(t))),
        "I25_scaffold_fragments": _query(lambda t: _rounded(rg.scaffold_fragments(_regions(t), t["calls2"]), "weight")),
        "I27_chain_orientation": _query(_oriented),
        "I28_region_resolve": _query(lambda t: rg.resolve_regions(t["obs"], _candidates(t), _regions(t), t["calls2"])),
    }


def _plain(x: str) -> str:
    return _INPUT.sub(r"\1", render(x, False))


def _with(ctes: str, select: str) -> str:
    own = ", ".join(f"{n} AS ({_plain(FIXTURES[n])})" for n in needed(["obs", "sites", "scores", "calls", "calls2", "bias", "siteprior", "comps"]))
    return f"WITH RECURSIVE {own}, {ctes} {select}"


def _region_ctes(max_sites: int = SITES) -> str:
    """Regions by reachability; a piece begins where a chain of first sites reaches."""
    return f"""cl AS (SELECT DISTINCT w, read_id, pos FROM obs WHERE allele <> 0 AND amb = 0 AND (conf >= 0.025 OR abs(delta) >= 0.45)),
    lk AS (SELECT DISTINCT x.w, x.pos AS a, y.pos AS b FROM cl x JOIN cl y ON x.w = y.w AND x.read_id = y.read_id AND y.pos > x.pos AND y.pos <= x.pos + {GAP} AND NOT EXISTS (SELECT 1 FROM cl z WHERE z.w = x.w AND z.read_id = x.read_id AND z.pos > x.pos AND z.pos < y.pos)),
    lk2 AS (SELECT w, a, b FROM lk UNION SELECT w, b, a FROM lk),
    rch AS (SELECT w, a, b FROM lk2 UNION SELECT r.w, r.a, l.b FROM rch r JOIN lk2 l ON l.w = r.w AND l.a = r.b),
    cc AS (SELECT w, a AS pos, min(least(a, b)) AS comp FROM rch GROUP BY w, a),
    tp AS (SELECT w, pos, arg_max(cstate, (score, CASE cand WHEN 'A' THEN 2 WHEN 'ABSTAIN' THEN 1 ELSE 0 END)) AS top, max(score) - coalesce(list_sort(list(score), 'DESC')[2], -999) AS lead FROM scores GROUP BY w, pos),
    wanted AS (SELECT t.w, t.pos, coalesce(cc.comp, -t.pos) AS comp FROM tp t LEFT JOIN calls c ON c.w = t.w AND c.pos = t.pos LEFT JOIN cc ON cc.w = t.w AND cc.pos = t.pos WHERE (t.top <> 0 AND t.top <> coalesce(c.state, 0)) OR coalesce(c.state, 0) = 0 OR round(t.lead, 9) >= 0.02),
    ordw AS (SELECT *, row_number() OVER (PARTITION BY w, comp ORDER BY pos) AS rn FROM wanted),
    heads AS (SELECT w, comp, pos, rn FROM ordw WHERE rn = 1 UNION ALL
        SELECT n.w, n.comp, n.pos, n.rn FROM heads h JOIN LATERAL (SELECT o.w, o.comp, o.pos, o.rn FROM ordw o WHERE o.w = h.w AND o.comp = h.comp AND o.rn > h.rn AND (o.rn - h.rn >= {max_sites} OR o.pos - h.pos > {SPAN}) ORDER BY o.rn LIMIT 1) n ON true),
    mem AS (SELECT o.w, o.comp, o.pos, max(h.pos) AS head FROM ordw o JOIN heads h ON h.w = o.w AND h.comp = o.comp AND h.pos <= o.pos GROUP BY o.w, o.comp, o.pos),
    rg AS (SELECT w, comp, head, min(pos) AS first, max(pos) AS last, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions, row_number() OVER (PARTITION BY w ORDER BY min(pos), max(pos)) AS region_id FROM mem GROUP BY w, comp, head),
    sc AS (SELECT w, pos, block_id, state, conf FROM calls2 WHERE state <> 0),
    anchored AS (SELECT r.*, l.pos AS lp, l.state AS ls, n.pos AS np, n.state AS ns FROM rg r
        LEFT JOIN sc l ON l.w = r.w AND l.pos = (SELECT max(pos) FROM sc s WHERE s.w = r.w AND s.pos < r.first) LEFT JOIN sc n ON n.w = r.w AND n.pos = (SELECT min(pos) FROM sc s WHERE s.w = r.w AND s.pos > r.last)),
    inr AS (SELECT m.w, a.region_id, a.n, m.pos, a.ls, a.ns FROM mem m JOIN anchored a ON a.w = m.w AND a.comp = m.comp AND a.head = m.head)"""


_WEIGHTED = """wo AS (SELECT w, read_id, pos, allele, weight FROM (SELECT *, row_number() OVER (PARTITION BY w, read_id, pos ORDER BY weight DESC, idx) AS k FROM (SELECT *, round(least(8, greatest(0.15, 1.5 * coalesce(w2, 0.5) + 2 * conf + least(abs(delta), 3) + baseq / 40)), 9) AS weight FROM obs WHERE allele <> 0 AND amb = 0 AND (conf >= 0.025 OR abs(delta) >= 0.45)) q) z WHERE k = 1),
    fr AS (SELECT o.w, i.region_id, o.read_id, count(*) AS n, round(count(*) * avg(o.weight) * ln(max(o.pos) - min(o.pos) + 11), 9) AS score, list(o.pos) AS ps FROM wo o JOIN inr i ON i.w = o.w AND i.pos = o.pos GROUP BY o.w, i.region_id, o.read_id HAVING count(*) >= 2 OR max(i.n) = 1)"""


def _scan(source: str, group: str, order: str, depth: int, most: int) -> str:
    """The greedy pass itself, one read after the other, with the cover of each site as a map."""
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {source}),
    pass AS (SELECT *, true AS taken, 0 AS got, map_from_entries(list_transform(ps, lambda p: {{'key': p, 'value': 1}})) AS cover FROM q WHERE rn = 1 UNION ALL
    SELECT n.* EXCLUDE (got, cover, ok), n.ok, n.got + CAST(n.ok AS INT), CASE WHEN ok THEN map_concat(cover, map_from_entries(list_transform(ps, lambda p: {{'key': p, 'value': coalesce(cover[p], 0) + 1}}))) ELSE cover END
    FROM (SELECT q.*, p.got, p.cover, p.got + 1 < {most} AND len(list_filter(q.ps, lambda s: coalesce(p.cover[s], 0) < {depth})) > 0 AS ok FROM pass p JOIN q ON {' AND '.join(f'q.{g} = p.{g}' for g in group.split(', '))} AND q.rn = p.rn + 1) AS n)"""


def oracle_sql() -> dict[str, str]:
    cast = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    bundles = """best AS (SELECT w, read_id, pos, arg_max(baseq, (baseq + mapq, -idx)) AS bq, arg_max(mapq, (baseq + mapq, -idx)) AS mq FROM obs WHERE allele <> 0 GROUP BY w, read_id, pos),
    bundle AS (SELECT w, read_id, count(*) AS n, round(3 * (count(*) - 1) + count(*) + 0.25 * sum(0.5 + 0.5 * least(1, bq / 40) * least(1, mq / 60)), 9) AS score, list(pos) AS ps FROM best GROUP BY w, read_id HAVING count(*) >= 3)"""
    fragments = """SELECT i.w, i.region_id, 'SCAFFOLD::' || s.block_id AS fragment, i.pos, s.state AS allele, greatest(4, 4 * s.conf) AS weight FROM inr i JOIN sc s ON s.w = i.w AND s.pos = i.pos WHERE s.conf > 0"""
    return {
        "E8_component_split": _with(
            """r AS (SELECT w, comp // 10 AS comp, pos, row_number() OVER (PARTITION BY w, comp // 10 ORDER BY pos) AS rn FROM comps),
            s AS (SELECT w, comp, rn, pos, pos AS start, 1 AS n, 0 AS piece FROM r WHERE rn = 1 UNION ALL SELECT r.w, r.comp, r.rn, r.pos, CASE WHEN s.n >= 4 OR r.pos - s.start > 700 THEN r.pos ELSE s.start END, CASE WHEN s.n >= 4 OR r.pos - s.start > 700 THEN 1 ELSE s.n + 1 END,
            s.piece + CASE WHEN s.n >= 4 OR r.pos - s.start > 700 THEN 1 ELSE 0 END FROM s JOIN r ON r.w = s.w AND r.comp = s.comp AND r.rn = s.rn + 1)""",
            f"SELECT {cast('w', 'comp', 'pos', 'piece')} FROM s",
        ),
        "I9_coverage_selection": _with(f"{bundles}, {_scan('bundle', 'w', 'n DESC, score DESC, read_id', 4, 20_000)}", "SELECT CAST(w AS BIGINT) AS w, CAST(read_id AS BIGINT) AS read_id, n, round(score, 6) AS score, CAST(got AS BIGINT) AS rank FROM pass WHERE taken"),
        "I22_connectivity_regions": _with(_region_ctes(24), f"SELECT {cast('w', 'region_id')}, CAST(n AS BIGINT) AS n_sites, CAST(first AS BIGINT) AS start_pos, CAST(last AS BIGINT) AS end_pos, CAST(last - first AS BIGINT) AS span_bp, positions, CAST(lp AS BIGINT) AS left_anchor_pos, CAST(ls AS INT) AS left_anchor_state, CAST(np AS BIGINT) AS right_anchor_pos, CAST(ns AS INT) AS right_anchor_state FROM anchored"),
        "I23_active_reads": _with(f"{_region_ctes()}, {_WEIGHTED}, {_scan('fr', 'w, region_id', 'score DESC, read_id DESC', 3, 12)}", f"SELECT {cast('w', 'region_id', 'read_id', 'n')}, round(score, 6) AS score, CAST(got AS BIGINT) AS rank FROM pass WHERE taken"),
        "I25_scaffold_fragments": _with(_region_ctes(), f"SELECT CAST(w AS BIGINT) AS w, CAST(region_id AS BIGINT) AS region_id, fragment, CAST(pos AS BIGINT) AS pos, CAST(allele AS INT) AS allele, round(CAST(weight AS DOUBLE), 6) AS weight FROM ({fragments} AND s.block_id <> '' UNION ALL SELECT i.w, i.region_id, 'SCAFFOLD::DIRECT', i.pos, s.state, greatest(2, 3 * s.conf) FROM inr i JOIN sc s ON s.w = i.w AND s.pos = i.pos WHERE s.conf > 0) AS f"),
        "I27_chain_orientation": _with(
            f"""{_region_ctes()}, sv AS (SELECT i.*, coalesce(b.state, 0) AS state, coalesce(d.bias, 0) AS bias, c.state AS loc FROM inr i LEFT JOIN (SELECT w, pos, arg_max(cstate, (score, cand = 'A')) AS state FROM scores WHERE cstate <> 0 GROUP BY w, pos) b ON b.w = i.w AND b.pos = i.pos LEFT JOIN bias d ON d.w = i.w AND d.pos = i.pos LEFT JOIN calls c ON c.w = i.w AND c.pos = i.pos),
            o2 AS (SELECT o.w, o.read_id, s.region_id, o.pos, o.allele, s.state, CASE WHEN w2 IS NOT NULL THEN least(6, greatest(0.05, w2)) ELSE least(4, greatest(0.05, 1 + 6 * o.conf)) END AS wt FROM obs o JOIN sv s ON s.w = o.w AND s.pos = o.pos WHERE o.allele <> 0 AND o.amb = 0),
            ends2 AS (SELECT w, read_id, region_id, min(pos) AS lo FROM o2 GROUP BY w, read_id, region_id),
            nb AS (SELECT w, read_id, region_id AS a, lead(region_id) OVER (PARTITION BY w, read_id ORDER BY lo, region_id) AS b FROM ends2),
            side AS (SELECT * FROM (VALUES (1), (-1)) AS v(sg)),
            hap AS (SELECT n.w, n.read_id, n.a, n.b, r.sg AS turn, h.sg AS hp, sum(CASE WHEN o.state <> 0 AND o.allele <> h.sg * o.state * CASE WHEN o.region_id = n.b THEN r.sg ELSE 1 END THEN o.wt ELSE 0 END) AS c FROM nb n JOIN o2 o ON o.w = n.w AND o.read_id = n.read_id AND o.region_id IN (n.a, n.b) CROSS JOIN side r CROSS JOIN side h WHERE n.b IS NOT NULL GROUP BY n.w, n.read_id, n.a, n.b, r.sg, h.sg),
            pc AS (SELECT w, a, b, round(sum(CASE WHEN turn = 1 THEN c END), 9) AS same, round(sum(CASE WHEN turn = -1 THEN c END), 9) AS other, count(DISTINCT read_id) AS reads FROM (SELECT w, read_id, a, b, turn, min(c) AS c FROM hap GROUP BY w, read_id, a, b, turn) AS m GROUP BY w, a, b),
            un AS (SELECT w, region_id, round(0.25 * p + 2.5 * (CASE WHEN ls <> 0 AND hd <> ls THEN 1 ELSE 0 END + CASE WHEN ns <> 0 AND tl <> ns THEN 1 ELSE 0 END) - bias, 9) AS up, round(0.25 * m + 2.5 * (CASE WHEN ls <> 0 AND -hd <> ls THEN 1 ELSE 0 END + CASE WHEN ns <> 0 AND -tl <> ns THEN 1 ELSE 0 END + least(2, ok)) + bias, 9) AS um, row_number() OVER (PARTITION BY w ORDER BY region_id) AS i, count(*) OVER (PARTITION BY w) AS n
                FROM (SELECT w, region_id, any_value(ls) AS ls, any_value(ns) AS ns, arg_min(state, pos) AS hd, arg_max(state, pos) AS tl, avg(bias) AS bias, avg(CASE WHEN ls = state THEN 1.0 ELSE 0.0 END) AS ok, sum(CASE WHEN loc <> 0 AND state <> loc THEN 1 ELSE 0 END) AS p, sum(CASE WHEN loc <> 0 AND -state <> loc THEN 1 ELSE 0 END) AS m FROM sv GROUP BY w, region_id) AS g),
            lnk AS (SELECT u.*, coalesce(pc.same, 0) AS same, coalesce(pc.other, 0) AS other FROM un u LEFT JOIN un v ON v.w = u.w AND v.i = u.i - 1 LEFT JOIN pc ON pc.w = u.w AND pc.a = v.region_id AND pc.b = u.region_id),
            rest AS (SELECT w, i, up AS gp, um AS gm, same, other FROM lnk WHERE i = n UNION ALL
                SELECT l.w, l.i, l.up + round(least(r.gp + r.same, r.gm + r.other), 9), l.um + round(least(r.gp + r.other, r.gm + r.same), 9), l.same, l.other FROM rest r JOIN lnk l ON l.w = r.w AND l.i = r.i - 1),
            fwd AS (SELECT w, i, CAST(up AS DOUBLE) AS fp, CAST(um AS DOUBLE) AS fm, 0 AS kp, 0 AS km FROM lnk WHERE i = 1 UNION ALL
                SELECT l.w, l.i, l.up + round(least(f.fp + l.same, f.fm + l.other), 9), l.um + round(least(f.fp + l.other, f.fm + l.same), 9), CASE WHEN round(f.fm + l.other, 9) < round(f.fp + l.same, 9) THEN 1 ELSE 0 END, CASE WHEN round(f.fm + l.same, 9) < round(f.fp + l.other, 9) THEN 1 ELSE 0 END FROM fwd f JOIN lnk l ON l.w = f.w AND l.i = f.i + 1),
            bk AS (SELECT f.w, f.i, CASE WHEN round(f.fm, 9) < round(f.fp, 9) THEN 1 ELSE 0 END AS s, f.kp, f.km FROM fwd f JOIN lnk l ON l.w = f.w AND l.i = f.i AND l.i = l.n UNION ALL SELECT f.w, f.i, CASE WHEN b.s = 1 THEN b.km ELSE b.kp END, f.kp, f.km FROM bk b JOIN fwd f ON f.w = b.w AND f.i = b.i - 1),
            met AS (SELECT w, r AS region_id, sum(reads) AS reads FROM (SELECT w, a AS r, reads FROM pc UNION ALL SELECT w, b, reads FROM pc) AS e GROUP BY w, r)""",
            """SELECT CAST(u.w AS BIGINT) AS w, CAST(u.region_id AS BIGINT) AS region_id, CAST(CASE WHEN b.s = 1 AND NOT (round(abs(u.up - u.um), 6) < 0.75 AND m.reads IS NULL) THEN -1 ELSE 1 END AS INT) AS orientation, CAST(1 - 2 * b.s AS INT) AS raw, round(CAST(abs(u.up - u.um) AS DOUBLE), 6) AS margin, CAST(coalesce(m.reads, 0) AS BIGINT) AS bridge_reads
            FROM un u JOIN bk b ON b.w = u.w AND b.i = u.i LEFT JOIN met m ON m.w = u.w AND m.region_id = u.region_id""",
        ),
        "I28_region_resolve": _with(
            f"""{_region_ctes()}, cd AS (SELECT s.w, s.pos, s.cand, s.cstate, s.score, round(s.score + CASE WHEN cstate = 0 THEN -0.05 ELSE 0 END + CASE WHEN cstate <> 0 AND coalesce(p.lft, 0) = -cstate THEN -0.6 ELSE 0 END + CASE WHEN cstate <> 0 AND sign(coalesce(p.donor_bias, 0)) = cstate THEN 0.4 ELSE 0 END + CASE WHEN coalesce(p.lft, 0) = cstate THEN 0.2 ELSE 0 END + CASE WHEN coalesce(p.rgt, 0) = cstate THEN 0.2 ELSE 0 END, 9) AS worth FROM scores s LEFT JOIN siteprior p ON p.w = s.w AND p.pos = s.pos),
            op AS (SELECT c.*, i.region_id, row_number() OVER (PARTITION BY c.w, c.pos ORDER BY cstate = 0, score DESC, cand) AS opt, dense_rank() OVER (PARTITION BY c.w, i.region_id ORDER BY c.pos) AS k, i.n FROM cd c JOIN inr i ON i.w = c.w AND i.pos = c.pos),
            en AS (SELECT w, region_id, 1 AS k, n, [opt] AS opts, [CAST(cstate AS DOUBLE)] AS sts, worth AS wsum FROM op WHERE k = 1 UNION ALL SELECT e.w, e.region_id, e.k + 1, e.n, list_append(e.opts, o.opt), list_append(e.sts, CAST(o.cstate AS DOUBLE)), e.wsum + o.worth FROM en e JOIN op o ON o.w = e.w AND o.region_id = e.region_id AND o.k = e.k + 1),
            rd AS (SELECT o.w, i.region_id, CAST(o.read_id AS VARCHAR) AS rid, o.pos, o.allele, CASE WHEN o.w2 > 0 THEN o.w2 ELSE greatest(0.01, o.conf + 0.1 * abs(o.delta)) END AS weight, o.idx, 1.0 AS f FROM obs o JOIN inr i ON i.w = o.w AND i.pos = o.pos WHERE o.allele <> 0 UNION ALL SELECT w, region_id, fragment, pos, allele, weight, pos, 1.5 FROM ({fragments} AND s.block_id <> '' UNION ALL SELECT i.w, i.region_id, 'SCAFFOLD::DIRECT', i.pos, s.state, greatest(2, 3 * s.conf) FROM inr i JOIN sc s ON s.w = i.w AND s.pos = i.pos WHERE s.conf > 0) AS f),
            nk AS (SELECT DISTINCT w, region_id, pos, k FROM op),
            pw AS (SELECT x.w, x.region_id, p.k AS p, q.k AS q, round(sum(least(x.weight, y.weight) * x.f * x.allele * y.allele), 9) AS wt FROM rd x JOIN rd y ON x.w = y.w AND x.region_id = y.region_id AND x.rid = y.rid AND (x.pos < y.pos OR (x.pos = y.pos AND x.idx < y.idx)) JOIN nk p ON p.w = x.w AND p.region_id = x.region_id AND p.pos = x.pos JOIN nk q ON q.w = y.w AND q.region_id = y.region_id AND q.pos = y.pos GROUP BY x.w, x.region_id, p.k, q.k),
            pl AS (SELECT w, region_id, list({{'p': p, 'q': q, 't': wt}}) AS ls FROM pw GROUP BY w, region_id),
            scored AS (SELECT e.w, e.region_id, e.opts, round(e.wsum + 0.35 * coalesce(list_sum(list_transform(l.ls, lambda z: z.t * e.sts[z.p] * e.sts[z.q])), 0), 9) AS score FROM en e LEFT JOIN pl l ON l.w = e.w AND l.region_id = e.region_id WHERE e.k = e.n),
            won AS (SELECT *, row_number() OVER (PARTITION BY w, region_id ORDER BY score DESC, opts) AS rn, lead(score) OVER (PARTITION BY w, region_id ORDER BY score DESC, opts) AS nxt FROM scored)""",
            "SELECT CAST(o.w AS BIGINT) AS w, CAST(o.region_id AS BIGINT) AS region_id, CAST(o.pos AS BIGINT) AS pos, o.cand, CAST(o.cstate AS INT) AS state, round(CAST(v.score AS DOUBLE), 6) AS score, round(CAST(v.score - coalesce(v.nxt, v.score) AS DOUBLE), 6) AS margin FROM won v JOIN op o ON o.w = v.w AND o.region_id = v.region_id AND o.opt = v.opts[o.k] WHERE v.rn = 1",
        ),
    }
