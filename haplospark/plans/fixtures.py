"""Domain tables derived from the test tables, and the queries over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.phasing import DECIDE
from .operator import REGISTRY, Operator, render

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
_K = ", ".join(f"({i})" for i in range(64))

#: In order: each may use those before it.
FIXTURES: dict[str, str] = {
    "obs": """SELECT IDIV(l_orderkey|200) AS w, l_orderkey AS read_id,
        1000 + 100 * (5 * IDIV(l_orderkey % 200|8) + l_partkey % 5 + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END) AS pos,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS allele, CAST(l_quantity AS BIGINT) AS baseq, 20 + l_suppkey % 41 AS mapq,
        CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS amb, ((l_partkey * 7 + l_linenumber) % 41 - 20) / 20.0 AS delta, (l_partkey * 13 % 100) / 100.0 AS conf,
        CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_suppkey % 10 + 1) / 10.0 END AS w2, l_orderkey * 10 + l_linenumber AS idx,
        CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS near_end, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS softclip, CASE WHEN l_suppkey % 11 >= 5 THEN 1 ELSE 0 END AS high_nm, CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS dense FROM {lineitem}""",
    "sites": """SELECT w, pos, i, CASE i % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END AS ref, CASE i % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'T' ELSE 'A' END AS alt
        FROM (SELECT DISTINCT w, pos, IDIV(pos - 1000|100) AS i FROM {obs}) AS x""",
    "calls": """SELECT w, pos, CASE WHEN s = 0 THEN 'unassigned' ELSE 'b' || CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS STRING) END AS block_id,
        CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE 0 END AS state, abs(s) / n AS conf
        FROM (SELECT w, pos, CAST(sum(allele) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM {obs} GROUP BY w, pos) AS x""",
    "calls2": "SELECT w, pos, block_id, CASE WHEN IDIV(pos|100) % 5 = 0 THEN 0 WHEN IDIV(pos|100) % 7 = 0 THEN -state ELSE state END AS state, conf * 0.9 AS conf FROM {calls} WHERE IDIV(pos|100) % 9 <> 0",
    "truth": """SELECT w, pos, ref, CASE WHEN i % 13 = 0 THEN 'X' ELSE alt END AS alt, CASE WHEN (i * 7 + w) % 5 < 3 THEN 1 ELSE -1 END AS tstate FROM {sites} WHERE i % 11 <> 0""",
    "cmp": """SELECT c.w, c.pos, c.block_id, c.state, t.tstate FROM {calls} c JOIN {sites} s ON c.w = s.w AND c.pos = s.pos
        LEFT JOIN {truth} t ON t.w = s.w AND t.pos = s.pos AND t.ref = s.ref AND t.alt = s.alt""",
    "blocks": "SELECT w, block_id, min(pos) AS s, max(pos) AS e, count(*) AS n FROM {calls} WHERE state <> 0 GROUP BY w, block_id",
    "fills": """SELECT w, pos, 'b' || CAST(i * 3 % 4 AS STRING) AS block_id, CASE WHEN i * 7 % 5 < 3 THEN 1 ELSE -1 END AS pred, i * 11 % 37 / 1.0 AS plus, (i + w) * 5 % 23 / 1.0 AS minus,
        (i * 17 + w) % 100 / 100.0 AS prob, 10 + i % 50 AS donors, 1 + i % 4 AS anchors, i % 6 AS orient_sites, (i + w) % 4 AS orient_margin FROM (SELECT *, IDIV(pos|100) AS i FROM {calls}) AS c WHERE state = 0 OR IDIV(pos|100) % 5 = 0""",
    "external": "SELECT w, pos, ref, alt, tstate, IDIV(pos|1000) AS ps FROM {truth}",
    "gated": "SELECT w, pos, max(pred) AS pred, max(CASE WHEN anchors < 4 THEN prob END) AS prob FROM {fills} GROUP BY w, pos",
    "panel": f"SELECT vec_id AS hap, IDIV(vec_id|2) AS donor, vec_id % 2 AS hap_id, 'g' || CAST(label AS STRING) AS grp, k, CASE WHEN ELEM(embedding, k + 1) > 0 THEN 1 ELSE -1 END AS allele FROM {{embeddings}} CROSS JOIN (VALUES {_K}) AS t(k)",
    "ancestry": "SELECT 'g' || CAST(r_regionkey AS STRING) AS grp, 1.0 / r_regionkey AS weight FROM {region} WHERE r_regionkey > 0",
    "psites": f"SELECT 1000 + 100 * (64 * h + k) AS pos, k FROM (VALUES {_K}) AS t(k) CROSS JOIN (VALUES (0), (1)) AS u(h)",
    "genotypes": "SELECT w, pos, CASE i % 9 WHEN 0 THEN '0|1' WHEN 1 THEN '1|0' WHEN 2 THEN '0/1' WHEN 3 THEN '1|1' WHEN 4 THEN '0|0' WHEN 5 THEN '.|.' WHEN 6 THEN '1|2' WHEN 7 THEN '1' ELSE '.|0' END AS gt FROM {sites}",
    "panelrecords": """SELECT pos, CASE WHEN i % 6 = 1 THEN lower(ref) ELSE ref END AS ref, CASE WHEN i % 7 = 0 THEN alt || ',N' WHEN i % 5 = 0 THEN 'N' ELSE alt END AS alt FROM (SELECT DISTINCT pos, i, ref, alt FROM {sites} WHERE i % 11 <> 0) AS x
        UNION ALL SELECT DISTINCT pos, ref, alt FROM {sites} WHERE i % 14 = 0""",
    "guards": "SELECT * FROM (VALUES ('loose', 0.5, 0.4, 0.0, 1, 1, 9000, 0.5), ('mid', 0.6, 0.5, 1.0, 2, 2, 3000, 1.0), ('strict', 0.9, 0.6, 2.0, 3, 3, 1000, 3.0)) AS t(cfg, prob, conf, margin, effective, usable, gap, support)",
    "bias": "SELECT w, pos, ((pos * 13 + w) % 21 - 10) / 10.0 AS bias FROM {sites} WHERE i % 8 <> 0",
    "seeds": "SELECT w, hap FROM (SELECT DISTINCT w FROM {sites}) AS s CROSS JOIN (SELECT DISTINCT hap FROM {panel}) AS p WHERE (hap * 7 + w) % 83 = 0",
    "centres": "SELECT w, min(pos) + 1500 AS centre FROM {sites} GROUP BY w",
    "lookups": "SELECT w, pos, (w * 3 + i) % 20 AS donor, i % 2 AS hap_id FROM {sites}",
    "holdout": "SELECT w FROM (SELECT DISTINCT w FROM {sites}) AS s WHERE w % 5 = 0",
    "hmmfills": "SELECT w, pos, block_id, CASE WHEN (IDIV(pos|100) * 5 + w) % 3 = 0 THEN -1 ELSE 1 END AS pred, (IDIV(pos|100) * 29 + w * 3) % 100 / 100.0 AS prob FROM {fills} WHERE (pos + w) % 4 <> 0",
    "gmap": "SELECT 1000 + 500 * n_nationkey AS bp, n_nationkey * 0.25 + n_regionkey * 0.01 AS cm FROM {nation}",
    "sitecm": """SELECT p.pos, m.cm + coalesce((m.ncm - m.cm) * (p.pos - m.bp) / (m.nbp - m.bp), 0.0) AS cm FROM (SELECT DISTINCT pos FROM {sites}) p
        JOIN (SELECT bp, cm, lead(bp) OVER (ORDER BY bp) AS nbp, lead(cm) OVER (ORDER BY bp) AS ncm FROM {gmap}) m ON p.pos >= m.bp AND (p.pos < m.nbp OR m.nbp IS NULL)""",
    "bed": "SELECT s_suppkey * 700 AS s, s_suppkey * 700 + 400 AS e FROM {supplier}",
    "tags": "SELECT DISTINCT w, read_id, CASE read_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE 'UNK' END AS hp, 'p' || CAST(IDIV(read_id % 200|40) AS STRING) AS ps FROM {obs}",
    "selected": "SELECT DISTINCT w, read_id FROM {obs} WHERE read_id % 4 <> 0",
    "comps": "SELECT w, pos, IDIV(pos - 1000|500) AS comp, state FROM {calls} WHERE state <> 0",
    "frags": """SELECT w, read_id, pos, CASE WHEN s > 0 THEN 1 ELSE -1 END AS allele, abs(s) AS weight FROM (
        SELECT w, read_id, pos, sum(allele * coalesce(w2, 0.5)) AS s FROM {obs} WHERE allele <> 0 GROUP BY w, read_id, pos) AS x WHERE abs(s) > 0.000001""",
    "metrics": """SELECT method, win, count(*) * 10 AS sites, count(*) * 8 AS truth, sum(event_id % 7) AS errors, sum(event_id % 3) AS switches, 100 + sum(event_id % 11) AS n50
        FROM (SELECT event_type AS method, user_id % 17 AS win, event_id FROM {events}) AS x GROUP BY method, win""",
    "scores": """SELECT w, 'q' || CAST(pos AS STRING) AS qid, pos, cand, cstate, ((pos * 31 + cstate * 17 + w * 7 + 100) % 97) / 97.0 AS score, conf FROM (SELECT * FROM {calls} WHERE conf < 0.7) AS x
        CROSS JOIN (VALUES ('A', 1), ('B', -1), ('ABSTAIN', 0)) AS t(cand, cstate)""",
    "evidence": """SELECT q.w, q.pos, q.cand, q.cstate, q.score, c.state, coalesce((coalesce(a.lft, 0) + coalesce(a.rgt, 0)) * q.cstate / nullif(abs(coalesce(a.lft, 0)) + abs(coalesce(a.rgt, 0)), 0), 0.0) AS anchor_agreement,
        CASE WHEN a.lft * a.rgt < 0 THEN 1 ELSE 0 END AS switch_risk, q.cstate * coalesce(b.bias, 0.0) AS donor_bias, 1.0 - abs(coalesce(b.bias, 0.0)) AS donor_entropy, CASE WHEN coalesce(a.lft, 0) <> 0 OR coalesce(a.rgt, 0) <> 0 THEN 100.0 ELSE 1000000000.0 END AS nearest_anchor
        FROM {scores} q JOIN {calls} c ON c.w = q.w AND c.pos = q.pos LEFT JOIN {bias} b ON b.w = q.w AND b.pos = q.pos LEFT JOIN (SELECT w, pos, lag(state) OVER (PARTITION BY w ORDER BY pos) AS lft, lead(state) OVER (PARTITION BY w ORDER BY pos) AS rgt FROM {calls2}) a ON a.w = q.w AND a.pos = q.pos""",
    "labelled": """SELECT event_id AS id, event_type AS method, user_id % 9 AS grp, CASE WHEN (event_id * 7 + user_id) % 10 < 6 THEN 1 ELSE 0 END AS label, ((event_id * 37 + user_id * 11) % 50 + CASE WHEN (event_id * 7 + user_id) % 10 < 6 THEN 20 ELSE 0 END) / 70.0 AS score,
        event_id % 40 AS support, user_id % 13 AS anchors FROM {events}""",
    "manifest": """SELECT w, 'chr20' AS chrom, 'w' || CAST(w AS STRING) || CASE w % 3 WHEN 0 THEN '_illumina30x_phase7a' WHEN 1 THEN '_illumina35x_phase7a' ELSE '_phase7a' END AS label,
        count(DISTINCT read_id) AS reads, count(DISTINCT pos) AS snps, min(pos) AS s, max(pos) + 1 AS e FROM {obs} GROUP BY w""",
    "decisions": DECIDE.replace(":min_inf", "2").replace(":min_conf", "0.3"),
    "siteprior": """SELECT s.w, s.pos, coalesce(b.bias, 0.0) AS donor_bias, coalesce(q.cstate, 0) AS top_state, coalesce(q.margin, 0.0) AS margin, a.lft, a.rgt FROM {sites} s LEFT JOIN {bias} b ON b.w = s.w AND b.pos = s.pos
        LEFT JOIN (SELECT w, pos, cstate, score - nxt AS margin FROM (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY score DESC, cand) AS rn, lead(score) OVER (PARTITION BY w, qid ORDER BY score DESC, cand) AS nxt FROM {scores}) AS r WHERE rn = 1) q ON q.w = s.w AND q.pos = s.pos
        LEFT JOIN (SELECT w, pos, lag(state) OVER (PARTITION BY w ORDER BY pos) AS lft, lead(state) OVER (PARTITION BY w ORDER BY pos) AS rgt FROM {calls2}) a ON a.w = s.w AND a.pos = s.pos""",
    "obsedges": """SELECT w, a, b, sum(CASE WHEN sg > 0 THEN 1 ELSE 0 END) AS plus, sum(CASE WHEN sg < 0 THEN 1 ELSE 0 END) AS minus, sum(CASE WHEN sg > 0 THEN wt ELSE 0.0 END) AS pw, sum(CASE WHEN sg < 0 THEN wt ELSE 0.0 END) AS mw FROM (
        SELECT x.w, x.comp AS a, y.comp AS b, x.v * y.v AS sg, least(abs(x.v), abs(y.v)) AS wt FROM
        (SELECT o.w, o.read_id, c.comp, sum(o.allele * c.state * 1.0) AS v FROM {obs} o JOIN {comps} c ON o.w = c.w AND o.pos = c.pos WHERE o.allele <> 0 GROUP BY o.w, o.read_id, c.comp) AS x JOIN
        (SELECT o.w, o.read_id, c.comp, sum(o.allele * c.state * 1.0) AS v FROM {obs} o JOIN {comps} c ON o.w = c.w AND o.pos = c.pos WHERE o.allele <> 0 GROUP BY o.w, o.read_id, c.comp) AS y
        ON x.w = y.w AND x.read_id = y.read_id AND x.comp < y.comp WHERE x.v <> 0 AND y.v <> 0) AS p GROUP BY w, a, b""",
    "bridgefeatures": """SELECT e.w, e.a, e.b, greatest(e.pw, e.mw) / (e.pw + e.mw) AS prob, greatest(e.pw, e.mw) / (e.pw + e.mw + 1.0) AS conf, abs(e.pw - e.mw) AS margin, (e.pw + e.mw) * (e.pw + e.mw) / (e.pw * e.pw + e.mw * e.mw) + (e.a + e.b) % 4 AS effective,
        x.n AS usable_a, y.n AS usable_b, y.s - x.e AS gap, e.pw + e.mw AS support FROM {obsedges} e JOIN (SELECT w, comp, count(*) AS n, min(pos) AS s, max(pos) AS e FROM {comps} GROUP BY w, comp) x ON x.w = e.w AND x.comp = e.a
        JOIN (SELECT w, comp, count(*) AS n, min(pos) AS s, max(pos) AS e FROM {comps} GROUP BY w, comp) y ON y.w = e.w AND y.comp = e.b""",
}
_INPUT = re.compile(r"\{(\w+)\}")


def needed(names: list[str]) -> list[str]:
    """The fixtures that ``names`` rest on, in order."""
    want: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n in FIXTURES and n not in want:
            want.add(n)
            todo += _INPUT.findall(FIXTURES[n])
    return [n for n in FIXTURES if n in want]


class Tables:
    """Fixtures of one folder as DataFrames, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.frames = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            if name in FIXTURES:
                uses = dict.fromkeys(_INPUT.findall(FIXTURES[name]))
                self.frames[name] = self.spark.sql(render(FIXTURES[name], True), **{u: self[u] for u in uses})
            else:
                self.frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.frames[name]


def spark_query(op: Operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return op.run(spark, {n: t[n] for n in op.inputs})

    query.__name__ = op.name
    return query


def duck(op: Operator) -> str:
    """The same query in DuckDB SQL over the test tables."""
    plain = lambda s: _INPUT.sub(r"\1", s)
    ctes = ", ".join(f"{n} AS ({plain(render(FIXTURES[n], False))})" for n in needed(op.inputs))
    body = plain(render(op.text(), False))
    return f"WITH {ctes} {body}" if ctes else body


def sql_queries() -> tuple[dict, dict]:
    from .. import operators  # noqa: F401  fills the registry

    return {n: spark_query(op) for n, op in REGISTRY.items()}, {n: duck(op) for n, op in REGISTRY.items()}
