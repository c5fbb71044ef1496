"""Queries of the operators that need a call per window, over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import donors, learning, scaffolds, stateful as st
from ..operators.phasing import BASE_SCORE
from ..sources import readers
from . import copying, regions
from .fixtures import FIXTURES, Tables, _INPUT, needed
from .operator import Operator, render

_READS = "w long, read_id long"


def _sql(t: Tables, text: str, out: str) -> DataFrame:
    op = Operator("q", text, out)
    return op.run(t.spark, {n: t[n] for n in op.inputs})


#: Bridges between components with their places in base pairs.
_BRIDGES = """SELECT e.w, e.a, e.b, CASE WHEN e.pw >= e.mw THEN 1 ELSE -1 END AS sign, greatest(e.pw, e.mw) / (e.pw + e.mw) AS prob, greatest(e.pw, e.mw) / (e.pw + e.mw + 1.0) AS conf, abs(e.pw - e.mw) AS margin, e.pw + e.mw AS total, greatest(0, greatest(x.s, y.s) - least(x.e, y.e)) AS gap, x.s AS a_s, x.e AS a_e, y.s AS b_s, y.e AS b_e
FROM {obsedges} e JOIN (SELECT w, comp, min(pos) AS s, max(pos) AS e FROM {comps} GROUP BY w, comp) x ON x.w = e.w AND x.comp = e.a JOIN (SELECT w, comp, min(pos) AS s, max(pos) AS e FROM {comps} GROUP BY w, comp) y ON y.w = e.w AND y.comp = e.b"""


def _bases(t: Tables) -> DataFrame:
    """The base score of each read and its sites."""
    base = _sql(t, BASE_SCORE.replace(":least", "2"), "w long, read_id long, n long, score double")
    sites = t["obs"].where("allele <> 0").groupBy("w", "read_id").agg(F.sort_array(F.collect_set("pos")).alias("sites"))
    return base.join(sites, ["w", "read_id"]).select("w", "read_id", F.col("score").alias("base"), "sites")


def _bridges(t: Tables) -> DataFrame:
    return _sql(t, _BRIDGES, "w long, a long, b long, sign int, prob double, conf double, margin double, total double, gap long, a_s long, a_e long, b_s long, b_e long")


_LINKS = "SELECT DISTINCT w, min(pos) OVER (PARTITION BY w, read_id) AS a, pos AS b FROM {frags}"


def _components(t: Tables) -> DataFrame:
    return st.per_window(_sql(t, _LINKS, "w long, a long, b long"), st.components, "w long, pos long, comp long")


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return st.per_window(t["frags"].join(_components(t), ["w", "pos"]), st.solve_component, st.SOLVED, "w", "comp")


_PAIRED = "SELECT w, read_id, pos, allele, weight FROM (SELECT *, count(*) OVER (PARTITION BY w, read_id) AS n FROM {frags} WHERE weight > 0) AS x WHERE n >= 2"


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each site; sites outside all solved components are unassigned."""
    t = Tables(spark, sf_dir)
    frags = _sql(t, _PAIRED, "w long, read_id long, pos long, allele int, weight double")
    links = frags.select("w", F.min("pos").over(Window.partitionBy("w", "read_id")).alias("a"), F.col("pos").alias("b")).distinct()
    comps = st.per_window(links, st.components, "w long, pos long, comp long")
    solved = st.per_window(frags.join(comps, ["w", "pos"]), st.solve_legacy, st.LEGACY, "w", "comp")
    unsolved = {"block_id": "unassigned", "solver": "unassigned", "state": 0, "conf": 0.0, "sites": 0, "fragments": 0, "support": 0.0, "conflict": 0.0}
    return t["sites"].select("w", "pos").join(solved, ["w", "pos"], "left").na.fill(unsolved)


_PRIORS = "SELECT f.w, f.read_id, f.pos, f.allele, f.weight, p.donor_bias, p.top_state, p.margin, p.lft, p.rgt FROM {frags} f LEFT JOIN {siteprior} p ON p.w = f.w AND p.pos = f.pos"


def _with_priors(t: Tables) -> DataFrame:
    return _sql(t, _PRIORS, "w long, read_id long, pos long, allele int, weight double, donor_bias double, top_state int, margin double, lft int, rgt int")


_LABELS = "w long, comp long, block long, orientation int"


def _window(table: str | Callable, fn, schema: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return st.per_window(table(t) if callable(table) else t[table], fn, schema)

    return query


def _scaffolds(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return scaffolds.scaffold(spark, {n: t[n] for n in ("blocks", "calls", "psites", "gmap", "panel")}, name)

    return query


def _donors(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return donors.features(spark, {n: t[n] for n in ("fills", "calls", "psites", "gmap", "panel")}, name)

    return query


def _labelled(t: Tables) -> DataFrame:
    return t["labelled"].select("id", "method", F.col("grp").cast("long").alias("grp"), F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), F.col("support").cast("double").alias("support"), F.col("anchors").cast("double").alias("anchors"))


def _learn(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, Tables(spark, sf_dir))

    return query


_FEATURES = ["score", "support", "anchors"]


def _ranker(spark, t):
    rows = _sql(t, "SELECT q.w, q.qid, q.cand, q.score, q.conf, CASE WHEN r.tstate = q.cstate THEN 1 ELSE 0 END AS label FROM {scores} q JOIN {truth} r ON r.w = q.w AND r.pos = q.pos", "w long, qid string, cand string, score double, conf double, label int")
    return learning.rank_candidates(rows.withColumn("sample", 0.5 + F.col("conf")), ["score", "conf"], ["w", "qid"], "sample")


def _json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments as a table with JSON cells, read back."""
    at = F.sort_array(F.collect_list(F.struct("pos", F.col("allele").cast("int").alias("allele"), F.col("weight").cast("double").alias("weight"))))
    cells = Tables(spark, sf_dir)["frags"].groupBy("w", "read_id").agg(at.alias("x"))
    return readers.fragments_from_cells(cells.select("w", "read_id", F.to_json("x.pos").alias("positions"), F.to_json("x.allele").alias("alleles"), F.to_json("x.weight").alias("weights")), "w", "read_id").withColumn("weight", F.round("weight", 6))


_SINKS = {"calls": "json", "blocks": "csv", "fills": "parquet"}


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in each format and read back."""
    t, folder = Tables(spark, sf_dir), readers.scratch_dir(spark)
    readers.write_results({n: t[n] for n in _SINKS}, folder, _SINKS)
    parts = []
    for name, kind in _SINKS.items():
        back = spark.read.schema(t[name].schema).format(kind).option("header", True).load(f"{folder}/{name}")
        parts.append(back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("w").cast("long").alias("windows"), F.countDistinct("block_id").alias("blocks")))
    return parts[0].union(parts[1]).union(parts[2])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return regions.queries() | copying.queries() | {
        **{n: _donors(n) for n in ("D13_donor_features", "D14_match_features", "D15_copying_features", "D17_scaffold_block_choice")},
        "I11_informative_reads": _window(_bases, st.informative_reads, _READS + ", base double, score double, rank long"),
        "I16_components": lambda spark, sf_dir: _components(Tables(spark, sf_dir)),
        "I17_I18_wmec_solve": _solved,
        "I21_wmec_legacy": _legacy,
        "I26_wmec_priors": _window(_with_priors, st.solve_with_priors, "w long, pos long, region long, state int, solver string, margin double"),
        "I31_component_stitching": _window("obsedges", st.stitch_components, _LABELS),
        "I32_two_colouring": _window("obsedges", st.two_colour, _LABELS),
        "I33_bridge_forest": _window(_bridges, lambda e: st.bridge_forest(e, prob=0.6, margin=0.5, degree=2, gap=1_000, blocks=8, span=10_000), _LABELS),
        "I34b_utility_forest": _window(_bridges, lambda e: st.utility_forest(e, prob=0.6, margin=0.5, degree=2, gain=100, merged=500, weight=0.001), _LABELS + ", mode string"),
        "I44_panel_scaffold": _scaffolds("I44_panel_scaffold"),
        "I45_scaffold_assignment": _scaffolds("I45_scaffold_assignment"),
        "I46_acceptance_model": _learn(lambda s, t: learning.out_of_fold(_labelled(t), _FEATURES, "grp").select("id", "fold", "prob")),
        "I46b_model_metrics": _learn(lambda s, t: learning.metrics(learning.out_of_fold(_labelled(t), _FEATURES, "grp"))),
        "I47_bridge_model": _learn(lambda s, t: learning.bridge_model(_labelled(t), [*_FEATURES, "label", "id"], "grp", {"label", "id"}).select("id", "fold", "prob")),
        "I48_candidate_ranker": _learn(lambda s, t: _ranker(s, t).select("w", "qid", "cand", "rank_score", "rank")),
        "I48b_ranker_top1": _learn(lambda s, t: learning.top_one(_ranker(s, t))),
        "I49_site_confidence": _learn(lambda s, t: learning.holdout_by_group(_labelled(t), _FEATURES, "method", "grp").select("id", "held", "prob")),
        "I50_feature_pruning": _learn(lambda s, t: s.createDataFrame(learning.prune(_labelled(t), {"evidence": ["support", "anchors"], "model": ["score"]}, "grp"), "step int, phase string, dropped string, auc double, ap double, features int, best int")),
        "H9_json_cells": _json_cells,
        "A21_sinks": _sinks,
        "F6_importances": _learn(lambda s, t: s.createDataFrame(learning.importances(_labelled(t), _FEATURES), "feature string, gain double")),
    }


def _recursive(uses: list[str], ctes: str, select: str) -> str:
    plain = lambda x: _INPUT.sub(r"\1", render(x, False))
    own = ", ".join(f"{n} AS ({plain(FIXTURES[n])})" for n in needed(uses))
    return f"WITH RECURSIVE {own}, {plain(ctes)} {select}"


def oracle_sql() -> dict[str, str]:
    """Recursive SQL of those that have a practical form."""
    return regions.oracle_sql() | copying.oracle_sql() | {
        "I16_components": _recursive(
            ["frags"],
            """link AS (SELECT DISTINCT x.w, x.pos AS a, y.pos AS b FROM frags x JOIN frags y ON x.w = y.w AND x.read_id = y.read_id),
            reach AS (SELECT w, a, b FROM link UNION SELECT r.w, r.a, l.b FROM reach r JOIN link l ON l.w = r.w AND l.a = r.b),
            root AS (SELECT w, a AS pos, min(b) AS root FROM reach GROUP BY w, a)""",
            "SELECT CAST(w AS BIGINT) AS w, CAST(pos AS BIGINT) AS pos, CAST(dense_rank() OVER (PARTITION BY w ORDER BY root) - 1 AS BIGINT) AS comp FROM root",
        ),
        "H9_json_cells": _recursive(["frags"], "x AS (SELECT 1)", "SELECT CAST(w AS BIGINT) AS w, CAST(read_id AS BIGINT) AS read_id, CAST(pos AS BIGINT) AS pos, CAST(allele AS INT) AS allele, round(CAST(weight AS DOUBLE), 6) AS weight FROM frags"),
        "A21_sinks": _recursive(list(_SINKS), "x AS (SELECT 1)", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, CAST(sum(w) AS BIGINT) AS windows, count(DISTINCT block_id) AS blocks FROM {n}" for n in _SINKS)),
        "I32_two_colouring": _recursive(
            ["obsedges"],
            """nodes AS (SELECT w, a AS n FROM obsedges UNION SELECT w, b FROM obsedges), one AS (SELECT w, a, b, CASE WHEN pw >= mw THEN 1 ELSE -1 END AS s FROM obsedges WHERE round(greatest(pw, mw) / round(pw + mw, 9), 9) >= 0.8),
            step AS (SELECT w, a, b, s FROM one UNION ALL SELECT w, b, a, s FROM one),
            reach AS (SELECT w, n, n AS m, 1 AS s FROM nodes UNION SELECT r.w, r.n, t.b, r.s * t.s FROM reach r JOIN step t ON t.w = r.w AND t.a = r.m),
            broken AS (SELECT DISTINCT w, n FROM reach WHERE n = m AND s = -1), low AS (SELECT w, n, min(m) AS m FROM reach GROUP BY w, n)""",
            """SELECT CAST(r.w AS BIGINT) AS w, CAST(r.n AS BIGINT) AS comp, CAST(CASE WHEN b.n IS NULL THEN r.m ELSE r.n END AS BIGINT) AS block, CAST(max(CASE WHEN b.n IS NULL THEN r.s ELSE 1 END) AS INT) AS orientation
            FROM reach r JOIN low l ON l.w = r.w AND l.n = r.n AND l.m = r.m LEFT JOIN broken b ON b.w = r.w AND b.n = r.n GROUP BY r.w, r.n, r.m, b.n""",
        ),
    }
