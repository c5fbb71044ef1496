"""Regions of uncertain sites: how they form, the reads that reach them, their fragments, states and orientation.

All steps that touch reads are joins, windows and sums keyed by window and
region; Python sees one region's fragments (at most ``most``), one region's
options, or one window's list of regions.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .stateful import components, per_window

#: Evidence of one agreeing site for the same haplotype, log(0.97 / 0.03).
AGREE = float(np.log(0.97 / 0.03))


def clean_observations(obs: DataFrame, min_conf: float = 0.025, min_delta: float = 0.45) -> DataFrame:
    """Unambiguous observations of an allele with enough confidence or score difference."""
    return obs.where(F.col("allele").isin(1, -1) & (F.coalesce("amb", F.lit(0)) == 0) & ((F.coalesce("conf", F.lit(0.0)) >= min_conf) | (F.abs(F.coalesce("delta", F.lit(0.0))) >= min_delta)))


def split_runs(df: DataFrame, keys: list[str], max_sites: int = 24, max_span: int = 100_000) -> DataFrame:
    """``keys, pos, piece``; a new piece begins where one has ``max_sites`` or the next site is over ``max_span`` from its start.

    A piece's start depends on all before it, so the sorted positions of a key
    are folded in order; the sites of a window bound the array.
    """
    step = f"""aggregate(ps, named_struct('s', 0L, 'n', 0, 'k', 0L, 'out', CAST(array() AS ARRAY<BIGINT>)), (a, p) -> CASE
        WHEN a.n = 0 THEN named_struct('s', p, 'n', 1, 'k', a.k, 'out', concat(a.out, array(a.k)))
        WHEN a.n >= {int(max_sites)} OR p - a.s > {int(max_span)} THEN named_struct('s', p, 'n', 1, 'k', a.k + 1, 'out', concat(a.out, array(a.k + 1)))
        ELSE named_struct('s', a.s, 'n', a.n + 1, 'k', a.k, 'out', concat(a.out, array(a.k))) END, a -> a.out)"""
    runs = df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("pos").cast("long"))).alias("ps")).withColumn("ks", F.expr(step))
    return runs.select(*keys, F.explode(F.arrays_zip("ps", "ks")).alias("x")).select(*keys, F.col("x.ps").alias("pos"), F.col("x.ks").alias("piece"))


def ranked_candidates(scores: DataFrame) -> DataFrame:
    """The best candidate of each site, its lead over the second (over -999 without one) and the best one with a state."""
    order = Window.partitionBy("w", "pos").orderBy(F.desc("score"), "cand")
    ranked = scores.withColumn("rn", F.row_number().over(order)).withColumn("nxt", F.lead("score").over(order))
    nonzero = F.min_by("cstate", F.when(F.col("cstate") != 0, F.col("rn")))
    return ranked.groupBy("w", "pos").agg(F.min_by("cstate", "rn").alias("top_state"), F.min_by(F.col("score") - F.coalesce("nxt", F.lit(-999.0)), "rn").alias("margin"), nonzero.alias("best_state"))


def nearest_anchors(spans: DataFrame, scaffold: DataFrame, id_col: str) -> DataFrame:
    """Position and state of the last phased scaffold site before ``first`` and of the next one after ``last``."""
    own = scaffold.where("state <> 0").select("w", "pos", F.lit(1).alias("kind"), F.lit(None).cast("long").alias(id_col), F.struct("pos", F.col("state").cast("int").alias("state")).alias("x"))

    def side(edge: str, order: Column, name: str) -> DataFrame:
        asked = spans.select("w", F.col(edge).alias("pos"), F.lit(0).alias("kind"), F.col(id_col).cast("long").alias(id_col), F.lit(None).cast("struct<pos: bigint, state: int>").alias("x"))
        seen = Window.partitionBy("w").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = asked.unionByName(own).withColumn("a", F.last("x", ignorenulls=True).over(seen)).where("kind = 0")
        return found.select("w", id_col, F.col("a.pos").alias(f"{name}_pos"), F.col("a.state").alias(f"{name}_state"))

    return spans.join(side("first", F.asc("pos"), "left_anchor"), ["w", id_col]).join(side("last", F.desc("pos"), "right_anchor"), ["w", id_col])


def connectivity_regions(
    obs: DataFrame, scores: DataFrame, calls: DataFrame, scaffold: DataFrame, *, min_conf: float = 0.025, min_delta: float = 0.45, min_sites: int = 2, max_gap: int = 100_000, min_margin: float = 0.02, max_sites: int = 24, max_span: int = 100_000
) -> DataFrame:
    """Regions of candidate sites that reads connect, with their scaffold anchors.

    Reads with ``min_sites`` sites link each to the next at most ``max_gap``
    away.  A site is a candidate if the ranker wants another state than the call,
    if there is no call, or if its lead is ``min_margin``.  The candidates of a
    component, which other sites may bridge, are cut as in E8; candidates that
    nothing links are regions of their own.
    """
    read = Window.partitionBy("w", "read_id")
    sites = clean_observations(obs, min_conf, min_delta).select("w", "read_id", "pos").distinct()
    links = sites.withColumn("n", F.count(F.lit(1)).over(read)).withColumn("b", F.lead("pos").over(read.orderBy("pos"))).where((F.col("n") >= min_sites) & (F.col("b") - F.col("pos") <= max_gap)).select("w", F.col("pos").alias("a"), "b").distinct()
    comps = per_window(links, components, "w long, pos long, comp long")
    local = calls.select("w", "pos", F.col("state").alias("local"))
    wanted = ranked_candidates(scores).join(local, ["w", "pos"], "left").withColumn("local", F.coalesce("local", F.lit(0)))
    wanted = wanted.where(((F.col("top_state") != 0) & (F.col("top_state") != F.col("local"))) | (F.col("local") == 0) | (F.round("margin", 9) >= min_margin)).select("w", "pos")
    members = wanted.join(comps, ["w", "pos"], "left")
    pieces = split_runs(members.where("comp IS NOT NULL"), ["w", "comp"], max_sites, max_span).unionByName(members.where("comp IS NULL").select("w", F.lit(None).cast("long").alias("comp"), "pos", F.col("pos").alias("piece")))
    regions = pieces.groupBy("w", "comp", "piece").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    regions = regions.select("w", "ps", F.col("ps")[0].alias("first"), F.element_at("ps", -1).alias("last")).withColumn("region_id", F.row_number().over(Window.partitionBy("w").orderBy("first", "last")).cast("long"))
    return nearest_anchors(regions, scaffold, "region_id")


def region_table(regions: DataFrame) -> DataFrame:
    """Regions as they are written: one row each, positions as a list."""
    return regions.select("w", "region_id", F.size("ps").cast("long").alias("n_sites"), F.col("first").alias("start_pos"), F.col("last").alias("end_pos"), (F.col("last") - F.col("first")).alias("span_bp"), F.array_join(F.transform("ps", lambda p: p.cast("string")), ",").alias("positions"), "left_anchor_pos", "left_anchor_state", "right_anchor_pos", "right_anchor_state")


def members_of(regions: DataFrame) -> DataFrame:
    return regions.select("w", "region_id", F.size("ps").alias("size"), F.explode("ps").alias("pos"))


# ---- reads ---------------------------------------------------------------


def cover_greedily(rows: DataFrame, keys: list[str], rank: list[Column], depth: int, most: int) -> DataFrame:
    """Reads that a greedy pass in the order of ``rank`` keeps: those with a site covered under ``depth`` times so far, ``most`` at most.

    A site's first ``depth`` reads are all kept, for the site isn't covered
    before; later ones find it covered.  So a read is kept exactly if it is among
    the first ``depth`` at one of its sites, and no scan in order is needed.
    ``rows`` has a row for each read and site.
    """
    own = Window.partitionBy(*keys, "pos").orderBy(*rank)
    kept = rows.withColumn("_at", F.row_number().over(own)).where(F.col("_at") <= depth).select(*keys, "read_id").distinct()
    reads = rows.dropDuplicates([*keys, "read_id"]).join(kept, [*keys, "read_id"])
    return reads.withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy(*rank)) - 1).cast("long")).where(F.col("rank") < most).drop("pos", "_at")


def bundles(obs: DataFrame, sites: DataFrame) -> DataFrame:
    """The best observation (base and mapping quality) of each read and site, with the score of the read's bundle."""
    quality = F.col("baseq").cast("long") + F.col("mapq")
    best = Window.partitionBy("w", "read_id", "pos").orderBy(F.desc("quality"), "idx")
    own = obs.where("allele <> 0").join(sites.select("w", "pos").distinct(), ["w", "pos"], "left_semi").withColumn("quality", quality).withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    clip = lambda x, top: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(x) / top))
    read = Window.partitionBy("w", "read_id")
    n = F.count(F.lit(1)).over(read)
    worth = F.sum(0.5 + 0.5 * clip("baseq", 40.0) * clip("mapq", 60.0)).over(read)
    return own.select("w", "read_id", "pos", F.col("allele").cast("int").alias("allele"), "quality", n.cast("long").alias("n"), F.round(3.0 * (n - 1) + n + 0.25 * worth, 9).alias("score"))


def coverage_selection(obs: DataFrame, sites: DataFrame, *, least: int = 3, depth: int = 12, most: int = 20_000) -> DataFrame:
    """Bundles of at least ``least`` sites, best first, while any of their sites is covered under ``depth`` times."""
    rows = bundles(obs, sites).where(F.col("n") >= least)
    return cover_greedily(rows, ["w"], [F.desc("n"), F.desc("score"), F.asc("read_id")], depth, most).select("w", "read_id", "n", "score", "rank")


def _runs(part: pd.DataFrame, keys: list[str], columns: list[str]):
    """Each run of equal keys in sorted rows, with its rows as tuples."""
    part = part.sort_values([*keys, "pos"], kind="stable")
    rows = list(zip(*(part[c].tolist() for c in columns)))
    at = np.flatnonzero(np.append(True, (part[keys].to_numpy()[1:] != part[keys].to_numpy()[:-1]).any(1)))
    for i, j in zip(at, np.append(at[1:], len(rows))):
        yield rows[i:j]


def _superreads(part: pd.DataFrame) -> pd.DataFrame:
    """Reads in order join the first superread that shares a site and contradicts none; an index from (site, allele) finds it."""
    has: dict[tuple[int, int], set[int]] = defaultdict(set)
    held: list[dict[int, tuple[int, int]]] = []
    rows = []
    for own in _runs(part, ["rank"], ["read_id", "pos", "allele", "quality"]):
        fits = set().union(*(has[p, a] for _, p, a, _ in own)).difference(*(has[p, -a] for _, p, a, _ in own))
        at = min(fits, default=len(held))
        if at == len(held):
            held.append({})
        for r, p, a, q in own:
            if p not in held[at] or q > held[at][p][1]:
                held[at][p] = (a, q)
            has[p, a].add(at)
            rows.append((r, at, p))
    w = part["w"].iloc[0]
    return pd.DataFrame([(w, r, s, p, *held[s][p]) for r, s, p in rows], columns=["w", "read_id", "superread", "pos", "allele", "quality"])


def superread_merge(obs: DataFrame, sites: DataFrame, **limits) -> DataFrame:
    """Members of each superread with the allele and quality that it keeps at their sites (the best observation's)."""
    kept = coverage_selection(obs, sites, **limits).select("w", "read_id", "rank")
    rows = bundles(obs, sites).join(kept, ["w", "read_id"]).select("w", "read_id", "pos", "allele", "quality", "rank")
    return per_window(rows, _superreads, "w long, read_id long, superread long, pos long, allele int, quality long")


def weighted_observations(obs: DataFrame, min_conf: float = 0.025, min_delta: float = 0.45) -> DataFrame:
    """The heaviest clean observation of each read and site: 1.5 weight + 2 confidence + score difference (3 at most) + base quality / 40, within 0.15 and 8."""
    delta = F.abs(F.coalesce("delta", F.lit(0.0)))
    weight = 1.5 * F.coalesce("w2", F.lit(0.5)) + 2.0 * F.coalesce("conf", F.lit(0.0)) + F.least(delta, F.lit(3.0)) + F.col("baseq") / 40.0
    best = Window.partitionBy("w", "read_id", "pos").orderBy(F.desc("weight"), "idx")
    own = clean_observations(obs, min_conf, min_delta).withColumn("weight", F.round(F.greatest(F.lit(0.15), F.least(F.lit(8.0), weight)), 9))
    return own.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("w", "read_id", "pos", F.col("allele").cast("int").alias("allele"), "weight")


def _region_reads(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """Observations in regions with their read's score there; reads need two sites unless the region has one."""
    own = Window.partitionBy("w", "region_id", "read_id")
    rows = weighted_observations(obs).join(members_of(regions), ["w", "pos"])
    span = F.max("pos").over(own) - F.min("pos").over(own) + 1
    n = F.count(F.lit(1)).over(own)
    return rows.withColumn("n", n).withColumn("score", F.round(n * F.avg("weight").over(own) * F.log(span + 10.0), 9)).where((F.col("n") >= 2) | (F.col("size") == 1))


def active_reads(obs: DataFrame, regions: DataFrame, *, depth: int = 32, most: int = 96) -> DataFrame:
    """The reads of each region by n * mean weight * ln(span + 10), under caps of depth and number."""
    kept = cover_greedily(_region_reads(obs, regions), ["w", "region_id"], [F.desc("score"), F.desc("read_id")], depth, most)
    return kept.select("w", "region_id", "read_id", F.col("n").cast("long").alias("n"), "score", "rank")


Site = dict[int, tuple[int, float]]


def merge_reads(reads: list[Site], accept: float = 6.0, overlap: int = 2) -> list[tuple[int, Site]]:
    """Clusters (number of reads, alleles with weights) of a region's reads, taken in order.

    A read joins the cluster with the largest log-odds above ``accept``, over
    ``overlap`` shared sites at least; an index from sites finds the clusters.
    Equal alleles add their weights; unequal ones cancel, the heavier stays (of
    equal ones the older), with 0.01 at least.
    """
    at_site: dict[int, list[int]] = defaultdict(list)
    clusters: list[Site] = []
    size: list[int] = []
    for mine in reads:
        agree: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for p, (a, _) in mine.items():
            for c in at_site[p]:
                agree[c][clusters[c][p][0] == a] += 1
        odds = {c: (yes - no) * AGREE for c, (no, yes) in agree.items() if yes + no >= overlap}
        best = max(odds, key=lambda c: (odds[c], -c), default=None)
        if best is None or odds[best] <= accept:
            best = len(clusters)
            clusters.append({})
            size.append(0)
        size[best] += 1
        held = clusters[best]
        for p, (a, wt) in mine.items():
            if p not in held:
                held[p] = (a, wt)
                at_site[p].append(best)
                continue
            b, old = held[p]
            held[p] = (b, old + wt) if a == b else (a, max(0.01, wt - old)) if wt > old else (b, max(0.01, old - wt))
    return list(zip(size, clusters))


#: Regions that one call takes.
BATCH = 64


def _batch() -> Column:
    return F.floor(F.col("region_id") / BATCH).alias("_batch")


def _merge_batch(part: pd.DataFrame) -> pd.DataFrame:
    reads: dict[int, list[Site]] = defaultdict(list)
    for own in _runs(part, ["region_id", "rank"], ["region_id", "pos", "allele", "weight"]):
        reads[own[0][0]].append({p: (a, wt) for _, p, a, wt in own})
    w = part["w"].iloc[0]
    rows = [(w, r, c, n, p, a, round(wt, 6)) for r, own in reads.items() for c, (n, held) in enumerate(merge_reads(own)) for p, (a, wt) in sorted(held.items())]
    return pd.DataFrame(rows, columns=["w", "region_id", "cluster", "reads", "pos", "allele", "weight"])


MERGED = "w long, region_id long, cluster long, reads long, pos long, allele int, weight double"


def probabilistic_merge(obs: DataFrame, regions: DataFrame, *, depth: int = 32, most: int = 96) -> DataFrame:
    """Merged fragments of the active reads, a row for each of their sites."""
    kept = active_reads(obs, regions, depth=depth, most=most).select("w", "region_id", "read_id", "rank")
    rows = _region_reads(obs, regions).join(kept, ["w", "region_id", "read_id"]).select("w", "region_id", "read_id", "rank", "pos", "allele", "weight")
    return rows.groupBy("w", _batch()).applyInPandas(lambda p: _merge_batch(p), MERGED)


def scaffold_fragments(regions: DataFrame, scaffold: DataFrame, *, anchor: float = 4.0, continuity: float = 2.0) -> DataFrame:
    """Made-up fragments from phased scaffold sites in a region: one a scaffold block (weight max(4, 4 conf)) and one of all of them (max(2, 3 conf))."""
    inside = members_of(regions).join(scaffold.where("state <> 0 AND conf > 0").select("w", "pos", "block_id", F.col("state").cast("int").alias("allele"), "conf"), ["w", "pos"])
    block = inside.where("block_id IS NOT NULL AND block_id <> ''").select("w", "region_id", F.concat(F.lit("SCAFFOLD::"), "block_id").alias("fragment"), "pos", "allele", F.greatest(F.lit(anchor), F.col("conf") * 4.0).alias("weight"))
    return block.unionByName(inside.select("w", "region_id", F.lit("SCAFFOLD::DIRECT").alias("fragment"), "pos", "allele", F.greatest(F.lit(continuity), F.col("conf") * 3.0).alias("weight")))


# ---- states and orientation ----------------------------------------------


def read_weight() -> Column:
    """Weight of an observation between regions: its weight within 0.05 and 6, or 1 + 6 conf within 0.05 and 4, or base quality / 10."""
    clip = lambda x, top: F.when(x.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(top), x)))  # noqa: E731  least() skips nulls
    return F.coalesce(clip(F.col("w2"), 6.0), clip(1.0 + 6.0 * F.col("conf"), 4.0), clip(F.col("baseq") / 10.0, 6.0))


def pair_costs(obs: DataFrame, solved: DataFrame) -> DataFrame:
    """Cost of each pair of regions next to each other on a read, if they keep (``same``) or change (``other``) their relation.

    A read pays, at the cheaper of its two haplotypes, the weight of the sites
    that contradict it.  Turning a region swaps its agreeing and contradicting
    weight, so that the four combinations have two costs.
    """
    own = obs.where("allele IN (1, -1) AND coalesce(amb, 0) = 0").withColumn("wt", read_weight()).join(solved.select("w", "pos", "region_id", "state"), ["w", "pos"])
    of = lambda sign: F.sum(F.when(F.col("allele") == sign * F.col("state"), F.col("wt")).otherwise(0.0))
    sums = own.groupBy("w", "read_id", "region_id").agg(F.min("pos").alias("at"), of(1).alias("yes"), of(-1).alias("no"))
    read = Window.partitionBy("w", "read_id").orderBy("at", "region_id")
    nxt = sums.withColumns({f"n_{c}": F.lead(c).over(read) for c in ("region_id", "yes", "no")}).where("n_region_id IS NOT NULL")
    same = F.least(F.col("no") + F.col("n_no"), F.col("yes") + F.col("n_yes"))
    other = F.least(F.col("no") + F.col("n_yes"), F.col("yes") + F.col("n_no"))
    return nxt.groupBy("w", F.col("region_id").alias("a"), F.col("n_region_id").alias("b")).agg(F.sum(same).alias("same"), F.sum(other).alias("other"), F.count(F.lit(1)).alias("reads"))


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """Cheapest orientations of a window's regions in order; of equal ones that with +1, from the last region back."""
    part = part.sort_values("region_id")
    unary = part[["plus", "minus"]].to_numpy(float)
    pair = part[["same", "other"]].to_numpy(float)
    best, back = unary[0], []
    for own, (same, other) in zip(unary[1:], pair[1:]):
        come = np.round(best + np.array([[same, other], [other, same]]), 9)
        back.append(come.argmin(1))
        best = own + come.min(1)
    at = [int(round(best[1], 9) < round(best[0], 9))]
    for come in reversed(back):
        at.append(int(come[at[-1]]))
    return part.assign(raw=[1 - 2 * k for k in reversed(at)])[["w", "region_id", "raw"]]


def orient_regions(obs: DataFrame, regions: DataFrame, solved: DataFrame, calls: DataFrame, *, anchor: float = 2.5, baseline: float = 0.25, donor: float = 1.0, min_flip: float = 0.75) -> DataFrame:
    """A sign for each solved region: costs of its own and of the reads to the next one, minimised along the window.

    A sign costs ``baseline`` for each call it contradicts, ``anchor`` for each
    end that contradicts its anchor, and ``donor`` times the mean donor bias
    against it; a flip costs ``anchor`` times the sites per region that agreed
    with their anchor (2 at most).  A flip whose costs differ by less than
    ``min_flip`` stands only if a read joins the region to another.
    ``solved``: w, region_id, pos, state, anchor_ok, donor_bias.
    """
    ordered = lambda f: f("state", "pos")
    against = lambda sign: F.sum(F.when((F.coalesce("local", F.lit(0)) != 0) & (sign * F.col("state") != F.col("local")), 1).otherwise(0))
    own = solved.join(calls.select("w", "pos", F.col("state").alias("local")), ["w", "pos"], "left").groupBy("w", "region_id").agg(
        F.count(F.lit(1)).alias("n"), against(1).alias("c_plus"), against(-1).alias("c_minus"), ordered(F.min_by).alias("head"), ordered(F.max_by).alias("tail"), F.sum(F.coalesce("anchor_ok", F.lit(0))).alias("ok"), F.avg(F.coalesce("donor_bias", F.lit(0.0))).alias("bias")
    )
    own = own.join(regions.select("w", "region_id", F.coalesce("left_anchor_state", F.lit(0)).alias("ls"), F.coalesce("right_anchor_state", F.lit(0)).alias("rs")), ["w", "region_id"], "left")
    ends = lambda sign: sum(F.when((F.coalesce(s, F.lit(0)) != 0) & (sign * F.col(e) != F.col(s)), anchor).otherwise(0.0) for e, s in (("head", "ls"), ("tail", "rs")))
    own = own.select("w", "region_id", F.round(baseline * F.col("c_plus") + ends(1) - donor * F.col("bias"), 9).alias("plus"), F.round(baseline * F.col("c_minus") + ends(-1) + anchor * F.least(F.lit(2.0), F.col("ok") / F.col("n")) + donor * F.col("bias"), 9).alias("minus"))
    pairs = pair_costs(obs, solved)
    before = own.withColumn("a", F.lag("region_id").over(Window.partitionBy("w").orderBy("region_id")))
    linked = before.join(pairs.select("w", "a", F.col("b").alias("region_id"), F.round("same", 9).alias("same"), F.round("other", 9).alias("other")), ["w", "a", "region_id"], "left").na.fill(0.0, ["same", "other"])
    raw = per_window(linked.select("w", "region_id", "plus", "minus", "same", "other"), _chain, "w long, region_id long, raw int")
    met = pairs.select("w", F.explode(F.array("a", "b")).alias("region_id"), "reads").groupBy("w", "region_id").agg(F.sum("reads").alias("bridge_reads"))
    out = own.join(raw, ["w", "region_id"]).join(met, ["w", "region_id"], "left").withColumn("margin", F.round(F.abs(F.col("plus") - F.col("minus")), 6)).withColumn("bridge_reads", F.coalesce("bridge_reads", F.lit(0).cast("long")))
    weak = (F.col("raw") == -1) & (F.col("margin") < min_flip) & (F.col("bridge_reads") == 0)
    return out.select("w", "region_id", F.when(weak, 1).otherwise(F.col("raw")).cast("int").alias("orientation"), "raw", "margin", "bridge_reads")


#: What a candidate's features add to its score.
FEATURES = {"anchor_consistent": 0.8, "anchor_conflict": -0.6, "donor_match": 0.4, "realign_margin": 0.4, "left_match": 0.2, "right_match": 0.2}


def region_options(cands: DataFrame, regions: DataFrame) -> DataFrame:
    """The two best candidates of each site that have a state, and its abstention; score with the features that the table has, 0.05 less for an abstention."""
    worth = F.col("score") - F.when(F.col("cstate") == 0, 0.05).otherwise(0.0)
    for name, factor in FEATURES.items():
        if name in cands.columns:
            worth = worth + factor * F.coalesce(F.col(name), F.lit(0))
    kind = Window.partitionBy("w", "pos", F.col("cstate") == 0)
    ranked = cands.withColumn("_up", F.row_number().over(kind.orderBy(F.desc("score"), "cand"))).withColumn("_down", F.row_number().over(kind.orderBy("score", F.desc("cand"))))
    kept = ranked.where(F.when(F.col("cstate") == 0, F.col("_down") == 1).otherwise(F.col("_up") <= 2))
    option = F.row_number().over(Window.partitionBy("w", "pos").orderBy(F.col("cstate") == 0, "_up"))
    return kept.withColumn("option", option).join(members_of(regions), ["w", "pos"]).select("w", "region_id", "pos", "option", "cand", F.col("cstate").cast("int").alias("state"), F.round(worth, 9).alias("worth"))


def pair_agreement(obs: DataFrame, regions: DataFrame, scaffold: DataFrame) -> DataFrame:
    """Of two sites of a region: the weight of reads that say equal less that of those that say different; fragments of the scaffold count half more."""
    weight = F.when(F.col("w2") > 0, F.col("w2")).otherwise(F.greatest(F.lit(0.01), F.coalesce("conf", F.lit(0.0)) + 0.1 * F.abs(F.coalesce("delta", F.lit(0.0)))))
    reads = obs.where("allele IN (1, -1)").select("w", F.col("read_id").cast("string").alias("read"), "pos", F.col("allele").cast("int").alias("allele"), weight.alias("weight"), "idx", F.lit(1.0).alias("factor")).join(members_of(regions).select("w", "region_id", "pos"), ["w", "pos"])
    made = scaffold_fragments(regions, scaffold).select("w", F.col("fragment").alias("read"), "pos", "allele", "weight", F.col("pos").alias("idx"), F.lit(1.5).alias("factor"), "region_id")
    rows = reads.unionByName(made)
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, ["w", "region_id", "read"]).where("x.factor = y.factor AND (x.pos < y.pos OR (x.pos = y.pos AND x.idx < y.idx))")
    term = F.least("x.weight", "y.weight") * F.col("x.factor") * F.col("x.allele") * F.col("y.allele")
    return both.groupBy("w", "region_id", F.col("x.pos").alias("p"), F.col("y.pos").alias("q")).agg(F.round(F.sum(term), 9).alias("weight"))


def solve_region(sites: list[tuple[np.ndarray, np.ndarray]], link: np.ndarray, exact_sites: int = 8, exact_states: int = 50_000, beam: int = 64, pair: float = 0.35) -> tuple[list[int], float, float]:
    """Chosen option of each site, the score, and its lead over the next.

    ``sites`` has the states and worths of each site's options, ``link[j, i]``
    (i <= j) the agreement of two sites.  The score is the sum of worths and
    ``pair`` times link times both states; all combinations are held for up to
    ``exact_sites`` sites, else the ``beam`` best of each prefix.
    """
    exact = len(sites) <= exact_sites and np.prod([len(s) for s, _ in sites]) <= exact_states
    picks, values, score = np.zeros((1, 0), int), np.zeros((1, 0)), np.zeros(1)
    for k, (states, worth) in enumerate(sites):
        n, m = len(states), len(score)
        s = np.tile(states, m)
        values, picks = np.repeat(values, n, axis=0), np.repeat(picks, n, axis=0)
        score = np.repeat(score, n) + np.tile(worth, m) + pair * s * (values @ link[k, :k] + s * link[k, k])
        values, picks = np.c_[values, s], np.c_[picks, np.tile(np.arange(n), m)]
        if not exact:
            kept = np.argsort(-np.round(score, 9), kind="stable")[:beam]
            values, picks, score = values[kept], picks[kept], score[kept]
    score = np.round(score, 9)
    best = int(score.argmax())
    rest = np.delete(score, best)
    return picks[best].tolist(), float(score[best]), float(score[best] - rest.max()) if len(rest) else 0.0


_RESOLVED_COLUMNS = ["w", "region_id", "pos", "cand", "state", "score", "margin"]


def _solve_batch(options: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    if not len(options):
        return pd.DataFrame(columns=_RESOLVED_COLUMNS)
    links: dict[int, list] = defaultdict(list)
    for r, p, q, wt in zip(pairs["region_id"].tolist(), pairs["p"].tolist(), pairs["q"].tolist(), pairs["weight"].tolist()):
        links[r].append((p, q, wt))
    regions: dict[int, list] = defaultdict(list)
    for own in _runs(options.sort_values("option"), ["region_id"], ["region_id", "pos", "cand", "state", "worth"]):
        regions[own[0][0]] = own
    w, rows = options["w"].iloc[0], []
    for r, own in regions.items():
        by_site: dict[int, list] = defaultdict(list)
        for _, p, *option in own:
            by_site[p].append(option)
        number = {p: k for k, p in enumerate(by_site)}
        link = np.zeros((len(number), len(number)))
        for p, q, wt in links[r]:
            if p in number and q in number:
                link[number[q], number[p]] += wt
        picks, score, margin = solve_region([(np.array([o[1] for o in x], float), np.array([o[2] for o in x], float)) for x in by_site.values()], link)
        rows += [(w, r, p, by_site[p][c][0], by_site[p][c][1], round(score, 6), round(margin, 6)) for p, c in zip(by_site, picks)]
    return pd.DataFrame(rows, columns=_RESOLVED_COLUMNS)


RESOLVED = "w long, region_id long, pos long, cand string, state int, score double, margin double"


def resolve_regions(obs: DataFrame, cands: DataFrame, regions: DataFrame, scaffold: DataFrame) -> DataFrame:
    """The states of each region's sites from their candidates and the reads inside it."""
    options, pairs = region_options(cands, regions), pair_agreement(obs, regions, scaffold)
    pairs = pairs.toDF(*pairs.columns)  # else its keys are the same columns as those of options
    return options.groupBy("w", _batch()).cogroup(pairs.groupBy("w", _batch())).applyInPandas(_solve_batch, RESOLVED)
