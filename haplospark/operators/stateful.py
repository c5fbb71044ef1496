"""Combinatorial, sequence and order-dependent operators: one Arrow-backed call per window or component.

A window is a few megabases, so its rows are bounded by the panel and the depth,
not by the genome or the cohort; windows run in parallel, and what can be solved
by component is dealt by (window, component).  Each function takes
and returns pandas frames and knows nothing of Spark.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EXACT_SITES = 18
#: Phasings that an exact solver holds at once.
MASKS = 4096


def per_window(df: DataFrame, fn, schema: str, *keys: str) -> DataFrame:
    return df.groupBy(*(keys or ("w",))).applyInPandas(lambda frame: fn(frame), schema)


# ---- sets of sites -------------------------------------------------------


class SignedSets:
    """Union-find with a sign relative to the root."""

    def __init__(self):
        self.up: dict = {}
        self.sign: dict = {}
        self.size: dict = {}

    def find(self, x):
        if x not in self.up:
            self.up[x], self.sign[x], self.size[x] = x, 1, 1
        path, s = [], 1
        while self.up[x] != x:
            path.append(x)
            x = self.up[x]
        for p in reversed(path):
            s = self.sign[p] * (s if self.up[p] != x else 1)
            self.up[p], self.sign[p] = x, s
        return x, (self.sign[path[0]] if path else 1)

    def union(self, a, b, sign: int) -> bool | None:
        """True if joined, False if already joined consistently, None on conflict."""
        (ra, sa), (rb, sb) = self.find(a), self.find(b)
        if ra == rb:
            return False if sa * sb == sign else None
        if self.size[ra] < self.size[rb]:
            ra, rb = rb, ra
        self.up[rb], self.sign[rb] = ra, sa * sb * sign
        self.size[ra] += self.size[rb]
        return True


def links(frags: pd.DataFrame) -> pd.DataFrame:
    """Distinct (w, a, b): the first site of a read and each of its sites."""
    return pd.DataFrame({"w": frags["w"], "a": frags.groupby("read_id")["pos"].transform("min"), "b": frags["pos"]}).drop_duplicates()


def components(linked: pd.DataFrame) -> pd.DataFrame:
    """Connected components of sites that links (w, a, b) join, numbered by (first, last) position."""
    sets = SignedSets()
    for a, b in zip(linked["a"].tolist(), linked["b"].tolist()):
        sets.find(a)
        if a != b:
            sets.union(a, b, 1)
    groups: dict = {}
    for p in sorted({*linked["a"].tolist(), *linked["b"].tolist()}):
        groups.setdefault(sets.find(p)[0], []).append(p)
    order = sorted(groups.values(), key=lambda g: (g[0], g[-1]))
    w = linked["w"].iloc[0]
    return pd.DataFrame([(w, p, i) for i, g in enumerate(order) for p in g], columns=["w", "pos", "comp"])


def split_component(rows: pd.DataFrame, max_sites: int = 24, max_span: int = 1500) -> pd.DataFrame:
    """A new piece when it has ``max_sites`` or spans over ``max_span`` from its start."""
    out, piece, start, n = [], 0, None, 0
    for p in sorted(rows["pos"].tolist()):
        if start is None or n >= max_sites or p - start > max_span:
            piece, start, n = piece + (start is not None), p, 0
        n += 1
        out.append((rows["w"].iloc[0], p, piece))
    return pd.DataFrame(out, columns=["w", "pos", "piece"])


# ---- minimum error correction --------------------------------------------


def _matrix(frags: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sites, and a fragment x site matrix of signed weights."""
    sites = np.array(sorted(frags["pos"].unique()))
    reads = {r: i for i, r in enumerate(sorted(frags["read_id"].unique()))}
    m = np.zeros((len(reads), len(sites)))
    m[[reads[r] for r in frags["read_id"]], np.searchsorted(sites, frags["pos"])] = frags["allele"] * frags["weight"]
    return sites, m[(m != 0).sum(1) >= 2]


def cost(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Error weight of phasings (rows of x): each fragment takes its cheaper haplotype."""
    agree = np.atleast_2d(x) @ m.T
    return ((np.abs(m).sum(1) - np.abs(agree)) / 2).sum(1)


def solve_exact(m: np.ndarray) -> tuple[np.ndarray, float, float]:
    """All phasings with the first site +1: the first minimum, its cost, and the margin to the next."""
    n = m.shape[1]
    low = min(n - 1, 9)
    signs = lambda bits: np.where(np.arange(1 << bits)[:, None] >> np.arange(bits) & 1, -1.0, 1.0)
    near, far = m[:, 0] + signs(low) @ m[:, 1 : 1 + low].T, signs(n - 1 - low) @ m[:, 1 + low :].T
    agree = np.concatenate([np.abs(near + f).sum(1) for f in far])  # mask: the bits of far, then of near
    c = np.round((np.abs(m).sum() - agree) / 2, 9)
    best = int(c.argmin())
    rest = np.delete(c, best)
    x = np.append(1.0, np.where(best >> np.arange(n - 1) & 1, -1.0, 1.0))
    return x, float(c[best]), float(rest.min() - c[best]) if len(rest) else 0.0


def refine(m: np.ndarray, x: np.ndarray, sweeps: int = 5) -> np.ndarray:
    """Flip single sites while it helps; a flip changes the agreement of the fragments at the site only."""
    x = x.copy()
    agree = m @ x
    at = [np.flatnonzero(m[:, k]) for k in range(len(x))]
    for _ in range(sweeps):
        moved = False
        for k, own in enumerate(at):
            after = agree[own] - 2 * m[own, k] * x[k]
            if (np.abs(agree[own]) - np.abs(after)).sum() / 2 < -1e-9:
                agree[own], x[k], moved = after, -x[k], True
        if not moved:
            break
    return x


def solve_greedy(m: np.ndarray, most: int = 20, skip: bool = False) -> tuple[np.ndarray, float]:
    """Grow from site 0 along the strongest pair weights, then flip single sites while it helps.

    Of fragments with over ``most`` sites the first ones pair, or none with ``skip``; all count in the flips.
    """
    n = m.shape[1]
    pair = np.zeros((n, n))
    for row in m:
        at = np.flatnonzero(row)
        at = at[: 0 if skip and len(at) > most else most]
        low = np.minimum.outer(np.abs(row[at]), np.abs(row[at])) * np.outer(np.sign(row[at]), np.sign(row[at]))
        pair[np.ix_(at, at)] += low
    np.fill_diagonal(pair, 0)
    x = np.zeros(n)
    x[0] = 1
    for _ in range(n - 1):
        known, rest = np.flatnonzero(x), np.flatnonzero(x == 0)
        link = np.abs(pair[np.ix_(known, rest)])
        a, b = np.unravel_index(link.argmax(), link.shape)
        x[rest[b]] = x[known[a]] * (np.sign(pair[known[a], rest[b]]) or 1)
    x = refine(m, x)
    return x, float(cost(m, x)[0])


def solve_component(frags: pd.DataFrame, exact_sites: int = EXACT_SITES, chunk: int = 256) -> pd.DataFrame:
    """One component (w, comp), in chunks of fixed size, solved exactly or greedily; support and conflict of each site."""
    w, c = frags["w"].iloc[0], frags["comp"].iloc[0]
    number = pd.Series(np.arange(frags["pos"].nunique()), index=np.sort(frags["pos"].unique()))
    rows = []
    for at, own in frags.groupby(frags["pos"].map(number) // chunk):
        own = own[own.groupby("read_id")["pos"].transform("size") >= 2]
        if own.empty:
            continue
        where, m = _matrix(own)
        if len(where) < 2:
            continue
        if len(where) <= exact_sites:
            x, value, margin = solve_exact(m)
            solver = "exact"
        else:
            x, value = solve_greedy(m)
            solver, margin = "greedy", None
        side = np.sign(m @ x)
        side[side == 0] = 1
        vote = m * x * side[:, None]
        for k, p in enumerate(where.tolist()):
            s, f = float(vote[:, k].clip(0).sum()), float((-vote[:, k]).clip(0).sum())
            rows.append((w, p, f"c{c}_{at}", int(x[k]), solver, round(value, 6), margin, round(s / (s + f), 6) if s + f else 0.0))
    return pd.DataFrame(rows, columns=["w", "pos", "block_id", "state", "solver", "objective", "margin", "conf"])


def solve_window(frags: pd.DataFrame, exact_sites: int = EXACT_SITES, chunk: int = 256) -> pd.DataFrame:
    """All components of a window."""
    own = frags.merge(components(links(frags)), on=["w", "pos"])
    return pd.concat([solve_component(g, exact_sites, chunk) for _, g in own.groupby("comp")], ignore_index=True)


SOLVED = "w long, pos long, block_id string, state int, solver string, objective double, margin double, conf double"


LEGACY = "w long, pos long, block_id string, state int, solver string, conf double, sites int, fragments int, objective double, margin double, support double, conflict double"


def solve_legacy(frags: pd.DataFrame, exact_sites: int = EXACT_SITES, chunk: int = 256) -> pd.DataFrame:
    """One component (w, comp) as the first solver had it.

    Chunks of ``chunk`` sites, the last one too if it has two; a chunk without a
    fragment of two sites stays unsolved, while sites that no fragment of the
    chunk covers are +1 with confidence 0.  Long fragments give no pairs.
    """
    w, c = frags["w"].iloc[0], frags["comp"].iloc[0]
    every = np.sort(frags["pos"].unique())
    rows = []
    for at in range(0, len(every), chunk):
        sites = every[at : at + chunk]
        own = frags[frags["pos"].isin(sites)]
        own = own[own.groupby("read_id")["pos"].transform("size") >= 2]
        if len(sites) < 2 or own.empty:
            continue
        where, covered = _matrix(own)
        m = np.zeros((len(covered), len(sites)))
        m[:, np.searchsorted(sites, where)] = covered
        if len(sites) <= exact_sites:
            x, value, margin = solve_exact(m)
            solver = "exact"
        else:
            x, value = solve_greedy(m, skip=True)
            solver, margin = "greedy_refine", None
        side = np.where(m @ x >= 0, 1, -1)
        vote = m * x * side[:, None]
        good, bad = vote.clip(0).sum(0), (-vote).clip(0).sum(0)
        conf = np.divide(good, good + bad, out=np.zeros(len(sites)), where=good + bad > 0)
        for k, p in enumerate(sites.tolist()):
            rows.append((w, p, f"c{c}_{at // chunk}", int(x[k]), solver, round(float(conf[k]), 6), len(sites), len(m), round(value, 6), margin, round(float(good[k]), 6), round(float(bad[k]), 6)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in LEGACY.split(", ")])


def solve_with_priors(frags: pd.DataFrame, beam: int = 256, donor: float = 0.05, ranker: float = 0.04, anchor: float = 0.75, switch: float = 0.10, exact_sites: int = EXACT_SITES) -> pd.DataFrame:
    """Regions of at most 24 sites, exact or by beam search and rescored.

    Beside the error weight a phasing pays, for each site, ``donor`` times its
    donor bias and ``ranker`` times the ranker's margin where it goes against
    them, ``anchor`` where an end goes against the phased call next to it (lft of
    the first site, rgt of the last), and ``switch`` for each change of state.
    The beam is ordered by these costs alone.
    """
    w = frags["w"].iloc[0]
    rows = []
    meta = frags.drop_duplicates("pos").set_index("pos")[["donor_bias", "top_state", "margin", "lft", "rgt"]].fillna(0)
    for piece, g in split_component(frags[["w", "pos"]].drop_duplicates()).groupby("piece"):
        own = frags[frags["pos"].isin(g["pos"])]
        sites, m = _matrix(own)
        if len(sites) < 2:
            continue
        prior = meta.loc[sites]
        against = lambda state, weight, s: weight * (state == -s)
        pay = {s: against(np.sign(prior["donor_bias"]), donor * prior["donor_bias"].abs().clip(upper=1), s) + against(prior["top_state"], ranker * prior["margin"].clip(0, 2), s) for s in (1, -1)}
        pay = {s: v.to_numpy() for s, v in pay.items()}
        ends = {s: (anchor * (prior["lft"].iloc[0] == -s), anchor * (prior["rgt"].iloc[-1] == -s)) for s in (1, -1)}

        def priors(x):
            out = np.where(x > 0, pay[1], pay[-1]).sum(1) + switch * (x[:, 1:] != x[:, :-1]).sum(1)
            return out + np.where(x[:, 0] > 0, ends[1][0], ends[-1][0]) + np.where(x[:, -1] > 0, ends[1][1], ends[-1][1])

        n = len(sites)
        if n <= exact_sites:
            solver = "exact"
            masks = np.arange(1 << n)
            signs = lambda own: np.where(own[:, None] >> np.arange(n - 1, -1, -1) & 1, -1.0, 1.0)
            c = np.concatenate([np.round(cost(m, x := signs(masks[a : a + MASKS])) + priors(x), 9) for a in range(0, len(masks), MASKS)])
            x = signs(np.argsort(c, kind="stable")[:2])
        else:
            solver = "beam"
            x, held = np.zeros((1, 0)), np.zeros(1)
            for k in range(n):
                both = np.tile([1.0, -1.0], len(x))
                held = np.repeat(held, 2) + np.where(both > 0, pay[1][k], pay[-1][k])
                held += np.where(both > 0, ends[1][0], ends[-1][0]) if not k else switch * (np.repeat(x[:, -1], 2) != both)
                x = np.c_[np.repeat(x, 2, axis=0), both]
                best = np.argsort(np.round(held, 9), kind="stable")[:beam]
                x, held = x[best], held[best]
        c = np.round(cost(m, x) + priors(x), 9)
        order = np.argsort(c, kind="stable")
        margin = float(c[order[1]] - c[order[0]]) if len(order) > 1 else 999.0
        rows += [(w, int(p), int(piece), int(v), solver, round(margin, 6)) for p, v in zip(sites, x[order[0]])]
    return pd.DataFrame(rows, columns=["w", "pos", "region", "state", "solver", "margin"])


# ---- reads ---------------------------------------------------------------


def informative_reads(rows: pd.DataFrame, most: int = 5000) -> pd.DataFrame:
    """One read after the other, the one with the largest base score less 0.4 for each time one of its sites is covered already (3 a site at most).

    ``rows``: w, read_id, base, sites (list).  Scores only fall, so that a read
    at the head of the queue whose score hasn't fallen since is the best.
    """
    cover: dict[int, int] = {}
    base = {r: (b, s) for r, b, s in zip(rows["read_id"].tolist(), rows["base"].tolist(), rows["sites"].tolist())}
    score = lambda r: round(base[r][0] - sum(min(3.0, 0.4 * cover.get(p, 0)) for p in base[r][1]), 9)
    queue = [(-score(r), r) for r in base]
    heapify(queue)
    out = []
    while queue and len(out) < most:
        bound, r = heappop(queue)
        now = score(r)
        if now < -bound:
            heappush(queue, (-now, r))
            continue
        for p in base[r][1]:
            cover[p] = cover.get(p, 0) + 1
        out.append((rows["w"].iloc[0], r, round(base[r][0], 6), now, len(out)))
    return pd.DataFrame(out, columns=["w", "read_id", "base", "score", "rank"])


# ---- bridges -------------------------------------------------------------


def _strongest(edges: pd.DataFrame) -> pd.DataFrame:
    e = edges.assign(sign=np.where(edges["pw"] >= edges["mw"], 1, -1), margin=(edges["pw"] - edges["mw"]).abs().round(9), total=(edges["pw"] + edges["mw"]).round(9))
    return e.assign(prob=(np.maximum(e["pw"], e["mw"]) / e["total"]).round(9))


def _labelled(sets: SignedSets, nodes: list, w) -> pd.DataFrame:
    low: dict = {}
    for n in sorted(nodes):
        low.setdefault(sets.find(n)[0], n)
    return pd.DataFrame([(w, n, low[sets.find(n)[0]], sets.find(n)[1] * sets.find(low[sets.find(n)[0]])[1]) for n in sorted(nodes)], columns=["w", "comp", "block", "orientation"])


def stitch_components(edges: pd.DataFrame, margin: float = 0.1, support: float = 0.25) -> pd.DataFrame:
    """Signed union of components by falling margin; edges that contradict what is joined are refused."""
    sets = SignedSets()
    e = _strongest(edges)
    for r in e[(e["margin"] >= margin) & (e["total"] >= support)].sort_values(["margin", "a", "b"], ascending=[False, True, True]).itertuples():
        sets.union(r.a, r.b, r.sign)
    return _labelled(sets, list({*edges["a"], *edges["b"]}), edges["w"].iloc[0])


def two_colour(edges: pd.DataFrame, prob: float = 0.8) -> pd.DataFrame:
    """I32: two-colouring of the bridge graph; a component with any conflict is left alone."""
    sets, bad = SignedSets(), set()
    e = _strongest(edges)
    e = e[e["prob"] >= prob].sort_values(["a", "b"])
    broken = [(r.a, r.b) for r in e.itertuples() if sets.union(r.a, r.b, r.sign) is None]
    bad = {sets.find(a)[0] for a, _ in broken}
    nodes = sorted({*edges["a"], *edges["b"]})
    fresh = SignedSets()
    for r in e.itertuples():
        if sets.find(r.a)[0] not in bad:
            fresh.union(r.a, r.b, r.sign)
    return _labelled(fresh, nodes, edges["w"].iloc[0])


SORTS = {
    "forest": ["prob", "conf", "margin", "total", "near"],
    "prob_first": ["prob", "conf", "margin", "gain", "near"],
    "utility_first": ["gain", "prob", "conf", "margin", "near"],
    "hybrid": ["mixed", "conf", "margin", "gain", "near"],
}


def bridge_forest(
    edges: pd.DataFrame, mode: str = "forest", prob: float = 0.995, conf: float = 0.5, margin: float = 50.0, total: float = 0.0, gap: int = 75_000, degree: int = 1, blocks: int = 3, span: int = 150_000, gain: int = 0, merged: int = 0, weight: float = 1e-5
) -> pd.DataFrame:
    """I33, and I34b with ``gain``: greedy forest of signed bridges under caps of degree, blocks and span in base pairs.

    Edges are taken in the order of ``mode``.  With ``gain`` an edge must lengthen
    the longer of its two blocks by it, and again the longer of the two sets when
    it is taken; ``merged`` is the least span of the two blocks together.
    """
    sets, deg, ends = SignedSets(), {}, {}
    for r in edges.itertuples():
        ends[r.a], ends[r.b] = (r.a_s, r.a_e), (r.b_s, r.b_e)
    long = lambda x: x[1] - x[0] + 1
    union = lambda x, y: (min(x[0], y[0]), max(x[1], y[1]))
    e = edges.assign(near=-edges["gap"], whole=[long(union(ends[a], ends[b])) for a, b in zip(edges["a"], edges["b"])])
    e["gain"] = [w - max(long(ends[a]), long(ends[b])) for a, b, w in zip(e["a"], e["b"], e["whole"])]
    e["mixed"] = (e["prob"] + e["gain"] * weight).round(9)
    e = e[(e["prob"] >= prob) & (e["conf"] >= conf) & (e["margin"] >= margin) & (e["total"] >= total) & (e["gap"] <= gap) & (e["gain"] >= gain) & (e["whole"] >= merged)]
    for r in e.sort_values([*SORTS[mode], "a", "b"], ascending=[False] * 5 + [True, True]).itertuples():
        ra, rb = sets.find(r.a)[0], sets.find(r.b)[0]
        if deg.get(r.a, 0) >= degree or deg.get(r.b, 0) >= degree or ra != rb and sets.size[ra] + sets.size[rb] > blocks:
            continue
        if ra == rb:  # agrees with what is joined, or is refused
            if not gain and sets.union(r.a, r.b, r.sign) is False:
                deg[r.a], deg[r.b] = deg.get(r.a, 0) + 1, deg.get(r.b, 0) + 1
            continue
        x, y = ends[ra], ends[rb]
        both = union(x, y)
        if long(both) > span or gain and long(both) - max(long(x), long(y)) < gain:
            continue
        sets.union(r.a, r.b, r.sign)
        ends[sets.find(r.a)[0]] = both
        deg[r.a], deg[r.b] = deg.get(r.a, 0) + 1, deg.get(r.b, 0) + 1
    return _labelled(sets, list(ends), edges["w"].iloc[0])


def utility_forest(edges: pd.DataFrame, **limits) -> pd.DataFrame:
    """I34b in its three orders."""
    limits = dict(gain=10_000, merged=25_000, gap=500_000, blocks=6, span=1_000_000) | limits
    return pd.concat([bridge_forest(edges, mode, **limits).assign(mode=mode) for mode in ("prob_first", "utility_first", "hybrid")], ignore_index=True)
