"""Mixing of sources to target weights: hierarchical token budgets and seeded epochs, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

LEVELS = ("domain", "lang", "source")
#: The order key has 60 bits; its upper 12 number the buckets of a leaf.
KEY_BITS, BUCKET_BITS = 60, 12


@dataclass(frozen=True)
class Target:
    """Integer weights of domains, languages and sources (1 where not named), and the budget.

    The budget is ``tokens``, or ``share`` (numerator, denominator) of all tokens
    there are; a document is used at most ``epochs`` times.
    """

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    share: tuple[int, int] = (9, 10)
    tokens: int | None = None
    epochs: int = 4
    seed: int = 1


def default_domain() -> Column:
    """Domain of a source: by the code of its last character, modulo 4."""
    return F.concat(F.lit("d"), (F.ascii(F.right(F.coalesce("source", F.lit("")), F.lit(1))) % 4).cast("string"))


def _weight(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(level == name, F.lit(w).cast("long")).otherwise(out)
    return out


def count_tokens(text: Column) -> Column:
    """Words of a text, runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``w``, none above its ``cap``.

    Children whose share would exceed their capacity get the capacity, and what
    they leave goes to their siblings by weight, again and again: in the order of
    cap / w the full ones are a prefix, found with running sums.  Whole tokens:
    differences of rounded-down running shares, so that the sum is the budget.
    """
    order = [(F.col("cap") / F.col("w")).asc(), F.col(name).asc()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_pc", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_sw", F.sum("w").over(onward))
    nodes = nodes.withColumn("_full", F.expr(f"cap * _sw <= w * ({budget} - _pc)"))
    nodes = nodes.withColumn("_rest", F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)))
    nodes = nodes.withColumn("_cw", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(upto), F.lit(0)))
    nodes = nodes.withColumn("_tw", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("w"))).over(whole), F.lit(0)))
    return nodes.withColumn(out, F.expr("case when _full then cap else (_rest * _cw) div _tw - (_rest * (_cw - w)) div _tw end")).drop("_pc", "_sw", "_full", "_rest", "_cw", "_tw")


def leaf_budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """Budgets of the leaves ``domain, lang, source, tokens``: adds ``budget``.

    A node's capacity is the sum of its leaves' tokens times the epochs.  Budgets
    go down the tree, so a shortage is made up by siblings first, and by the
    siblings of an ancestor only where its whole subtree is short.
    """
    leaves = leaves.withColumn("leaf_cap", F.col("tokens") * target.epochs)
    top = leaves.groupBy("domain").agg(F.sum("leaf_cap").alias("cap"), F.sum("tokens").alias("t")).withColumn("one", F.lit(1))
    size = F.lit(target.tokens).cast("long") if target.tokens is not None else F.expr(f"(sum(t) over (partition by one) * {target.share[0]}) div {target.share[1]}")
    top = top.withColumn("total", F.least(size, F.sum("cap").over(Window.partitionBy("one")))).withColumn("w", _weight(F.col("domain"), target.domains))
    top = share_out(top, ["one"], "domain", "total", "b1").select("domain", "b1")
    mid = leaves.groupBy("domain", "lang").agg(F.sum("leaf_cap").alias("cap")).join(top, "domain").withColumn("w", _weight(F.col("lang"), target.langs))
    mid = share_out(mid, ["domain"], "lang", "b1", "b2").select("domain", "lang", "b2")
    low = leaves.withColumn("cap", F.col("leaf_cap")).join(mid, ["domain", "lang"]).withColumn("w", _weight(F.col("source"), target.sources))
    return share_out(low, ["domain", "lang"], "source", "b2", "budget").select(*LEVELS, "tokens", "budget")


def _numbered(docs: DataFrame, domain: Column) -> DataFrame:
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), count_tokens(F.col("text")).alias("n_tokens"))
    return kept


def mix(docs: DataFrame, target: Target | None = None, domain: Column | None = None) -> DataFrame:
    """Documents that the mixture uses: ``doc_id, domain, lang, source, n_tokens, copies``.

    A leaf's budget buys whole epochs of all its documents, then the longest
    prefix, in the next epoch's seeded order, that fits what is left.  The order
    key of an epoch is 60 bits of md5(seed:epoch:doc_id).  A leaf of any size is
    ordered without gathering it: token sums of its 4096 key buckets say which
    buckets are in and which one the prefix ends in; only that one is ordered.
    Documents without words are never used.  Null domain, lang and source count
    as ''; rows with equal doc_id share a place in the order and are in or out
    together; other columns are ignored; an empty table gives no rows.
    """
    target = target or Target()
    rows = cut(_numbered(docs, default_domain() if domain is None else domain).where("n_tokens > 0"), "token-counts")
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    # written, so that the planner knows its size and broadcasts it only if it is small
    budgets = cut(leaf_budgets(leaves, target).select(*LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("left")), "budgets")
    text = F.concat_ws(":", F.lit(str(target.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = rows.join(budgets, list(LEVELS)).withColumn("key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("s"), F.first("left").alias("left"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    # joined by leaf and bucket, so that a leaf with most of the rows is dealt to all tasks
    sums = sums.withColumn("base", F.sum("s").over(run) - F.col("s")).select(*LEVELS, "bucket", "s", "base")
    placed = keyed.join(sums, [*LEVELS, "bucket"])
    whole = placed.where("base + s <= left or base > left").withColumn("more", (F.col("base") + F.col("s") <= F.col("left")).cast("int"))
    peers = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id")
    edge = placed.where("base + s > left and base <= left").withColumn("more", (F.col("base") + F.sum("n_tokens").over(peers) <= F.col("left")).cast("int"))
    used = whole.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("more")).cast("long")).where("copies > 0")
    return used.select("doc_id", *LEVELS, "n_tokens", "copies")


def mix_documents(docs: DataFrame, target: Target | None = None, domain: Column | None = None) -> DataFrame:
    """The used documents with all their columns and ``copies``; a column of that name is replaced."""
    docs = docs.drop("copies")
    chosen = mix(docs, target, domain).select(F.col("doc_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in LEVELS), F.col("copies").alias("__copies")).distinct()
    place = default_domain() if domain is None else domain
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    for c, v in zip(LEVELS, (place, F.col("lang"), F.col("source"))):
        same = same & (F.coalesce(v, F.lit("")) == F.col(f"__{c}"))
    return docs.where(count_tokens(F.col("text")) > 0).join(chosen, same).select(*docs.columns, F.col("__copies").alias("copies"))


def _case(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _sql_level(source: str, parent: str, name: str, budget: str, out: str) -> str:
    part = f"PARTITION BY {parent}"
    order = f"{part} ORDER BY cap / w, {name}"
    return f"""SELECT *, CASE WHEN f THEN cap ELSE (rest * cw) // tw - (rest * (cw - w)) // tw END AS {out} FROM (
      SELECT *, {budget} - coalesce(sum(CASE WHEN f THEN cap END) OVER ({part}), 0) AS rest,
        coalesce(sum(CASE WHEN NOT f THEN w END) OVER ({order} ROWS UNBOUNDED PRECEDING), 0) AS cw,
        coalesce(sum(CASE WHEN NOT f THEN w END) OVER ({part}), 0) AS tw FROM (
        SELECT *, cap * sw <= w * ({budget} - pc) AS f FROM (
          SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc,
            sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sw FROM ({source}))))"""


def sql(target: Target | None = None) -> str:
    """The default mixture in DuckDB SQL."""
    t = target or Target()
    total = str(t.tokens) if t.tokens is not None else f"(sum(t) OVER () * {t.share[0]}) // {t.share[1]}"
    top = f"SELECT *, least({total}, sum(cap) OVER ()) AS total, {_case('domain', t.domains)} AS w, 1 AS one FROM (SELECT domain, sum(tokens * {t.epochs}) AS cap, sum(tokens) AS t FROM leaves GROUP BY 1)"
    mid = f"SELECT l.domain, l.lang, sum(l.tokens * {t.epochs}) AS cap, any_value(b1) AS b1, {_case('l.lang', t.langs)} AS w FROM leaves l JOIN l1 USING (domain) GROUP BY l.domain, l.lang"
    low = f"SELECT l.*, l.tokens * {t.epochs} AS cap, b2, {_case('l.source', t.sources)} AS w FROM leaves l JOIN l2 USING (domain, lang)"
    return f"""WITH d AS (SELECT doc_id, 'd' || (ascii(right(coalesce(source, ''), 1)) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
    l1 AS ({_sql_level(top, 'one', 'domain', 'total', 'b1')}),
    l2 AS ({_sql_level(mid, 'domain', 'lang', 'b1', 'b2')}),
    l3 AS ({_sql_level(low, 'domain, lang', 'source', 'b2', 'budget')}),
    k AS (SELECT d.*, budget // tokens AS whole, budget % tokens AS rem,
      ('0x' || substr(md5('{t.seed}:' || (budget // tokens) || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
      FROM d JOIN l3 USING (domain, lang, source) WHERE n_tokens > 0),
    r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) AS upto FROM k)
    SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + CASE WHEN upto <= rem THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM r WHERE whole + CASE WHEN upto <= rem THEN 1 ELSE 0 END > 0"""
