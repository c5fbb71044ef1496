"""Merkle manifest of a table: a persistent tree, changed leaves as path-copied versions."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: An aligned block has 2**LEVELS nodes at most; a call builds one.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """``levels`` levels of a tree above consecutive nodes; two make one, a last single one is hashed alone."""

    def __init__(self, nodes: list[str], levels: int):
        self.rows = [nodes]
        for _ in range(levels):
            below = self.rows[-1]
            self.rows.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.rows[-1][0]

    def path(self, i: int) -> list[str]:
        """The other node of each run from node ``i`` up, marked with its side; empty where there is none."""
        out = []
        for row in self.rows[:-1]:
            j = i ^ 1
            out.append("" if j >= len(row) else ("L" if j < i else "R") + row[j])
            i >>= 1
        return out

    def version(self, i: int, node: str) -> list[str]:
        """Node ``i`` and its ancestors, copied with ``node`` in its place; all other nodes are this block's."""
        return climb(node, self.path(i))


def climb(node: str, path: list[str]) -> list[str]:
    """``node`` and the ancestors that it has beside the nodes of ``path``."""
    out = [node]
    for other in path:
        node = digest(other[1:], node) if other[:1] == "L" else digest(node, other[1:])
        out.append(node)
    return out


def _levels(total: int) -> int:
    """Levels from so many nodes up to one."""
    return (total - 1).bit_length()


def _block_of(part: pd.DataFrame, levels: int) -> Block:
    return Block(part["node"].tolist(), min(levels, _levels(int(part["total"].iloc[0]))))


def _roots(levels: int):
    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        root = _block_of(part.sort_values("idx"), levels).root
        return pd.DataFrame({"key": [keys[0]], "idx": [keys[1]], "node": [root], "total": [-(-int(part["total"].iloc[0]) >> levels)]})

    return run


def _inner(levels: int):
    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        block, first = _block_of(part, levels), keys[1] << levels
        return pd.DataFrame({"key": keys[0], "idx": part["idx"], "block": keys[1], "inner": [block.path(i - first) for i in part["idx"]]})

    return run


_NODES = "key string, idx long, node string, total long"


def _number(levels: int) -> Column:
    return F.shiftright("idx", levels).alias("block")


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """``key, idx, path, root`` of ``key, idx, node, total``: what stands beside the way from a node to its key's root.

    Each call builds a block; their roots are the nodes of the next round,
    which are fewer by the size of a block.
    """
    if nodes.where("total > 1").isEmpty():
        return nodes.select("key", "idx", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    blocks = nodes.groupBy("key", _number(levels))
    upper = _paths(cut(blocks.applyInPandas(_roots(levels), _NODES), "merkle"), levels)
    inner = blocks.applyInPandas(_inner(levels), "key string, idx long, block long, inner array<string>")
    return cut(inner.join(upper.withColumnRenamed("idx", "block"), ["key", "block"]).select("key", "idx", F.concat("inner", "path").alias("path"), "root"), "merkle")


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` with ``idx``, its place from 0 among the rows of its key by ``order``, and ``total``, their number.

    Rows are dealt by range and sorted; a partition adds the rows of its key
    before it.  Rows that are equal in ``order`` are dealt by chance, so that no
    value of key or order has to fit in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.rand(7))
    by = [key, *order, "_salt"]
    laid = cut(salted.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    runs = cut(laid.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "runs")
    totals = runs.groupBy(key).agg(F.sum("_n").alias("total"))
    offset = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n") - F.col("_first")
    runs = runs.select("_part", key, offset.alias("_shift")).join(totals, key)
    return laid.join(runs, ["_part", key]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Digest of the fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _fold(levels: int):
    def run(keys: tuple, part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Rows of a block of leaves: their proofs, and the roots of the versions that changed leaves make."""
        part = part.sort_values("idx")
        path, top = list(above["path"].iloc[0]), int(above["top"].iloc[0])
        block, first, rows = _block_of(part, levels), keys[1] << levels, []
        base = climb(block.root, path)
        subroot, root = base[len(path) - top], base[-1]
        for doc_id, i, leaf, changed in zip(part["doc_id"], part["idx"], part["node"], part["changed"]):
            proof = digest(*[x[1:] for x in block.path(i - first) + path])
            folded = climb(block.version(i - first, changed)[-1], path)[-1] if changed is not None and changed != leaf else root
            rows.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
        out = pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return out.astype({"doc_id": "Int64"})

    return run


def manifest(docs: DataFrame, *, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row a document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of ``FIELDS``; the leaves of a language, by doc_id,
    make its subroot, and the subroots by language make the root (null first,
    then by UTF-8 bytes).  Each run of two nodes makes one, a single last one
    too, until one is left.  ``tampered`` (default: crc32 of the decimal doc_id
    is divisible by 7) marks rows that are changed afterwards: their n_chars is
    one larger.  Each makes a version of the tree that copies the changed leaf's
    ancestors and shares all other nodes: first in its aligned block, then in
    the levels above, whose nodes are met by a join.  ``folded_root`` is the
    root of that version; unchanged rows have the base version's.

    Null fields count as ``-``; a null n_chars stays null, so that its version
    is the base.  A null doc_id comes first and isn't tampered with.  Rows with
    equal doc_id are ordered by leaf; repeated rows are leaves of their own.
    Extra columns are ignored; an empty table gives no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = leaf_hash(fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    key = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf_hash(fields).alias("node"), F.when(tampered, more).alias("changed"))
    leaves = cut(numbered(leaves, "key", "doc_id", "node"), "leaves")
    blocks = _paths(cut(leaves.groupBy("key", _number(levels)).applyInPandas(_roots(levels), _NODES), "merkle"), levels)
    langs = numbered(blocks.select(F.lit("").alias("key"), F.col("key").alias("lang"), F.col("root").alias("node")).distinct(), "key", "lang")
    langs = cut(langs, "subroots")
    top = _paths(langs.select("key", "idx", "node", "total"), levels).join(langs.select("idx", "lang", F.col("node").alias("subroot")), "idx")
    above = blocks.join(top.select(F.col("lang").alias("key"), F.col("path").alias("up")), "key")
    above = cut(above.select("key", F.col("idx").alias("block"), F.concat("path", "up").alias("path"), F.size("up").alias("top"), "root"), "above")
    return leaves.groupBy("key", _number(levels)).cogroup(above.groupBy("key", "block")).applyInPandas(_fold(levels), _OUT)


def sql() -> str:
    """The manifest in DuckDB SQL, level by level."""
    field = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in FIELDS) + ")"
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, c: list_reduce(list_prepend(xor(r, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"
    tree = lambda source: f"""SELECT g, lvl, i, h, n FROM (SELECT g, 0 AS lvl, i, h, n FROM {source})"""

    def levels(name: str, source: str) -> str:
        return f"""{name} AS ({tree(source)} UNION ALL
        SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 2)"""

    def fold(name: str, nodes: str, source: str) -> str:
        return f"""{name} AS (SELECT id, g, 0 AS lvl, i, n, '' AS proof, h FROM {source} UNION ALL
        SELECT f.id, f.g, f.lvl + 1, f.i // 2, (f.n + 1) // 2, f.proof || coalesce(s.h, ''), sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
        FROM {name} f LEFT JOIN {nodes} s ON s.g = f.g AND s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1)"""

    return f"""WITH RECURSIVE leaf AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('n_chars')} AS h, CASE WHEN xor({crc}, 4294967295) % 7 = 0 THEN {leaf('n_chars + 1')} END AS changed FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, h) AS id FROM leaf),
    {levels("node", "numbered")},
    sub AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(g)) AS id FROM node WHERE n = 1),
    {levels("up", "sub")},
    {fold("inner_path", "node", "(SELECT id, g, i, n, coalesce(changed, h) AS h FROM numbered)")},
    {fold("upper_path", "up", "(SELECT x.id, '' AS g, s.i, s.n, x.h FROM (SELECT id, g, h FROM inner_path WHERE n = 1) x JOIN sub s ON s.lang = x.g)")}
    SELECT CAST(n.doc_id AS BIGINT) AS doc_id, n.h AS leaf, s.h AS subroot, r.h AS root, sha256(p.proof || q.proof) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified
    FROM numbered n JOIN sub s ON s.lang = n.g JOIN (SELECT * FROM inner_path WHERE n = 1) p ON p.id = n.id JOIN (SELECT * FROM upper_path WHERE n = 1) q ON q.id = n.id CROSS JOIN (SELECT h FROM up WHERE n = 1) r"""
