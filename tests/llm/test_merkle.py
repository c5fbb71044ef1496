import zlib
from hashlib import sha256

import duckdb
import pytest

from haplospark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def siblings(rows, i):
    out = []
    for row in rows[:-1]:
        out.append(row[i ^ 1] if i ^ 1 < len(row) else "")
        i >>= 1
    return out


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append(d)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for g in langs}
    trees = {g: tree([leaf(d) for d in ordered[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, d in enumerate(ordered[g]):
            changed = list(d)
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None:
                changed[4] += 1
            mine = [leaf(x) for x in ordered[g]]
            mine[i] = leaf(changed)
            above = [trees[x][-1][0] for x in langs]
            above[k] = tree(mine)[-1][0]  # the whole tree anew
            folded = tree(above)[-1][0]
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], h(*siblings(trees[g], i), *siblings(top, k)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows(n, lang):
    return [(i * 3 + 1, f"text é {i % 5}", lang, None if i % 4 == 0 else "s", None if i % 11 == 0 else i) for i in range(n)]


CASES = {
    "one": rows(1, "en"),
    "null_lang": rows(3, None) + rows(1, "é") + rows(6, "zz") + rows(5, ""),
    "odd": rows(13, "en") + rows(7, "de") + rows(2, "fr"),
    "ties": [(7, "a", "en", "s", 1)] * 5 + [(7, "b", "en", "s", 1), (None, None, None, None, None), (None, "", "en", "", 0)],
    "long": [(14, "wörd " * 100_000, "en", "s", 2**31 - 1), (1, "", "en", None, 0), (28, None, "en", "s", None)],
}


@pytest.mark.parametrize("name, levels", [("one", 10), ("null_lang", 1), ("odd", 2), ("odd", 10), ("ties", 2), ("long", 10)])
def test_equals_a_tree_built_anew(spark, name, levels):
    docs = spark.createDataFrame(CASES[name], SCHEMA).selectExpr("*", "1 AS leaf", "'x' AS root", "2 AS idx", "'y' AS key")
    assert sorted(map(tuple, merkle.manifest(docs, levels=levels).collect()), key=repr) == brute(CASES[name])


def test_empty(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_version_copies_ancestors_only():
    block = merkle.Block([h(str(i)) for i in range(11)], 4)
    before = [list(r) for r in block.rows]
    copies = block.version(5, h("x"))
    assert len(copies) == 5 and block.rows == before
    assert copies[-1] == merkle.Block([h("x") if i == 5 else h(str(i)) for i in range(11)], 4).root != block.root


def test_sql_equals_brute_force():
    for name in ("null_lang", "odd", "long"):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars INTEGER)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", CASES[name])
        if name == "long":
            con.execute("ALTER TABLE documents ALTER n_chars TYPE BIGINT")
        assert sorted(con.execute(merkle.sql()).fetchall(), key=repr) == brute(CASES[name])
