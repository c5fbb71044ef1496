import hashlib
import re
from collections import defaultdict

import duckdb

from haplospark.llm import mixing


def fill(budget, caps, weights):
    """Water-filling by repeated rounds, in exact fractions."""
    from fractions import Fraction

    left, out, todo = Fraction(budget), {}, set(caps)
    while todo:
        full = {k for k in todo if caps[k] * sum(weights[j] for j in todo) <= weights[k] * left}
        if not full:
            total = sum(weights[j] for j in todo)
            out |= {k: left * weights[k] / total for k in todo}
            break
        for k in full:
            out[k] = Fraction(caps[k])
        left -= sum(caps[k] for k in full)
        todo -= full
    return out


def rows():
    out = []
    for i in range(600):
        lang = ["en", "en", "en", "de", "fr", None][i % 6]
        source = "src%d" % (0 if i % 3 == 0 else i % 9)
        out.append((i, "w " * (1 + i * 7 % 50), lang, source, 1, 0))
    out += [(9000, None, "en", "src1", 0, 0), (9001, " ", "en", "src1", 0, 0), (5, out[5][1], "de", out[5][3], 1, 1), (5, out[5][1], out[5][2], out[5][3], 1, 1), (None, "x y", "en", None, 1, 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int"


def test_against_sql_and_plain_python(spark):
    target = mixing.Target(share=(3, 2), epochs=3)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted((tuple(r) for r in mixing.mix(df, target).collect()), key=repr)
    documents = df.toArrow()  # noqa: F841
    want = sorted(duckdb.sql(mixing.sql(target)).fetchall(), key=repr)
    assert got == want
    tokens = defaultdict(int)
    for d, t, lang, s, *_ in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if n:
            tokens["d%d" % (ord((s or "\0")[-1]) % 4), lang or "", s or ""] += n
    budget = sum(tokens.values()) * 3 // 2
    by_domain = defaultdict(int)
    for (a, _, _), n in tokens.items():
        by_domain[a] += 3 * n
    top = fill(min(budget, sum(by_domain.values())), by_domain, {k: target.domains.get(k, 1) for k in by_domain})
    used = defaultdict(int)
    for d, a, lang, s, n, c in got:
        used[a] += n * c
    largest = 50 * 60  # a prefix falls short of its leaf's budget by less than one document
    for a, n in top.items():
        assert n - largest <= used[a] <= n + 1


def test_hot_leaf_is_a_prefix(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "src1", 5, 0) for i in range(20_000)], SCHEMA)
    got = mixing.mix(df, mixing.Target(tokens=31_000)).collect()
    assert len(got) == 31_000 // 3 and {r.copies for r in got} == {1}
    keys = {i: int(hashlib.md5(f"1:0:{i}".encode()).hexdigest()[:15], 16) for i in range(20_000)}
    assert {r.doc_id for r in got} == set(sorted(keys, key=keys.get)[: len(got)])
    whole = mixing.mix_documents(df, mixing.Target(tokens=31_000))
    assert whole.columns == df.columns and whole.count() == len(got)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
