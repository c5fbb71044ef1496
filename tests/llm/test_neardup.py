import numpy as np

from haplospark.llm import neardup


def jaccard(a, b):
    f = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = f(a), f(b)
    return len(x & y) / len(x | y)


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda: "w%d" % rng.integers(0, 3000)
    rows = []
    for i in range(120):
        base = [word() for _ in range(int(rng.integers(60, 200)))]
        rows.append((i, " ".join(base), "x", 1))
        for c in range(3):
            copy = list(base)
            for k in rng.integers(0, len(base), max(1, len(base) // 80)):
                copy[k] = "zz%d" % rng.integers(0, 1000)
            rows.append((1000 + 10 * i + c, " ".join(copy), "x", 1))
    rows += [(5000, None, None, 1), (5001, "", "y", 1), (5002, "few words", "y", 1), (5003, "few words", "y", 1), (5003, "few words", "y", 1), (None, rows[0][1], "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, group_id int")
    ids = [r[0] for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or a and b and abs(len(a) - len(b)) < 0.3 * max(len(a), len(b)) and jaccard(a, b) >= 0.8:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = {d: low[find(i)] for i, d in enumerate(ids) if d is not None}
    got = neardup.near_groups(df).collect()
    assert len(got) == len(rows)
    right = [r.group_id == want[r.doc_id] for r in got if r.doc_id is not None]
    assert np.mean(right) >= 0.98
    assert all(r.group_id >= want[r.doc_id] for r in got if r.doc_id is not None)  # no false link
    kept = [r.doc_id for r in neardup.keep_first(df).collect()]
    assert len(kept) == len(set(kept)) == len({r.group_id for r in got}) and set(kept) == {r.group_id for r in got}
    assert neardup.near_groups(df.limit(0)).count() == 0


def crowd(rng, size, words=160, edits=3):
    """A base and copies that are alike to it to 0.8, but not to each other."""
    base = ["b%d" % k for k in range(words)]
    copies = []
    for c in range(size):
        copy = list(base)
        for k in rng.choice(np.arange(4, words - 4), edits, replace=False):
            copy[k] = "e%d_%d" % (c, k)
        copies.append(" ".join(copy))
    return [" ".join(base), *copies]


def test_crowd_around_one_base(spark):
    texts = crowd(np.random.default_rng(3), 2000)
    assert min(jaccard(texts[0], x) for x in texts[1:]) >= 0.8 and np.mean([jaccard(texts[k], texts[k + 1]) < 0.8 for k in range(1, 200)]) > 0.9
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in neardup.near_groups(df).collect()}
    joined = np.mean([g == 0 for g in got.values()])
    assert joined >= 0.97


def test_crowd_waits_in_later_tables(spark, monkeypatch):
    """A text of a crowd costs about one row a table, not one for each of its nearest neighbours in every table."""
    texts = crowd(np.random.default_rng(3), 1500, edits=1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    made, search = [], neardup._proposals

    def counted(*args):
        found = search(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(neardup, "_proposals", counted)
    assert {r.group_id for r in neardup.near_groups(df).collect()} == {0}
    assert 0 < sum(made) <= 1.5 * len(neardup.tables(len(texts), 0.97)) * len(texts)


def test_pairs_of_a_split_bucket(spark, monkeypatch):
    texts = crowd(np.random.default_rng(4), 150)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    groups = lambda limit: {r.t: r.label for r in neardup._known(df, 0.8, 14, 0.97, limit)[1].collect()}
    assert groups(8) == groups(10_000)


def test_different_texts_with_one_id_or_none_stay(spark):
    words = lambda k: " ".join(f"v{k}_{i}" for i in range(30))
    rows = [(None, words(k)) for k in range(6)] + [(None, words(0)), (1, words(10)), (1, words(11)), (2, words(12)), (None, words(12)), (3, words(12)), (2, words(12))]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, words(k)) for k in range(6)] + [(1, words(10)), (1, words(11)), (2, words(12))])


def test_texts_that_share_a_hash_are_kept(spark):
    """With a hash of one value for all, the second one tells texts apart."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "doc_id long, text string")
    marked = neardup._identified(docs)
    assert marked.select("__t", "__u").distinct().count() == 3 and marked.where("__t = __u").isEmpty()
    same = marked.selectExpr("doc_id", "text", "5L AS __t", "__u")
    shared = same.groupBy("__t").agg({"__u": "max"}).select("__t")
    out = neardup._once(same.where("doc_id = 1"), same, shared)
    assert sorted(r.text for r in out.collect()) == ["a", "b", "c"]
    assert neardup._once(same.where("doc_id = 1"), same, shared.limit(0)).count() == 1
