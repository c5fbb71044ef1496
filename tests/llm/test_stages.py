"""Row-keeping forms of the operators on small tables with odd rows."""

from haplospark.llm import quality, suffix_dedup, tiling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rejected_documents_go(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 90}" for k in range(40 + i % 20)), "en", "s", 1) for i in range(80)]
    bad = [(1000 + i, " ".join(f"w{i}%%%" for _ in range(40 + i % 9)), "en", "s", 1) for i in range(40)]
    odd = [(5000, None, None, None, None), (None, good[3][1], None, "s", 1), (3, good[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(good + bad + odd, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in bad], "doc_id long, quality int")
    kept = quality.keep_accepted(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and set(range(80)) <= set(ids) and not set(ids) & {r[0] for r in bad} and ids.count(3) == 2 and ids.count(None) == 1
    assert quality.keep_accepted(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_accepted(docs.limit(0), labels).count() == 0


def test_repeats_are_cut_from_texts(spark):
    shared = "é" * 30
    rows = [(1, "aaa " + shared + " bbb", "en", None, 70), (2, shared + " ccc", None, "s", 1), (3, None, "en", "s", None), (4, "clean text", "en", "s", 10), (5, "same " * 12, "en", "s", 60), (5, "same " * 12, "en", "s", 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = suffix_dedup.remove_repeats(docs, length=40)
    assert out.columns == docs.columns and out.count() == 6
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].text == "clean text" and got[3].text == "" and got[5].text == ""
    assert got[1].text.startswith("aaa") and got[1].text.endswith("bbb") and shared not in got[1].text
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_matches_column_keeps_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven", "en", "s", 1), (1, None, None, None, None)], SCHEMA)
    bench = spark.createDataFrame([(9, "Two three, four five six")], "item_id long, text string")
    got = tiling.with_matches(docs, bench).collect()
    assert sorted(len(r.matches) for r in got) == [0, 1] and next(r.matches[0].item_id for r in got if r.matches) == 9
