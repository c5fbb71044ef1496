import hashlib
import random

from haplospark.llm import warc


def test_loser_tree():
    r = random.Random(0)
    for k in range(0, 12):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for run in runs for x in run)


def test_url_key():
    assert warc.url_key("https://www.Example.com/A/b?C=1#x") == "com,example)/a/b?c=1"
    assert warc.url_key(None) == ")"


def test_pages(spark):
    big, small = "<p>" + "é" * 600, "short"
    rows = [(1, "http://a.com/x", big, 1), (2, "http://b.com/\r\n", big, 1), (9, None, big, 1), (3, "http://a.com/x", small, 1), (4, "http://a.com/y", small, 1), (5, "u", None, 1), (6, "u", "", 1), (7, "u", "z" * 1000, 1), (7, "u", "z" * 1000, 1), (None, "http://c", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.archive_and_index(df).collect()
    want = []
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        last = max((q or -1) for q, _, h, _ in rows if h == html) if len(raw) >= 1000 else None
        refers = last if last is not None and last != p else None
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    order = sorted(got, key=lambda r: (r.range_no, r.position))
    assert [r.urlkey for r in order] == sorted(r.urlkey for r in got)
    assert warc.archive_and_index(df.limit(0)).count() == 0
