import zlib

import numpy as np

from haplospark.llm import quality


def test_classifier_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    vocab = ["word%s" % chr(97 + i) * (1 + i % 3) for i in range(26)]
    docs, labels = [], []
    for i in range(400):
        n = int(rng.integers(20, 200))
        words = [vocab[k] for k in rng.integers(0, 26, n)]
        bad = i % 4 == 0
        if bad:
            words = [w + "%%%" for w in words] if i % 8 else [words[0]] * n
        docs.append((i, " ".join(words), "x", 0.0))
        labels.append((i, int(not bad), 0))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "a", None, None), (None, "b c", None, None), (5, docs[5][1], "y", 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert {r.score for r in quality.classify(d, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(d.limit(0), lab).count() == 0


def test_scores_match_plain_formula(spark):
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(1, 2, (200, d))])
    y = [0] * 300 + [1] * 200
    df = spark.createDataFrame([(a.tolist(), b) for a, b in zip(x, y)], "x array<double>, label int")
    m = quality.fit(df, shrink=0, ridge=0, temper=1.0)
    got = m.scores(x)
    log = []
    for k in (0, 1):
        part = x[np.array(y) == k]
        c = np.cov(part.T, bias=True)
        e = x - part.mean(0)
        log.append(np.log(len(part) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(got, 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40))))
