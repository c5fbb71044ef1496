import zlib

import numpy as np

from haplospark.llm import toxicity


def brute_kernel(s, t, order, decay):
    from itertools import combinations

    def feats(x):
        out = {}
        for c in combinations(range(len(x)), order):
            k = "".join(x[i] for i in c)
            out[k] = out.get(k, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = feats(s), feats(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_against_enumeration():
    words = ["^^idiot", "^^idiiot", "^^i.d.i.o.t", "cat", "^^éa", "aaaa"]
    codes = toxicity._codes(words, 21)
    got = toxicity.raw_kernel(codes, codes)
    want = [[brute_kernel(a, b, toxicity.ORDER, toxicity.DECAY) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-4)
    assert np.allclose(toxicity._self_many(codes), np.diag(want), rtol=1e-4)


def test_short_strings_by_subsequences():
    """The table of the landmarks' subsequences gives what dynamic programming gives, for all strings."""
    rng = np.random.default_rng(4)
    marks = toxicity.Landmarks(["idiot", "zwurgle", "aaa"], ["ideal", "pliff.or"])
    words = ["^^" + "".join(rng.choice(list("idiotzwurgleaxé.")) for _ in range(n)) for n in rng.integers(1, 19, 300)] + ["^^", "a", "^^ixxdxxixxoxxt"]
    codes = toxicity._codes(words, toxicity.PIECE)
    assert np.allclose(marks.raw(codes), toxicity.raw_kernel(codes, marks.codes), rtol=1e-4, atol=1e-7)
    marks.weights = marks.weights[:0]
    assert np.allclose(marks.raw(codes), toxicity.raw_kernel(codes, marks.codes), rtol=1e-6)


def test_a_string_is_compared_once(monkeypatch):
    """Words that differ in the marks at their ends only share their string, and all get its value."""
    model = toxicity.Model(toxicity.Landmarks(["idiot"], ["ideal"]), np.array([1.0, -1.0]), -0.2, np.zeros(toxicity.SIGNS + 1))
    compared, decide = [], toxicity.Model.decisions

    def counted(self, strings):
        compared.extend(strings)
        return decide(self, strings)

    monkeypatch.setattr(toxicity.Model, "decisions", counted)
    scorer = toxicity.Scorer(model)
    scorer(["Idiot idiot, (idiot) idiot! ideal ideal. x - é", "\U0001f600idiot ideal\u0301"])
    assert len(compared) == len(set(compared)) and {"^^idiot", "^^ideal"} <= set(compared)
    assert len({scorer.known[w] for w in ("idiot", "idiot,", "(idiot)", "idiot!")}) == 1 and scorer.known["idiot"] > 0.5 > scorer.known["ideal."]
    assert scorer.known["x"] == scorer.known["-"] == model.bias


def test_learns_and_tolerates_gaps(spark):
    rng = np.random.default_rng(0)
    vocab = ["".join(chr(97 + k) for k in rng.integers(0, 20, n)) for n in rng.integers(3, 9, 300)]
    bad = ["zwurgle", "pliffor", "quamtoz"]
    docs, labels = [], []
    for i in range(500):
        words = [vocab[k] for k in rng.integers(0, 300, 40)]
        toxic = i % 3 == 0
        if toxic:
            for k in (3, 11, 20, 30):
                words[k] = bad[int(rng.integers(0, 3))]
        docs.append((i, ". ".join(" ".join(words[j : j + 8]) for j in range(0, 40, 8)), "x", 1.0))
        labels.append((i, int(toxic)))
    plain = docs[1][1]
    docs += [(1000, plain + " zwuurgle pl.iff.or quamtoz zw-urgle", "x", 1.0), (1001, None, None, None), (1002, "", None, None), (None, "a", None, None), (1003, "z w u r g l e", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].predicted == 1 and by_id[1001].predicted == by_id[1002].predicted == 0
    assert {r.score for r in toxicity.classify(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.classify(d.limit(0), lab).count() == 0
