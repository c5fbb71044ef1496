"""Stages against plain Python on the smallest tables."""

import os
import random

import pytest

import corpus_pipeline
from haplospark.llm import mixing, quality, tiling

SF = "/root/testdata/sf0.001"
SIZE = corpus_pipeline.PASSAGE_BYTES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        outs.append(docs)
    first = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, unique, cut_, clean, mixed = ([r for r in o.collect()] for o in outs)
    assert all(o.columns == list(corpus_pipeline.COLUMNS) for o in outs[:4])

    accepted = {r.doc_id for r in quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in good} == accepted and all(r.text == first[r.doc_id].text for r in good)

    words = {r.doc_id: r.text.lower().split() for r in good}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    first_ones, got = {d for d in sets if root[d] == d}, {r.doc_id for r in unique}
    assert first_ones <= got and len(got - first_ones) <= 2  # never a false link; recall is high, not whole

    raw = {r.doc_id: r.text.encode() for r in unique}
    seen = {}
    for t in raw.values():
        for i in range(len(t) - SIZE + 1):
            w = t[i : i + SIZE]
            seen[w] = seen.get(w, 0) + 1
    assert {r.doc_id for r in cut_} == set(raw)
    for r in cut_:
        t = raw[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - SIZE + 1):
            if seen[t[i : i + SIZE]] > 1:
                gone[i : i + SIZE] = b"\1" * SIZE
        kept = bytes(c for c, g in zip(t, gone) if not g)
        assert abs(len(r.text.encode()) - len(kept)) <= 6 * gone.count(1) and r.n_chars == len(r.text)
        if not any(gone):
            assert r.text.encode() == t

    bench = [tiling.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in cut_ if any(" ".join(b) in " ".join(tiling.tokens(r.text)) for b in bench)}
    dropped = {r.doc_id for r in cut_} - {r.doc_id for r in clean}
    assert whole <= dropped and len(dropped) <= len(whole) + 3

    want = {r.doc_id: r.copies for r in mixing.mix(outs[3]).collect()}
    assert {r.doc_id: r.copies for r in mixed} == want and want


WORDS = {
    "en": "the of and to in is that it was for on are with as at be this have from or had by word but what some we can out other were all there when up use your how said each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui nous comme mais pouvoir avoir tout faire elle autre on leur si deux moins même ces bien entre sans".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split(),
}


def test_planted_passages_of_over_fifty_words(spark):
    """The suffix-array stage removes passages of 51 to 60 words, mostly short ones, from all texts that share them, and leaves the others whole."""
    rng = random.Random(5)
    rows, planted = [], {}
    for lang, words in WORDS.items():
        said = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", "", "s", "en", "tion")) for _ in range(n))  # noqa: E731, B023
        for size in range(51, 61):
            passage = said(size)
            for _ in range(3):
                planted[len(rows)] = passage
                rows.append((len(rows), f"{said(70)} {passage} {said(70)}", lang, "s", 0))
        rows += [(len(rows) + k, said(200), lang, "s", 0) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, SF).collect()}
    caught = [planted[d] not in got[d] and len(got[d]) <= len(rows[d][1]) - 0.98 * len(planted[d]) for d in planted]
    assert sum(caught) >= 0.97 * len(caught)
    assert all(got[d] == text for d, text, *_ in rows if d not in planted)
