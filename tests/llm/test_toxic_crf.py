"""Operator 1: marginals against enumeration, spans, and held-out accuracy."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from petrichor.llm import toxic_crf as C


def test_marginals_and_expected_transitions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 6, size=3)
        t = rng.normal(size=(2, 2))
        e = [rng.normal(size=n) * 2 for n in lengths]
        p, expected, total = C.marginals(np.concatenate(e), np.repeat(np.arange(3), lengths), np.concatenate([np.arange(n) for n in lengths]), t, pairs=True)
        want, moves, z_all = [], np.zeros((2, 2)), 0.0
        for x in e:
            z, m, k = 0.0, np.zeros(len(x)), np.zeros((2, 2))
            for y in itertools.product([0, 1], repeat=len(x)):
                s = np.exp(sum(a for a, b in zip(x, y) if b) + sum(t[a, b] for a, b in zip(y, y[1:])))
                z += s
                m += s * np.array(y)
                for a, b in zip(y, y[1:]):
                    k[a, b] += s
            want.append(m / z)
            moves += k / z
            z_all += np.log(z)
        assert np.allclose(p, np.concatenate(want)) and np.allclose(expected, moves) and abs(total - z_all) < 1e-8


def test_layout_breaks_at_stops_texts_and_length():
    stop = np.array([False, False, True, False, False, False])
    doc = np.array([0, 0, 0, 0, 1, 1])
    word, chain, place = C.layout(stop, doc)
    assert word.tolist() == [0, 1, 3, 4, 5] and chain.tolist() == [0, 0, 1, 2, 2] and place.tolist() == [0, 1, 0, 0, 1]
    _, chain, place = C.layout(np.zeros(130, bool), np.zeros(130, int))
    assert place.max() == C.CHAIN - 1 and chain[-1] == 2


def sample():
    rows = []
    for k in range(200):
        words = ["good", "day", "and", "fine", "words", "in", "rows", str(k)] * 3
        if k % 4 == 0:
            words[k % 20] = "idiot" if k % 8 else f"moron{k}s"
        rows.append((k, " ".join(words) + ".", int(k % 4 == 0)))
    return rows


def test_spans_and_scores(docs, empty):
    field = C.fit(sample(), rounds=20)
    out = {r.doc_id: r for r in C.tagged(docs, field).collect()}
    assert C.tagged(docs, field).count() == docs.count() and C.tagged(empty, field).count() == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert out[2].score == out[3].score == out[4].score < 0.5 and not out[2].spans
    text = "a fine day, idiot. Good rows"
    one = C.tagged(docs.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"), field).first()
    assert one.predicted == 1 and [text[s.start: s.end] for s in one.spans] == ["idiot"]


def test_nothing_to_learn(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not C.train(docs, none).usable
    assert {r.predicted for r in C.tagged(docs, C.train(docs, none)).collect()} == {0}
    odd = spark.createDataFrame([(1, None), (None, 1), (999, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    assert not C.train(docs, odd).usable


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    field = C.train(d, lab.filter(~held))
    truth = {r.doc_id: r.toxic for r in lab.filter(held).collect()}
    assert all(zlib.crc32(str(k).encode()) % 5 == 0 for k in truth)
    out = {r.doc_id: r.predicted for r in C.tagged(d.filter(held), field).collect()}
    hits = [out[k] == v for k, v in truth.items() if k in out]
    found = [out[k] for k, v in truth.items() if k in out and v == 1]
    assert np.mean(hits) > 0.95 and np.mean(found) > 0.8
