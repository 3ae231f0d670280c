"""Operator 9: base counts against a plain version; the order of the cascade never changes the verdict."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from petrichor.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(inside)


def test_counts(spark, docs, empty):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", " \x0b\x0c\r"]) for _ in range(120)]
    texts += ["\n".join(rng.choice(["x y", " x y", "", "z", "é#*"]) for _ in range(12)) for _ in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    for r in Q.counted(df).collect():
        assert tuple(r._q)[:6] == plain(r.text), r.text
    assert Q.judged(empty).count() == 0


def test_counts_past_the_position_bits(spark, monkeypatch):
    """Repeats at positions that need more bits than a short text's, at small and at real width."""
    def of(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert [tuple(r._q)[:6] == plain(r.text) for r in Q.counted(df).collect()] == [True] * len(texts)

    fresh = [f"w{k}" for k in range(200)]
    tail = " ".join(fresh[:100] + ["x", "y", "z"] + fresh[100:] + ["x", "y", "z", "end"])
    rng = random.Random(3)
    with monkeypatch.context() as m:
        m.setattr(Q, "_POSITION_BITS", 3)
        of([tail, " ".join(fresh * 2), *(" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 500))])
    long = " ".join(f"{k:x}" for k in range((1 << 21) + 10))
    assert Q.counted(spark.createDataFrame([(long + " x y z and x y z",)], "text string")).first()._q.n_repeat_words == 6


def test_columns_stay(docs):
    out = Q.judged(docs)
    assert out.drop("_q", "_base_failed", "_failed", "_kept").columns == docs.columns and out.count() == docs.count()


def test_order_does_not_change_the_verdict(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    names = sorted(Q.RULES)
    a = Q.judged(d, sequence=names).select("doc_id", "_kept")
    b = Q.judged(d, sequence=names[::-1]).select("doc_id", "_kept")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    order = Q.order(d)
    assert sorted(order) == names


def test_base_fails_and_good_text_stays(spark):
    good = " ".join(f"Word{k} stands here" for k in range(60))
    rows = [(1, good), (2, "too short"), (3, "same old thing " * 40), (4, None), (5, "\n".join(f"###{k}### $$%%" for k in range(60)))]
    out = {r.doc_id: r for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]._kept and not out[1]._base_failed
    assert out[2]._base_failed and out[3]._base_failed and out[4]._base_failed
    assert not out[5]._kept


def test_native_plan(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q.judged(d, sequence=sorted(Q.RULES)).select(F.col("_kept"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_cascade_gives_the_verdict_of_all_counts_in_any_order(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    names = sorted([*Q.BASE_RULES, *Q.RULES])
    want = Q.judged(d, sequence=sorted(Q.RULES)).select("doc_id", F.col("_kept").alias("kept"))
    for sequence in (names, names[::-1], Q.order(d, {**Q.BASE_RULES, **Q.RULES})):
        assert sorted(sequence) == names
        got = Q.filtered(d, sequence=sequence).select("doc_id", F.col("_failed").isNull().alias("kept"))
        assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert Q.filtered(docs).columns == [*docs.columns, "_failed"] and Q.filtered(empty).count() == 0


def test_a_failed_document_is_not_counted_any_more(spark):
    d = spark.createDataFrame([(1, "short"), (2, " ".join(f"word{k}" for k in range(80)))], "doc_id long, text string")
    alarm = {"alarm": "CASE WHEN text = 'short' THEN raise_error('counted') ELSE false END"}
    out = {r.doc_id: r._failed for r in Q.filtered(d, alarm, sequence=["few_words", "alarm", "repeats"]).collect()}
    assert out == {1: "few_words", 2: None}
    windows = Q.filtered(d, {}, sequence=["few_words", "repeats"])
    text = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "_q_open" in text and "Exchange" not in text  # words of open documents alone go into the windows
