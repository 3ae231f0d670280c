"""Runs, gap merge, guard, containment: hand-computed cases and brute force under hostile chunking."""

import random

import pytest
from pyspark.sql import functions as F

from petrichor.operators import events as E
from petrichor.operators import slots as S


def brute_merge(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return sorted(tuple(o) for o in out)


def test_three_seeds_become_one_through_gap_then_guard(spark):
    seeds = spark.createDataFrame([(0, 1), (13, 14), (27, 28)], "start long, end long")
    assert [tuple(r) for r in E.merge_intervals(seeds, 12).select("start", "end").orderBy("start").collect()] == [(0, 14), (27, 28)]
    both = E.guard_and_merge(E.merge_intervals(seeds, 12), 7)
    assert [tuple(r)[:2] for r in both.collect()] == [(-7, 35)]
    assert [tuple(r)[:2] for r in E.event_intervals(seeds, 12, 7).collect()] == [(-7, 35)]


@pytest.mark.parametrize("gap,chunk", [(0, 1), (0, 7), (1, 1), (3, 1), (5, 2), (40, 3), (3, 4096)])
def test_merge_equals_brute_force(spark, gap, chunk):
    rng = random.Random(gap * 31 + chunk)
    # one source holds most rows; some intervals run across many chunks
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), s, s + (rng.choice([0, 1, 2, 400]) if rng.random() < 0.05 else rng.randint(0, 3)))
            for s in (rng.randint(-500, 4000) for _ in range(600))]
    df = spark.createDataFrame(rows, "source string, start long, end long").repartition(7)
    got = {}
    for r in E.merge_intervals(df, gap, ["source"], chunk_cells=chunk).collect():
        got.setdefault(r["source"], []).append((r["start"], r["end"], r["n_seeds"]))
    want = {}
    for src in {r[0] for r in rows}:
        want[src] = brute_merge([(a, b) for k, a, b in rows if k == src], gap)
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_runs_do_not_depend_on_chunks_or_partitions(spark, parts, chunk):
    rng = random.Random(chunk)
    slots = sorted({rng.randint(0, 300) for _ in range(200)})
    df = spark.createDataFrame([(s,) for s in slots], "slot long").repartition(parts)
    got = sorted((r["run_start"], r["run_end"], r["run_len"]) for r in S.runs(df, chunk_slots=chunk).collect())
    assert got == brute_merge([(s, s) for s in slots], 1)


def test_strict_issue_slots_need_the_whole_dependency(spark):
    df = spark.range(0, 84).select(F.col("id").alias("slot"))
    assert [r["slot"] for r in S.strict_issue_slots(df).collect()] == [11]
    assert S.strict_issue_slots(df.filter("slot <> 40")).count() == 0


def test_endpoint_mode_allows_a_gap_in_the_middle(spark):
    slots = spark.createDataFrame([(i,) for i in (0, 1, 2, 8, 9, 10)], "slot long")
    issue = spark.createDataFrame([(2, 8)], "slot long, lead int")
    from petrichor.functions import time as T
    ends = T.endpoint_slots(F.col("slot"), F.col("lead"), 3, 3)
    whole = F.sequence(F.col("slot") - 2, F.col("slot") + F.col("lead"))
    assert S.available(issue, slots, ends, keys=("slot", "lead")).count() == 1
    assert S.available(issue, slots, whole, keys=("slot", "lead")).count() == 0


def test_availability_stats(spark):
    df = spark.createDataFrame([(i,) for i in list(range(100)) + list(range(200, 210))], "slot long")
    r = S.availability_stats(df).collect()[0]
    assert (r["timestamps"], r["runs"], r["windows"], r["supporting_runs"], r["disjoint_blocks"]) == (110, 2, 17, 1, 1)


def test_containment_bounds_are_inclusive(spark):
    ev = spark.createDataFrame([(0, 10, "a"), (20, 300, "b")], "start long, end long, id string")
    pts = spark.createDataFrame([(0, 10), (0, 11), (20, 300), (150, 151), (11, 12)], "lo long, hi long")
    got = sorted((r["lo"], r["hi"], r["id"]) for r in E.containing_event(pts, ev, F.col("lo"), F.col("hi"), 16).collect())
    assert got == [(0, 10, "a"), (20, 300, "b"), (150, 151, "b")]


def test_order_violations_cross_chunk_edges(spark):
    df = spark.createDataFrame(list(enumerate([1, 2, 2, 5, 4, 6, 7, 3])), "pos long, k long")
    for chunk in (1, 2, 3, 100):
        assert sorted(r["pos"] for r in S.order_violations(df, "pos", ["k"], chunk).collect()) == [2, 4, 7]
