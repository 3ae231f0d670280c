"""Operator 6 against brute force; a small block size meets several query blocks."""

import math

import pytest

from petrichor.llm import topk_search as T


def brute(rows, k, every):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {i: e for i, e in v if i % every == 0}.items():
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q)[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block, slice_rows", [(2, 7), (4096, 32768)])
def test_search(spark, block, slice_rows):
    import random
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(80)]
    rows += [(80, None), (82, [1.0, None]), (84, [float("nan")] * 6), (86, [float("inf")] * 6), (None, [1.0] * 6), (90, []), (91, [0.5, 0.5]), (7, [0.25] * 6), (7, [0.25] * 6)]
    df = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], "vec_id long, embedding array<float>, score string, rank int")
    import struct
    exact = [(i, None if e is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in e]) for i, e in rows]
    q = T.quantised(df)
    out = T.search(q.filter("vec_id % 10 = 0"), q, 5, block=block, rows=slice_rows)
    assert sorted(tuple(r) for r in out.collect()) == brute(exact, 5, 10)
    assert T.search(q.filter("vec_id < 0"), q, 5).count() == 0
    assert T.search(q.filter("vec_id = 10"), q.limit(0), 5).count() == 0


def test_huge_components_do_not_run_over(spark):
    rows = [(0, [3e38, -3e38]), (1, [3e38, 3e38]), (2, [3e38, -1.0]), (3, [-3e38, 3e38])]
    q = T.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    top = 1 << 54
    assert [(r.vec_id, r.score) for r in T.search(q.filter("vec_id = 0"), q, 5).orderBy("rank").collect()] == [(2, top + 256 * (1 << 27)), (1, 0), (3, -2 * top)]
