"""Operator 13 against brute force, and the tree's elimination."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrichor.llm import gnat
from petrichor.llm import hard_negatives as N


def single(x):
    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, every):
    v = [(i, y, [math.floor(256 * x) for x in e]) for i, y, e in rows if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a in sorted({i for i, _, _ in v if i % every == 0}):
        _, label, q = min(r for r in v if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(q, e)), i, y == label) for i, y, e in v if i != a)
        for n, p, _ in [s for s in scored if s[2]][:5]:
            fit = [(s, i) for s, i, same in scored if not same and 50 * -n <= 100 * -s <= 95 * -n][:3]
            out += [(a, p, r + 1, i, -n, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def clustered(n, dims=6, seed=4):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        k = rng.randrange(6)
        rows.append((i, k % 3, [single(b + rng.gauss(0, 0.15)) for b in base[k]]))
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>, leaf string, score string"


@pytest.mark.parametrize("blocks", [(32768, 2048), (16, 4)])
def test_as_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(N, "BLOCK_ANCHORS", blocks[1])
    rows = clustered(260)
    same = [single(x) for x in (0.5, 0.25, 0.5, 0.25, 0.5, 0.25)]
    rows += [(300 + k, k % 2, same) for k in range(12)]  # ties
    rows += [(5, 1, rows[5][2]), (10, 2, rows[11][2]), (None, 1, same), (400, None, same), (410, 1, None), (420, 1, [single(0.1), None]), (430, 1, [float("nan")] * 6),
             (440, 1, [float("inf")] * 6), (450, 1, []), (460, 2, [single(0.7)] * 2), (470, 99, same)]
    df = spark.createDataFrame([(i, y, e, "clash", "x") for i, y, e in rows], SCHEMA)
    out = N.mined(df, F.col("vec_id") % 10 == 0, sample=120, fanout=4, depth=3, least=8)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 10)


def test_empty_tables_and_no_negatives(spark):
    df = spark.createDataFrame([(0, 1, [0.5, 0.5], "", ""), (1, 1, [0.5, 0.25], "", "")], SCHEMA)
    assert N.mined(df, F.col("vec_id") == 0).collect() == []
    assert N.mined(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_elimination_keeps_what_is_needed_and_drops_much():
    rng = np.random.default_rng(6)
    base = rng.integers(-400, 400, (40, 8))
    x = (base[rng.integers(0, 40, 6000)] + rng.integers(-12, 13, (6000, 8))).astype(np.int64)
    tree = gnat.Tree(x[:1500], 6, 3, 20)
    passed, leaf = tree.walk(x)
    norm = (x * x).sum(axis=1)
    found = {}
    for node, at, d, to in passed:
        for j in np.unique(to):
            for i in range(len(node.points)):
                one, n = d[to == j, i], norm[at[to == j]]
                found[node.number, i, int(j)] = (int(one.min()), int(one.max()), int(n.min()), int(n.max()))
    tree.ranges([(*k, *v) for k, v in found.items()])
    q = x[::60]
    scores = q @ x.T
    top = np.sort(scores, axis=1)[:, -5:]
    low, high = np.stack([top[:, 0], top[:, 0] // 2], axis=1), np.stack([np.full(len(q), 1 << 62), top[:, 0] * 19 // 20], axis=1)
    seen = tree.visited(q, low, high)
    for i in range(len(q)):
        needed = np.unique(leaf[((scores[i] >= low[i, 0]) | ((scores[i] >= low[i, 1]) & (scores[i] <= high[i, 1])))])
        assert seen[i, needed].all()
    only_best = tree.visited(q, low[:, :1], high[:, :1])
    assert only_best.mean() < 0.2 and tree.leaves > 30
    assert not tree.visited(q, np.ones((len(q), 1), np.int64), np.zeros((len(q), 1), np.int64)).any()
