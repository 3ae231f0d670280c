"""Operator 12 against plain rounds, and its incremental update."""

import hashlib
import math
import random
import struct

import numpy as np

from petrichor.llm import centroids as C


def single(x):
    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, k, dims, rounds, seed=2):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(v, key=lambda r: ((r[0] is None), hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [q for _, q in order[:k]]

    def assign():
        return [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(q, c[j])), j)) for _, q in v]
    for _ in range(rounds):
        to = assign()
        for j in range(len(c)):
            mine = [q for (_, q), t in zip(v, to) if t == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    d = [sum((a - b) ** 2 for a, b in zip(q, c[t])) for (_, q), t in zip(v, to)]
    return sorted(((i, t, n, sum(m for m, u in zip(d, to) if u == t), sum(d), hashlib.sha256(",".join(map(str, c[t])).encode()).hexdigest())
                   for (i, _), t, n in zip(v, to, d)), key=repr)


def rows_of(n, dims, seed=3):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    out = [(i, [single(b + rng.gauss(0, 0.2)) for b in rng.choice(base)]) for i in range(n)]
    out += [(7, out[7][1]), (7, out[8][1]), (None, out[9][1]), (n + 1, None), (n + 2, [0.5, None] + [0.1] * (dims - 2)), (n + 3, [float("nan")] * dims),
            (n + 4, [float("-inf")] * dims), (n + 5, [0.5] * (dims - 1)), (n + 6, []), (n + 7, [0.5] * (dims + 1))]
    return [(i, None if e is None else [single(x) if x is not None and math.isfinite(x) else x for x in e]) for i, e in out]


SCHEMA = "vec_id long, embedding array<float>, cluster string, q int, dots string"


def test_as_plain_rounds(spark):
    rows = rows_of(120, 6)
    df = spark.createDataFrame([(i, e, "clash", 1, "x") for i, e in rows], SCHEMA)
    for k, rounds in ((8, 5), (3, 0)):
        out = C.clustered(df, k=k, dimensions=6, rounds=rounds)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in out.repartition(5).collect()), key=repr) == brute(rows, k, 6, rounds)


def test_fewer_vectors_than_centroids_ties_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.25, 0.0])]
    df = spark.createDataFrame([(i, e, "", 1, "") for i, e in rows], SCHEMA)
    assert sorted((tuple(r) for r in C.clustered(df, k=10, dimensions=2).collect()), key=repr) == brute(rows, 10, 2, 5)
    assert C.clustered(df.limit(0), k=3, dimensions=2).collect() == []
    assert C.clustered(df, k=3, dimensions=5).collect() == []


def test_huge_components_stay_exact(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38], "", 1, ""), (2, [0.0, 0.0], "", 1, "")], SCHEMA)
    out = {r.vec_id: r.distance for r in C.clustered(df, k=1, dimensions=2, rounds=0).collect()}
    assert sorted(out.values()) == [0, 2 * (1 << 54)]


def test_update_reads_changed_components_only():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-300, 300, (50, 9)), rng.integers(-300, 300, (4, 9))
    after = c.copy()
    after[1, 3] += 5
    after[2, [0, 8]] -= 7
    dots = C.updated(x, x @ c.T, after - c)
    assert (dots == x @ after.T).all()
    broken = x.copy()
    broken[:, [1, 2, 4, 5, 6, 7]] = 0  # components that no centroid changed are never looked at
    assert (C.updated(broken, x @ c.T, after - c) == dots).all()
