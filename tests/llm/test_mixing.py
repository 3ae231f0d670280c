"""Operator 11 against a plain fair queue, packet by packet."""

import hashlib
import math
import random
import re

from petrichor.llm import mixing as M

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def size_of(text):
    return len([w for w in SPACE.split(text or "") if w])


def level(sizes, weights, budget):
    """Targets by stopping sources one round after another."""
    stopped = set()
    while True:
        free = [s for s in sizes if s not in stopped]
        if not free:
            return {s: 2.0 * sizes[s] for s in sizes}
        x = (budget - sum(2 * sizes[s] for s in stopped)) / sum(weights[s] for s in free)
        over = {s for s in free if x * weights[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in stopped else x * weights[s] for s in sizes}
        stopped |= over


def brute(rows, weights=(3, 1, 2), packet=M.PACKET):
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    each = {s: [(i, size_of(t), hashlib.md5(f"mix:{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, x, t in rows if x == s] for s in names}
    sizes = {s: sum(n for _, n, _ in d) for s, d in each.items()}
    target = level(sizes, {s: weights[k % len(weights)] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    line, docs = [], []
    for place, s in enumerate(names):
        at = 0
        for i, n, _ in sorted(each[s], key=lambda d: (d[2], -1 if d[0] is None else d[0], d[1])):
            docs.append([i, n, sizes[s], target[s], 0])
            for copy in range(2):
                for a in range(0, n, packet):
                    end = copy * sizes[s] + at + min(a + packet, n)
                    line.append((end / target[s], place, end, min(packet, n - a), docs[-1]))
            at += n
    left = math.floor(1.5 * sum(sizes.values()))
    for _, _, _, n, doc in sorted(line, key=lambda p: p[:3]):
        took = min(left, n)
        doc[4] += took
        left -= took
    return docs


def shown(docs):
    return sorted(((i, n, z, round(t, 6), k) for i, n, z, t, k in docs), key=repr)


def got(df):
    return shown([tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()])


def test_as_a_plain_queue_whatever_the_layout(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", "c", "d", "é", "\U0001f642", None, "a", "a", "a"]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 300, 2000]))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute(rows)
    assert got(M.mixed(df, (3, 1, 2))) == shown(want)
    monkeypatch.setattr(M, "CHUNK", 7)  # several chunks a source
    assert got(M.mixed(df.repartition(13, "text"), (3, 1, 2))) == shown(want)
    by_source = {}
    for (_, s, _), in zip(rows):
        by_source.setdefault(s, 0)
    assert all(k <= 2 * n for _, n, _, _, k in want) and sum(k for *_, k in want) == math.floor(1.5 * sum(d[1] for d in want))


def test_each_source_ends_within_a_packet_of_its_target(spark):
    rows = [(k, f"s{min(k % 9, 5)}", " ".join(["w"] * (1 + k * 37 % 900))) for k in range(200)]
    out = M.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), (3, 1, 2), packet=16).collect()
    source = {k: s for k, s, _ in rows}
    for s in set(source.values()):
        mine = [r for r in out if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * 16


def test_sources_stop_at_twice_their_size(spark):
    rows = [(1, "big", "w " * 1000), (2, "small", "w " * 10), (3, "tiny", "w")]
    out = {r.doc_id: r for r in M.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), (1, 1, 1)).collect()}
    assert out[2].target == 20.0 and out[3].target == 2.0 and out[1].target == 1.5 * 1011 - 22
    assert (out[2].taken, out[3].taken) == (20, 2) and out[1].taken == math.floor(1.5 * 1011) - 22


def test_odd_rows(docs, empty):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    out = M.mixed(docs, (3, 1, 2))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got(out) == shown(brute(rows))
    assert M.mixed(empty, (3, 1, 2)).count() == 0
    silent = M.mixed(docs.filter("text is null or text = ''"), (3, 1, 2)).collect()
    assert len(silent) == 2 and all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in silent)
