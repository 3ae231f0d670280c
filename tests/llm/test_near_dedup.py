"""Operator 2 against brute force, and the parts of HyperMinHash."""

import random

import numpy as np

from petrichor.llm import hyperminhash as H
from petrichor.llm import near_dedup as D
from petrichor.llm.text import shingle_sets, words
from petrichor.operators import components as C


def plain_set(text, width):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i: i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    sets = [plain_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        named = [x for x in ids[root(i)] if x is not None]
        c = min(named) if named else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def test_groups_as_brute_force(spark, monkeypatch):
    """Small groups, a shared boiler plate, a large group of near copies in several blocks, and a chain of links."""
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "BLOCK_MEMBERS", 5)
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 12, 60, 200]))]
        texts += [" ".join(edited(rng, base, rng.randint(0, 3))) for _ in range(rng.randint(1, 5))]
    boiler = [rng.choice(vocabulary) for _ in range(30)]
    texts += [" ".join(boiler + [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]) for _ in range(30)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randint(1, 5))) for _ in range(60)]
    chain = [f"v{k}" for k in range(400)]
    texts += [" ".join(chain[4 * k: 4 * k + 60]) for k in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    out = D.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, 4)


def test_odd_rows(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = D.groups(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = []
    for d, n, c, _ in brute(rows, 5):
        want.append((d, n, c, d == c))
    assert got == sorted(want, key=repr)
    assert D.groups(empty).count() == 0


def test_deduplicated_keeps_columns_and_one_of_each(docs, empty):
    out = D.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert D.deduplicated(empty).count() == 0


def test_words_and_shingles():
    texts = [b"a b  c\nd\te", b"", b"   ", "é ü".encode(), b"A b C d e"]
    h, n = words([t.lower() for t in texts])
    assert n.tolist() == [5, 0, 0, 2, 5] and (h[:5] == h[7:]).all()
    s = shingle_sets(texts, 4)
    assert [len(x) for x in s] == [2, 0, 0, 1, 2] and (s[0] == s[4]).all()


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(1)
    for j, n in ((0.0, 20000), (0.5, 3000), (0.8, 5000), (0.9, 400)):
        both = int(n * 2 * j / (1 + j))
        pool = np.unique(rng.integers(0, 2**64, 2 * n + 100, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n: 2 * n - both])))
        regs = H.registers([a, b], 4096)
        est, used = H.estimate(regs[:1], np.array([len(a)]), regs[1:], np.array([len(b)]))
        assert abs(est[0] - j) < 4 * np.sqrt(max(j * (1 - j), 0.002) / used[0]) + 0.01


def test_registers_of_empty_and_small_sets():
    regs = H.registers([np.zeros(0, np.uint64), np.array([5], np.uint64)], 200)
    assert not regs[0].any() and (regs[1] != 0).sum() == 1
    keys = H.bands(regs, 5)
    assert keys.shape == (2, 40) and len(set(keys[1].tolist())) == 40


def test_a_chain_of_a_thousand_links_takes_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length, and no table's size estimate grows from round to round."""
    sizes = []
    real = C.written

    def watched(df, keep=None):
        out = real(df, keep)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out
    monkeypatch.setattr(C, "written", watched)
    names = [bytes(x) for x in np.random.default_rng(3).permutation(1001).astype(">u2").reshape(-1, 1).view(np.uint8)]
    links = spark.createDataFrame(list(zip(names, names[1:])), "a binary, b binary")
    out = {bytes(r.fp): bytes(r.label) for r in D.components(links).collect()}
    assert set(out) == set(names) and set(out.values()) == {min(names)}
    assert len(sizes) < 2 * 14 + 2 and max(sizes) < 1 << 20


def test_recall_near_the_threshold(spark):
    """Pairs of 4 to 60 shingles at or just above 0.8: none may be lost."""
    rng, rows, pairs = random.Random(11), [], []
    for k in range(3000):
        n = rng.randint(9, 60)
        base = [f"w{k}_{i}" for i in range(n)]
        cut = max(0, int(2 * 0.2 / 1.8 * n * rng.uniform(0.3, 0.55)))
        other = base[cut:] + [f"x{k}_{i}" for i in range(cut)]
        one, two = plain_set(" ".join(base), 4), plain_set(" ".join(other), 4)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        if 100 * len(one & two) >= 80 * len(one | two):
            pairs.append(2 * k)
    out = {r.doc_id: r.component_id for r in D.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert len(pairs) > 1000
    assert [p for p in pairs if out[p + 1] != p] == []
