"""Operator 10: every id in exactly one piece, limits kept, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P

from petrichor.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def check_pieces(found, tokens, loss, limits):
    quiet = [n - m for n, m in zip(tokens, loss)]
    covered = defaultdict(list)
    for s in found:
        assert s and len(s) <= limits.segments and sum(n for _, _, n in s) <= limits.tokens
        assert sum(max(0, a + n - max(a + 1, quiet[i])) for i, a, n in s) <= limits.loss
        for i, a, n in s:
            assert n > 0
            covered[i].append((a, n))
    for i, n in enumerate(tokens):
        at = 0
        for a, m in sorted(covered[i]):
            assert a == at
            at += m
        assert at == n


def test_limits_on_all_three_sizes():
    rng = random.Random(3)
    for limits in (K.Limits(64, 4, 40), K.Limits(64, 64, 63), K.Limits(32, 2, 5), K.Limits(16, 1, 16)):
        tokens = [rng.choice([0, 1, 2, 7, 30, 64, 65, 200]) for _ in range(120)]
        loss = [rng.randint(0, n) for n in tokens]
        check_pieces(K.pack(tokens, loss, limits), tokens, loss, limits)
    assert K.pack([], []) == []


def test_powers_keep_order_and_content():
    out = K.powers([(0, 5, 3), (1, 0, 8), (2, 0, 2)])
    assert [sum(n for _, _, n in s) for s in out] == [8, 4, 1]
    assert [p for s in out for p in s] == [(0, 5, 3), (1, 0, 5), (1, 5, 3), (2, 0, 1), (2, 1, 1)]


def test_chunks_equal_the_tokenizer():
    t = K.ids_of(PATH)
    rng = random.Random(2)
    al = ["a", "B", "é", "É", "é", " ", "\n", "'s", "'", "12", "!", "<|endoftext|>", "ß", "İ", "Σ", "ς", "　", "\x85", "\x1d", " ", "中", "_", "½"]
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    assert t.encode_all(texts) == t.fresh(texts)


def test_rows(docs, empty):
    out = K.packed(docs, PATH).collect()
    t = K.ids_of(PATH)
    end = np.array([1], "<u4").tobytes()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(t.fresh([r.text or ""])[0] + end)
    got, line = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
        line[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for d, pieces in got.items():
        ids = want[d][0]
        assert sum(p.length for p in pieces) == sum(len(x) // 4 for x in want[d])
        for p in pieces:
            assert p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * p.start: 4 * (p.start + p.length)])
    for pieces in line.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert K.packed(empty, PATH).count() == 0


def test_loss_limit_binds_through_the_operator(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["word"] * rng.choice([3, 20, 90, 300])), rng.choice([None, -2, 0, 1, 5, 40, 10_000])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, answer int").coalesce(1)
    limits = K.Limits(256, 16, 60)
    out = K.packed(df, PATH, limits=limits, loss="answer").collect()
    tokens = {r.doc_id: r.doc_tokens for r in out}
    loss = {k: tokens[k] if n is None else min(tokens[k], max(0, n)) for k, _, n in rows}
    ids = sorted(tokens)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.doc_id, r.start, r.length))
    check_pieces(list(sequences.values()), [tokens[k] for k in ids], [loss[k] for k in ids], limits)

    def most(found):
        return max(sum(n for _, _, n in s) for s in found)
    free = defaultdict(int)
    for r in K.packed(df, PATH, limits=limits).collect():
        free[r.sequence_id] += r.length
    assert most(sequences.values()) > max(free.values())  # masked prompts fill up what loss alone would leave


def test_padding_is_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used = [r.n for r in K.packed(df, PATH).groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    padded = sum(2048 - n for n in used if n & (n - 1))
    assert padded < 0.01 * sum(used)


def test_number_of_remembered_chunks_is_a_parameter_and_changes_nothing():
    texts = [" ".join(f"w{i * k}" for i in range(40)) for k in range(1, 60)]
    few, many = K.Ids(PATH, kept=50), K.Ids(PATH, kept=100_000)
    assert [few.encode_all([t]) for t in texts] == [many.encode_all([t]) for t in texts]
    assert len(many.seen) > 500 and not many.older and few.older
