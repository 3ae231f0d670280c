"""Operator 4: everything reads back, targets once, windows within their budget."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from petrichor.llm import chat_windows as C

NASTY = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\b\\l\\g\\", "a>b<c", "", None, "word " * 900, "é 中 \U0001f642", "x\n\ny", "</turn>\n"]


def rows(rng):
    out = []
    for c in range(12):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None, "a>b", "system"])
            out.append((c, t, role, rng.choice(NASTY + ["some words here " * rng.randint(1, 60)])))
    out += [(50, 1, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, None, "user", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (51, 0, "system", "alone")]
    out += [(60, t, "assistant" if t % 2 else "user", f"turn {t} of many") for t in range(1000)]
    rng.shuffle(out)
    return out


@pytest.fixture
def turns(spark):
    data = rows(random.Random(11))
    return data, spark.createDataFrame([(*r, "clash", 1, 2) for r in data], "conv_id long, turn long, role string, text string, key string, span int, pos int")


def test_read_back(turns):
    data, df = turns
    by = defaultdict(list)
    for c, t, r, x in data:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in C.digests(C.formatted(df)).collect()}
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in v)
        target = "".join(x for _, _, r, x in v if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(v), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest()), c


def test_windows(turns):
    _, df = turns
    w = C.formatted(df, span=256, history=2, history_tokens=64).withColumn("t", C.turns_of()).collect()
    placed = C.placed(df, 256).collect()
    tokens = defaultdict(int)
    n = defaultdict(int)
    for r in placed:
        tokens[r.key, r.span] += r.tokens
        n[r.key, r.span] += 1
    assert all(v <= 256 or n[k] == 1 for k, v in tokens.items())
    first = {}
    for r in placed:
        if r.pos == 1 and r.role == "system":
            first[r.key] = r.text
    for r in w:
        if r.key in first:
            assert r.formatted.startswith("<turn system>\n" + first[r.key].replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g") + "</turn>\n")
        assert r.n_repeated <= 3
        for s in r.loss:
            assert "<" not in r.formatted[s.start: s.start + s.length]
            assert r.formatted[s.start + s.length:].startswith("</turn>\n")


def test_no_history_and_empty(turns):
    _, df = turns
    a = C.digests(C.formatted(df, history=0)).select("conv_id", "turns_sha256")
    b = C.digests(C.formatted(df)).select("conv_id", "turns_sha256")
    assert a.exceptAll(b).isEmpty()
    assert C.digests(C.formatted(df.limit(0))).count() == 0


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in NASTY if x is not None], "x string")
    assert df.filter(C.unescaped(C.escaped(F.col("x"))) != F.col("x")).isEmpty()
