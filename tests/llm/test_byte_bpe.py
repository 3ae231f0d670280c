"""Operator 8 against the tiktoken library, and exact round trips."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from petrichor.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    c = B.codec(PATH, P.PATTERN)
    ranks = {t: i for i, t in enumerate(B.read_ranks(PATH))}
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_every_rank_is_a_piece(pair):
    c, _ = pair
    assert c.bytes_of == B.read_ranks(PATH)


def test_all_characters_as_the_library(pair):
    c, e = pair
    for a in range(0, 0x30000, 64):
        s = "".join(f"a{chr(x)} {chr(x)}b1" for x in range(a, a + 64) if not 0xD800 <= x < 0xE000)
        assert ids(c.encode(s)) == e.encode_ordinary(s)


def test_random_texts_and_long_runs(pair):
    c, e = pair
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdé_ß \n\t  .,!'srtll19🙂中文   ") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += ["a" * 20000, " " * 20000, "!" * 9999, "aé" * 9999, "<|endoftext|>", ""]
    for s, packed in zip(texts, c.encode_all(texts)):
        assert ids(packed) == e.encode_ordinary(s)
        assert c.decode(packed) == s.encode()


def test_memory_is_bounded(pair, monkeypatch):
    c, e = pair
    monkeypatch.setattr(B, "KEPT", 10)
    for k in range(30):
        s = " ".join(f"w{k}x{j}" for j in range(9))
        assert ids(c.encode(s)) == e.encode_ordinary(s)
    assert len(c.seen) <= 60


def test_rows(docs, empty, pair):
    _, e = pair
    out = B.round_trip(docs, PATH, P.PATTERN).collect()
    source = docs.collect()
    assert len(out) == len(source)
    want = sorted((r.doc_id or 0, len(i := e.encode_ordinary(r.text or "")), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in source)
    assert sorted((r.doc_id or 0, *tuple(r)[1:]) for r in out) == want
    assert B.round_trip(empty, PATH, P.PATTERN).count() == 0


def test_encode_then_decode(docs):
    back = B.decode(B.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in docs.collect())


def test_gaps_in_ranks_are_refused(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        B.read_ranks(str(tmp_path / "r"))
