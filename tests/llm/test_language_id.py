"""Operator 5: code lengths against a plain recursive version, and held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from petrichor.llm import language_id as L


def plain_bits(cells, size, ctx, sym):
    bits = 0.0
    for order in range(len(ctx), -1, -1):
        c = 0
        for x in ctx[len(ctx) - order:] if order else []:
            c = c * size + x
        index, count = cells[order]
        here = index // size == c
        if here.any():
            n, d = count[here].sum(), here.sum()
            hit = index[here] % size == sym
            if hit.any():
                return bits + np.log2((n + d) / count[here][hit][0])
            bits += np.log2((n + d) / d)
    return bits + np.log2(size)


def test_code_lengths():
    m = L.fit({"x": [b"abracadabra abracadabra", b"cab"], "y": [b"the cat sat on the mat"]})
    rng = np.random.default_rng(0)
    for _ in range(400):
        c = [int(v) for v in rng.integers(0, m.symbols, 4)]
        at = ((c[0] * m.symbols + c[1]) * m.symbols + c[2]) * m.symbols + c[3]
        for k in range(2):
            assert abs(plain_bits(m.cells[k], m.symbols, c[:3], c[3]) - m.table[at, k]) < 1e-3


def test_score_sums_code_lengths():
    m = L.fit({"x": [b"abracadabra"], "y": [b"the cat"]})
    text = b"The abra  cat"
    s = [int(v) for v in m.alphabet[np.frombuffer(b"   " + b"the abra cat ", np.uint8)]]
    for k in range(2):
        want = sum(plain_bits(m.cells[k], m.symbols, s[i - 3: i], s[i]) for i in range(3, len(s)))
        assert abs(L.score(m, [text])[0, k] - want) < 1e-2


def test_no_byte_is_merged():
    """Every byte has its own symbol, whatever its frequency and the number of languages."""
    rng = np.random.default_rng(1)
    common = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    rare = {f"l{k:03d}": [common, chr(0x4E00 + k).encode() * 3] for k in range(100)}
    m = L.fit(rare)
    assert L.judged(m, [chr(0x4E00 + k).encode() * 9 for k in range(100)])[0] == sorted(rare)
    two = L.fit({"de": [common, "ä ö ü ß ".encode() * 2], "es": [common, "ñ í ó á ".encode() * 2]})
    assert L.judged(two, ["ßäß".encode(), "íñí".encode()])[0] == ["de", "es"]
    for k, name in enumerate(sorted(rare)):  # a further language leaves the others as they are
        if k % 25 == 0:
            alone = L.fit({name: rare[name]})
            assert np.array_equal(L.score(alone, [b"some text"])[0], L.score(m, [b"some text"])[0, [k]])


def test_long_texts_in_blocks(monkeypatch):
    m = L.fit({"x": [b"abracadabra"], "y": [b"the cat"]})
    texts = [b"The abra  cat " * 9, b"a", b"", "naïve cat".encode() * 5, b"x"]
    whole = L.score(m, texts)
    monkeypatch.setattr(L, "BLOCK", 7)
    assert np.allclose(L.score(m, texts), whole, atol=1e-6)
    for i, t in enumerate(texts):
        s = [int(v) for v in m.alphabet[np.frombuffer(b"   " + L.fold(t) + b" ", np.uint8)]]
        for k in range(2):
            assert abs(sum(plain_bits(m.cells[k], m.symbols, s[j - 3: j], s[j]) for j in range(3, len(s))) - whole[i, k]) < 1e-2


def test_edge_rows(docs, empty):
    m = L.train(docs)
    out = {(r.doc_id, r.lang_pred, round(r.score, 3) > 0) for r in L.predict(docs, m).collect()}
    assert {x for x in out if x[0] in (2, 3, 4, 8)} == {(k, "und", False) for k in (2, 3, 4, 8)}
    assert L.predict(docs, m).count() == docs.count()
    assert {x[1] for x in out} <= {"en", "de", "es", "fr", "und"}
    none = L.train(empty)
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(empty, m).count() == 0
    kept = L.flagged(docs, m)
    assert kept.columns[:-1] == docs.columns and kept.count() == docs.count()


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    m = L.train(d.filter(~held))
    real = {r.doc_id: r.lang for r in d.filter(held).collect()}
    assert all(zlib.crc32(str(k).encode()) % 4 == 2 for k in real)
    out = L.predict(d.filter(held), m).collect()
    assert sum(real[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out)


def test_repeated_rows_are_one_document_of_the_sample(spark, monkeypatch):
    rows = [(k, f"document {k} tells of its own number {k * k} and of nothing else", "en") for k in range(300)] + [(k, f"le texte {k}", "fr") for k in range(50)]
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = one.orderBy(F.xxhash64("doc_id", "text")).first()
    many = spark.createDataFrame(rows + [tuple(first)] * 500, one.schema)
    for docs_each in (400, 20, 3):
        assert L.train(many, docs_each).name == L.train(one, docs_each).name
    order = sorted((r.k, r.text) for r in one.filter("lang = 'en'").select(F.xxhash64("doc_id", "text").alias("k"), "text").collect())
    want = L.fit({"en": [t.encode() for _, t in order[:20]]})
    got = L.train(one.filter("lang = 'en'"), 20)
    assert got.name == want.name
    monkeypatch.setattr(L, "TRAIN_BYTES", 12)  # only the shortest count
    assert L.train(one).languages == ["fr"]
