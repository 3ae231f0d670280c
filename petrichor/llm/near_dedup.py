"""Operator 2: near-duplicate groups of documents by HyperMinHash.

1. Each text becomes its set of word shingles; equal sets form a class (128-bit fingerprint of the set). Copies end here.
2. A class has HyperMinHash registers (leading zeros and mantissa bits a bucket). Bands of ``ROWS`` registers are hashed;
   classes that share a band key meet in a bucket.
3. In every bucket all members meet its leader. The shingle sets of the classes that share any bucket are read once more
   from the texts; a fixed-size bit map of their keys tells the scan which ones to keep.
4. Of buckets whose other members still lie in several components, these members meet each other too, in pairs of blocks
   of bounded members and shingles. A task compares a pair of blocks inside: size ratio, collision-corrected estimate, then the
   full sets; it keeps a small union-find, so what it emits is at most one link a member, never all pairs.
5. Components follow from smallest labels, hooking of roots and pointer jumping, until nothing changes.

No candidate of a band is dropped; with 40 bands of 5 registers a pair at the threshold of 0.8 shares no band with a
chance of about 1e-7, and the estimate lets pass what is less than six standard errors below the threshold.

Defined cases: words are runs without the six ASCII white-space bytes, A-Z lower-cased; fewer words than a shingle make one
shingle; null text and text without words have an empty set, are linked with nothing and are kept. component_id is the
smallest id reachable. A row without id is in the component of its text, names no component unless all ids in it are null,
and is kept only then. Rows that repeat an id each give a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import smallest_labels
from ..session import cut_lineage, written
from . import hyperminhash as H
from .text import as_bytes, shingle_sets, slices

BANDS, ROWS, BLOCK, BITS = 40, 5, 256, 26
#: Most members and about the most shingles of a block whose members are compared with each other.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 18
SIGNED = "doc_id long, fp binary, c long, n long, keys array<long>"
FULL = "fp binary, c long, n long, regs binary, items binary"
_EMPTY = "a binary, b binary"


def fingerprint(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _key(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "big", signed=True)


def key_of(fp: str):
    """The same 64-bit key from a fingerprint column."""
    return F.conv(F.hex(F.substring(fp, 1, 8)), 16, -10).cast("long")


def _sign(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(as_bytes(part.column(1)), width)
            fps = [fingerprint(s) if len(s) else None for s in sets]
            keys = H.bands(H.registers(sets, BANDS * ROWS), ROWS)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(fps, pa.binary()), pa.array([_key(f) if f else None for f in fps], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([k if f else None for k, f in zip(keys, fps)], pa.list_(pa.int64()))],
                names=["doc_id", "fp", "c", "n", "keys"])
    return run


def _wanted(width: int, bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets and registers of texts whose key is in the bit map, once a slice."""
    def run(batches):
        want = np.frombuffer(bits.value, dtype=np.uint8)
        for part in slices(batches, "text"):
            rows = {}
            for s in shingle_sets(as_bytes(part.column(0)), width):
                if len(s):
                    fp = fingerprint(s)
                    at = _key(fp) & ((1 << BITS) - 1)
                    if want[at >> 3] >> (at & 7) & 1:
                        rows[fp] = s
            regs = H.registers(list(rows.values()), BANDS * ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(rows), pa.binary()), pa.array([_key(f) for f in rows], pa.int64()), pa.array([len(s) for s in rows.values()], pa.int64()),
                pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() for s in rows.values()], pa.binary())],
                names=["fp", "c", "n", "regs", "items"])
    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Union:
    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _columns(t: pa.Table):
    fp = t["fp"].to_pylist()
    n = np.asarray(t["n"], dtype=np.int64)
    regs = np.frombuffer(b"".join(t["regs"].to_pylist()), dtype=np.uint16).reshape(len(fp), -1)
    return fp, n, regs, [np.frombuffer(x, dtype=np.uint64) for x in t["items"].to_pylist()]


def _near(i: int, js: np.ndarray, n: np.ndarray, regs: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``js`` whose size and estimate allow a link with ``i``."""
    js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
    if not len(js):
        return js
    est, used = H.estimate(regs[js], n[js], regs[i][None, :], np.full(len(js), n[i]))
    return js[H.passes(est, used, percent / 100)]


def _links(pairs: list) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def _star(percent: int):
    """Members of one leader (``blk`` 0 is the leader, 1 a member) against it."""
    def run(t: pa.Table) -> pa.Table:
        fp, n, regs, items = _columns(t)
        blk = np.asarray(t["blk"])
        out = []
        for i in np.flatnonzero(blk == 0):
            for j in _near(i, np.flatnonzero(blk == 1), n, regs, percent):
                if _similar(items[i], items[j], percent):
                    out.append((fp[i], fp[j]))
        return _links(out)
    return run


def _blocks(percent: int):
    """Two blocks of one bucket (or one with itself): links between different components, at most one a member.

    A pair that shares an earlier band is left to that band's bucket.
    """
    def run(t: pa.Table) -> pa.Table:
        fp, n, regs, items = _columns(t)
        blk, band = np.asarray(t["blk"]), int(t["band"][0].as_py())
        keys = H.bands(regs, ROWS)
        union = _Union(t["label"].to_pylist())
        lo, hi = blk.min(), blk.max()
        alone = lo == hi and t["g1"][0].as_py() == t["g2"][0].as_py()
        order, out = np.arange(len(fp)), []
        for i in order:
            if alone:
                js = order[i + 1:]
            elif blk[i] == lo and lo != hi:
                js = np.flatnonzero(blk == hi)
            else:
                continue
            mine = union.root(i)
            js = js[[union.root(j) != mine for j in js]] if len(js) else js
            if len(js):
                js = js[(keys[js] == keys[i]).argmax(axis=1) == band]
            for j in _near(i, js, n, regs, percent):
                a, b = union.root(i), union.root(j)
                if a != b and _similar(items[i], items[j], percent):
                    union.up[max(a, b)] = min(a, b)
                    out.append((fp[i], fp[j]))
        return _links(out)
    return run


def components(links: DataFrame) -> DataFrame:
    """fp, label: the smallest fingerprint reachable, for all that have a link. Runs until no label falls."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return smallest_labels(written(both)).select(F.col("a").alias("fp"), "label")


def _bit_map(keys: DataFrame) -> bytes:
    """Bit map of 2**BITS key residues: at most 2**(BITS - 15) rows of 4 KB reach the driver, whatever the input."""
    at = F.col("c").bitwiseAND((1 << BITS) - 1)
    rows = keys.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray(1 << (BITS - 3))
    for r in rows:
        out[r["bucket"] << 12: (r["bucket"] + 1) << 12] = bytes(r["bits"])
    return bytes(out)


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = cut_lineage(docs.mapInArrow(_sign(width), SIGNED))
    classes = cut_lineage(signed.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.any_value("c").alias("c"), F.any_value("keys").alias("keys")))

    rows = classes.select("c", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("leader")).filter("m > 1")
    members = cut_lineage(rows.join(shared, "key"))

    bits = spark.sparkContext.broadcast(_bit_map(members.select("c")))
    sets = cut_lineage(docs.select("text").mapInArrow(_wanted(width, bits), FULL).groupBy("fp").agg(
        *[F.any_value(x).alias(x) for x in ("c", "n", "regs", "items")]))

    # every member with its leader; a leader with many members is spread over several groups
    star = (members.filter("c <> leader").groupBy("leader", "c").agg(F.max("m").alias("m"))
            .withColumn("g1", F.ceil(F.col("m") / BLOCK)).withColumn("g2", F.pmod(F.xxhash64("c"), "g1")).select("leader", "g1", "g2", "c"))
    pairs = star.withColumn("blk", F.lit(1)).unionByName(
        star.select("leader", "g1", "g2").distinct().withColumn("c", F.col("leader")).withColumn("blk", F.lit(0)))
    first = cut_lineage(pairs.join(sets, "c").groupBy("leader", "g1", "g2").applyInArrow(_star(percent), _EMPTY))

    # the others of a bucket with each other, where they aren't in one component yet
    label = components(first).select(key_of("fp").alias("c"), key_of("label").alias("label")).groupBy("c").agg(F.min("label").alias("label"))
    known = cut_lineage(sets.groupBy("c").agg(F.max("n").alias("n")).join(label, "c", "left").select("c", "n", F.coalesce("label", "c").alias("label")))
    rest = cut_lineage(members.filter("m > 2 AND c <> leader").join(known, "c", "left").select("band", "key", "c", "n", "label"))
    several = (rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                                               F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
               .filter("lo <> hi").groupBy("m", "n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")))  # equal buckets once, in their first band
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("n") / BLOCK_SHINGLES))
    wide = (rest.drop("n").join(several.select(F.col("b.band").alias("band"), F.col("b.key").alias("key"), blocks.alias("nb")), ["band", "key"])
            .withColumn("blk", F.pmod(F.xxhash64("c", F.lit(2)), "nb")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
            .select("band", "key", "c", "label", "blk", F.least("blk", "other").alias("g1"), F.greatest("blk", "other").alias("g2")))
    second = wide.join(sets, "c").groupBy("key", "g1", "g2").applyInArrow(_blocks(percent), _EMPTY)

    linked = components(first.unionByName(second))
    lowest = linked.join(classes.select("fp", "first_id"), "fp").groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = classes.select("fp", "first_id").join(linked.join(lowest, "label").select("fp", "label", "component_id"), "fp", "left").select(
        "fp", F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = signed.select("doc_id", "fp", F.col("n").alias("n_shingles")).join(found, "fp", "left").withColumn(
        "component_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns. Rows without an id stay; of rows equal in id and text one does."""
    judged = cut_lineage(groups(docs, width, percent).filter("doc_id IS NOT NULL"))
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    out = docs.join(gone.filter("NOT kept").select("doc_id"), "doc_id", "left_anti")
    again = cut_lineage(gone.filter("kept AND rows > 1").select("doc_id"))
    if again.isEmpty():
        return out.select(*docs.columns)
    single = out.join(again, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
