"""Operator 11: mixing of sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue. Its documents are shuffled by a digest of their content and stand in line twice, so that a small
source can give each document a second time. A document is sent in packets of at most ``packet`` words; a packet's virtual
finish time is the number of the source's words up to its end divided by the source's target. All packets are sorted by
finish time over range partitions and the line is cut where the budget is spent; the packet on the cut gives its first
words. Queues advance in proportion to their targets, so each source's words end within a packet of its target.

Targets: ``share`` times all words, split by weight; a source stops at ``repeats`` times its size and the excess is shared
again by weight among the others. In order of size by weight the level is the largest one that any prefix of stopped
sources gives, so one sorted prefix sum finds it.

A hot source is cut in chunks of its digests, scanned apart, with one row of carry a chunk. Only the packets that
share the range partition of the cut are summed one by one. What a document gives follows from the key of the cut and
its place in the queue alone, so documents are not joined with packets again.

Defined cases: null and empty text has no word, takes part with size 0 and gives 0; a null source is a source of its own, the last in order; rows that repeat
are queued each; a row without id is queued as any other; without any word all targets are 0; an empty table gives an
empty result; other columns are ignored. The digest, and with it the result, does not depend on layout or run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import dense_index, placed, prefix_sum, running_sum
from ..session import cut_lineage, small_side

#: Most words of a packet, and about the most documents of a source that are scanned in one chunk (there are 16 at least).
PACKET, CHUNK = 256, 20_000


def words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sources`` (source, size) with ``place`` (by code point, null last) and ``target``; weights repeat in that order."""
    named = dense_index(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "place").drop("_null")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = named.withColumn("_weight", weight).withColumn("_cap", F.col("size") * repeats).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    both = prefix_sum(s.withColumn("_w", F.col("_weight").cast("long")), ["_ratio", "place"], "_cap", "_stopped")
    both = cut_lineage(prefix_sum(both, ["_ratio", "place"], "_w", "_stopped_weight"))
    # prefix_sum replaces nothing: the inclusive sums of a row stop it and all before it
    all_of = both.agg(F.sum("size").alias("size"), F.sum("_w").alias("w")).first()
    if all_of["size"] is None:
        return both.select("source", "size", "place", F.lit(0.0).alias("target"))
    budget, weight_sum = share * all_of["size"], all_of["w"]
    left = F.lit(weight_sum) - F.col("_stopped_weight")
    level = both.filter(left > 0).agg(F.max((F.lit(budget) - F.col("_stopped")) / left).alias("level")).first()["level"]
    level = max(budget / weight_sum, level if level is not None else 0.0)
    return both.select("source", "size", "place", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight")).alias("target"))


def _packets(size: Column, repeats: int, packet: int) -> Column:
    """(copy, from, words) of every packet of a document in all its copies."""
    per_copy = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / packet).cast("long"))
    one = lambda copy: F.transform(per_copy, lambda i: F.struct(
        F.lit(copy).cast("long").alias("copy"), (i * packet).alias("from"), F.least(F.lit(packet).cast("long"), size - i * packet).alias("words")))
    return F.when(size > 0, F.concat(*[one(c) for c in range(repeats)])).otherwise(F.array().cast("array<struct<copy: bigint, from: bigint, words: bigint>>"))


def mixed(docs: DataFrame, weights: Sequence[int], share: float = 1.5, repeats: int = 2, packet: int = PACKET, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, source, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    slim = cut_lineage(docs.select("doc_id", "source", words().alias("size"), key.alias("key")))
    per_source = cut_lineage(slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    level = cut_lineage(targets(per_source.select("source", "size"), weights, share, repeats))
    total = level.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()["words"]
    budget = math.floor(share * total)

    # place in the queue: prefix sums of shuffled documents, chunk by chunk of the digest
    largest = per_source.agg(F.max("n").alias("n")).first()["n"] or 0
    digits = max(1, math.ceil(math.log(max(1, largest / CHUNK), 16)))
    side = small_side(level.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "place", "target"))
    queued = slim.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_chunk", F.substring("key", 1, digits))
    order = ["key", F.asc_nulls_first("doc_id"), "size"]
    queue = cut_lineage(running_sum(queued, ["place"], "_chunk", order, {"end": F.col("size")}).select(
        "doc_id", "size", "source_size", "place", "target", (F.col("end") - F.col("size")).cast("long").alias("start")))

    def until(p: Column) -> Column:
        return F.col("source_size") * p["copy"] + F.col("start") + p["from"] + p["words"]

    def finish(p: Column) -> Column:
        return until(p).cast("double") / F.col("target")

    # an empty line, or a budget that all of it fits in, has no cut
    line = queue.select("place", "target", "source_size", "start", F.explode(_packets(F.col("size"), repeats, packet)).alias("p")).select(
        finish(F.col("p")).alias("finish"), "place", until(F.col("p")).alias("until"), F.col("p.words").alias("words"))
    cut = _cut(placed(line, ["finish", "place", "until"]), budget)
    if cut is None:
        given = lambda p: p["words"]
    else:
        at = F.struct(F.lit(cut["finish"]).alias("a"), F.lit(cut["place"]).alias("b"), F.lit(cut["until"]).alias("c"))
        here = lambda p: F.struct(finish(p).alias("a"), F.col("place").alias("b"), until(p).alias("c"))
        given = lambda p: F.when(here(p) < at, p["words"]).when(here(p) == at, F.lit(cut["part"])).otherwise(F.lit(0))
    taken = F.aggregate(_packets(F.col("size"), repeats, packet), F.lit(0).cast("long"), lambda acc, p: acc + given(p).cast("long"))
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _cut(line: DataFrame, budget: int) -> dict | None:
    """Key of the packet on which the budget ends, and the words that it still gives; None if the whole line fits."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = line.groupBy("_part").agg(F.sum("words").alias("words"))  # one row a range partition
    crossing = parts.withColumn("_sum", F.sum("words").over(before)).filter(F.col("_sum") > budget).orderBy("_part").limit(1).collect()
    if not crossing:
        return None
    part, spent = crossing[0]["_part"], crossing[0]["_sum"] - crossing[0]["words"]
    inside = W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    row = (line.filter(F.col("_part") == part).withColumn("_sum", F.sum("words").over(inside))
           .filter(F.col("_sum") > budget - spent).orderBy("_pos").limit(1).first())
    return {"finish": row["finish"], "place": row["place"], "until": row["until"], "part": budget - spent - (row["_sum"] - row["words"])}
