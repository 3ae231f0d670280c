"""Operator 9: quality rules as a short-circuit cascade, in DataFrame functions only.

A rule has a predicate that is true where the document fails, over features of the text. All rules share the number of words
and of their characters; each makes the other features that it needs itself. On a bounded sample the cost of every rule
(seconds to make its own features and its predicate, less those of an empty pass) and its rejection rate are measured, and
the rules are put in order of rejections per cost. ``filtered`` runs them as a cascade: each rule gets the text of the
documents that passed all rules before it and null for the others, so nothing is counted any more for a document that
has failed. The order changes the work, never the verdict. The base rules (too few words, too many words in repeated
windows) are part of the cascade like all others.

``judged`` is for who wants all counts of all documents: there the counts are made for every row, the base comes first, and only
what the counts don't hold is left to the cascade.

Words are runs without the six ASCII white-space bytes. A repeated window is three successive words found twice or more
in the text. Windows are compared by two independent hashes, each packed with the position into one long and sorted as
primitive arrays: a window counts as repeated if both find it, so chance agreement needs two 43-bit collisions at once.
The position takes as many bits as the number of words needs: a text of 2**21 words or more leaves its hashes one bit
less for each doubling.

Defined cases: null text is a text without words; a document with nothing in it fails the base; texts of any length are
read whole; repeated rows are judged alike; the input's columns are kept as they are and may have any names.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
#: Bits of a position in a text of fewer than 2**21 words.
_POSITION_BITS = 21
SAMPLE_ROWS = 1000

#: Rules of the cascade: SQL predicates that are true where the document fails; ``words`` etc. are the base counts.
RULES: dict[str, str] = {
    "symbols": "n_symbols > 0.15 * word_chars",
    "separators": "4 * n_symbols > n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "5 * regexp_count(text, '[A-Z\u00c0-\u00de]{3,}') > n_words",
    "exclamations": "length(text) - length(replace(text, '!!', '')) > n_words",
}


def _words(text: Column) -> Column:
    """Array of words; empty for a text without any. Plain replacements and a one-character split need no pattern."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: a one-element transform gives it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _position_bits(n: Column) -> Column:
    """Bits that hold every position in a text of ``n`` words."""
    return F.greatest(F.lit(_POSITION_BITS), F.length(F.bin(n)))


def _windows(words: Column, starts: Column, seed: int, bits: Column) -> Column:
    """For each start, the lower bits of its window's hash with the start in ``bits`` bits below them."""
    first = [F.lit(seed)] if seed else []
    return F.transform(starts, lambda i: F.call_function("shiftleft", F.xxhash64(
        *first, F.get(words, i), F.get(words, i + F.lit(1).cast("long")), F.get(words, i + F.lit(2).cast("long"))), bits).bitwiseOR(i))


def _equal_neighbours(s: Column, bits: Column) -> Column:
    """Starts in a sorted packed array whose hash equals a neighbour's."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")
    pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)),
                       lambda a, b: F.when(F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0, F.array(a, b)))
    hits = F.flatten(F.filter(pairs, lambda p: p.isNotNull()))
    return F.array_distinct(F.transform(hits, lambda x: x.bitwiseAND(low)))


def _covered(starts: Column) -> Column:
    """Words in the union of three-word windows at the given starts."""
    def total(s: Column) -> Column:
        steps = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3).cast("long")), F.lit(3).cast("long")))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return _bound(F.sort_array(starts), total).cast("long")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_q``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, text.

    Each step is a column of its own: later steps use it several times, and sorting at the top of a projection is
    compiled for primitive arrays, which sorting inside a lambda isn't. The row mark in the struct is there for its being
    non-deterministic: a filter on the verdict then stays above the counts instead of being written out in terms of them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    zero = F.lit(0).cast("long")

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    n = F.size("_q_words").cast("long")
    bits = F.col("_q_bits")
    out = docs.withColumn("_q_words", _words(t)).withColumn("_q_bits", _position_bits(n))
    out = out.withColumn("_q_sorted", F.sort_array(_windows(F.col("_q_words"), F.when(n >= 4, F.sequence(zero, n - 3)).otherwise(F.array(zero)), 0, bits)))
    out = out.withColumn("_q_first", _equal_neighbours(F.col("_q_sorted"), bits))
    again = _bound(F.sort_array(_windows(F.col("_q_words"), F.col("_q_first"), 1, bits)), lambda s: _equal_neighbours(s, bits))
    out = out.withColumn("_q", F.struct(
        n.alias("n_words"), F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), _bound(lines, of_lines).alias("l"),
        F.when(F.size("_q_first") == 0, zero).otherwise(_covered(again)).alias("n_repeat_words"), t.alias("text"),
        F.monotonically_increasing_id().alias("mark")))
    return out.drop("_q_words", "_q_bits", "_q_sorted", "_q_first").withColumn("_q", F.struct(
        "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.l.n_lines", "_q.l.n_dup_lines", "_q.n_repeat_words", "_q.text"))


def base_failed() -> Column:
    n = F.col("_q.n_words")
    return (n < 50) | (100 * F.col("_q.n_repeat_words") > 50 * n)


def _predicate(sql: str) -> Column:
    """A rule's predicate over the fields of ``_q``; null is no failure."""
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "text")
    out = sql
    for f in fields:
        out = _word_replace(out, f, f"_q.{f}")
    return F.coalesce(F.expr(out), F.lit(False))


def _word_replace(sql: str, name: str, by: str) -> str:
    import re
    return re.sub(rf"(?<![\w.]){name}(?!\w)", by, sql)


#: The base as rules of the cascade.
BASE_RULES: dict[str, str] = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
_SHARED = ("n_words", "word_chars")


def _uses(rule: str, feature: str) -> bool:
    return _word_replace(rule, feature, "") != rule


def _shared(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the text, its words and what all rules share of them; the mark keeps a later filter above these columns."""
    out = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_q_words", _words(F.col("_q_text")))
    return out.withColumn("_q_all", F.struct(F.size("_q_words").cast("long").alias("n_words"), F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
                                             F.monotonically_increasing_id().alias("mark")))


def _step(docs: DataFrame, rule: str, open_: Column) -> tuple[DataFrame, Column]:
    """``docs`` with the features of one rule, made where ``open_`` holds, and the rule's predicate over them."""
    zero = F.lit(0).cast("long")
    text, fields = F.when(open_, F.col("_q_text")), []
    out = docs
    if _uses(rule, "n_repeat_words"):
        n = F.size("_q_open").cast("long")
        bits = F.col("_q_bits")
        out = out.withColumn("_q_open", F.when(open_, F.col("_q_words")).otherwise(F.array().cast("array<string>"))).withColumn("_q_bits", _position_bits(n))
        starts = F.when(n >= 4, F.sequence(zero, n - 3)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn("_q_sorted", F.sort_array(_windows(F.col("_q_open"), starts, 0, bits))).withColumn("_q_first", _equal_neighbours(F.col("_q_sorted"), bits))
        again = _bound(F.sort_array(_windows(F.col("_q_open"), F.col("_q_first"), 1, bits)), lambda s: _equal_neighbours(s, bits))
        out = out.withColumn("_q_repeats", F.when(F.size("_q_first") == 0, zero).otherwise(_covered(again)))
        fields.append(F.col("_q_repeats").alias("n_repeat_words"))
    if _uses(rule, "n_symbols"):
        fields.append(F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    if _uses(rule, "n_lines") or _uses(rule, "n_dup_lines"):
        out = out.withColumn("_q_lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
        fields += [F.size("_q_lines").cast("long").alias("n_lines"), (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines")]
    out = out.withColumn("_q_own", F.struct(text.alias("text"), *fields, F.monotonically_increasing_id().alias("mark")))
    predicate = rule
    for f in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "text"):
        predicate = _word_replace(predicate, f, f"_q_all.{f}" if f in _SHARED else f"_q_own.{f}")
    return out, open_ & F.coalesce(F.expr(predicate), F.lit(False))


def order(docs: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second of a rule's own work, on a sample of at most ``rows`` documents; ties by name."""
    n = docs.count()
    share = max(1, n // rows)
    sample = _shared(docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(share)) == 0).limit(rows), text).cache()
    try:
        size = sample.count()
        if not size:
            return sorted(rules)
        every = F.lit(True)

        def measured(rule: str) -> tuple[int, float]:
            out, failed = _step(sample, rule, every)
            ask = out.select(failed.alias("x")).agg(F.count_if("x").alias("n"))
            took = []
            for _ in range(3):
                began = time.perf_counter()
                found = ask.first()["n"]
                took.append(time.perf_counter() - began)
            return found, min(took)
        empty = measured("n_words < -1")[1]
        rate = {k: (found / size) / max(1e-3, took - empty) for k, p in rules.items() for found, took in [measured(p)]}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda k: (-rate[k], k))


def filtered(docs: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text", sequence: list[str] | None = None) -> DataFrame:
    """``docs`` with ``_failed``: the first rule of the cascade that fails, base rules included, else null."""
    every = {**BASE_RULES, **rules}

    def state(failed: Column) -> Column:
        """The mark is non-deterministic: no step is written out in terms of those before it, and no filter moves below one."""
        return F.struct(failed.alias("failed"), F.monotonically_increasing_id().alias("mark"))
    out = _shared(docs, text).withColumn("_q_state", state(F.lit(None).cast("string")))
    for k in sequence or order(docs, every, text):
        out, failed = _step(out, every[k], F.col("_q_state.failed").isNull())
        out = out.withColumn("_q_state", state(F.when(failed, F.lit(k)).otherwise(F.col("_q_state.failed"))))
    return out.select(*docs.columns, F.col("_q_state.failed").alias("_failed"))


def judged(docs: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text", sequence: list[str] | None = None) -> DataFrame:
    """``docs`` with ``_q``, ``_base_failed``, ``_failed`` (the first rule in the chosen order that fails, else null) and ``_kept``."""
    names = sequence or order(docs, rules, text)
    failed = F.when(base_failed(), "base")
    for k in names:
        failed = failed.when(_predicate(rules[k]), k)
    return (counted(docs, text).withColumn("_base_failed", base_failed()).withColumn("_failed", failed)
            .withColumn("_kept", F.col("_failed").isNull()))
