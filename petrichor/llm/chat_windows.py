"""Operator 4: chat formatting in budgeted windows, in DataFrame functions only.

A turn is ``<turn ROLE>``, a line end, its text, ``</turn>`` and a line end. Inside roles and texts a backslash becomes
``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no text can hold a mark, and reading back undoes it.

Token prefix sums of a conversation place its turns on a line that is cut every ``span`` tokens; the turns that lie in one
piece are a span, and a turn that crosses a cut is a span of its own. A window is the conversation's system turn (if the
first turn is one), then up to ``history`` turns before the span with at most ``history_tokens`` tokens, then the span. Only the
span's assistant texts are under the loss mask, so each is a target once, and what is repeated is masked.

Positions and prefix sums come from chunks of the turn numbers (``ordered.running_sum``), so a conversation of any length
is spread over tasks; a window holds a bounded number of turns, as each counts at least ``TURN_TOKENS``.

Defined cases: null texts and roles are empty; turns are ordered by number (nulls first), then role, then text, so repeated
rows and ties are all kept, next to each other; rows without conv_id form one conversation; only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from ..session import cut_lineage

SPAN, HISTORY, HISTORY_TOKENS, TURN_TOKENS, CHUNK = 1024, 2, 512, 4, 128
_MARK, _END = "<turn ", "</turn>\n"


def escaped(x: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescaped(x: Column) -> Column:
    for raw, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def placed(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """key, conv_id, pos (from 1), role, text, at (tokens before it), tokens, span number."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), "turn", role.alias("role"), text.alias("text"),
                        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("chunk"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")).cast("long") + TURN_TOKENS)
    rows = rows.withColumn("_own", F.col("tokens"))
    rows = running_sum(rows, "key", "chunk", [F.col("turn").asc_nulls_first(), "role", "text"], {"pos": F.lit(1).cast("long"), "upto": F.col("tokens")})
    at = F.col("upto") - F.col("_own")
    first, last = F.floor(at / span), F.floor((F.col("upto") - 1) / span)
    return rows.select("key", "conv_id", "pos", "role", "text", at.alias("at"), F.col("_own").alias("tokens"), (2 * first + (first != last).cast("int")).alias("span"))


def formatted(turns: DataFrame, span: int = SPAN, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """key, conv_id, span, formatted, loss (array of start and length in characters), n_repeated (leading turns shown before)."""
    rows = cut_lineage(placed(turns, span))
    retained = (F.col("pos") == 1) & (F.col("role") == "system")
    head = rows.groupBy("key", "span").agg(F.min(F.when(~retained, F.struct("pos", "at"))).alias("f"))
    system = rows.filter(retained).select("key", "pos", "role", "text", F.col("span").alias("_home"))
    parts = ("key", "span", "kind", "again", "pos", "role", "text")
    own = rows.filter(~retained).withColumn("kind", F.lit(2)).withColumn("again", F.lit(False)).select(*parts)
    asked = (head.filter("f IS NOT NULL").select("key", "span", F.col("f.at").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(history))).alias("_back"), F.col("f.pos").alias("_pos"))
             .select("key", "span", "_from", (F.col("_pos") - F.col("_back")).alias("pos")).filter("pos >= 1"))
    before = (asked.join(rows.filter(~retained).select("key", "pos", "role", "text", "at"), ["key", "pos"]).filter(F.col("_from") - F.col("at") <= history_tokens)
              .withColumn("kind", F.lit(1)).withColumn("again", F.lit(True)).select(*parts))
    top = (head.select("key", "span").join(system, "key").withColumn("kind", F.lit(0)).withColumn("again", F.col("span") != F.col("_home")).select(*parts))
    every = own.unionByName(before).unionByName(top) if history else own.unionByName(top)
    block = F.concat(F.lit(_MARK), escaped(F.col("role")), F.lit(">\n"), escaped(F.col("text")), F.lit(_END))
    every = every.withColumn("block", block).withColumn("size", F.length("block"))
    ahead = Window.partitionBy("key", "span").orderBy("kind", "pos").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("start", F.coalesce(F.sum("size").over(ahead), F.lit(0)) + F.length(F.lit(_MARK)) + F.length(escaped(F.col("role"))) + 2)
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    windows = every.groupBy("key", "span").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "pos", "block"))), lambda x: x["block"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(target, F.struct("start", F.length(escaped(F.col("text"))).alias("length"))))).alias("loss"),
        F.count_if("again").alias("n_repeated"))
    return windows.withColumn("conv_id", F.when(F.col("key") != "null", F.col("key").cast("long"))).select("key", "conv_id", "span", "formatted", "loss", "n_repeated")


def turns_of(window: str = "formatted", skip: str = "n_repeated") -> Column:
    """Array of (role, text) that a window shows for the first time, read from its text."""
    blocks = F.filter(F.split(window, "</turn>\n", -1), lambda b: b != "")
    fresh = F.slice(blocks, F.col(skip).cast("int") + 1, F.greatest(F.size(blocks), F.lit(1)))
    return F.transform(fresh, lambda b: F.struct(
        unescaped(F.regexp_extract(b, r"(?s)^<turn ([^>]*)>\n(.*)$", 1)).alias("role"), unescaped(F.regexp_extract(b, r"(?s)^<turn ([^>]*)>\n(.*)$", 2)).alias("text")))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the windows.

    A digest covers a whole conversation, so its text meets in one row here; the formatting itself never needs that.
    """
    read = windows.withColumn("_t", turns_of()).select(
        "key", "conv_id", "span", F.size("_t").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"]))), "").alias("target"))
    whole = read.groupBy("key", "conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                               F.array_sort(F.collect_list(F.struct("span", "said", "target"))).alias("_w"))
    said, target = F.array_join("_w.said", ""), F.array_join("_w.target", "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"),
                        F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
