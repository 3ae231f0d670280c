"""Operator 3: URL filter by a host-and-path policy and mined association rules, in DataFrame functions only.

The policy comes first. Where none of its rules fits, the method decides: frequent combinations of URL tokens are mined
from labelled URLs by Spark's FP-growth. Frequent tokens that occur in exactly the same labelled URLs are one item there, named by
the smallest of them: k tokens that always come together would give 2^k combinations and say no more than one. Combinations are kept as rules ``tokens -> label`` if their support and confidence reach the bounds,
and matched through an inverted index: a rule is filed under its rarest token, a URL looks up each of its tokens and meets
only rules filed there, and a rule fits if the URL has all of its tokens. The most confident rule wins, then the one with
more items, then more support, then ``block``; without any rule the URL is allowed. A URL has an item if it has any token of it.

Defined cases: a null url, or one without ``://``, has empty host and path and no tokens, and is allowed; so is everything if
there are no labels to mine; repeated rows are judged alike; columns beyond the two that are read are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "label=block", "label=allow"
#: Item of a labelled URL without any frequent token: it counts among all, and no URL is looked up by it.
NOTHING = "-"
#: Least share of labelled URLs that have a combination, and least share of these that have the rule's label.
SUPPORT, CONFIDENCE = 0.005, 0.6


def host_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments, and query parameters, by name and with their value.

    Support and confidence prune them.
    """
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    names = F.transform(pairs, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    values = F.transform(F.filter(pairs, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("query:"), x))
    return F.array_sort(F.array_distinct(F.concat(labels, segments, names, values)))


def policy_rule(host: Column, path: Column, policy: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, ``host/path``), ties to the smaller text; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(policy, key=lambda r: (len(r[1]), tuple(-ord(c) for c in r[1]))):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def contracted(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(token, item) of the frequent tokens of ``labelled`` (items): tokens of exactly the same rows share an item.

    Rows are told apart by two 64-bit sums of random numbers of their ids. At most 1 / ``support`` times the mean number
    of tokens a row are frequent, whatever the number of rows.
    """
    rows = labelled.select("items", F.monotonically_increasing_id().alias("_row"))
    rows = cut_lineage(rows)
    least = F.lit(support * rows.count())
    prints = [F.sum(F.xxhash64("_row", F.lit(k)).cast("decimal(38,0)")).alias(f"_{k}") for k in (1, 2)]
    tokens = rows.select("_row", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_n"), *prints).filter(F.col("_n") >= least)
    names = tokens.groupBy("_n", "_1", "_2").agg(F.min("token").alias("item"))
    return tokens.join(names, ["_n", "_1", "_2"]).select("token", "item")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent, label, confidence, support, token) from ``labelled`` (items, label); ``token`` is the rarest one."""
    baskets = cut_lineage(labelled.filter("label IS NOT NULL AND size(items) > 0").select(F.array_append("items", F.col("label")).alias("items")))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, label string, confidence double, support double, token string")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    alone = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = cut_lineage(model.associationRules.filter(F.col("consequent")[0].isin(BLOCK, ALLOW)).filter(
        ~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW)).select(
        F.array_sort("antecedent").alias("antecedent"), F.col("consequent")[0].alias("label"), "confidence", "support"))
    rarest = (found.select("antecedent", F.explode("antecedent").alias("token")).join(alone, "token")
              .groupBy("antecedent").agg(F.min(F.struct("freq", "token")).alias("_r")).select("antecedent", F.col("_r.token").alias("token")))
    return found.join(rarest, "antecedent").select("antecedent", "label", "confidence", "support", "token")


def renamed(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``sets`` (items) with ``held``, the items that ``names`` (token, item) gives for its tokens; null without any."""
    held = sets.select("items", F.explode("items").alias("token")).join(names, "token").groupBy("items").agg(F.array_sort(F.collect_set("item")).alias("held"))
    return sets.join(held, "items", "left")


def matched(sets: DataFrame, rules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """items, best (confidence, n, support, label) of every token set that some rule fits; ``names`` as ``contracted`` gives them."""
    index = small_side(rules)
    if names is None:
        held = sets.select("items", F.col("items").alias("held"))
    else:
        held = renamed(sets.select("items"), names).filter("held IS NOT NULL")
    hit = held.select("items", "held", F.explode("held").alias("token")).join(index, "token").filter(F.size(F.array_except("antecedent", "held")) == 0)
    return hit.groupBy("items").agg(F.max(F.struct("confidence", F.size("antecedent").alias("n"), "support", "label")).alias("best"))


def judged(pages: DataFrame, labels: DataFrame, policy: Sequence[tuple[str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) names pages by id. A URL that the policy judges teaches the policy's verdict; any
    other teaches ``block`` if its page is labelled of low quality or toxic, ``allow`` if it is labelled otherwise.
    """
    host, path = host_path()
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("items", tokens(F.col("host"), F.col("path"), F.col("url")))
    rule, verdict = policy_rule(F.col("host"), F.col("path"), policy)
    rows = cut_lineage(rows.select("page_id", "host", "path", "items", rule.alias("rule"), verdict.alias("_verdict")))
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg((F.coalesce(F.min("quality"), F.lit(1)) == 0).alias("_low"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("_toxic"))
    taught = F.when(F.col("_verdict") == "block", BLOCK).when(F.col("_verdict") == "allow", ALLOW).when(F.col("_low") | F.col("_toxic"), BLOCK).when(F.col("_low").isNotNull(), ALLOW)
    labelled = cut_lineage(rows.join(bad, "page_id", "left").select("items", taught.alias("label")).filter("label IS NOT NULL AND size(items) > 0"))
    names = small_side(contracted(labelled, support))
    counted = labelled.groupBy("items", "label").agg(F.count(F.lit(1)).alias("_n"))  # equal baskets meet the names once
    baskets = counted.join(renamed(counted.select("items").distinct(), names), "items").select(
        F.coalesce("held", F.array(F.lit(NOTHING))).alias("items"), "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    rules = mine(baskets.select("items", "label"), support, confidence)
    best = matched(rows.filter("rule IS NULL").select("items").distinct(), rules, names)
    method = F.when(F.col("best.label") == BLOCK, "block").otherwise("allow")
    return rows.join(best, "items", "left").select("page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"),
                                                    F.when(F.col("rule").isNull(), F.col("best.confidence")).alias("confidence"))
