"""Contracts as violation tables (rule, key, detail): all bad rows at once, not the first one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signature as SG
from ..functions.values import FUTURE_NAMES, MAX_RATE
from .manifest import union_all, violation
from .splits import PRIORITY


class ContractError(ValueError):
    """A contract is broken; the message shows a few of the rows."""


def require_clean(violations: DataFrame, show: int = 5) -> None:
    bad = violations.limit(show).collect()
    if bad:
        raise ContractError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}" for r in bad))


def condition_columns(df: DataFrame, names) -> DataFrame:
    """PR29: project condition columns; names that only exist after the issue time are refused while planning."""
    def plain(n):
        return "_".join(n.strip().lower().replace("-", "_").split())
    bad = sorted({n for n in names if plain(n) in FUTURE_NAMES})
    if bad or len({plain(n) for n in names}) != len(list(names)):
        raise ContractError(f"not condition columns: {bad or 'repeated names'}")
    return df.select(*names)


def split_violations(splits: DataFrame) -> DataFrame:
    """VA01: splits (name, start, end); at most a few rows by contract."""
    c = F.col
    nxt = F.lead("start").over(W.orderBy("start", "end"))
    names = splits.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return union_all([
        violation(splits.filter(~c("name").isin(*PRIORITY)), "unknown_name", c("name")),
        violation(splits.filter(c("start") >= c("end")), "empty", c("name")),
        violation(names, "duplicate_name", c("name"), c("n")),
        violation(splits.withColumn("_n", nxt).filter(c("_n") < c("end")), "overlap", c("name"), c("_n"))])


def policy_violations(policy: DataFrame, source: str, tp_off: str, null_sig: str, strategy: str = "matched_arm") -> DataFrame:
    """VA03: policy (signature, p_target, p_draw), a handful of rows.

    Null, NaN and infinite probabilities break their rule, and a sum that they leave undefined its own. Every access mode of an
    entry with a source must have it with and without tp. ``matched_arm`` allows the source's access mode only;
    ``full_with_target_end_causal_augmentation`` asks for a full-trajectory source and exactly the full and the causal mode.
    """
    c = F.col
    total = policy.agg(F.sum("p_target").alias("t"), F.sum("p_draw").alias("d"), F.collect_set("signature").alias("s"))
    need = F.array(F.lit(source), F.lit(tp_off), F.lit(null_sig))
    other = (SG.provider(c("signature")) != source.split(":")[0]) & (c("signature") != null_sig)
    def bad(x):
        return x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))
    f = SG.fields(c("signature"))
    present = policy.filter(SG.is_canonical(c("signature")) & f["era"]).select(f["access"].alias("access"), f["tp"].alias("tp"))
    modes = present.groupBy("access").agg(F.count_distinct("tp").alias("states"))
    access = source.rsplit(":", 1)[-1]
    allowed = {"matched_arm": [access], "full_with_target_end_causal_augmentation": ["full_trajectory", "target_end_causal"]}.get(strategy)
    if allowed is None:
        raise ValueError(f"unknown access strategy {strategy}")
    have = modes.agg(F.collect_set("access").alias("have"))  # at most as many as there are modes
    missing = F.array_except(F.array(*[F.lit(m) for m in allowed]), "have")
    strategies = [violation(modes.filter(~c("access").isin(*allowed)), "access_strategy", c("access"), "not allowed"),
                  violation(have.select(F.explode(missing).alias("m")), "access_strategy", c("m"), "missing")]
    if strategy != "matched_arm" and access != "full_trajectory":
        strategies.append(violation(total, "access_strategy", F.lit(source), "source"))
    return union_all([
        *strategies,
        violation(modes.filter("states < 2"), "tp_pair", c("access")),
        violation(policy.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_signature", c("signature"), c("n")),
        violation(policy.filter(bad(c("p_target")) | bad(c("p_draw"))), "probability", c("signature")),
        violation(policy.filter(~SG.is_canonical(c("signature"))), "not_canonical", c("signature")),
        violation(policy.filter(other), "provider_switch", c("signature")),
        violation(total.filter("coalesce(isnan(t) or abs(t - 1) > 1e-12, true)"), "target_sum", F.lit("policy")),
        violation(total.filter("coalesce(isnan(d) or abs(d - 1) > 1e-12, true)"), "draw_sum", F.lit("policy")),
        violation(total.select(F.explode(F.array_except(need, "s")).alias("m")), "missing_entry", c("m"))])


def value_violations(df: DataFrame, key: str, normalized: str | None = None, rate: str | None = None, valid: str = "valid") -> DataFrame:
    """VA04: normalized values in [0,1], rates in [0, max], finite where valid; one pass over the rows."""
    rules = []

    def finite(c):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    if normalized:
        rules.append(F.when(F.col(valid) & ~finite(normalized), "not_finite").when((F.col(normalized) < 0) | (F.col(normalized) > 1), "normalized_range"))
    if rate:
        rules.append(F.when(F.col(valid) & ~finite(rate), "rate_not_finite").when(F.col(rate) < 0, "negative_rate")
                     .when(F.col(rate) > MAX_RATE * (1 + 1e-6), "rate_above_maximum"))
    d = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    return d.select("rule", "key", F.lit("").alias("detail"))
