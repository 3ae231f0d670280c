"""Deterministic draws, condition support, shard plans: keyed by content, never by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as H
from .manifest import union_all, violation
from .ordered import dense_index, hashed_index, placed, running_last, running_sum

CANONICAL = ("t0_utc", "lead_hours", "condition_signature")
EXACT = "decimal(28,26)"  # probabilities are summed exactly, so the answer does not depend on partitioning
META = ("t0_utc", "lead_hours", "condition_signature", "block_id", "stratum", "split", "fold_id")


def prefix_cdf(cands: DataFrame, order=CANONICAL, p: str = "p_draw") -> DataFrame:
    """WN07: half-open interval [cdf_lo, cdf_hi) per candidate; the last one ends at exactly 1.

    Probabilities that don't sum to one (to 1e-9) are an error of the job: no candidate may take the rest in silence.
    """
    base = placed(cands.withColumn("_p", F.col(p).cast(EXACT)), list(order))
    cum = running_sum(base, [], "_part", ["_pos"], {"_hi": F.col("_p")})
    total = base.agg(F.sum("_p").alias("_total"))  # one row
    wrong = F.raise_error(F.concat(F.lit(f"{p} sums to "), F.coalesce(F.col("_total").cast("string"), F.lit("nothing")), F.lit(", not to 1"))).cast("double")
    off = F.coalesce(F.abs(F.col("_total").cast("double") - 1) > 1e-9, F.lit(True))
    lo = F.when(off, wrong).otherwise((F.col("_hi") - F.col("_p")).cast("double"))
    hi = F.when(off, wrong).when(F.col("_hi") >= F.col("_total"), F.lit(1.0)).otherwise(F.col("_hi").cast("double"))
    return (cum.join(F.broadcast(total)).withColumn("cdf_lo", lo).withColumn("cdf_hi", hi)
            .drop("_p", "_hi", "_part", "_pos", "_total"))


def draw_from_cdf(cands: DataFrame, draws: int, seed: int, purpose: str, order=CANONICAL) -> DataFrame:
    """JN16: draws with replacement. Each index has its own uniform; the first cumulative above it wins.

    Uniforms and interval starts go through one global order; a draw's candidate is the last start at or before it, carried
    along the line from part to part. No list is built for a heavy candidate and nothing is joined on it: its draws lie
    in as many range parts as they fill.
    """
    kept = [c for c in cands.columns if c != "omega"]
    cdf = prefix_cdf(cands, order)
    start = cdf.select(F.col("cdf_lo").alias("_v"), F.lit(0).alias("_kind"),
                       F.lit(None).cast("long").alias("global_example_index"), F.struct(*kept).alias("_c"))
    u = cands.sparkSession.range(draws).select(F.col("id").alias("global_example_index"))
    drawn = u.select(H.hash_uniform(seed, purpose, F.col("global_example_index")).alias("_v"), F.lit(1).alias("_kind"), "global_example_index",
                     F.lit(None).cast(start.schema["_c"].dataType).alias("_c"))
    line = placed(start.unionByName(drawn), ["_v", "_kind", "global_example_index"])
    hit = running_last(line, [], "_part", "_pos", {"_c": F.col("_c")}).filter("_kind = 1")
    return (hit.select("global_example_index", "_c.*").withColumn("omega", F.col("p_target") / F.col("p_draw"))
            .select("global_example_index", *kept, "omega"))


def hash_shuffle(cands: DataFrame, seed: int, purpose: str) -> DataFrame:
    """SO01: every candidate once, ordered by the digest of its id; p_draw = 1/N, omega = 1.

    That is right for an item-uniform target only: a given ``p_target`` that isn't uniform is an error of the job.
    """
    known = "p_target" in cands.columns
    spread = [F.min("p_target").alias("_lo"), F.max("p_target").alias("_hi")] if known else []
    n = cands.agg(F.count(F.lit(1)).alias("_n"), *spread)  # one row
    one = F.lit(1.0)
    if known:
        uneven = F.coalesce(F.isnan("_hi") | (F.col("_hi") - F.col("_lo") > 1e-12), F.lit(True))
        one = F.when(uneven, F.raise_error(F.lit("a full shuffle needs an item-uniform p_target")).cast("double")).otherwise(one)
    keyed = cands.withColumn("_key", H.shuffle_key(seed, purpose, F.col("sample_id")))
    ordered = hashed_index(keyed, "_key", "sample_id", "global_example_index").drop("_key")
    return (ordered.join(F.broadcast(n)).withColumn("p_draw", F.lit(1.0) / F.col("_n"))
            .withColumn("omega", one).drop("_n", *(["_lo", "_hi"] if known else [])))


def prefix(draws: DataFrame, n: int) -> DataFrame:
    """SO02: first n of a fixed sequence; a filter, not a global limit."""
    return draws.filter(F.col("global_example_index") < n)


def rank_shard(rows: DataFrame, rank: int, world: int, idx: str = "global_example_index") -> DataFrame:
    """SO04."""
    return rows.filter(F.pmod(F.col(idx), F.lit(world)) == rank)


def shard_plan(draws: DataFrame, world: int, micro: int, accum: int, epochs: int,
               idx: str = "global_example_index") -> DataFrame:
    """SO03: (epoch, step, accumulation, rank, slot) of every row; the tail is padded by empty slots.

    ``idx`` must be dense. The padding is shorter than one synchronized step.
    """
    width = world * micro * accum
    n = draws.agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_padded", F.ceil(F.col("_n") / width) * width)  # one row
    pad = n.filter("_padded > _n").select(F.explode(F.sequence(F.col("_n"), F.col("_padded") - 1)).alias("position"),
                                          F.lit(None).cast("long").alias("row_index"))
    flat = draws.select(F.col(idx).alias("position"), F.col(idx).alias("row_index")).unionByName(pad)

    def div(a, b):
        return F.call_function("div", a, F.lit(b))

    pos = F.col("position")
    inside = F.pmod(pos, F.lit(width))
    return (flat.join(F.broadcast(n)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
            .select("epoch", div(pos, width).alias("step"), div(inside, world * micro).alias("accumulation"),
                    div(F.pmod(inside, F.lit(world * micro)), micro).alias("rank"), F.pmod(pos, F.lit(micro)).alias("slot"),
                    (pos + F.col("epoch") * F.col("_padded")).alias("logical_position"), "row_index"))


# --- condition support ----------------------------------------------------------------------------------
def _entries(policy) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("sig"), F.lit(t).alias("pt"), F.lit(d).alias("pd")) for s, t, d in policy])


def _null_entry(null_sig: str) -> Column:
    return F.array(F.struct(F.lit(null_sig).alias("sig"), F.lit(1.0).alias("pt"), F.lit(1.0).alias("pd")))


def _with_entry(df: DataFrame) -> DataFrame:
    e = F.col("_e")
    return (df.withColumn("condition_signature", e["sig"]).withColumn("p_target", F.col("p_target") * e["pt"])
            .withColumn("p_draw", F.col("p_draw") * e["pd"]).withColumn("omega", F.col("p_target") / F.col("p_draw"))
            .withColumn("sample_id", H.sample_id(F.col("t0_utc"), F.col("lead_hours"), F.col("condition_signature")))
            .drop("_e"))


def expand_support(items: DataFrame, policy, null_sig: str) -> DataFrame:
    """JN17: training items times the policy (a literal of a few entries, no join); all others untouched, also without a split."""
    train = F.coalesce(F.col("split") == "outer_train", F.lit(False))
    entries = F.when(F.col("condition_signature") == null_sig, _null_entry(null_sig)).otherwise(_entries(policy))
    wide = _with_entry(items.filter(train).withColumn("_e", F.explode(entries)))
    return wide.select(*items.columns).unionByName(items.filter(~train))


def materialize_signatures(draws: DataFrame, policy, null_sig: str, seed: int, purpose: str) -> DataFrame:
    """JN18: one signature per draw from its own hash namespace; the policy CDF is a CASE expression."""
    u = H.hash_uniform(seed, purpose, F.col("global_example_index"))
    pick, cum = F.lit(len(policy)), 0.0
    cuts = []
    for i, (_, _, d) in enumerate(policy):
        cum += d
        cuts.append((i + 1, cum if i + 1 < len(policy) else 1.0))
    for i, c in reversed(cuts):
        pick = F.when(F.col("_u") < c, F.lit(i)).otherwise(pick)
    entry = F.when(F.col("condition_signature") == null_sig, F.element_at(_null_entry(null_sig), 1)).otherwise(
        F.element_at(_entries(policy), pick))
    return _with_entry(draws.withColumn("_u", u).withColumn("_e", entry).drop("_u")).select(*draws.columns)


def validate_provenance(base: DataFrame, augmented: DataFrame, policy, null_sig: str, seed: int, purpose: str) -> DataFrame:
    """JN28: rows of the re-derived draws that differ from the given ones, either way."""
    again = materialize_signatures(base, policy, null_sig, seed, purpose)
    cols = augmented.columns
    gone = again.select(*cols).exceptAll(augmented).withColumn("side", F.lit("missing"))
    extra = augmented.exceptAll(again.select(*cols)).withColumn("side", F.lit("unexpected"))
    return gone.unionByName(extra)


def audit_draw_membership(draws: DataFrame, cands: DataFrame, tol: float = 1e-12) -> DataFrame:
    """JN19: draws without a candidate, or with other metadata or weights.

    Repeats of a draw are folded first, so a hot candidate meets its row once.
    """
    facts = draws.groupBy("sample_id", *META, "p_target", "p_draw", "omega").agg(F.count(F.lit(1)).alias("draws"))
    want = cands.select(F.col("sample_id").alias("_id"), *[F.col(c).alias(f"c_{c}") for c in (*META, "p_target", "p_draw", "omega")])
    j = facts.join(want, facts["sample_id"] == want["_id"], "left")
    meta_bad = ~sum((F.col(c).eqNullSafe(F.col(f"c_{c}")).cast("int") for c in META), F.lit(0)).eqNullSafe(F.lit(len(META)))
    far = sum((F.coalesce((F.abs(F.col(c) - F.col(f"c_{c}")) > tol) | F.isnan(c), F.lit(True)).cast("int") for c in ("p_target", "p_draw", "omega")), F.lit(0)) > 0
    rule = (F.when(F.col("_id").isNull(), "not_a_candidate").when(meta_bad, "metadata").when(far, "weights"))
    return j.withColumn("rule", rule).filter("rule is not null").select("rule", "sample_id", "draws")


def reconcile_fold(draws: DataFrame, by_signature: DataFrame, by_id: DataFrame) -> DataFrame:
    """JN24: own fold, else the fold of (id, signature), else of the id; ``conflict`` marks disagreement."""
    a = by_signature.select("sample_id", "condition_signature", F.col("fold_id").alias("_a"))
    b = by_id.select("sample_id", F.col("fold_id").alias("_b"))
    j = draws.join(a, ["sample_id", "condition_signature"], "left").join(b, "sample_id", "left")
    mapped = F.coalesce("_a", "_b")
    return (j.withColumn("conflict", F.coalesce(F.col("fold_id") != mapped, F.lit(False)))
            .withColumn("fold_id", F.coalesce(F.col("fold_id"), mapped)).drop("_a", "_b"))


def fold_lineage(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """JN29: rows not scored exactly once by the checkpoint of their own fold."""
    scored = rows.join(checkpoints, "fold_id", "left").groupBy("sample_id", "fold_id").agg(
        F.count("checkpoint").alias("n"))
    return scored.filter("n <> 1")


# --- reports --------------------------------------------------------------------------------------------
def draw_multiplicity(draws: DataFrame) -> DataFrame:
    """AG20: distinct semantic keys with count and first position; ``stable`` if metadata never changes."""
    meta = F.struct("sample_id", "block_id", "stratum", "split", F.coalesce("fold_id", F.lit(-1)))
    return draws.groupBy(*CANONICAL).agg(
        F.count(F.lit(1)).alias("multiplicity"), F.min("global_example_index").alias("first_index"),
        (F.min(meta) == F.max(meta)).alias("stable"))


def dense_budget(draws: DataFrame, height: int, width: int, fields: int = 2, bytes_per_value: int = 4) -> DataFrame:
    """AG21."""
    cell = height * width * fields * bytes_per_value
    return draws.select(*CANONICAL).distinct().agg(F.count(F.lit(1)).alias("unique_items"),
                                                   (F.count(F.lit(1)) * cell).alias("dense_bytes"))


def signature_report(draws: DataFrame) -> DataFrame:
    """AG23."""
    once = draws.groupBy("condition_signature", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("block_id") != F.max("block_id")).alias("bad"))
    return once.groupBy("condition_signature").agg(F.sum("n").alias("draws"), F.count(F.lit(1)).alias("unique_items"),
                                                   F.count_if("bad").alias("conflicts"))


def draw_violations(draws: DataFrame) -> DataFrame:
    """SC08 / VA02 row and table rules of a draw manifest; what is null or not a number breaks its rule, and so does an empty manifest."""
    c = F.col

    def bad(x):
        return x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))

    dup = draws.groupBy("global_example_index").count().filter("count > 1")
    span = draws.agg(F.count(F.lit(1)).alias("n"), F.min("global_example_index").alias("a"), F.max("global_example_index").alias("b"))
    return union_all([
        violation(draws.filter(bad(c("p_target")) | bad(c("p_draw"))), "probability", c("global_example_index")),
        violation(draws.filter(F.coalesce(F.isnan("omega") | (F.abs(c("omega") - F.try_divide(c("p_target"), c("p_draw"))) > 1e-12 * F.greatest(F.lit(1.0), F.abs(c("omega")))), F.lit(True))),
                  "omega", c("global_example_index")),
        violation(draws.filter("global_example_index is null"), "index_missing", c("sample_id")),
        violation(span.filter("n = 0"), "empty", F.lit("manifest")),
        violation(draws.filter("fold_id < 0"), "fold", c("global_example_index")),
        violation(dup, "duplicate_index", c("global_example_index"), c("count")),
        violation(span.filter("n > 0 and (a <> 0 or b <> n - 1)"), "dense_index", c("n"), F.concat_ws("..", "a", "b")),
    ])


def _draw_rules(cands: DataFrame) -> list[DataFrame]:
    """Rules of the draw probabilities of candidates: each in (0, 1], and one in sum."""
    c = F.col("p_draw")
    fine = F.when(c.between(0, 1), c.cast(EXACT))
    total = cands.agg(F.sum(fine).alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 0")  # that there are none is said once
    return [violation(cands.filter(fine.isNull() | (c <= 0) | F.isnan(c)), "draw_probability", F.col("sample_id")),
            violation(total.filter("coalesce(abs(s - 1) > 1e-12, true)"), "draw_sum", F.coalesce(F.col("s").cast("string"), F.lit("none")))]


def candidate_violations(cands: DataFrame) -> DataFrame:
    """VA02 for candidates; with a column ``p_draw`` its rules too."""
    c = F.col
    ident = cands.groupBy(*CANONICAL).count().filter("count > 1")
    ids = cands.groupBy("sample_id").count().filter("count > 1")
    plain = F.when(c("p_target").between(0, 1), c("p_target").cast(EXACT))  # others have a rule of their own and can't be cast
    odd = ~plain.isNotNull()
    total = cands.agg(F.sum(plain).alias("s"))
    rules = [] if "p_draw" not in cands.columns else _draw_rules(cands)
    return union_all([
        *rules,
        violation(ids, "duplicate_sample_id", c("sample_id"), c("count")),
        violation(ident, "duplicate_identity", F.concat_ws("|", *CANONICAL), c("count")),
        violation(cands.filter(odd | (c("p_target") <= 0) | F.isnan("p_target")), "probability", c("sample_id")),
        violation(cands.filter("fold_id < 0"), "fold", c("sample_id")),
        violation(total.filter("coalesce(abs(s - 1) > 1e-12, true)"), "target_sum", F.coalesce(c("s").cast("string"), F.lit("none"))),
    ])


# --- order ----------------------------------------------------------------------------------------------
def batch_by_issue(draws: DataFrame, size: int, idx: str = "global_example_index") -> DataFrame:
    """WN11: rows of one (t0, signature) stay together, by lead, cut in batches; groups in first-seen order.

    A group may hold any share of the draws: positions come from a global index, not from a group window.
    """
    key = ["t0_utc", "condition_signature"]
    groups = draws.groupBy(*key).agg(F.min(idx).alias("_first"), F.count(F.lit(1)).alias("_n"))
    g = placed(groups, ["_first"])
    batches = F.ceil(F.col("_n") / size)
    g = g.withColumn("_b", batches)
    g = running_sum(g.withColumn("_off", F.col("_n")).withColumn("_boff", F.col("_b")), [], "_part", ["_pos"],
                    {"_off": F.col("_n"), "_boff": F.col("_b")}, inclusive=False)
    rows = draws.join(g.select(*key, "_first", "_off", "_boff"), key)
    placed_rows = dense_index(rows, ["_first", "lead_hours", idx], "_at")
    inside = F.col("_at") - F.col("_off")
    return placed_rows.select(
        idx, *key, "lead_hours", (F.col("_boff") + F.floor(inside / size)).cast("long").alias("batch"),
        F.pmod(inside, F.lit(size)).cast("long").alias("place"))


def subset_year(draws: DataFrame, year: int, idx: str = "global_example_index") -> DataFrame:
    """PR38: one issue year, re-indexed densely in the original order; the source position is kept."""
    return dense_index(draws.filter(F.year("t0_utc") == year).withColumnRenamed(idx, "source_index"), ["source_index"], idx)


def grouped_quantiles(df: DataFrame, by, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group without holding a group in one task.

    Values are folded to counts, placed in one global order, and each quantile reads the two rows that cover
    its rank.
    """
    by = [by] if isinstance(by, str) else list(by)
    clean = df.filter(F.col(value).isNotNull())
    counts = clean.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    base = placed(counts, [*by, "_v"])
    cum = running_sum(base.withColumn("_cum", F.col("_c")), by, "_part", ["_pos"], {"_cum": F.col("_c")})
    total = base.groupBy(*by).agg(F.sum("_c").alias("_n"))
    j = cum.join(total, by) if by else cum.join(F.broadcast(total))  # one row without groups
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum"))
            out.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    picked = j.groupBy(*by).agg(F.max("_n").alias("n"), *out)
    cols = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*by, "n", *cols)


def weight_report(draws: DataFrame) -> DataFrame:
    """AG22: range, quantiles and effective size of the importance weights."""
    q = grouped_quantiles(draws, [], "omega", {"median": 0.5, "p95": 0.95})
    s = draws.agg(F.min("omega").alias("min"), F.max("omega").alias("max"),
                  (F.sum("omega") * F.sum("omega") / F.sum(F.col("omega") * F.col("omega"))).alias("ess"))
    return s.join(F.broadcast(q))  # one row each
