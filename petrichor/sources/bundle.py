"""Training bundles in one call: audit, draw, budget, publication, and their augmentation by condition policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..operators.sets import combine_support, draw_candidates, empty_split
from ..operators.validate import ContractError, policy_violations, require_clean
from ..session import cut_lineage
from .publish import publish_bundle


def _draws(cands: DataFrame, draws: int | None, seed: int, purpose: str) -> DataFrame:
    """``draws`` draws with replacement, or every candidate once in hashed order where ``draws`` is None."""
    made = SA.hash_shuffle(cands, seed, purpose) if draws is None else SA.draw_from_cdf(cands, draws, seed, purpose)
    made = cut_lineage(made)
    require_clean(SA.draw_violations(made))
    return made


def _published(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """All tables or none; what is returned is read back from the published files and has as many rows as were written."""
    counts = {r["tbl"]: r["rows"] for r in publish_bundle(spark, tables, path).collect()}  # one row a table
    if set(counts) != set(tables):
        raise ContractError(f"published {sorted(counts)}, not {sorted(tables)}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in tables}


def build_training_bundle(index: DataFrame, items: DataFrame, path: str, split: str, seed: int, purpose: str, draws: int | None,
                          shape: tuple[int, int], max_dense_bytes: int) -> dict[str, DataFrame]:
    """IT07: index, candidates, draws and a budget row, published together.

    ``items`` holds sampler columns with p_target, p_draw and omega. The candidates of ``split`` are audited, drawn (with
    replacement, or each once), the draws are audited against them, the dense size of the distinct items is held against
    ``max_dense_bytes``, and only then is anything written. A broken rule raises ``ContractError``.
    """
    spark = index.sparkSession
    require_clean(empty_split(items, split))
    cands = cut_lineage(draw_candidates(items, split).join(items.filter(F.col("split") == split).select("sample_id", "p_draw", "omega"), "sample_id"))
    require_clean(SA.candidate_violations(cands))
    made = _draws(cands, draws, seed, purpose)
    if draws is not None:
        require_clean(SA.audit_draw_membership(made, cands).select("rule", F.col("sample_id").alias("key"), F.col("draws").cast("string").alias("detail")))
    changed = SA.draw_multiplicity(made).filter(~F.coalesce("stable", F.lit(False)))
    require_clean(changed.select(F.lit("unstable").alias("rule"), F.col("t0_utc").cast("string").alias("key"), F.lit("").alias("detail")))
    budget = cut_lineage(SA.dense_budget(made, *shape))
    size = budget.first()["dense_bytes"]
    if size > max_dense_bytes:
        raise ContractError(f"dense size {size} above {max_dense_bytes}")
    return _published(spark, {"index": index, "candidates": cands, "draws": made, "budget": budget}, path)


def augment_bundle(bundle: dict[str, DataFrame], holdout: DataFrame, path: str, policy, source: str, tp_off: str, null_sig: str, seed: int,
                   signature_purpose: str, reshuffle_purpose: str | None = None) -> dict[str, DataFrame]:
    """IT08: the bundle's draws with one policy signature each, its support with all of them, published anew.

    The draws keep their order, or are made anew as one full shuffle of the candidates if ``reshuffle_purpose`` is given.
    Training support is expanded by the policy and joined by the untouched ``holdout``. The augmented draws are audited and
    derived a second time; any difference raises ``ContractError``.
    """
    spark = holdout.sparkSession
    rows = spark.createDataFrame([(s, float(t), float(d)) for s, t, d in policy], "signature string, p_target double, p_draw double")
    require_clean(policy_violations(rows, source, tp_off, null_sig))
    base = bundle["draws"] if reshuffle_purpose is None else _draws(bundle["candidates"], None, seed, reshuffle_purpose)
    made = cut_lineage(SA.materialize_signatures(base, policy, null_sig, seed, signature_purpose))
    require_clean(SA.draw_violations(made))
    again = SA.validate_provenance(base, made, policy, null_sig, seed, signature_purpose)
    require_clean(again.select(F.col("side").alias("rule"), F.col("sample_id").alias("key"), F.lit("").alias("detail")))
    train = SA.expand_support(bundle["candidates"], policy, null_sig)
    support = combine_support(train, holdout.select(*train.columns))
    return _published(spark, {"draws": made, "support": support, "policy": rows}, path)
