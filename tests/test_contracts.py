"""Gates, contracts and helpers fail closed; nothing vanishes; no caps."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from petrichor.functions import values as V
from petrichor.operators import calibration as CB
from petrichor.operators import components as CO
from petrichor.operators import covariates as CV
from petrichor.operators import events as EV
from petrichor.operators import metrics as ME
from petrichor.operators import sampling as SA
from petrichor.operators import stats as SS
from petrichor.operators import targets as TG
from petrichor.operators import validate as VA
from petrichor.session import small_side
from petrichor.sources import frames as FR

NAN = float("nan")


def test_gate_fails_closed(spark):
    rows = [("good", "b", "m1", 0.0, 0.1), ("good", "b", "m2", 0.5, 0.6), ("missing", "b", "m1", 0.0, 0.1), ("null", "b", "m1", 0.0, None), ("null", "b", "m2", 0.5, 0.6),
            ("nan", "b", "m1", 0.0, NAN), ("nan", "b", "m2", NAN, 0.6), ("nothing", "b", "other", 0.0, 0.0), ("half", "b", "m1", 0.0, 0.1), ("half", "b", "m2", 0.5, 0.6), ("half", "c", "m1", 0.0, 0.1)]
    ci = spark.createDataFrame(rows, "arm string, baseline string, metric string, low double, high double")
    rules = spark.createDataFrame([("m1", "upper_below", 0.2), ("m2", "lower_above", 0.4)], "metric string, side string, bound double")
    got = {r.arm: (r.passed, r.failed) for r in ME.gate(ci, rules).collect()}
    assert got == {"good": (True, 0), "missing": (False, 1), "null": (False, 1), "nan": (False, 2), "nothing": (False, 2), "half": (False, 1)}
    odd = rules.unionByName(spark.createDataFrame([("m1", "sideways", 1.0), ("m2", "upper_below", None)], rules.schema))
    assert not any(r.passed for r in ME.gate(ci, odd).collect())


def test_dead_groups_stay(spark):
    d = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("dead", 5.0, False), ("dead", None, True), (None, 2.0, True)], "channel string, v double, valid boolean")
    got = {r.channel: (r.n, r["mean"]) for r in SS.masked_moments(d, ["channel"]).collect()}
    assert got == {"a": (2, 2.0), "dead": (0, None), None: (1, 2.0)}
    merged = {r.channel: (r.n, r["mean"], r.variance) for r in SS.merge_moments(SS.moments_state(d.withColumn("part", F.monotonically_increasing_id()), ["channel", "part"]), ["channel"]).collect()}
    assert merged == {"a": (2, 2.0, 1.0), "dead": (0, None, None), None: (1, 2.0, 0.0)}
    assert {r.channel for r in SS.degenerate_channels(SS.masked_moments(d, ["channel"]), ["channel"]).collect()} == {"dead", None}


def test_unfit_cells_are_identity(spark):
    rows = [("one_class", 0.2, 1.0, 1.0), ("one_class", 0.7, 1.0, 1.0), ("no_spread", 0.5, 0.0, 1.0), ("no_spread", 0.5, 1.0, 1.0), ("no_weight", 0.5, 1.0, 0.0)]
    rows += [("fit", p, y, 1.0) for p in (0.2, 0.4, 0.6, 0.8) for y in (0.0, 1.0)] + [("unsupported", p, y, 1.0) for p in (0.2, 0.8) for y in (0.0, 1.0)]
    d = spark.createDataFrame(rows, "cell string, p double, y double, w double")
    out = {r.cell: r for r in CB.fit_probability(d, ["cell"], supported=d.filter("cell <> 'unsupported'")).collect()}
    assert {k for k, r in out.items() if r.terminal} == {"one_class", "no_spread", "no_weight", "unsupported"}
    for k in out:
        if out[k].terminal:
            assert (out[k].alpha, out[k].slope) == (0.0, 1.0) and abs(math.log1p(math.exp(out[k].beta_raw)) - 1) < 1e-12


CAND = "sample_id string, t0_utc timestamp_ntz, lead_hours double, condition_signature string, block_id string, stratum string, split string, p_target double, p_draw double, omega double, fold_id int"


def cands(spark, probabilities, target=None):
    return spark.createDataFrame([(f"s{i}", dt.datetime(2024, 1, 1, i), 0.5, "sig", "b", "wet", "outer_train", (target or probabilities)[i], p, 1.0, None)
                                  for i, p in enumerate(probabilities)], CAND)


def test_draws_of_a_heavy_candidate(spark):
    c = cands(spark, [0.05, 0.9, 0.05])
    n = {r.sample_id: r["count"] for r in SA.draw_from_cdf(c, 4000, 1, "x").groupBy("sample_id").count().collect()}
    assert sum(n.values()) == 4000 and 3500 < n["s1"] < 3700
    plan = SA.draw_from_cdf(c, 100, 1, "x")._jdf.queryExecution().toString()
    assert "explode(sequence" not in plan.lower()


def test_probabilities_must_sum_to_one(spark):
    with pytest.raises(Exception, match="sums to"):
        SA.draw_from_cdf(cands(spark, [0.2, 0.3]), 10, 1, "x").collect()
    with pytest.raises(Exception, match="item-uniform"):
        SA.hash_shuffle(cands(spark, [0.5, 0.5], [0.9, 0.1]), 1, "x").collect()
    assert SA.hash_shuffle(cands(spark, [0.5, 0.5]), 1, "x").count() == 2


def test_manifest_rules_see_null_nan_and_nothing(spark):
    d = cands(spark, [0.5, 0.5]).withColumn("global_example_index", F.row_number().over(Window.orderBy("sample_id")).cast("long") - 1)
    clean = {r.rule for r in SA.draw_violations(d).collect()}
    assert clean == set()
    for bad, rule in ((F.lit(None).cast("double"), "omega"), (F.lit(NAN), "omega")):
        assert {r.rule for r in SA.draw_violations(d.withColumn("omega", bad)).collect()} == {rule}
    assert {r.rule for r in SA.draw_violations(d.limit(0)).collect()} == {"empty"}
    assert {r.rule for r in SA.candidate_violations(d.withColumn("p_target", F.lit(float("inf")))).collect()} >= {"probability", "target_sum"}
    assert {r.rule for r in SA.candidate_violations(d.limit(0)).collect()} == {"target_sum"}
    none = SA.audit_draw_membership(d.withColumn("omega", F.lit(None).cast("double")), d)
    assert {r.rule for r in none.collect()} == {"weights"}


def test_rows_without_split_stay(spark):
    c = cands(spark, [0.5, 0.5]).withColumn("split", F.when(F.col("sample_id") == "s0", "outer_train"))
    out = SA.expand_support(c, (("x", 0.5, 0.5), ("y", 0.5, 0.5)), "null")
    assert out.count() == 3 and out.filter("split IS NULL").count() == 1


def test_not_a_number_is_no_number(spark):
    d = spark.createDataFrame([(NAN,), (None,), (-1.0,), (2000.0,), (0.0,), (1000.0,)], "x double")
    got = [tuple(r) for r in d.select(V.clip(F.col("x"), 0.0, 1.0), V.wet(F.col("x")), V.censored(F.col("x")), V.normalized_from_rate(F.col("x"))).collect()]
    assert got[0] == got[1] == (None, None, None, None)
    assert got[2][3] is None and got[3][3] is None and got[4][3] == 0.0 and got[5][3] == 1.0


def test_one_grid_over_all_channels(spark):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("a", t, "g1"), ("b", t, "g2")], "channel string, valid_time timestamp_ntz, grid string")
    assert {r.rule for r in CV.grid_violations(d).collect()} == {"grid_changes"}
    assert {r.rule for r in CV.grid_violations(d.withColumn("grid", F.lit(None).cast("string"))).collect()} == {"incomplete"}


def test_overlapping_events_are_named(spark):
    d = spark.createDataFrame([("x", 0, 10), ("x", 3, 4), ("x", 8, 9), ("x", 11, 12), ("y", 5, 6)], "source string, start long, end long")
    assert {(r.rule, r.key) for r in EV.overlapping(d, ["source"]).collect()} == {("overlap", "x|3"), ("overlap", "x|8")}


def test_a_long_winding_area_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(CO, "TILE", 2)
    path = []
    for k in range(0, 24, 2):
        row = [(k, x) for x in range(24)]
        path += row if k % 4 == 0 else row[::-1]
        path.append((k + 1, path[-1][1]))
    d = spark.createDataFrame([(1, y, x, 1.0) for y, x in path], "field int, y int, x int, v double")
    assert CO.wet_components(d, ["field"]).select("label").distinct().count() == 1


def test_past_the_bound_the_answer_is_the_same(spark):
    small = spark.createDataFrame([(k, f"name {k}") for k in range(50)], "k long, name string")
    rows = spark.range(1000).select((F.col("id") % 60).alias("k"))
    a, b = (rows.join(small_side(small, n), "k").groupBy("name").count() for n in (1 << 20, 0))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_gate_without_rules_and_with_absent_baselines(spark):
    ci = spark.createDataFrame([("a", "b", "m", 0.0, 0.1), ("z", "b", "m", 0.0, 0.1), ("z", "c", "m", 0.0, 0.1)], "arm string, baseline string, metric string, low double, high double")
    rules = spark.createDataFrame([("m", "upper_below", 0.2)], "metric string, side string, bound double")
    assert [r.passed for r in ME.gate(ci, rules.limit(0)).collect()] == [False, False]
    pairs = spark.createDataFrame([(a, b) for a in "az" for b in "bc"], "arm string, baseline string")
    assert {r.arm: (r.passed, r.failed) for r in ME.gate(ci, rules, pairs).collect()} == {"a": (False, 1), "z": (True, 0)}
    named = spark.createDataFrame([("b", "m", "upper_below", 0.2), ("c", "m", "upper_below", 0.2)], "baseline string, metric string, side string, bound double")
    assert {r.arm: (r.passed, r.failed) for r in ME.gate(ci, named).collect()} == {"a": (False, 1), "z": (True, 0)}
    over = spark.createDataFrame([("m", "lower_over", 0.0)], rules.schema)
    assert not any(r.passed for r in ME.gate(ci, over).collect())
    assert all(r.passed for r in ME.gate(ci, spark.createDataFrame([("m", "lower_over", -0.1)], rules.schema)).collect())


def test_band_rules_and_cull(spark):
    rules = ME.band_rules(spark)
    full = rules.select(F.lit("a").alias("arm"), "band", "baseline", "metric", F.lit(0.01).alias("low"), F.lit(0.015).alias("high")).distinct()
    assert [(r.passed, r.failed) for r in ME.gate(full, rules).collect()] == [(True, 0)]
    short = full.filter("not (band = '4.5-6.0' and baseline = 'coarse_tp')")
    assert [(r.passed, r.failed) for r in ME.gate(short, rules).collect()] == [(False, 1)]
    ends = [("ok", "E1", 0.0, 0.04), ("ok", "E2", -0.01, 0.1), ("worse", "E1", 0.0, 0.06), ("worse", "E2", -0.01, 0.1), ("lost", "E1", 0.0, 0.04), ("lost", "E2", -0.03, 0.1)]
    ci = spark.createDataFrame([(a, "reference", m, x, y) for a, m, x, y in ends], "arm string, baseline string, metric string, low double, high double")
    assert {r.arm: r.passed for r in ME.gate(ci, ME.cull_rules(spark)).collect()} == {"ok": True, "worse": False, "lost": False}


def test_policy_contracts_refuse_null_repeats_and_access(spark):
    full, causal, null = "era5:era=1:tp={}:full_trajectory", "era5:era=1:tp={}:target_end_causal", "null_provider:era=0:tp=0:no_era_access"

    def broken(rows, strategy="matched_arm"):
        d = spark.createDataFrame([(s, t, t) for s, t in rows], "signature string, p_target double, p_draw double")
        return sorted({r.rule for r in VA.policy_violations(d, full.format(1), full.format(0), null, strategy).collect()})
    good = [(full.format(1), 0.5), (full.format(0), 0.25), (null, 0.25)]
    assert broken(good) == []
    assert broken(good[:2] + [(null, None)]) == ["draw_sum", "probability", "target_sum"]
    assert broken(good[:2] + [(null, NAN)]) == ["draw_sum", "probability", "target_sum"]
    assert broken(good[:2] + [(null, 0.125), (null, 0.125)]) == ["duplicate_signature"]
    both = [(full.format(1), 0.25), (full.format(0), 0.25), (causal.format(1), 0.25), (causal.format(0), 0.125), (null, 0.125)]
    assert broken(both) == ["access_strategy"]
    assert broken(both, "full_with_target_end_causal_augmentation") == []
    assert broken(good, "full_with_target_end_causal_augmentation") == ["access_strategy"]
    assert broken(both[:3] + [(null, 0.25)], "full_with_target_end_causal_augmentation") == ["tp_pair"]
    with pytest.raises(ValueError):
        broken(good, "other")


def test_candidate_draw_probabilities(spark):
    rows = [(f"s{k}", dt.datetime(2024, 1, 1), 0.5 * k, "x", "b", 0.25, p, 0) for k, p in enumerate([0.5, 0.5, None, NAN])]
    d = spark.createDataFrame(rows, "sample_id string, t0_utc timestamp_ntz, lead_hours double, condition_signature string, block_id string, p_target double, p_draw double, fold_id int")
    got = sorted((r.rule, r.key) for r in SA.candidate_violations(d).collect())
    assert got == [("draw_probability", "s2"), ("draw_probability", "s3")]
    assert SA.candidate_violations(d.drop("p_draw")).collect() == []


def test_draws_of_a_heavy_candidate_fill_several_parts(spark):
    rows = [(f"s{k}", dt.datetime(2024, 1, 1), 0.5 * k, "x", 0.9 if k == 1 else 0.05, 1 / 3) for k in range(3)]
    d = spark.createDataFrame(rows, "sample_id string, t0_utc timestamp_ntz, lead_hours double, condition_signature string, p_draw double, p_target double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part else
    try:
        out = SA.draw_from_cdf(d, 4000, 3, "heavy")
        heavy = out.filter("sample_id = 's1'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["count"] for r in heavy) > 3400 and len(heavy) > 3
    assert out.count() == 4000


def test_bottom_k_samples_merge_and_are_exact_below_k(spark):
    rows = [("l", f"p{k % 4}", f"q{k % 4 // 2}", float(k * 37 % 101), k) for k in range(60)] + [("l", "lone", "q9", 5.0, 900), ("l", "p0", "q0", None, 901)]
    d = spark.createDataFrame(rows, "lead string, pixel string, pool string, v double, k long")
    whole = {r.pixel: (r.level, list(r.sample)) for r in ME.empirical_climatology(d, "pixel", "pool", "v", F.col("k"), 100, 15, ["lead"]).collect()}
    assert whole["p1"] == ("pixel", sorted(v for _, p, _, v, _ in rows if p == "p1"))
    assert whole["lone"] == ("domain", sorted(v for *_, v, _ in rows if v is not None))
    few = {r.pixel: list(r.sample) for r in ME.empirical_climatology(d, "pixel", "pool", "v", F.col("k"), 7, 1000, ["lead"]).collect()}
    assert len({tuple(s) for s in few.values()}) == 1 and len(few["p1"]) == 7
    crps = spark.createDataFrame([([1.0, 2.0, 4.0], 3.0), ([2.0], 5.0)], "s array<double>, y double").select(ME.empirical_crps(F.col("s"), F.col("y")).alias("c")).collect()
    assert abs(crps[0].c - ((2 + 1 + 1) / 3 - 2 * (1 + 3 + 2) / 9 / 2)) < 1e-12 and crps[1].c == 3.0


def test_unequal_pairs(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 1), ("only", 7), ("same", 1), ("same", 2)], "pair string, key long")
    b = spark.createDataFrame([("p", 2), ("p", 1), ("q", 1), ("r", 3), ("same", 2), ("same", 1)], "pair string, key long")
    got = sorted(tuple(r) for r in FR.unequal_pairs(a, b).collect())
    assert got == [("only", 7, 1, 0), ("q", 1, 2, 1), ("r", 3, 0, 1)]


def test_timeline_must_be_a_partition(spark):
    issues = spark.createDataFrame([(k,) for k in range(6)], "slot long")
    items = spark.createDataFrame([(0, "event"), (1, "strict_dry"), (2, "strict_dry"), (3, "marginal_background"), (3, "event"), (4, "unassigned")], "slot long, stratum string")
    seen = spark.createDataFrame([(0, True, True), (1, False, False), (2, True, False), (3, True, True), (4, True, True)], "slot long, any_wet boolean, significant boolean")
    got = sorted((r.rule, r.key) for r in TG.timeline_violations(issues, items, seen).collect())
    assert got == [("assigned_twice", "3"), ("significant_not_covered", "3"), ("significant_not_covered", "4"), ("strict_dry_contaminated", "2"), ("unassigned", "4"), ("unassigned", "5")]


def test_disabled_calibration_passes_the_raw_value(spark):
    cells = spark.createDataFrame([(k,) for k in range(5)], "lead long")
    records = spark.createDataFrame([(0, 0.5, False, False), (1, 0.5, True, False), (2, 0.5, False, True), (3, 0.5, True, None)], "lead long, b double, terminal boolean, off boolean")
    got = {r.lead: (r.mode, r.b) for r in CB.resolve_calibration(cells, records, ["lead"], {"b": 0.0}, "off").collect()}
    assert got == {0: ("fitted", 0.5), 1: ("terminal_identity", 0.0), 2: ("selection_disabled", 0.0), 3: ("terminal_identity", 0.0), 4: ("missing_record", None)}
