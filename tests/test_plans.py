"""Shape of the physical plans: pruning, pushdown, no raw rows in one task, no cartesian product."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from petrichor.operators import metrics as ME
from petrichor.operators import stats as SS
from petrichor.session import small_side

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["wn01_runs", "ag09_masked_moments", "ag16_residual_scales", "me02_contingency", "ag32_rollup_report", "jn11_regrid_mean",
                                  "ag01_accumulate_target", "me09_reliability", "jn16_draw_from_cdf", "jn02_containing_event"])
def test_no_cartesian_and_pruned_scans(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert "props" not in schema and "l_tax" not in schema or name == "ag16_residual_scales"


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["jn08_asof_cycle"](spark, SF))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text and "EqualTo(o_orderstatus,F)" in text


def test_runs_never_window_over_one_task(spark):
    slots = spark.range(1000).select(F.col("id").alias("slot"))
    from petrichor.operators.slots import runs
    text = plan(runs(slots))
    assert "SinglePartition" not in text


def test_moments_are_partial_then_final(spark):
    df = spark.range(100).select(F.lit("c").alias("channel"), F.col("id").cast("double").alias("v"), F.lit(True).alias("valid"))
    text = plan(SS.masked_moments(df, ["channel"]))
    assert "partial_var_pop" in text or "partial_var_pop" in text.lower()


def test_distinct_blocks_do_not_expand_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, "b")], "f double, o double, block string")
    assert "Expand" not in plan(ME.contingency(df, [], [1.0, 2.0, 3.0], None, "block"))


def test_broadcast_only_below_the_limit(spark):
    big = spark.range(1000).select(F.col("id").alias("k"))
    rows = spark.range(10).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(rows.join(small_side(big, 1 << 20), "k"))
        assert "BroadcastHashJoin" not in plan(rows.join(small_side(big, 10), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoint_folder_comes_from_the_session(spark):
    from petrichor import session
    from petrichor.streaming.streams import scratch
    named = spark.conf.get("spark.checkpoint.dir")
    assert named in session.ensure_checkpoint_dir(spark)
    assert scratch(spark, "x").startswith(named)
