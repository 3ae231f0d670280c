"""Session SQL functions: expressions the optimizer inlines, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "hash_uniform(seed STRING, purpose STRING, k STRING) RETURNS DOUBLE":
        "with_hash(sha2(concat_ws(char(0), seed, purpose, k), 256))",
    "rate_from_normalized(v DOUBLE) RETURNS DOUBLE": "CASE WHEN v = 0 THEN 0D ELSE pow(10D, (45D * v - 15D) / 10D) END",
    "censor(raw DOUBLE, a_wet DOUBLE) RETURNS DOUBLE": "CASE WHEN raw >= a_wet THEN raw WHEN raw IS NOT NULL THEN 0D END",
    "sample_id(t0 TIMESTAMP_NTZ, lead DOUBLE, sig STRING) RETURNS STRING":
        "substring(sha2(concat(date_format(t0, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00|', format_string('%.1f', lead), '|', sig), 256), 1, 24)",
    "lower_median(m ARRAY<DOUBLE>) RETURNS DOUBLE": "element_at(array_sort(m), CAST(floor((size(m) - 1) / 2) AS INT) + 1)",
    "fair_crps(m ARRAY<DOUBLE>, y DOUBLE) RETURNS DOUBLE":
        "aggregate(transform(m, x -> abs(x - y)), 0D, (a, x) -> a + x) / size(m) - CASE WHEN size(m) < 2 THEN 0D ELSE "
        "aggregate(transform(array_sort(m), (x, i) -> (2 * i - size(m) + 1) * x), 0D, (a, x) -> a + x) / (size(m) * (size(m) - 1)) END",
}
WITH_HASH = ("with_hash(h STRING) RETURNS DOUBLE",
             "(CAST(conv(concat(substring(h, 15, 2), substring(h, 13, 2), substring(h, 11, 2), substring(h, 9, 2)), 16, 10) AS BIGINT) * 2097152 + "
             "shiftright(CAST(conv(concat(substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)), 16, 10) AS BIGINT), 11)) "
             "* pow(2D, -53)")
TABLES = {
    "expand_leads(mask INT) RETURNS TABLE (lead_hours DOUBLE)":
        "SELECT i * 0.5D FROM (SELECT explode(filter(sequence(1, 12), i -> (shiftright(mask, i - 1) & 1) = 1)) AS i)",
    "explode_slots(slot BIGINT, before INT, after INT) RETURNS TABLE (need BIGINT)":
        "SELECT explode(sequence(slot - before, slot + after))",
}


def register(spark: SparkSession) -> None:
    """UD02, UD03."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {WITH_HASH[0]} RETURN {WITH_HASH[1]}")
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
