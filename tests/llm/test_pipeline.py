"""The corpus pipeline stage by stage against plain versions, and every query's columns."""

import public_tokenizers as P
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from petrichor.llm import packing
from tests.llm.test_near_dedup import brute
from tests.llm.test_quality_rules import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(kept)
        if name == "language_id":
            assert set(ids) == {k for k, r in kept.items() if regex.search(r"\p{L}", r.text or "")}
        if name == "quality_rules":
            for k, r in kept.items():
                n, _, _, _, _, again = plain(r.text)
                assert k not in ids or not (n < 50 or 100 * again > 50 * n)
        if name == "near_dedup":
            assert set(ids) == {d for d, _, c, keep in brute([(k, r.text) for k, r in kept.items()], 5) if keep}
        kept = {k: kept[k] for k in ids}
        docs = spark.createDataFrame([tuple(r) for r in kept.values()], docs.schema)
    whole = corpus_pipeline.run(spark, SF).collect()
    t = packing.ids_of(P.path("word_bpe_49k.json"))
    assert {r.doc_id for r in whole} == set(kept)
    assert sum(r.length for r in whole) == sum(len(x) // 4 + 1 for x in t.fresh([r.text for r in kept.values()]))


def test_language_scores_decide(spark):
    """A script that no language taught goes, known languages stay; with nothing to learn, all that has a letter stays."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10 ** 9, "これは日本語の文書です。" * 9), (10 ** 9 + 1, "12 $$ 34"), (10 ** 9 + 2, None), (10 ** 9 + 3, "The house of the family is in the city.")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    both = real.unionByName(odd, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, both, SF).select("doc_id").collect()}
    assert kept & {k for k, _ in rows} == {10 ** 9 + 3}
    bare = both.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, bare, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in both.select("doc_id", "text").collect() if regex.search(r"\p{L}", r.text or "")}


def test_odd_documents(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, empty, SF).count() == 0


def test_fourteen_queries():
    names = [n for n in entry.queries() if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
    assert sorted(n.split("_")[0] for n in names) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])
