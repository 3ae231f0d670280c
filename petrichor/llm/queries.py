"""The thirteen operators applied to their whole tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, centroids, chat_windows, hard_negatives, language_id, license_scan, mixing, near_dedup, packing, quality_rules, topk_search,
               toxic_crf, url_rules)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


@query("op5_language_id")
def op5(spark, sf):
    """doc_id, held_out, lang_pred, score of every document; learned from documents that aren't held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op6_topk_search", """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as q from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""")
def op6(spark, sf):
    """query_id, rank, vec_id, score: the five best rows of each vector whose id is divisible by 50."""
    rows = topk_search.quantised(table(spark, sf, "embeddings"))
    return topk_search.search(rows.filter(F.col("vec_id") % 50 == 0), rows, 5)


@query("op7_license_scan")
def op7(spark, sf):
    """Exact base columns, labels with fuzzy finds, and score of every document."""
    return license_scan.scan(table(spark, sf, "documents"), spans=False)


@query("op8_byte_bpe")
def op8(spark, sf):
    """Digests of the ids of every document and of the bytes that they decode to."""
    return byte_bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_packing")
def op10(spark, sf):
    """Pieces of all documents in sequences of at most 2048 tokens; alone in its workers, it may remember more than a pipeline's stage."""
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), kept=400_000)


@query("op9_quality_rules")
def op9(spark, sf):
    """Base counts and verdict of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
                                             F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


@query("op2_near_dedup", r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
k as (select s.*, md5(array_to_string(list_sort(s), chr(10))) as k, len(s) as n from s),
c as (select k, min(doc_id) as id, any_value(s) as s, any_value(n) as n from k where n > 0 group by k),
u as (select k, id, n, unnest(s) as x from c),
p as (select a.id as a, b.id as b, count(*) as hit, any_value(a.n) as na, any_value(b.n) as nb from u a join u b on a.x = b.x and a.id < b.id group by 1, 2),
e as (select a, b from p where 100 * hit >= 80 * (na + nb - hit)),
g as (with recursive r(v, root) as (select id, id from c union select case when r.v = e.a then e.b else e.a end, r.root from r join e on r.v = e.a or r.v = e.b)
      select v, min(root) as component_id from r group by v)
select k.doc_id, k.n::bigint as n_shingles, coalesce(g.component_id, k.doc_id) as component_id, k.doc_id = coalesce(g.component_id, k.doc_id) as kept
from k left join c on k.k = c.k and k.n > 0 left join g on c.id = g.v""")
def op2(spark, sf):
    """doc_id, n_shingles, component_id, kept of every document, on 4-word shingles."""
    return near_dedup.groups(table(spark, sf, "documents"), width=4, percent=80)


# fixed values: the host-and-path policy
POLICY = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query("op3_url_rules")
def op3(spark, sf):
    """page_id, host, path, rule, verdict of every page."""
    return url_rules.judged(table(spark, sf, "pages"), table(spark, sf, "labels"), POLICY).drop("confidence")


@query("op4_chat_windows")
def op4(spark, sf):
    """Digests, read back from the formatted windows, of every conversation and of one whose texts hold control strings."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_windows.digests(chat_windows.formatted(turns))


@query("op1_toxic_crf")
def op1(spark, sf):
    """doc_id, held_out, score, predicted, n_spans of every document; learned from labels that aren't held out."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    field = toxic_crf.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    return toxic_crf.tagged(docs, field).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted",
                                                F.size("spans").cast("long").alias("n_spans"))


@query("op11_mix_sources", r"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
       md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as place from d group by source),
w as (select *, [3, 1, 2][place % 3 + 1]::bigint as weight, 2 * source_size as cap from s),
x as (select *, (sum(cap) over o)::double as stopped, (sum(weight) over o)::double as sw from w window o as (order by cap / weight, place rows unbounded preceding)),
t as (select 1.5::double * sum(source_size)::double as budget, sum(weight)::double as w from w),
l as (select greatest(any_value(budget / t.w), coalesce(max(case when t.w - sw > 0 then (budget - stopped) / (t.w - sw) end), 0)) as level from x, t),
g as materialized (select source, source_size, place, least(cap::double, level * weight) as target from w, l),
q as materialized (select d.doc_id, d.size, g.*, row_number() over () as rid,
       (sum(size) over (partition by place order by key, doc_id nulls first, size rows unbounded preceding))::bigint - size as start
       from d join g on d.source is not distinct from g.source),
p as (select rid, target, place, c * source_size + start + least((i + 1) * 256, size) as until, least(256, size - i * 256) as words
      from (select *, unnest(range((size + 255) // 256)) as i from q), range(2) as r(c) where size > 0),
f as (select *, sum(words) over (order by until::double / target, place, until rows unbounded preceding) as upto from p),
k as (select rid, sum(greatest(0, least(words, floor(budget)::bigint - (upto - words))))::bigint as taken from f, t group by rid)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::bigint as taken from q left join k using (rid)""")
def op11(spark, sf):
    """doc_id, size, source_size, target, taken of every document: a mix of 150 % of all words with weights 3, 1, 2."""
    return mixing.mixed(table(spark, sf, "documents"), (3, 1, 2), share=1.5, repeats=2)


def _centroid_sql(k: int, dimensions: int, rounds: int, seed: int) -> str:
    parts = [f"""v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
       where len(embedding) = {dimensions} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
             f"""c0 as materialized (select (row_number() over (order by h, q) - 1)::bigint as c, q from (select sha256('{seed}:' || vec_id::varchar) as h, q from v) order by h, q limit {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select rid, min((list_inner_product(c.q, c.q) - 2 * list_inner_product(v.q, c.q))::bigint * {k} + c.c) as m from v, c{r} c group by rid)""")
        if r < rounds:
            parts.append(f"""m{r} as (select ((m % {k}) + {k}) % {k} as c, j, floor(sum(q[j]) / count(*)) as x from a{r} join v using (rid), range(1, {dimensions + 1}) as t(j) group by 1, 2)""")
            parts.append(f"""c{r + 1} as materialized (select c.c, coalesce(n.q, c.q) as q from c{r} c left join (select c, list(x order by j) as q from m{r} group by c) n using (c))""")
    return f"""with {", ".join(parts)},
o as (select vec_id, c.c::int as cluster, (list_inner_product(v.q, v.q) + list_inner_product(c.q, c.q) - 2 * list_inner_product(v.q, c.q))::bigint as distance,
      sha256(array_to_string(list_transform(c.q, lambda x: x::bigint), ',')) as centroid_sha256
      from v join a{rounds} a using (rid) join c{rounds} c on c.c = ((a.m % {k}) + {k}) % {k})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256 from o"""


@query("op12_centroids", _centroid_sql(40, 64, 5, 2))
def op12(spark, sf):
    """Cluster, distance and inertia of every whole vector of 64 components after five rounds."""
    return centroids.clustered(table(spark, sf, "embeddings"), k=40, dimensions=64, rounds=5, seed=2)


@query("op13_hard_negatives", """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
      from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as r from s where same) where r <= 5),
n as (select p.anchor_id, p.other_id as positive_id, s.other_id as negative_id, p.score as positive_score, s.score as negative_score,
      row_number() over (partition by p.anchor_id, p.r order by s.score desc, s.other_id)::int as rank
      from p join s on p.anchor_id = s.anchor_id where not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""")
def op13(spark, sf):
    """Hard negatives of every vector whose id is divisible by 50, after the labels of every seventh one are moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)
