"""The registered queries of the text operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamis.llm import fingerprints, jaccard, knn, mixing, packing, quality, tokens, toxicity, urlfilter, warc

LIMIT = 2048


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe(), LIMIT)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.train(docs, labels, quality.learns(5, 0)))
    return found.select("doc_id", (~quality.learns(5, 0)).alias("held_out"), "score", "predicted", "example_ids", "example_cosines", "example_labels")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, quality.train(docs, labels, quality.learns(3, 1)))
    return found.select("doc_id", (~quality.learns(3, 1)).alias("held_out"), "score", "predicted")


def op4_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5, scale=256)


OP4 = """
with parts as (
  select vec_id, unnest(generate_series(1, len(embedding))) as i, unnest(embedding) as x from embeddings
), ints as (
  select vec_id, i, cast(floor(256 * cast(x as double)) as bigint) as x from parts
), scores as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from ints q join ints c on q.i = c.i and q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
  group by all
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scores
)
select * from ranked where rank <= 5
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe(), LIMIT, end_id=0)


#: The rules that the query judges by.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP6 = r"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path
  from cut
), rules(verdict, host, path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
         row_number() over (partition by p.page_id, p.host, p.path order by length(r.host) - length(replace(r.host, '.', '')) desc, length(r.path) desc) as k
  from parts p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=5, similarity=(4, 5)).drop("links")


OP7 = r"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from split
), sized as (select doc_id, len(s) as n, s from sets), rows as (
  select doc_id, n, unnest(s) as g from sized
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as k, any_value(a.n) as x, any_value(b.n) as y
  from rows a join rows b on a.g = b.g and a.doc_id < b.doc_id
  group by all
), links as (
  select u, v from pairs where 100 * k >= 80 * (x + y - k)
), edges as (select u, v from links union all select v, u from links), reach(node, seen) as (
  select doc_id, doc_id from sized
  union
  select edges.v, reach.seen from reach join edges on edges.u = reach.node
)
select doc_id, cast(any_value(n) as bigint) as n_shingles, min(seen) as component_id
from sized join reach on doc_id = node group by doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), (5.0, 2.0, 1.0), most=3).drop("times")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_quality, op4_knn_join, op5_best_fit_packing, op6_url_filters, op7_jaccard_join, op8_warc, op9_token_counts, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op4_knn_join": OP4, "op6_url_filters": OP6, "op7_jaccard_join": OP7}
