"""Queries of the corpus operators: thin calls that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, golden, hard_negatives, html, language, licenses, media, mixing, near_vectors, ngram_join, packing, quality, substrings
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])
    return found.drop("evidence")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("notices")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = media.store(table(spark, sf_dir, "documents"))
    return media.described(spark, folder)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.records(table(spark, sf_dir, "clients"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Maximal conversations by exact comparison of turn lists, independent of hashes.
_CHAT = """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM c, unnest(range(1, len(l))) AS u(k)),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY l),
m AS (SELECT * FROM w ANTI JOIN p USING (l))
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, CAST(n_equal AS BIGINT) AS n_equal,
       array_to_string(list_transform(l, lambda x: concat('<|', coalesce(x.r, ''), '|>' || chr(10), coalesce(x.t, ''), chr(10))), '') || '<|end|>' AS rendered
FROM m"""


_FILLED = "CASE WHEN regexp_matches({0}, '[^\\x20\\x09-\\x0D]') THEN {0} END AS {0}"

#: Every order as a rank over the whole cluster.
_GOLDEN = f"""
WITH c AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents,
  {", ".join(_FILLED.format(x) for x in ("source", "name", "email", "city", "segment"))} FROM clients),
t AS (SELECT *, CASE source WHEN 'crm' THEN 1 WHEN 'web' THEN 2 WHEN 'store' THEN 3 WHEN 'partner' THEN 4 ELSE 5 END AS trust,
  updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOUR AS stale FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id) AS recent FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled,
  arg_min({{'v': segment, 'i': client_id}}, recent) FILTER (segment IS NOT NULL) OVER (PARTITION BY cluster_id) AS seg FROM r)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
  arg_min({{'v': name, 'i': client_id}}, [-length(name), trusted]) FILTER (name IS NOT NULL) AS n,
  arg_min({{'v': email, 'i': client_id}}, trusted) FILTER (email IS NOT NULL) AS e,
  any_value(seg) AS s,
  arg_min({{'v': cents, 'i': client_id}}, [(segment IS DISTINCT FROM seg.v)::INT, recent]) FILTER (cents IS NOT NULL) AS b,
  arg_min({{'c': city, 'n': nation_id, 'i': client_id}}, [-filled, recent]) FILTER (filled > 0) AS a
FROM o GROUP BY cluster_id"""
_GOLDEN = f"""SELECT cluster_id, n_records, n_stale, n.v AS name, e.v AS email, s.v AS segment, a.c AS city, a.n AS nation_id, b.v AS balance_cents,
  n.i AS name_from, e.i AS email_from, s.i AS segment_from, b.i AS balance_from, a.i AS address_from FROM ({_GOLDEN}) AS g"""

#: All products of anchors and rows.
_HARD = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(generate_series(1, len(a.x)), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_formatting": _CHAT, "op11_hard_negatives": _HARD, "op13_golden_records": _GOLDEN}
