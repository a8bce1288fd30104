"""The operators bound to the tables: one thin query each, with production parameters.

Every query reads its whole table. SQL holds the statements that DuckDB can run over
the same tables; queries without one are tested against brute force in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tributary.llm.best_fit_packing import pack
from tributary.llm.curriculum_mix import by_position, plan_mixture
from tributary.llm.hamming_search import hamming_top_k
from tributary.llm.ordinal_toxicity import toxicity
from tributary.llm.prob_minhash import near_duplicates
from tributary.llm.run_length_dedup import run_length_dedup
from tributary.llm.site_quality import quality
from tributary.llm.storage import table
from tributary.llm.substring_dedup import substring_dedup
from tributary.llm.warc import round_trip
from tributary.llm.winnowing import compare_edited

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).withColumnRenamed("c_doc_id", "doc_id")


SQL["op1_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, unnest(list_transform(generate_series(1, len(w) - 49), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS k
  FROM d WHERE len(w) >= 50),
firsts AS (SELECT k, min(doc_id) AS least FROM starts GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + j AS place FROM starts JOIN firsts USING (k), range(50) AS r(j) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.place) AS t
  FROM words LEFT JOIN gone USING (doc_id, place) WHERE gone.place IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op4_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query
def op5_site_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality(docs, table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op8_prob_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id")


@query
def op10_curriculum_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = by_position(plan_mixture(docs))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


@query
def op2_warc(spark, sf_dir):
    pages = round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return pages.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc"] = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM d),
m AS (SELECT payload_digest, max(page_id) AS top FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b JOIN m USING (payload_digest)
"""


@query
def op3_winnowing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_edited(docs).withColumnRenamed("id", "doc_id")


@query
def op9_run_length_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_length_dedup(docs, with_bytes=False).withColumnRenamed("c_doc_id", "doc_id")


@query
def op6_hamming_search(spark, sf_dir):
    return hamming_top_k(table(spark, sf_dir, "embeddings"))


SQL["op6_hamming_search"] = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
         CAST(len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (e.embedding[i] > 0))) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= 10
"""


@query
def op7_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "severity", "grade", "toxic")
