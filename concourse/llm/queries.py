"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_text, language_id, lexical_search, line_dedup, media, near_dedup, packing, simhash_dedup, substring_dedup, top_k, unigram_counts, whitening
from ._shared import table

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_JSON, public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)
    both = byte_bpe.decode(ids, BPE_RANKS)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_features(media.store_texts(table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_html_text, op4_near_dedup, op5_top_k, op6_unigram_counts, op7_byte_bpe, op8_substring_dedup, op9_line_dedup, op10_media, op11_lexical_search, op12_whitening, op13_simhash)}

ORACLES = {
    "op4_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) END AS s FROM words),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
counted AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM counted JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n_both >= 80 * (len(p.s) + len(q.s) - n_both)),
ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, w.v FROM reached r JOIN ways w ON w.u = r.v),
least_id AS (SELECT u, min(v) AS m FROM reached GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM sets JOIN least_id ON u = doc_id""",
    "op5_top_k": """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, unnest([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS c FROM good),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(sum(q.c * p.c) AS BIGINT) AS score FROM parts q JOIN parts p ON q.i = p.i AND q.vec_id <> p.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""",
    "op11_lexical_search": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
wanted AS (SELECT item_id, t, count(*) AS q FROM asked GROUP BY 1, 2),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words),
flat AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM words),
held AS (SELECT doc_id, n, t, count(*) AS tf FROM flat WHERE t IN (SELECT t FROM wanted) GROUP BY 1, 2, 3),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, total GROUP BY t),
impacts AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)) AS i FROM held, total),
scored AS (SELECT item_id, doc_id, CAST(sum(q * w * i) AS BIGINT) AS score FROM wanted JOIN weights USING (t) JOIN impacts USING (t) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
}
