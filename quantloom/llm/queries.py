"""The thin ``opN_<name>`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bm25, bpe, langid, mixing, shards, simhash, substring, vectors, warc
from quantloom.llm.base import prepare, shared_dir, table


def op1_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, text_sha256 of every document, read back from a store that got them in several arrivals."""
    return shards.contents(shards.compacted(table(spark, sf_dir, "documents"), shared_dir(spark, "shards")))


def op2_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, doc_id, score of the ten best documents of each document whose id is divisible by 50."""
    return bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from WARC archives."""
    path = shared_dir(spark, "warc")
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages"), "page_id", "html"), path)
    return warc.read_pages(spark, path)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = mixing.taken(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the twenty nearest vectors of each vector whose id is divisible by 20."""
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_tiered_compaction": op1_tiered_compaction,
    "op2_bm25_top_k": op2_bm25_top_k,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_nearest_vectors": op10_nearest_vectors,
}

_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, source_size * 2 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM by_source
), levelled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER rising, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0))::DOUBLE AS level
  FROM weighed
  WINDOW rising AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fixed AS (
  SELECT level FROM levelled WHERE cap >= weight * level ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST LIMIT 1
), goal AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(weight::DOUBLE * (SELECT level FROM fixed), cap::DOUBLE)) AS target FROM levelled
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0 ELSE g.target / g.source_size::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

_SUBSTRING_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM w WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, p, sha256(array_to_string(words[p:p+12], ' ')) AS h FROM starts
), hits AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM hits
), marked AS (
  SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w.words) AS n_words, CASE WHEN m.cut IS NULL THEN w.words
    ELSE list_transform(list_filter(range(1, len(w.words) + 1), lambda i: NOT list_contains(m.cut, i)), lambda i: w.words[i]) END AS k
  FROM w LEFT JOIN marked m USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, (n_words - len(k))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

_COMPACTION_SQL = """
SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""

_BM25_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL
), len AS (
  SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id
), df AS (
  SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term
), s AS (
  SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM len
), impact AS (
  SELECT t.doc_id, t.term, ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len.dl / s.mean)) AS w
  FROM tf t JOIN len USING (doc_id) JOIN df USING (term), s
), scored AS (
  SELECT q.doc_id AS query_id, i.doc_id, round(sum(q.tf * i.w), 6) AS score
  FROM tf q JOIN impact i USING (term) WHERE q.doc_id % 50 = 0 AND q.doc_id <> i.doc_id GROUP BY ALL
)
SELECT query_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored
) WHERE rank <= 10
"""

_NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> {}) & 31)::INT + 1, 1)"
_WARC_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, array_to_string(list_transform(list_transform([1, 11, 21, 31], lambda pos: ('0x' || substr(h, pos, 10))::BIGINT),
    lambda x: {" || ".join(_DIGIT.format(35 - 5 * k) for k in range(8))}), '') AS payload_digest, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
"""

ORACLE_SQL: dict[str, str] = {
    "op5_warc": _WARC_SQL,
    "op1_tiered_compaction": _COMPACTION_SQL,
    "op2_bm25_top_k": _BM25_SQL,
    "op7_substring_dedup": _SUBSTRING_SQL,
    "op8_source_mixing": _MIX_SQL,
    "op10_nearest_vectors": _NEAREST_SQL,
}
