"""The ten operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, near_dedup, plane_files, ppm, quality, substring_dedup, url_filter, warc, word_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, taken as responses."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram log-probabilities of all documents, trained on six sevenths."""
    return ppm.score(table(spark, sf_dir, "documents"))


def digested(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows (doc_id, ids, text)."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded through the distinct-word table and decoded through pieces."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digested(word_table.round_trip(table(spark, sf_dir, "documents"), path))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents, and how many are there but for some words' places."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), b_at AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM b_at
), sizes AS (
  SELECT DISTINCT n FROM win
), d_at AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM d_at) JOIN win USING (n, p)
), places AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit
), by_doc AS (
  SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id
), by_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
), phrases AS (
  SELECT n, ws, unnest(ws[1:1]) AS first FROM (SELECT DISTINCT n, string_split(p, ' ') AS ws FROM win)
), starts AS (
  SELECT doc_id, w, unnest(w) AS first, unnest(range(1, len(w) + 1)) AS i FROM d
), by_near AS (
  SELECT doc_id, count(*) AS n_near FROM (
    SELECT * FROM starts JOIN phrases USING (first) WHERE list_contains(w[greatest(1, i - 1):i + 3], ws[2]) AND list_contains(w[greatest(1, i + n - 3):i + n + 1], ws[n])
  )
  WHERE w[i:i + n - 1] <> ws AND len(list_filter(range(2, n + 1), lambda j: list_contains(w[greatest(1, i + j - 3):i + j + 1], ws[j]))) = n - 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN by_item USING (doc_id) LEFT JOIN by_near USING (doc_id)
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their five-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), parts AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences that repeat in spans of three; and without those that repeat in these or in fewer, of twenty words."""
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


OP8_RULES = (
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"), OP8_RULES, url_filter.fit(url_filter.labelled_urls()))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts: odd ids come in against a published snapshot of even ids."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.deduplicate(docs, F.col("doc_id") % 2 == 0).withColumnRenamed("digest", "text_sha256")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op10_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in plane files, read back from them."""
    return plane_files.read(plane_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def queries():
    """Name to function of (spark, sf_dir)."""
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_ppm_score": op2_ppm_score,
        "op3_bpe_word_table": op3_bpe_word_table,
        "op4_quality": op4_quality,
        "op5_decontaminate": op5_decontaminate,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_plane_files": op10_plane_files,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the result."""
    return {"op5_decontaminate": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL}
