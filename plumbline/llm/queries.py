"""Driver queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard, langid, license, media, packing, quality, sharding, tokencount, urlrules
from plumbline.llm.shared import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_documents(spark, sf_dir))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after four edits of every document: a heading, a deletion in the middle, an insertion, an ending."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda pos, cut, new: F.struct(pos.cast("long").alias("pos"), F.lit(cut).cast("long").alias("n_delete"), F.lit(new).alias("insert"))
    edits = F.array(edit(F.lit(0), 0, "Second edition. "), edit(F.floor(n / 2), 40, ""), edit(F.floor(n / 3), 0, " see the note below "), edit(n + 1000, 0, "\nEnd of text."))
    return tokencount.count_tokens(_documents(spark, sf_dir), edits)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(_documents(spark, sf_dir)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_license_scan that SQL can state."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_url_filter that the given rules decide."""
    found = op3_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, least and greatest slot, and bytes of each shard of op6_sharding, and whether its slots are all different."""
    found = op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    return found


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document in op6_sharding, law, and the range of shards."""
    return op6_sharding(spark, sf_dir).select("doc_id", "size", "law", F.col("shard").between(0, sharding.SHARDS - 1).alias("placed"), F.col("grown_shard").isNull().alias("not_grown"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_media_columns that SQL can state."""
    return op8_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_license_scan, op3_url_filter, op4_language_id, op5_best_fit_packing,
        op6_sharding, op7_token_counts, op8_media_columns, op9_decontamination, op10_jaccard_join, pipeline, license_base, url_rules, shard_sizes, document_sizes, media_payload,
    )
}

#: What of op2, op3, op6 and op8 SQL can state, over whole tables. The rest (hashing, trained models, alignments) is held against brute
#: force or an exact round trip in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "license_base": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) v(phrase, label)),
h AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: list_slice(words, i + 1, i + len(phrase)) = phrase)) AS place FROM w, p)
SELECT w.doc_id, len(words) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN h ON w.doc_id = h.doc_id GROUP BY w.doc_id, len(words)
""",
    "url_rules": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) v(h, q, verdict)),
f AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(verdict, length(h || q)) AS given FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, given FROM p LEFT JOIN f USING (page_id)
""",
    "shard_sizes": "WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT shard, (n - shard + 39) // 40 AS n FROM t, range(40) r(shard)) SELECT CAST(shard AS INTEGER) AS shard, n, CAST(0 AS BIGINT) AS first, n - 1 AS last, n AS slots FROM s WHERE n > 0",
    "document_sizes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, 'rows' AS law, true AS placed, true AS not_grown FROM documents",
    "media_payload": """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), n AS (SELECT doc_id, raw, octet_length(raw) AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64) AS padded FROM b)
SELECT doc_id, n AS n_bytes, CAST(padded AS BIGINT) AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(padded - n AS INTEGER)))) AS payload_sha256 FROM n
""",
}
