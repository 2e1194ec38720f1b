"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontaminate, exact_dedup, langid, license, packing, sharding, simhash, substring, warc, wavelet
from credence.llm.common import read_table

SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents")).drop("intervals")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read_table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return license.scan(docs, license.train(docs))


def capture_records(pages: DataFrame) -> DataFrame:
    """Three WARC records for each page: a full response, a later not-modified revisit, and one after that.

    The pages have no capture times or header fields, so these follow from page_id and the html.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(1000)) * 60)
    date = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")
    headers = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), tag)
    base = pages.filter("page_id is not null").select("page_id", "url", digest.alias("payload_digest"), tag.alias("tag"), day.alias("day"), date.alias("date"), headers.alias("full"))
    late = F.create_map(F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-length"), F.lit("0"))
    changed = F.pmod("page_id", F.lit(7)) == 3
    kinds = F.array(
        F.struct(F.lit(0).alias("k"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.when(F.pmod("page_id", F.lit(5)) != 1, F.col("tag")).alias("etag"), F.col("date").alias("last_modified"), F.col("full").alias("headers"), F.lit(0).alias("after")),
        F.struct(F.lit(1).alias("k"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.when(changed, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("etag"), F.col("date").alias("last_modified"), late.alias("headers"), F.lit(90_000).alias("after")),
        F.struct(F.lit(2).alias("k"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("etag"), F.when(~changed, F.col("date")).alias("last_modified"), late.alias("headers"), F.lit(180_000).alias("after")),
    )
    each = base.select("*", F.explode(kinds).alias("r"))
    return each.select((F.col("page_id") * 3 + F.col("r.k")).alias("record_id"), "url", F.timestamp_seconds(F.unix_seconds("day") + F.col("r.after")).alias("at"), F.col("r.kind").alias("kind"), F.col("r.status").alias("status"), F.col("r.etag").alias("etag"), F.col("r.last_modified").alias("last_modified"), F.col("r.headers").alias("headers"), F.when(F.col("r.k") == 0, F.col("payload_digest")).alias("payload_digest"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(capture_records(read_table(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return done.withColumn("headers", F.array_join(fields, ";"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = langid.predictions(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_exact_dedup, op3_decontaminate, op4_substring, op5_sharding, op6_license, op7_revisits, op8_packing, op9_wavelet, op10_langid)}


_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -length(t), b := doc_id)) AS keep_id FROM d GROUP BY n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""

_OP3 = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT item_id, least(5, len(w)) AS k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda x: array_to_string(w[x : x + least(5, len(w)) - 1], ' '))) AS shingles
  FROM i WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), e AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x : x + k - 1], ' '))) AS shingle
  FROM d, (SELECT DISTINCT k FROM s)
), p AS (
  SELECT item_id, k, len(shingles) AS n_shingles, unnest(shingles) AS shingle FROM s
)
SELECT doc_id, item_id, count(*)::INTEGER AS n_shared, any_value(n_shingles)::INTEGER AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM e JOIN p USING (k, shingle) GROUP BY doc_id, item_id HAVING count(*) * 5 >= any_value(n_shingles) * 4
"""

_OP7 = r"""
WITH p AS (
  SELECT page_id, url, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size, 1700000000 + ((page_id * 7919) % 1000) * 60 AS day FROM pages WHERE page_id IS NOT NULL
), u AS (
  SELECT *, '"' || digest[1:16] || '"' AS tag, strftime(make_timestamp(day * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM p
), v AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(x, '\?(.*)$', 1), '(^|&)(fbclid|gclid|ref|utm_campaign|utm_content|utm_medium|utm_source|utm_term)=[^&]*', '', 'g'), '^&+', '') AS q FROM u
), c AS (
  SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM v
), r AS (
  SELECT page_id * 3 AS record_id, canonical, day AS at, CASE WHEN page_id % 5 <> 1 THEN tag END AS etag, date, tag, size, digest FROM c
), a AS (
  SELECT page_id * 3 + 1 AS record_id, canonical, day + 90000 AS at, CASE WHEN page_id % 7 = 3 THEN '"other"' ELSE tag END AS etag, date FROM c
  UNION ALL SELECT page_id * 3 + 2, canonical, day + 180000, NULL, CASE WHEN page_id % 7 <> 3 THEN date END FROM c
), j AS (
  SELECT a.record_id, a.canonical, a.etag, a.date, arg_max(r, struct_pack(x := r.at, y := r.record_id)) AS f
  FROM a LEFT JOIN r ON r.canonical = a.canonical AND (r.at < a.at OR (r.at = a.at AND r.record_id < a.record_id)) GROUP BY ALL
), z AS (
  SELECT *, CASE WHEN f.record_id IS NULL THEN 'missing' WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN etag = f.etag THEN 'resolved' ELSE 'mismatch' END
    WHEN date IS NOT NULL AND f.date IS NOT NULL AND date = f.date THEN 'resolved' ELSE 'mismatch' END AS status FROM j
)
SELECT record_id, canonical AS url, CASE WHEN status = 'resolved' THEN f.record_id END AS resolved_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=3600;content-length=' || f.size || ';content-type=text/html;etag=' || f.tag END AS headers,
  CASE WHEN status = 'resolved' THEN f.digest END AS payload_digest FROM z
"""


def oracle_sql() -> dict[str, str]:
    """SimHash, windows over all words, crc32, tokenizers and trained models have no SQL; their tests are brute force."""
    return {"op2_exact_dedup": _OP2, "op3_decontaminate": _OP3, "op7_revisits": _OP7}
