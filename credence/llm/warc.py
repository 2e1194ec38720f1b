"""WARC server-not-modified revisits, resolved by an as-of join on the canonical URL.

A revisit takes the latest earlier full response of its URL, if the validators agree: equal entity tags (weak
comparison), or, where either has none, equal Last-Modified dates.  The 304 response may then renew some header
fields of the stored one; fields that describe the stored body stay.

The join sorts records by (URL, time) into ranges and carries each range's last full response of a URL
over to the following ranges, so one URL may fill many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import shared_table

# Fields of a 304 that never replace those of the stored response.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
# Query parameters that track visits.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
#: Records of one sorted range, on average.
RANGE_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """Scheme-less, lower-case host without ``www.`` and default port, no fragment, tracking parameters or final slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(u, "\\?(.*)$", 1), "(^|&)(" + "|".join(TRACKING) + ")=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each revisit: record_id, url, resolved_id, status, headers, payload_digest.

    ``records`` has record_id long, url string, at timestamp, kind string (``response`` or ``revisit``), status int, etag string,
    last_modified string, headers map<string,string> with lower-case names, payload_digest string.  Only responses with
    status 200 are full.  "Earlier" is by (at, record_id).  Status is
    ``resolved``, ``mismatch`` (the validators differ, or neither is there on both), or ``missing``.  Revisits with a null URL or time are ``missing``;
    responses with either are not used.  Repeated records are resolved each, and of
    responses repeated with one id and time the last by validators, digest and fields is the one that counts.  Other columns are ignored.
    """
    picked = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", "status", "etag", "last_modified", "headers", "payload_digest")
    placed = picked.filter("canonical is not null and at is not null")
    # as many ranges as the cluster has shuffle partitions, and more where they would hold more rows than that
    n_ranges = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // range_rows)
    ranged = placed.repartitionByRange(n_ranges, "canonical", "at", "record_id").withColumn("range", F.spark_partition_id())
    # of records repeated with one id, time and URL, the last in this order counts, one without a validator first
    fields = F.array_sort(F.map_entries(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    rows = shared_table(ranged.withColumn("tie", F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in ("etag", "last_modified", "payload_digest")], F.to_json(fields))), "warc-ranges")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    source = F.struct("at", "record_id", "etag", "last_modified", "headers", "payload_digest")
    rows = rows.withColumn("source", F.when(full, source))
    earlier = Window.partitionBy("range", "canonical").orderBy("at", "record_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("near", F.last("source", ignorenulls=True).over(earlier))
    # the last full response of each URL in each range, and by carrying, before each range
    ends = rows.filter(full).groupBy("canonical", "range").agg(F.max(F.struct("at", "record_id", "tie")).alias("end"))
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spots = rows.select("canonical", "range").distinct().join(ends, ["canonical", "range"], "left")
    carried = spots.withColumn("carry", F.last("end", ignorenulls=True).over(before)).filter("carry is not null").select("canonical", "range", F.col("carry.at").alias("c_at"), F.col("carry.record_id").alias("c_id"), F.col("carry.tie").alias("c_tie"))
    sources = rows.filter(full).select(F.col("canonical").alias("s_url"), F.col("at").alias("s_at"), F.col("record_id").alias("s_id"), F.col("tie").alias("s_tie"), "source").dropDuplicates(["s_url", "s_at", "s_id", "s_tie"])
    carried = carried.join(sources, (F.col("canonical") == F.col("s_url")) & (F.col("c_at") == F.col("s_at")) & (F.col("c_id") == F.col("s_id")) & (F.col("c_tie") == F.col("s_tie"))).select("canonical", "range", F.col("source").alias("far"))
    asked = local.filter("kind = 'revisit'").drop("source").join(carried, ["canonical", "range"], "left").withColumn("found", F.coalesce("near", "far"))

    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agree = F.when(tags, weak_tag(F.col("etag")) == weak_tag(F.col("found.etag"))).when(dates, F.col("last_modified") == F.col("found.last_modified")).otherwise(False)
    status = F.when(F.col("found").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    renewed = F.map_filter(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(KEPT_FIELDS))
    stored = F.coalesce(F.col("found.headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    merged = F.map_concat(kept, renewed)
    ok = F.col("state") == "resolved"
    done = asked.withColumn("state", status).select("record_id", F.col("canonical").alias("url"), F.when(ok, F.col("found.record_id")).alias("resolved_id"), F.col("state").alias("status"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("found.payload_digest")).alias("payload_digest"))
    lost = picked.filter("kind = 'revisit' and (canonical is null or at is null)")
    none = lost.select("record_id", F.col("canonical").alias("url"), F.lit(None).cast("long").alias("resolved_id"), F.lit("missing").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return done.unionByName(none)
