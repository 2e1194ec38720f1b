"""Weighted rendezvous sharding; DataFrame functions only.

Every record scores each shard with -weight / ln(u), u being a hash of its key and the shard's name as a number in
(0, 1); the highest score wins.  A new shard changes no other score, so it takes records only into itself,
and a record's place depends on its key and the weighted shards alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import shared_table

#: Rows of one numbering block; blocks are hashed, so none holds many times more.
BLOCK_ROWS = 20_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 ..) of ``key``, null keys included (they hash like any other value)."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    scores = [score(s, w) for s, w in enumerate(weights) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def shard_records(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes and the crc of nothing.  Slots number a
    shard's rows from 0 without gaps: rows are numbered within hashed blocks of bounded size and the blocks'
    counts are summed up per shard, so no shard is gathered in one task.  Null and repeated ids are placed like
    any other key.  Extra columns are ignored; an empty table gives an empty result.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    grown = rendezvous(F.col("doc_id"), [*weights, grown_weight if grown_weight is not None else sum(weights) / len(weights)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))
    blocks = max(1, docs.count() // BLOCK_ROWS)
    # null ids and copies of a row are spread over the blocks by what else they hold
    rows = shared_table(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int")), "shard-rows")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("rank", F.row_number().over(inside)).join(starts, ["shard", "block"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
