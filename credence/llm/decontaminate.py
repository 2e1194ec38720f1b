"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Items are distinct word-shingle sets, partitioned by size into powers of two.  An item's sketch is its smallest
shingle hashes, floor((1 - t) * size) + 1 of them: a document that contains a share t of the item misses at most
floor((1 - t) * size) shingles, so it holds at least one hash of the sketch, however long the document is.  Any
so many shingles would do, so those that many items have come last in that order, and few items share a hash.

Each partition has a bound, the largest hash of its sketches, and a need, the fewest shingles of a document that contains t of
its smallest item.  A document only looks up hashes up to the largest bound of the partitions whose need it meets, and
meets only items that are small enough for it.  Candidates are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import row_hash, shared_table, without_rows

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch hashes that are broadcast at most (about 24 MB); beyond it they meet the documents by shuffle.
BROADCAST_HASHES = 1_000_000
#: Shingles that more items than this have come last in the order of a sketch.
COMMON_ITEMS = 16
_NOT_WORD = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    n = F.size(words) - width + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, width), " "))


def _needed(size: Column, threshold: float) -> Column:
    """The fewest shared shingles that are ``threshold`` of ``size``, in whole numbers, as t isn't exact in binary."""
    return F.ceil(F.lit(round(threshold * 1_000_000)).cast("long") * size / F.lit(1_000_000)).cast("int")


def item_sketches(benchmark: DataFrame, item_col: str, text_col: str, width: int, threshold: float, common_items: int = COMMON_ITEMS) -> DataFrame:
    """(item_id, width, size, needed, shingles, sketch, size_class) of the items that have a word."""
    words = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    # an item of fewer words than a shingle is one shingle of all of them
    sized = words.withColumn("width", F.least(F.lit(width), F.size("w")))
    per = [F.when(F.col("width") == k, F.array_distinct(_shingles(F.col("w"), k))) for k in range(1, width + 1)]
    made = sized.select("item_id", F.xxhash64("item_id", "w").alias("item_row"), "width", F.coalesce(*per).alias("shingles"))
    made = shared_table(made.withColumn("size", F.size("shingles")).withColumn("needed", _needed(F.col("size"), threshold)), "items")
    each = made.select("item_row", "width", "size", "needed", F.explode(F.transform("shingles", lambda s: F.xxhash64(s))).alias("h"))
    often = each.groupBy("width", "h").agg(F.count("*").alias("items"))
    ranked = each.join(often, ["width", "h"]).select("item_row", "size", "needed", F.struct((F.col("items") > common_items).alias("common"), "h").alias("x"))
    chosen = ranked.groupBy("item_row").agg(F.slice(F.array_sort(F.collect_set("x")), F.lit(1), F.first("size") - F.first("needed") + 1).getField("h").alias("sketch"))  # of one item's shingles
    return made.join(chosen, "item_row").select("item_id", "width", "size", "needed", "shingles", "sketch", F.floor(F.log2("size")).cast("int").alias("size_class"))


def _found(data: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, threshold: float, broadcast_hashes: int) -> DataFrame:
    """(doc_id, row, item_id, n_shared, n_shingles) of data (doc_id, row, text): what each row contains."""
    items = shared_table(item_sketches(benchmark.filter(F.col(item_col).isNotNull()), item_col, item_text_col, width, threshold), "item-sketches")
    per_class = items.groupBy("width", "size_class").agg(F.max(F.array_max("sketch")).alias("bound"), F.min("needed").alias("need"), F.sum(F.size("sketch")).alias("hashes"))
    found = per_class.orderBy("width", "size_class").collect()  # a row for each width and power of two
    if not found:
        return data.select("doc_id", "row", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_shingles")).filter("false")
    widths = sorted({r.width for r in found})
    worded = data.select("row", words_of(F.col("text")).alias("w"))
    sketch = items.select("item_id", "width", "needed", F.explode("sketch").alias("h"))
    if sum(r.hashes for r in found) <= broadcast_hashes:
        sketch = F.broadcast(sketch)
    hits = []
    for k in widths:
        n = F.size("w") - k + 1
        bounds = [F.when(n >= r.need, F.lit(r.bound)) for r in found if r.width == k]
        bound = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
        probed = worded.select("row", "w", n.alias("n"), bound.alias("bound")).filter("bound is not null")
        kept = F.filter(F.transform(_shingles(F.col("w"), k), lambda s: F.xxhash64(s)), lambda h: h <= F.col("bound"))
        hits.append(probed.select("row", "n", F.explode(kept).alias("h"), F.lit(k).alias("width")))
    met = reduce(DataFrame.unionByName, hits).join(sketch, ["width", "h"]).filter("n >= needed")
    pairs = shared_table(met.select("row", "item_id").distinct(), "candidates")

    # the rows that have a candidate, and only their words
    own = data.join(pairs, "row").select("doc_id", "row", "item_id", words_of(F.col("text")).alias("w"))
    own = own.join(items.select("item_id", "width", "size", "needed", "shingles"), "item_id")
    per = [F.when(F.col("width") == k, F.size(F.array_intersect("shingles", _shingles(F.col("w"), k)))) for k in widths]
    exact = own.select("doc_id", "row", "item_id", F.coalesce(*per).alias("n_shared"), F.col("size").alias("n_shingles"), "needed")
    return exact.filter("n_shared >= needed").drop("needed")


def _data(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), row_hash(doc_id, text).alias("row"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every document that holds ``threshold`` of an item's shingles.

    Null texts and texts or items without a letter or digit match nothing; rows with a null id can't be named and
    give no result; rows that repeat an id count together as the best of them.  Extra columns are ignored.  Empty
    tables give no rows.
    """
    data = _data(docs, id_col, text_col).filter("doc_id is not null")
    exact = _found(data, benchmark, item_col, item_text_col, width, threshold, broadcast_hashes)
    best = exact.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.select("*", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = SHINGLE, threshold: float = THRESHOLD, broadcast_hashes: int = BROADCAST_HASHES, whole_ids: bool = True) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    With ``whole_ids`` an id names a document, so all rows go that repeat an id of which one row contains an item, and rows
    without an id stay.  Otherwise each row is judged by its own text, those of a null or repeated id too.  Rows without a word
    stay, and equal rows stay or go together.  If either table is empty, all rows stay.
    """
    rows = _data(docs, id_col, text_col)
    gone = _found(rows.filter("doc_id is not null") if whole_ids else rows, benchmark, item_col, item_text_col, width, threshold, broadcast_hashes)
    doc_id = F.col(id_col).cast("long")
    if whole_ids:
        gone = shared_table(gone.select("doc_id").distinct(), "contaminated")
        return without_rows(docs, gone, [doc_id])
    gone = shared_table(gone.select("doc_id", "row").distinct(), "contaminated")
    return without_rows(docs, gone, [doc_id, row_hash(doc_id, F.col(text_col).cast("string"))])
