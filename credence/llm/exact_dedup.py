"""Exact duplicates through an extendible-hash index kept in shared files; DataFrame functions only.

Keys are 64-bit hashes of the normalised text.  The directory starts with one bucket and doubles whenever an
overfull bucket needs a bit more than the directory has, so it follows the keys, not the rows: copies of one
text are one key.  Each owner task has a range of buckets, which is a range of keys, with about as many keys as any other; rows are
dealt to the owner of their key's bucket, who compares their bytes, chains the texts that collide on a hash, and writes its
range as a file set of its own.  Documents then find their bucket and its owner in the directory and look themselves up there.

Keys with very many rows are combined before they are dealt out, so each map task sends one row of such a text.  Those are
few by pigeonhole, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credence.llm.common import fresh_path, lookup, shared_table, without_rows

#: ASCII white space, deleted before texts are compared.
SPACE = "[\\x20\\x09-\\x0D]+"
#: The directory has at most 2 ** MAX_DEPTH slots, whatever the input, so it may be broadcast.  Beyond 2 ** 26 keys
#: buckets hold more than BUCKET_KEYS, in proportion to the keys.
MAX_DEPTH = 16
BUCKET_KEYS = 4096
#: Keys with more rows than this, and than one row in HOT_KEYS, are combined first; there are at most HOT_KEYS of them.
HOT_ROWS = 1000
HOT_KEYS = 1_000_000

_BASE = "36893488147419103232BD"  # 2 ** 65
_TOP = "9223372036854775808BD"  # 2 ** 63


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def directory(counts: dict[int, int], capacity: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and the bucket of each slot, from the number of keys under each ``max_depth``-bit prefix.

    Bucket numbers grow with the key range, so ranges of buckets are ranges of keys.  A bucket at the depth
    limit may overflow; its keys are chained like any others.
    """
    at = [0] * (1 << max_depth)
    for prefix, n in counts.items():
        at[prefix] += n
    below = [at]
    while len(below[0]) > 1:
        level = below[0]
        below.insert(0, [level[i] + level[i + 1] for i in range(0, len(level), 2)])
    buckets, todo, depth = [], [(0, 0)], 0
    while todo:
        local, prefix = todo.pop()
        if below[local][prefix] > capacity and local < max_depth:
            depth = max(depth, local + 1)  # the directory doubles when this exceeds its depth
            todo += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            buckets.append((local, prefix))
    slots = [k for k, (local, _) in enumerate(buckets) for _ in range(1 << (depth - local))]
    return depth, slots


def _packed(points: Column, doc_id: Column) -> Column:
    """One number whose maximum is the row to keep: most code points, then smallest id, null ids last."""
    low = F.coalesce(F.expr(_TOP) - doc_id.cast("decimal(20,0)"), F.expr("0BD")).cast("decimal(20,0)")
    return (points.cast("decimal(18,0)") * F.expr(_BASE).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _unpacked(packed: Column) -> Column:
    low = (packed % F.expr(_BASE).cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.when(low > 0, (F.expr(_TOP).cast("decimal(38,0)") - low).cast("long"))


@dataclass(frozen=True)
class Directory:
    """The bucket of each slot, a slot being the first ``depth`` bits of a key, and the owner of each bucket."""

    depth: int
    slots: list[int]
    owners: list[int]

    def slot(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.depth).cast("int") if self.depth else F.lit(0)

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of their ``h`` and its owner."""
        schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("slot", "bucket", "owner")])
        table = rows.sparkSession.createDataFrame([(k, b, self.owners[b]) for k, b in enumerate(self.slots)], schema)
        return rows.withColumn("slot", self.slot(F.col("h"))).join(F.broadcast(table), "slot").drop("slot")


def _directory(spark: SparkSession, keys: DataFrame, capacity: int) -> Directory:
    prefix = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    counts = {r.p: r.n for r in keys.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    depth, slots = directory(counts, max(capacity, total >> (MAX_DEPTH - 2)))
    held = [0] * (slots[-1] + 1)
    for p, n in counts.items():
        held[slots[p >> (MAX_DEPTH - depth)]] += n
    tasks, before, owners = int(spark.conf.get("spark.sql.shuffle.partitions")), 0, []
    for n in held:
        owners.append(min(tasks - 1, (before + n // 2) * tasks // max(1, total)))
        before += n
    return Directory(depth, slots, owners)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, Directory, str]:
    """The rows' keys (doc_id, h, text_sha256), the directory, and where the index is: a folder ``owner=...`` for each range of buckets."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("norm"), F.length(text).alias("points"))
    # written once, as normalising takes longer than reading it back
    rows = shared_table(base.withColumns({"h": F.xxhash64("norm"), "text_sha256": F.sha2(F.col("norm").cast("binary"), 256)}), "exact-rows")
    keys = shared_table(rows.groupBy("h").agg(F.count("*").alias("n")), "exact-keys")
    found = _directory(spark, keys, capacity)

    each = rows.select("h", "norm", "text_sha256", F.lit(1).cast("long").alias("rows"), _packed(F.col("points"), F.col("doc_id")).alias("best"))
    hot = F.broadcast(keys.filter(F.col("n") > max(hot_rows, rows.count() // HOT_KEYS)).select("h"))
    same = ["h", "norm", "text_sha256"]
    whole = [F.sum("rows").alias("rows"), F.max("best").alias("best")]
    dealt = each.join(hot, "h", "left_semi").groupBy(*same).agg(*whole).unionByName(each.join(hot, "h", "left_anti"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = found.placed(dealt).repartitionById(tasks, "owner")
    # partitioned by owner already, so neither bytes nor chains are shuffled again
    told = owned.groupBy("owner", "bucket", *same).agg(*whole)
    chained = told.select("owner", "bucket", "h", "text_sha256", F.col("rows").alias("group_size"), _unpacked(F.col("best")).alias("keep_id"))
    place = Window.partitionBy("owner", "bucket", "h").orderBy("text_sha256")
    path = fresh_path(spark, "exact-index")
    chained.withColumn("chain", F.row_number().over(place)).sortWithinPartitions("owner", "bucket", "h", "chain").write.partitionBy("owner").parquet(path)
    return rows.select("doc_id", "h", "text_sha256"), found, path


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    A null text counts as empty.  Of equal texts the row with the most code points stays, then the smallest id;
    null ids come last, and a group of null ids only has a null keep_id.  Rows repeated with the id that stays
    are all kept.  Extra columns are ignored; an empty table gives an empty result.
    """
    entries, found, path = build_index(docs, id_col, text_col, capacity, hot_rows)
    schema = "bucket int, h long, text_sha256 string, group_size long, keep_id long, chain int, owner int"
    index = docs.sparkSession.read.schema(schema).parquet(path).filter("group_size > 1")
    index = index.select("owner", "bucket", "h", "text_sha256", "keep_id", "group_size", F.col("group_size").alias("rows"))
    at = lookup(found.placed(entries), index, ["owner", "bucket", "h", "text_sha256"], "rows", entries.count())
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return at.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows with a null id stay only where no other copy has an id.

    A row goes by its id and text, so what else has its id, or also a null one, isn't touched.  Rows of one text repeated
    with the id that stays are all kept, as are those of a text that only null ids have.
    """
    gone = exact_duplicates(docs, id_col, text_col).filter("not kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    return without_rows(docs, gone, [F.col(id_col).cast("long"), sha])
