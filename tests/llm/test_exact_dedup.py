"""Which rows exact deduplication leaves where ids are null or come again."""

from collections import Counter

from credence.llm import exact_dedup


def test_rows_that_stay(spark):
    rows = [(1, "a b"), (2, "ab"), (None, "a b"), (None, "only here"), (None, "and here"), (2, "of id 2 only"), (3, "c"), (3, "d e"), (4, "d  e"), (5, "c"), (None, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    want = [(1, "a b"), (None, "only here"), (None, "and here"), (2, "of id 2 only"), (3, "c"), (4, "d  e"), (6, "")]
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_rows_of_null_ids_only(spark):
    rows = [(None, "a"), (None, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in exact_dedup.deduplicated(docs).collect()) == Counter(rows)


def test_the_directory_decides_the_file(spark):
    rows = [(i, f"text {i % 300}" + " " * (i % 3)) for i in range(1200)] + [(5000 + i, "one hot text") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    entries, found, path = exact_dedup.build_index(docs, capacity=4, hot_rows=100)
    index = spark.read.parquet(path).collect()
    assert found.depth >= 6 and sum(r.group_size for r in index) == len(rows) and len(index) == 301
    for r in index:
        bucket = found.slots[(r.h % 2**64) >> (64 - found.depth)]
        assert r.bucket == bucket and r.owner == found.owners[bucket]
    assert found.owners == sorted(found.owners) and len({r.owner for r in index}) == 4  # a range of keys each
    held = Counter(r.owner for r in index)
    assert max(held.values()) < 2 * min(held.values())
    # with another directory the rows aren't found where it points
    plain = Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, capacity=4, hot_rows=100).collect())
    assert plain == Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs, capacity=1 << 20).collect())
    moved = exact_dedup.Directory(found.depth, found.slots[::-1], found.owners)
    at = moved.placed(entries).join(spark.read.parquet(path), ["owner", "bucket", "h", "text_sha256"])
    assert at.count() < len(rows) // 4


def test_owners_get_rows_in_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "text as norm", "xxhash64(text) as h", "1L as rows")
    found = exact_dedup.Directory(0, [0], [0])
    told = found.placed(rows).repartitionById(4, "owner").groupBy("owner", "bucket", "h", "norm").count()
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1
