"""Conversations packed under three limits at once; shards by a plain computation; shards of token files."""

import math
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from credence.llm import packing, sharding, wavelet
from credence.llm.catalog import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.mark.parametrize("limits", [packing.Limits(128, 64, 40), packing.Limits(400, 3, 400), packing.Limits(64, 2, 8)])
def test_conversations(spark, limits):
    real = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [(-1, 0, "user", None), (-1, 1, "assistant", "a reply " * 300), (None, 0, "user", "nobody asked"), (-2, 0, "assistant", ""), (-3, 0, None, "x"), (-3, 0, None, "x")]
    turns = real.unionByName(spark.createDataFrame(more, real.schema)).withColumn("length", F.lit(1)).repartition(3)
    t = Tokenizer.from_file(tokenizer_path())
    bears = defaultdict(list)  # whether each id of a conversation bears loss
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn)):
        bears[r.conv_id] += [r.role == "assistant"] * (len(t.encode(r.text or "", add_special_tokens=False).ids) + 1)
    rows = packing.pack_conversations(turns, tokenizer_path(), limits, flush_items=50).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.conv_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == bears.keys()
    for conv, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(bears[conv]) == own[0].conv_tokens
        assert all(r.loss_tokens == sum(bears[conv][r.start : r.start + r.length]) for r in own)
    bound = Counter()
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        used = sum(r.length for r in own), len(own), sum(r.loss_tokens for r in own)
        assert all(u <= c for u, c in zip(used, limits.vector().tolist(), strict=True))
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        bound.update(k for k, (u, c) in enumerate(zip(used, limits.vector().tolist(), strict=True)) if u == c)
    # each limit stops some sequence in one of the cases: loss in the first, pieces in the second
    assert bound[2 if limits.loss_tokens < limits.tokens else 1] > 0
    assert packing.pack_conversations(turns.filter("false"), tokenizer_path(), limits).count() == 0


def test_shards_by_plain_rendezvous(spark):
    weights = [1.0, 2.0, 0.0, 0.5, 1.0]
    keys = [None, 0, -7, *range(1, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.rendezvous(F.col("k"), weights).alias("shard"))

    def plain(key):
        text = "\0null" if key is None else str(key)
        best = None
        for shard, w in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(text.encode(), 42))
            if w:
                score = -w / math.log(((h >> 11) + 0.5) / 2**53)
                best = max(best or (score, -shard), (score, -shard))
        return -best[1]

    assert {r.k: r.shard for r in df.collect()} == {k: plain(k) for k in keys}


def test_an_id_of_many_rows_fills_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"text number {i} of the many") for i in range(400)], "doc_id long, text string").repartition(3)
    manifest = wavelet.write_shards(docs, str(tmp_path), tokenizer_path(), shard_bytes=1500)
    assert manifest.count() >= 6 and manifest.agg(F.max("documents")).first()[0] < 200
    rows = sorted(wavelet.read_shards(manifest, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows] == [None] * 200 + [7] * 200


def test_stores_by_their_uris():
    from pyarrow import fs

    for path in ("/tmp/x", "file:/tmp/x", "file:///tmp/x"):
        store, folder = wavelet._open(path)
        assert isinstance(store, fs.LocalFileSystem) and folder == "/tmp/x"
    assert wavelet._uri("s3a://some-bucket/folder/x") == "s3://some-bucket/folder/x"
    assert wavelet._uri("hdfs://host:8020/x") == "hdfs://host:8020/x"
