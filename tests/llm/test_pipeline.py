"""The pipeline against its stages, one by one, in plain Python."""

import numpy as np
import pytest

import corpus_pipeline
from credence.llm.catalog import tokenizer_path
from tests.llm.test_operators import brute_print, norm, plain_words, shingles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    text = lambda k: " ".join(f"lorem{k}x{i} ipsum" for i in range(80))
    rows = [(0, text(0), "en"), (1, text(0), "en"), (2, text(0).replace(" ", "  "), "fr"), (3, None, "en"), (4, "123 456", "en"), (5, text(5) + " last", "fr"), (6, text(6) + " " + text(99), "fr")]
    rows += [(10 + k, text(k), "en" if k % 2 else "fr") for k in range(20, 40)] + [(50, text(21) + " x", "en"), (None, text(77), "en")]
    made = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, text(99)), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [text(99)]


def test_stages(spark, tables):
    folder, rows, bench = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = [(i, t) for i, t, _ in rows if any(map(str.isalpha, t or ""))]
    groups = {}
    for i, t in left:
        groups.setdefault(norm(t), []).append((-len(t), i is None, i))
    left = [(i, t) for i, t in left if min(groups[norm(t)])[2] == i]
    prints = [brute_print(t) for _, t in left]
    linked = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(len(left)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    linked[a] = linked[b] = min(linked[a], linked[b])
    low = {}
    for (i, _), c in zip(left, linked, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    left = [(i, t) for (i, t), c in zip(left, linked, strict=True) if i is None or low[c] == i]
    items = [shingles(plain_words(b), 5) for b in bench]
    left = [(i, t) for i, t in left if i is None or not any(5 * len(s & shingles(plain_words(t), 5)) >= 4 * len(s) for s in items)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert {r.doc_id: int(np.int64(r.doc_tokens)) for r in corpus_pipeline.run(spark, folder).collect()} == want
