"""The whole pipeline against plain Python, near copies being those with a Jaccard similarity of 0.8 over five words."""

from collections import Counter

import corpus_pipeline
from credence.llm.catalog import tokenizer_path
from tests.llm.test_near_copies import alike
from tests.llm.test_operators import norm, plain_words, shingles
from tokenizers import Tokenizer


def test_run(spark, tmp_path):
    text = lambda k: " ".join(f"lorem{k}x{i} ipsum" for i in range(80))
    item = " ".join(f"bench{i}" for i in range(25))
    rows = [(0, text(0), "en"), (1, text(0), "en"), (2, text(0).replace(" ", "  "), "fr"), (3, None, "en"), (4, "123 456", "en"), (5, text(5) + " last", "fr"), (6, f"{text(6)} {item}", "fr"), (None, text(77), "en"), (None, f"only here {item}", "fr")]
    rows += [(10 + k, text(k), "en" if k % 2 else "fr") for k in range(20, 40)] + [(50, text(21) + " x", "en"), (60, text(22).replace("x3 ", "y ").replace("x60 ", "z "), "fr"), (61, text(22)[: len(text(22)) // 2], "en"), (31, "another text of a repeated id", "en"), (0, f"a second one, with {item} in it", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, _ in rows if any(map(str.isalpha, t or ""))]
    best = {}
    for i, t in left:
        best[norm(t)] = min(best.get(norm(t), (1, 0, 0)), (-len(t), i is None, i))
    left = [(i, t) for i, t in left if best[norm(t)][2] == i]
    label = list(range(len(left)))
    for _ in left:
        for a, (i, t) in enumerate(left):
            for b, (j, u) in enumerate(left):
                if None not in (i, j) and alike(t, u):
                    label[a] = label[b] = min(label[a], label[b])
    low = {c: min(i for (i, _), x in zip(left, label, strict=True) if x == c and i is not None) for (i, _), c in zip(left, label, strict=True) if i is not None}
    left = [(i, t) for (i, t), c in zip(left, label, strict=True) if i is None or low[c] == i]
    left = [(i, t) for i, t in left if 5 * len(shingles(plain_words(item), 5) & shingles(plain_words(t), 5)) < 4 * len(shingles(plain_words(item), 5))]
    kept = {i for i, _ in left}
    assert not kept & {1, 3, 4, 6, 50, 60} and kept >= {2, 5, 31, 61, None} and (31, "another text of a repeated id") in left

    t = Tokenizer.from_file(tokenizer_path())
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, x in left:
        n = len(t.encode(x, add_special_tokens=False).ids) + 1
        want[i, n] += n
    assert got == want
