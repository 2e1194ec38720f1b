"""Near copies against all pairs, in plain Python."""

import random

import corpus_pipeline
import numpy as np
import pytest
from credence.llm import near_copies
from tests.llm.test_operators import shingles


def alike(a, b):
    a, b = (shingles(t.lower().split(), 5) or {t.lower()} for t in (a, b))
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def rows():
    """Pairs on both sides of the bound, a chain, a group around one text, null and repeated ids, and short texts."""
    rng = random.Random(4)
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]

    def changed(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            w[i] = f"z{rng.random()}"
        return w

    texts = []
    for k in range(60):
        base = words(k, 300)
        texts += [base, changed(base, k % 12 + 1)]
    chain = words("c", 200)
    for _ in range(6):
        texts.append(chain)
        chain = changed(chain, 3)
    hub = words("h", 150)
    texts += [changed(hub, rng.randint(0, 4)) for _ in range(120)]
    texts += [["one"], ["ONE"], ["two", "words"]]
    rng.shuffle(texts)
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    same = " ".join(words("s", 100))
    return [*out, (None, same), (None, out[0][1]), (900, same), (900, "a text of its own with a repeated id"), (901, same + " more"), (902, ""), (903, None)]


def test_near_copies_are_all_found(spark, rows):
    label = list(range(len(rows)))
    named = [i for i, (d, t) in enumerate(rows) if d is not None and t]
    pairs = [(i, j) for i in named for j in named if j < i and alike(rows[i][1], rows[j][1])]
    before = None
    while label != before:
        before = label[:]
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    low = {}
    for i in named:
        low[label[i]] = min(low.get(label[i], (1 << 40, 0)), (rows[i][0], i))
    want = [r for i, r in enumerate(rows) if i not in named or low[label[i]][1] == i]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for found in (near_copies.deduplicated(docs), corpus_pipeline.near_dedup(spark, docs, "")):
        assert found.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in found.collect()), key=order) == sorted(want, key=order)
    assert near_copies.deduplicated(docs.filter("false")).count() == 0


def test_all_pairs_of_different_labels(spark):
    data = [(k, n, n % 3 if k else n) for k in (0, 1) for n in range(9)]
    members = spark.createDataFrame(data, "key long, node long, label long")
    want = {(a, b) for k, a, x in data for j, b, y in data if k == j and a < b and x != y}
    assert {tuple(r) for r in near_copies.cross_pairs(members, len(data)).collect()} == want


def test_fingerprints_link_near_copies(spark, rows, monkeypatch):
    """Without any bucket, what op1's method links goes, and nothing that isn't similar."""
    from credence.llm.simhash import fingerprint, shingle_hashes

    none = lambda members, *_: members.select(members.node.alias("a"), members.node.alias("b")).filter("false")
    monkeypatch.setattr(near_copies, "star_pairs", none)
    monkeypatch.setattr(near_copies, "cross_pairs", none)
    long = " ".join(f"v{i} v{i % 7}" for i in range(3000))
    some = [(d, t) for d, t in rows if d is not None and d < 900] + [(1000 + k, f"{long} {'x ' * k}") for k in range(4)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    left = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    assert len(left) < len(some) and left & {1000, 1001, 1002, 1003} == {1000}
    prints = {d: fingerprint(np.unique(shingle_hashes(t.encode(), 5))) for d, t in some}
    text = dict(some)
    for d in set(text) - left:
        assert any(o != d and alike(text[d], text[o]) for o in text)
    for d, t in some:
        if any(o < d and prints[d] == prints[o] and alike(t, u) for o, u in some):
            assert d not in left
