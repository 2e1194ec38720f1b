"""Rows that stages keep where ids are null or repeated and columns have the names used inside."""

from collections import Counter

import corpus_pipeline
import pytest
from credence.llm import decontaminate, langid, simhash

ITEM = " ".join(f"item{i}" for i in range(30))
NEAR = " ".join(f"near{i}" for i in range(400))
ROWS = [
    (None, f"start {ITEM} end"), (None, "a unique text of no id"), (5, ITEM), (5, "a clean text of the same id"), (6, NEAR), (6, "one more text of its own"),
    (7, NEAR), (8, ""), (9, None), (None, None), (6, NEAR), (10, "12 34"),
]
SCHEMA = "doc_id long, text string, lang string, lang_pred string, __gone long, gone_0 int, GONE_1 string, fingerprint string, row long, node int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "kept", 1, 2, "g", "f", 3, 4) for i, t in ROWS], SCHEMA).repartition(3)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_decontamination_by_row(spark, docs):
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    got = decontaminate.decontaminated(docs, bench, whole_ids=False)
    assert got.columns == docs.columns
    assert left(got) == Counter(r for r in ROWS if ITEM not in (r[1] or ""))
    whole = decontaminate.decontaminated(docs, bench)
    assert left(whole) == Counter(r for r in ROWS if r[0] != 5)


def test_simhash_by_row(docs):
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    # 8 and 9 have fingerprint zero, so they are near each other; rows of 6 with the text of 7 stay, as 6 is smaller
    assert left(got) == Counter(r for r in ROWS if r not in ((7, NEAR), (9, None)))


def test_many_items_that_share_shingles(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    items = [(k, f"{shared} own{k} own{k + 1} own{k + 2} own{k + 3} own{k + 4} own{k + 5}") for k in range(0, 400, 10)] + [(900, shared)]
    texts = [(k, f"before {t} after") for k, t in items] + [(1000, shared), (1001, "s0 s1 s2")]
    bench, data = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in texts for i, x in items if 5 * len(grams(t) & grams(x)) >= 4 * len(grams(x))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(data, bench).collect()} == want
    # what all items share is in no sketch that can do without it
    sketches = decontaminate.item_sketches(bench, "item_id", "text", 5, 0.8).collect()
    common = {r.item_id: r.sketch for r in sketches}[900]
    assert len(sketches) == len(items) and not any(set(common) & set(r.sketch) for r in sketches if r.item_id != 900)


def test_language_stage(spark, docs):
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and {r.lang_pred for r in got.collect()} == {"kept"}
    assert left(got) == Counter(r for r in ROWS if any(map(str.isalpha, r[1] or "")))


def test_nothing_to_learn_rejects_no_letters(spark, docs):
    none = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    got = corpus_pipeline.language_id(spark, none, "")
    assert left(got) == Counter(r for r in ROWS if any(map(str.isalpha, r[1] or "")))


def test_text_unlike_every_language_is_rejected(spark):
    rows = [(f"{w} the house and the road {w} with a view of the sea", "en") for w in map(str, range(60))]
    rows += [(f"{w} das Haus und die Strasse {w} mit einem Blick auf das Meer", "de") for w in map(str, range(60))]
    model = langid.fit(rows)
    assert not model.predict("the sea and the road")[3] and not model.predict("das Meer und die Strasse")[3]
    assert model.predict("123")[3]
    zero = langid.Model(model.languages, model.code, model.weights * 0, model.bias * 0, model.trust, model.scale)
    assert zero.predict("the sea and the road")[3]


def test_repeated_responses(spark):
    from credence.llm import warc

    full = [(1, "http://a.example/x", 10, "response", 200, t, None, {"x": t or "-"}, f"p{t}") for t in ('"a"', '"b"', '"b"', None)]
    asked = [(2, "http://a.example/x", 20, "revisit", 304, '"b"', None, None, None)] * 2
    data = spark.createDataFrame(full + asked, "record_id long, url string, at_s long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload_digest string")
    data = data.selectExpr("*", "timestamp_seconds(at_s) as at", "1 as tie", "2 as source").repartition(3)
    for size in (100_000, 1):
        rows = warc.resolve_revisits(data, range_rows=size).collect()
        assert [(r.status, r.resolved_id, r.headers, r.payload_digest) for r in rows] == [("resolved", 1, {"x": '"b"'}, 'p"b"')] * 2
