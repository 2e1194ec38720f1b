"""The operators against brute force, on small documents with every awkward case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.llm import decontaminate, exact_dedup, langid, license, packing, sharding, simhash, substring, warc, wavelet
from credence.llm.catalog import tokenizer_path
from credence.llm.tokens import Encoder

SPACE = " \t\n\v\f\r"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (0, "Hello there, World!"), (1, None), (2, ""), (3, "Hello  there,\nWorld!"), (4, " \t\n"), (5, LONG), (6, LONG), (7, BASE),
    (8, BASE + " tail one two"), (9, "x " + BASE), (10, "one"), (11, "one two"), (None, "Hello there, World!"), (None, None), (7, BASE),
    (12, "日本語 テキスト é÷"), (13, "a  b\n\n c\td"), (14, "<|endoftext|> don't"), (-5, "negative"), (15, "hellothere,world!"), (16, "y" * 5000),
]
SCHEMA = "doc_id long, text string, norm string, batch int, h long, fp string, shard string, words string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "n", 1, 2, "f", "s", "w") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes_are_those_of_spark(spark):
    texts = ["", "a", "één twee", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in rows] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        words = words.replace(c, " ")
    words = words.split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    prints = [brute_print(t) for _, t in DOCS]
    component = list(range(len(DOCS)))
    changed = True
    while changed:
        changed = False
        for i in range(len(DOCS)):
            for j in range(len(DOCS)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and component[j] < component[i]:
                    component[i], changed = component[j], True
    name = {c: min((d for (d, _), k in zip(DOCS, component, strict=True) if k == c and d is not None), default=None) for c in component}
    want = Counter((d, f"{p:016x}", name[c]) for (d, _), p, c in zip(DOCS, prints, component, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_vantage_tree_misses_no_pair(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    near = base[:150] ^ (np.int64(1) << rng.integers(0, 62, 150)) ^ (np.int64(1) << rng.integers(0, 62, 150))
    fps = np.unique(np.concatenate([base, near, base[:80] ^ 7]))
    classes = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps)], "rep long, fp long").repartition(3)
    links = simhash.near_links(classes, bits, tree_sample=64, leaf_target=8)
    got = dict(simhash.components(links).collect())
    label = list(range(len(fps)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= bits]
    for _ in range(len(fps)):
        before = label[:]
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert got == {i: label[i] for p in pairs for i in p}


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(3)
    assert {tuple(r) for r in simhash.components(links).collect()} == {(i, 0) for i in range(301)}


def norm(text):
    return "".join(c for c in text or "" if c not in SPACE)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in DOCS:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    want = Counter()
    for d, t in DOCS:
        own = groups[norm(t)]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[d, keep, len(own), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    for capacity in (1, 4096):
        got = exact_dedup.exact_duplicates(docs, capacity=capacity)
        assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert len(exact_dedup.deduplicated(docs).columns) == len(docs.columns)


@given(st.dictionaries(st.integers(0, 255), st.integers(1, 40)), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_extendible_directory(counts, capacity):
    depth, slots = exact_dedup.directory(counts, capacity, 8)
    assert len(slots) == 1 << depth and slots == sorted(slots)
    held = Counter()
    for prefix, n in counts.items():
        held[slots[prefix >> (8 - depth)]] += n
    for bucket, n in held.items():
        assert n <= capacity or slots.count(bucket) == 1 and depth == 8
    if depth:  # the directory never doubles without need
        assert any(slots.count(b) == 1 for b in slots)


BENCH = [(0, "The quick brown fox jumps over the lazy dog near the old river bank today"), (1, "tiny item"), (2, None), (3, ""), (4, " ".join(f"b{i}" for i in range(50))), (None, "no name at all here now"), (5, "?!")]


def shingles(words, k):
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_decontamination(spark, docs, empty, limit):
    b50 = [f"b{i}" for i in range(50)]
    rows = [(100, "prefix " * 500 + BENCH[0][1].upper() + " suffix" * 500), (101, " ".join(b50)), (102, " ".join(b50[:40])), (103, " ".join(b50[:42])), (104, "a tiny item here"), (105, None), (None, BENCH[0][1]), (106, " ".join(b50[:25] + ["zz"] + b50[25:])), (106, "other")]
    data = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = set()
    for d, t in rows + DOCS:
        for i, x in BENCH:
            w = plain_words(x)
            if not w or i is None or d is None:
                continue
            s = shingles(w, min(5, len(w)))
            n = len(s & shingles(plain_words(t), min(5, len(w))))
            if n * 5 >= len(s) * 4:
                want.add((d, i, n, len(s)))
    got = decontaminate.contaminated(data, bench, broadcast_hashes=limit)
    assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want)
    assert {d for d, *_ in want} >= {100, 101, 103, 104}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(data, bench.filter("false")).count() == 0
    left = decontaminate.decontaminated(data, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows + DOCS} - {d for d, *_ in want}


def brute_windows(rows, width=13):
    first = {}
    order = lambda d: float("inf") if d is None else d
    cut = []
    for d, t in rows:
        words = (t or "").encode().split()
        cut.append((d, words))
        for i in range(len(words) - width + 1):
            k = tuple(words[i : i + width])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = Counter()
    for d, words in cut:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < order(d):
                gone[i : i + width] = [True] * width
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[d, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("batch", "span"), [(4_000_000, 1_000_000), (2000, 50)])
def test_substring(spark, docs, empty, batch, span):
    more = [(200 + i, f"own{i} " + " ".join(f"s{j}" for j in range(i, i + 40)) + f" end{i}") for i in range(30)]
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = substring.remove_repeats(data, batch_bytes=batch, range_windows=span, with_text=True)
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_windows(DOCS + more)
    for r in rows:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))
    assert substring.remove_repeats(empty).count() == 0


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_rolling_hashes(digits, width):
    got = substring.rolling_hashes(np.array(digits, np.uint64) * np.uint64(0x123456789ABCDEF1), width)
    windows = [tuple(digits[i : i + width]) for i in range(len(digits) - width + 1)]
    assert len(got) == len(windows)
    same = defaultdict(set)
    for h, w in zip(got.tolist(), windows, strict=True):
        same[w].add(h)
    assert all(len(x) == 1 for x in same.values()) and len({h for x in same.values() for h in x}) == len(same)


def test_sharding(docs, empty, spark):
    rows = sharding.shard_records(docs, [1.0] * 24).collect()
    assert len(rows) == len(DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in DOCS)
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    big = sharding.shard_records(spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), [1.0] * 23 + [2.0]).collect()
    for found in (rows, big):
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = Counter(r.shard for r in big)
    assert all(abs(n[k] - 2400) < 300 for k in range(23)) and abs(n[23] - 4800) < 400
    moved = sum(r.grown_shard != r.shard for r in big)
    assert abs(moved - 60_000 / 25) < 400
    assert sharding.shard_records(empty, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0.0])


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path(), kept_words=50)


@given(st.lists(st.text(alphabet="ab é÷'.,!5\n\t  日\0", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_encoder_gives_the_tokenizers_ids(encoder, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, empty, encoder):
    rows = packing.pack_tokens(docs, tokenizer_path(), flush_items=5).collect()
    tokens = Counter()
    for d, t in DOCS:
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            part = np.array(ids[start : start + 1024], "<u4")
            tokens[d, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == tokens
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) <= 1024 and len(own) <= 64 and sum(r.loss_tokens for r in own) <= 1024
    assert packing.pack_tokens(empty, tokenizer_path()).count() == 0


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 40)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_dot_product_pack(items):
    demand = np.array([(t, 1, min(t, x)) for t, x in items], np.int64).reshape(-1, 3)
    capacity = np.array([64, 6, 40])
    bins = packing.dot_product_pack(demand, capacity)
    used = np.zeros((len(items) + 1, 3), np.int64)
    np.add.at(used, bins, demand)
    assert (used <= capacity).all()
    if len(items):
        assert set(bins.tolist()) == set(range(int(bins.max()) + 1))


def test_packing_leaves_little_padding():
    lengths = np.random.default_rng(3).integers(1, 1024, 4000)
    demand = np.stack([lengths, np.ones_like(lengths), lengths - 1], axis=1)
    bins = packing.dot_product_pack(demand, packing.Limits().vector())
    assert lengths.sum() / (1024 * (bins.max() + 1)) > 0.99


@given(st.lists(st.integers(0, 300), max_size=700), st.integers(0, 300))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids, token):
    w = wavelet.WaveletMatrix(wavelet.build(np.array(ids, np.uint32), np.array([len(ids)]), [None]))
    assert w.decode().tolist() == ids and w.doc_ids == [None]
    assert [w.access(i) for i in range(0, len(ids), 37)] == ids[::37]
    assert w.count(token) == ids.count(token) and w.count(token, len(ids) // 2) == ids[: len(ids) // 2].count(token)
    at = [i for i, x in enumerate(ids) if x == token]
    assert [w.locate(token, k) for k in range(len(at))] == at


@pytest.mark.parametrize("size", [16_000_000, 30_000])
def test_token_files(docs, empty, encoder, size):
    rows = wavelet.token_files(docs, tokenizer_path(), shard_bytes=size).collect()
    want = Counter()
    for d, t in DOCS:
        ids = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows[:-1]]))
    named = [r.doc_id for r in rows if r.doc_id is not None]
    assert named == sorted(named)
    assert wavelet.token_files(empty, tokenizer_path()).count() == 0


def test_licences(spark, docs, empty):
    model = license.train(docs)
    texts = [t for family in license.TEMPLATES.values() for t in family]
    data = spark.createDataFrame([(i, f"Some text before.\n{t}\nand after") for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "The driver must show a valid license at the border.\nMIT is a university")], "doc_id long, text string")
    rows = license.scan(data, model).collect()
    want = [f for f, family in license.TEMPLATES.items() for _ in family]
    got = {r.doc_id: r.family for r in rows if r.paragraph == 1}
    right = sum(got.get(i) == f for i, f in enumerate(want))
    assert right >= 0.95 * len(want) and not {900, 901, 902} & {r.doc_id for r in rows}
    assert all(r.confirmed for r in rows if r.paragraph == 1)
    for r in rows:  # the scan is the model, paragraph by paragraph
        family, p = model.predict(data.filter(F.col("doc_id") == r.doc_id).first().text.split("\n")[r.paragraph])
        assert family == r.family and p == pytest.approx(r.probability, abs=1e-9)
    assert license.scan(empty, model).count() == 0
    assert license.scan(docs, model).count() == 0


def test_revisits(spark):
    rng = np.random.default_rng(1)
    hosts = ["http://WWW.a.example/x/", "https://a.example:443/x?utm_source=q#top", "http://b.example/y?k=1&ref=z", "http://b.example/y?k=1"]
    canonical = ["a.example/x", "a.example/x", "b.example/y?k=1", "b.example/y?k=1"]
    rows, plain = [], []
    for i in range(400):
        k = int(rng.integers(0, 4))
        kind = "response" if rng.random() < 0.4 else "revisit"
        at, status = int(rng.integers(0, 50)), 200 if kind == "response" and rng.random() < 0.8 else 404 if kind == "response" else 304
        tag = [None, '"a"', 'W/"a"', '"b"'][int(rng.integers(0, 4))]
        date = [None, "d1", "d2"][int(rng.integers(0, 3))]
        headers = {"content-type": f"t{i}", "x": str(i)} if rng.random() < 0.9 else None
        rows.append((i, hosts[k], at, kind, status, tag, date, headers, f"p{i}" if kind == "response" else None))
        plain.append((i, canonical[k], *rows[-1][2:]))
    rows += [(900, None, 5, "revisit", 304, None, None, None, None), (901, hosts[0], None, "revisit", 304, None, None, None, None)]
    data = spark.createDataFrame(rows, "record_id long, url string, at_s long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload_digest string")
    data = data.withColumn("at", F.timestamp_seconds("at_s")).withColumn("range", F.lit("clash"))
    want = {900: ("missing", None, None), 901: ("missing", None, None)}
    for i, url, at, kind, _, tag, date, headers, _ in plain:
        if kind != "revisit":
            continue
        full = max((r for r in plain if r[1] == url and r[3] == "response" and r[4] == 200 and (r[2], r[0]) < (at, i)), key=lambda r: (r[2], r[0]), default=None)
        if full is None:
            want[i] = ("missing", None, None)
            continue
        strip = lambda t: t.removeprefix("W/")
        agree = strip(tag) == strip(full[5]) if tag and full[5] else bool(date and date == full[6])
        merged = (full[7] or {}) | {k: v for k, v in (headers or {}).items() if k != "content-type"}
        want[i] = ("resolved", full[0], merged) if agree else ("mismatch", None, None)
    for size in (100_000, 20):
        got = {r.record_id: (r.status, r.resolved_id, r.headers) for r in warc.resolve_revisits(data, range_rows=size).collect()}
        assert got == want
    assert warc.resolve_revisits(data.filter("false")).count() == 0


@pytest.fixture(scope="module")
def languages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_id_on_held_out_documents(languages):
    model = langid.train(languages)
    rows = langid.predictions(languages, model).filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 250 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "es"} and all(0 <= r.lang_score <= 1 for r in rows)


def test_language_id_edges(spark, docs, empty):
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 8, "xx").otherwise("yy"))
    model = langid.train(labelled)
    got = {r.doc_id: r.lang_pred for r in langid.predictions(labelled, model).collect()}
    assert got[1] == got[2] == got[4] == "und" and got[0] in ("xx", "yy")
    assert langid.predictions(empty, model).count() == 0
    nothing = langid.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predictions(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code.tolist()}) == n and all(len(set(c)) == 2 for c in code.T.tolist())
    assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= code.shape[1] // 3
