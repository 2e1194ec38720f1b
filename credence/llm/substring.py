"""Repeated token windows, removed where an earlier document has them too.

Every window of ``width`` words gets a Rabin-Karp hash: the words' own hashes as digits of a number in an odd base,
modulo 2 ** 64, rolled over the document.  Documents are dealt to batches by a hash of their id and text.  A batch sends each of
its distinct window hashes once, with the smallest id that has it, packed into one row for each range of hashes that it has;
so a passage that many documents share is one entry per batch, and work and traffic are in proportion to the windows.  The
owner of a range counts them and answers the batches in which a window's smallest id is not the smallest of all.  A batch then knows for each of its windows whether a document with a
smaller id has it, merges those windows into maximal intervals and removes their words.

Two windows of different batches are taken for the same if the lower 56 bits of their hashes and their ranges
agree, which together are 56 bits and the logarithm of the number of ranges, up to 64.  Windows travel packed because a Spark row
for each would be some 28 bytes against 8, and go twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import released, ship

#: Text bytes of a batch, and windows of a hash range, on average.
BATCH_BYTES = 4_000_000
RANGE_WINDOWS = 1_000_000
#: Bytes of a hash that are sent; the range it is sent to tells most of the rest.
SENT = 7
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15


def rolling_hashes(digits: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all ``width``-long windows of ``digits``, mixed so that every bit depends on all."""
    n = len(digits) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(_BASE)
    # doubling: a window of 2k digits from two of k; then the binary digits of the width put together
    power, step, made, size = base, digits, None, 0
    left, span = width, 1
    while left:
        if left & 1:
            if made is None:
                made, size = step, span
            else:
                shift = np.uint64(pow(_BASE, span, 1 << 64))
                m = len(digits) - (size + span) + 1
                made = made[:m] * shift + step[size : size + m]
                size += span
        left >>= 1
        if left:
            m = len(step) - span
            step = step[:m] * power + step[span : span + m]
            power = power * power
            span *= 2
    h = made[:n].copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _windows(texts: list[bytes], width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, hashes of all windows that lie in one text, and each window's first word in the batch."""
    from xxhash import xxh64_intdigest

    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum())
    digits = np.fromiter((xxh64_intdigest(x) for w in words for x in w), np.uint64, total)
    with np.errstate(over="ignore"):
        hashes = rolling_hashes(digits, width)
    ends = np.repeat(np.cumsum(lengths), lengths)[: len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) + width <= ends)
    return words, hashes[inside], inside


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _short(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]).tobytes()


def _long(data: bytes, number: int) -> np.ndarray:
    """What was sent to range ``number``, the range's last byte put on top."""
    low = np.frombuffer(data, np.uint8).reshape(-1, SENT)
    full = np.full((len(low), 8), number & 255, np.uint8)
    full[:, :SENT] = low
    return full.view("<u8").reshape(-1)


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the smallest id of each."""
    order = np.argsort(hashes)
    h, d = hashes[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.minimum.reduceat(d, first) if len(h) else d


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, batch_bytes: int = BATCH_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, intervals (and kept_text) for every row of ``docs``.

    Words are runs of anything but ASCII white space; a null text has none.  ``intervals`` lists the maximal
    [start, end) word ranges that were removed.  A null id counts as larger than any other; rows with the same id
    never remove words from each other.  Extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    data = every.filter("text <> ''")
    total = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, -(-total // batch_bytes))
    n_ranges = max(1, total // 6 // range_windows)
    # by the text too, so that null and repeated ids are spread; rows of one id have no need to meet
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int")
    dealt = data.withColumn("batch", batch).repartition(n_batches, "batch")

    def smallest(texts: list[bytes], ids: np.ndarray):
        words, hashes, at = _windows(texts, width)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        return words, hashes, at, owner, ids[owner[at]]

    def arrays(table):
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        return ids, texts

    def send(batches):
        def packed(tables):
            table = pa.Table.from_batches(tables)
            for number in np.unique(table.column("batch").to_numpy()).tolist():
                own = table.filter(pa.compute.equal(table.column("batch"), number))
                ids, texts = arrays(own)
                _, hashes, _, _, id_of = smallest(texts, ids)
                h, d = _least(hashes, id_of)
                # sorted by hash, so each range of hashes is a slice; by id within it, which packs ids best
                of = _ranges(h, n_ranges)
                cuts = _edges(of)
                rows = []
                for a, z in zip(cuts, cuts[1:], strict=False):  # ranges that have windows
                    k, x, y = int(of[a]), h[a:z], d[a:z]
                    order = np.argsort(y, kind="stable")
                    x, y = x[order], y[order]
                    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
                    runs = np.diff(np.append(first, len(y))).astype("<u4")
                    rows.append((k, number, _short(x), y[first].tobytes(), runs.tobytes()))
                for at in range(0, len(rows), 256):
                    cols = list(zip(*rows[at : at + 256], strict=True))
                    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["range", "batch", "hashes", "ids", "runs"])

        # the rows of a batch come together or not; a batch seen in parts is answered in parts, which is right too
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= 4 * batch_bytes:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    def answer(table: pa.Table) -> pa.Table:
        """To each batch, the hashes of which another batch has a smaller id."""
        numbers = table.column("batch").to_pylist()
        number = table.column("range")[0].as_py()
        hashes = [_long(x, number) for x in table.column("hashes").to_pylist()]
        ids = [np.repeat(np.frombuffer(i, np.int64), np.frombuffer(r, "<u4")) for i, r in zip(table.column("ids").to_pylist(), table.column("runs").to_pylist(), strict=True)]
        h, d = np.concatenate(hashes), np.concatenate(ids)
        source = np.repeat(np.arange(len(numbers)), [len(x) for x in hashes])
        order = np.lexsort((d, h))
        h, d, source = h[order], d[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(first, len(h)))
        home = np.array(numbers)[source]
        late = (d > np.repeat(d[first], counts)) & (home != np.repeat(home[first], counts))
        h, source = h[late], source[late]
        order = np.argsort(source, kind="stable")
        h, source = h[order], source[order]
        cuts = _edges(source)
        to, late = [numbers[k] for k in source[cuts[:-1]].tolist()], [_short(h[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"batch": pa.array(to, pa.int32()), "range": pa.array([number] * len(to), pa.int32()), "late": pa.array(late, pa.binary())})

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = arrays(left)
        words, hashes, at, owner, id_of = smallest(texts, ids)
        elsewhere = np.unique(np.concatenate([np.empty(0, np.uint64), *(_long(x, k) for k, x in zip(right.column("range").to_pylist(), right.column("late").to_pylist(), strict=True))]))
        order = np.argsort(hashes)
        h, d = hashes[order], id_of[order]
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts = np.diff(np.append(first, len(h)))
            here = np.repeat(np.minimum.reduceat(d, first), counts)
            sent = (h[first] & np.uint64((1 << 8 * SENT) - 1)) | ((_ranges(h[first], n_ranges) & np.uint64(255)) << np.uint64(8 * SENT))
            known = np.repeat(np.isin(sent, elsewhere), counts)
            repeated = np.sort(at[order[known | (d > here)]])
        else:
            repeated = np.empty(0, np.int64)
        marks = np.zeros(len(owner) + 1, np.int32)
        np.add.at(marks, repeated, 1)
        np.add.at(marks, np.minimum(repeated + width, len(owner)), -1)
        gone = np.cumsum(marks[:-1]) > 0
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "intervals": [], "kept_text": []}
        begin = 0
        for own in words:
            off = gone[begin : begin + len(own)]
            begin += len(own)
            spans = []
            if off.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
                spans = edge.reshape(-1, 2).tolist()
                keep, last = [], 0
                for a, z in spans:
                    keep += own[last:a]
                    last = z
                keep += own[last:]
            else:
                keep = own
            text = b" ".join(keep)
            out["n_words"].append(len(own))
            out["n_removed"].append(len(own) - len(keep))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["intervals"].append([{"start": a, "end": z} for a, z in spans])
            out["kept_text"].append(text)
        spans_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = {"doc_id": left.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "intervals": pa.array(out["intervals"], spans_t)}
        if with_text:
            made["kept_text"] = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
        return pa.table(made)

    sent = dealt.mapInArrow(released(send), "range int, batch int, hashes binary, ids binary, runs binary")
    answers = sent.groupBy("range").applyInArrow(answer, "batch int, range int, late binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:int,end:int>>" + (", kept_text string" if with_text else "")
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, schema)
    none = every.filter("text is null or text = ''")  # of which a third of all rows may be, so they aren't dealt
    zero, blank = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    empty = [zero.alias("n_words"), zero.alias("n_removed"), blank.alias("kept_sha256"), F.array().cast("array<struct<start:int,end:int>>").alias("intervals")]
    return done.unionByName(none.select("doc_id", *empty, *([F.lit("").alias("kept_text")] if with_text else [])))
