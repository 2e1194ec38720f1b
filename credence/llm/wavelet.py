"""Token files as wavelet matrices.

A shard's ids are stored as one bit-plane per bit, from the highest down; after each plane the ids with a 0
come before those with a 1, in order.  With counts of ones at regular steps, a plane answers rank and select,
and one file answers access, counting and occurrence lookup without being decoded.

File format (little-endian): magic ``CWM1``, u32 bits, u64 tokens, u64 documents, u64 zeros of each plane;
i64 ids of the documents, with their nulls as a bitmap before; u64 token counts of the documents; then for each plane
the u64 words of its bits and the u32 ones before each block of BLOCK words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.llm.common import fresh_path, released, shared_table, ship

MAGIC = b"CWM1"
#: 64-bit words between two counts.
BLOCK = 8
#: Ids that are moved at a time, so that they and their places stay in a core's cache.
PART = 1 << 15
#: Files whose tokens are summed up together.
FILES_A_RUN = 4096
#: Mean size of the texts of one shard.
SHARD_BYTES = 16_000_000


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    words = -(-len(bits) // 64)
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(words * 8 - len(packed), np.uint8)]).view("<u8")


def _parted(ids: np.ndarray, ones: np.ndarray, into: np.ndarray, spare: np.ndarray) -> int:
    """Put the ids with a 0 in order into ``into``, and those with a 1 after them; returns the number of the former."""
    z = o = 0
    for at in range(0, len(ids), PART):
        some, own = ones[at : at + PART], ids[at : at + PART]
        zero, one = np.flatnonzero(~some), np.flatnonzero(some)
        # these places are all there, and "clip" writes without a buffer
        np.take(own, zero, out=into[z : z + len(zero)], mode="clip")
        np.take(own, one, out=spare[o : o + len(one)], mode="clip")
        z, o = z + len(zero), o + len(one)
    into[z:] = spare[:o]
    return z


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of ``ids``, the concatenated tokens of documents with these lengths."""
    bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    zeros, planes = [], []
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    after, spare = np.empty_like(now), np.empty_like(now)
    for level in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)) != 0
        words = _pack_bits(ones)
        counts = np.bitwise_count(words).astype(np.uint64)
        before = np.concatenate([[0], np.cumsum(counts)])[:-1][::BLOCK].astype("<u4")
        planes += [words.tobytes(), before.tobytes()]
        zeros.append(_parted(now, ones, after, spare))
        now, after = after, now
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little").tobytes()
    head = MAGIC + struct.pack("<IQQ", bits, len(ids), len(lengths)) + struct.pack(f"<{bits}Q", *zeros)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([head, nulls, named, np.asarray(lengths, "<u8").tobytes(), *planes])


class WaveletMatrix:
    """A shard's file, queried in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.bits, self.n, self.docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        self.zeros = struct.unpack_from(f"<{self.bits}Q", data, at)
        at += 8 * self.bits
        n_nulls = -(-self.docs // 8)
        nulls = np.unpackbits(np.frombuffer(data, np.uint8, n_nulls, at), bitorder="little")[: self.docs].astype(bool)
        at += n_nulls
        self.doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(data, "<i8", self.docs, at).tolist(), nulls.tolist(), strict=True)]
        at += 8 * self.docs
        self.lengths = np.frombuffer(data, "<u8", self.docs, at).astype(np.int64)
        at += 8 * self.docs
        words = -(-self.n // 64)
        steps = -(-words // BLOCK)
        self.words, self.before = [], []
        for _ in range(self.bits):
            self.words.append(np.frombuffer(data, "<u8", words, at))
            at += 8 * words
            self.before.append(np.frombuffer(data, "<u4", steps, at))
            at += 4 * steps

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits."""
        word, bit = divmod(i, 64)
        block = word // BLOCK
        if block >= len(self.before[plane]):
            return self.n - self.zeros[plane]
        ones = int(self.before[plane][block]) + int(np.bitwise_count(self.words[plane][block * BLOCK : word]).sum())
        return ones + (int(self.words[plane][word]) & ((1 << bit) - 1)).bit_count() if bit else ones

    def _select(self, plane: int, one: bool, k: int) -> int:
        """The position of the k-th (from 0) one or zero."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if one else mid + 1 - ones) <= k:
                low = mid + 1
            else:
                high = mid
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            one = (int(self.words[plane][i // 64]) >> (i % 64)) & 1
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if one else i - ones
            value = 2 * value + one
        return value

    def count(self, token: int, end: int | None = None, start: int = 0) -> int:
        """How often ``token`` occurs in positions start to end."""
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            one = (token >> (self.bits - 1 - plane)) & 1
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            low, high = (self.zeros[plane] + a, self.zeros[plane] + b) if one else (low - a, high - b)
        return low, high

    def locate(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for plane in range(self.bits - 1, -1, -1):
            one = bool((token >> (self.bits - 1 - plane)) & 1)
            i = self._select(plane, one, i - self.zeros[plane] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last up."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        up = np.empty_like(values)
        for plane in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.words[plane].view(np.uint8), bitorder="little")[: self.n].view(bool)
            z, o = 0, self.zeros[plane]
            values[o:] |= values.dtype.type(1 << (self.bits - 1 - plane))
            for at in range(0, self.n, PART):
                some, own = ones[at : at + PART], up[at : at + PART]
                zero, one = np.flatnonzero(~some), np.flatnonzero(some)
                own[zero] = values[z : z + len(zero)]
                own[one] = values[o : o + len(one)]
                z, o = z + len(zero), o + len(one)
            values, up = up, values
        return values.astype(np.uint32)


#: Schemes that Hadoop and Arrow call differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def _uri(path: str) -> str:
    """A path as Spark writes it, as Arrow does."""
    scheme, _, rest = path.partition(":/")
    if not rest or "/" in scheme:
        return "file://" + path
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{_SCHEMES.get(scheme, scheme)}://{rest.lstrip('/')}"


def _open(path: str):
    """The file system of a path and the path in it; any store that Arrow knows by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path)) if ":/" in path else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files of ``docs`` under ``path`` in ascending id order; returns their manifest, already made.

    (shard, file, documents, tokens), one row per file.  A null text has the end id only, null ids come first, and rows
    of a null or repeated id stay, ordered by a hash of their texts, so that those of one id may fill several files.  Each attempt at a task writes a file of its own, named once it is complete, and the manifest
    has the files of the attempts that counted, so tasks may be lost and run again.  An empty table gives no files.
    """
    ship(docs.sparkSession)
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    place = ["doc_id", F.xxhash64("text")]
    ordered = data.repartitionByRange(shards, *place).sortWithinPartitions(*place, "text")

    def run(batches):
        from pyspark import TaskContext

        from credence.llm.tokens import bounded, encoder

        enc, task = encoder(tokenizer_path), TaskContext.get()
        end = np.array([end_id], np.uint32)
        ids, lengths, names = [], [], []
        for b in batches:
            names += b.column(0).to_pylist()
            for at, n in bounded(b.column(1)):
                for own in enc.encode([t or "" for t in b.column(1).slice(at, n).to_pylist()]):
                    ids += [own, end]
                    lengths.append(len(own) + 1)
        if names:
            made = build(np.concatenate(ids), np.array(lengths), names)
            store, folder = _open(path)
            store.create_dir(folder, recursive=True)
            shard = task.partitionId()
            file = f"shard-{shard:08d}-{task.taskAttemptId()}.cwm"
            part = f"{folder}/.{file}"
            with store.open_output_stream(part) as out:
                out.write(made)
            store.move(part, f"{folder}/{file}")
            yield pa.record_batch([[shard], [file], [len(names)], [sum(lengths)]], ["shard", "file", "documents", "tokens"])

    return shared_table(ordered.mapInArrow(released(run), "shard long, file string, documents long, tokens long"), "token-manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of ``manifest``."""
    ship(manifest.sparkSession)
    # tokens before each file: those of whole runs of files, of which there is a row for FILES_A_RUN, and those within its run
    runs = manifest.withColumn("run", F.floor(F.col("shard") / FILES_A_RUN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("run").agg(F.sum("tokens").alias("tokens"))
    starts = totals.select("run", F.coalesce(F.sum("tokens").over(before(Window.orderBy("run"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("run").orderBy("shard"))), F.lit(0))
    placed = runs.withColumn("within", within).join(starts, "run").withColumn("first", F.col("base") + F.col("within"))

    def run(batches):
        store, folder = _open(path)
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{file}") as f:
                    shard = WaveletMatrix(f.read())
                data = shard.decode().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = placed.select("file", "first")
    tasks = max(1, manifest.count())
    return files.repartition(tasks).mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files of ``docs`` in the shared folder and read every document back from them."""
    path = fresh_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, path, tokenizer_path, **options), path)
