"""SimHash near-duplicates with a vantage-point tree.

Fingerprints are 64-bit SimHashes of word shingles.  Equal fingerprints collapse to one class, then a
vantage-point tree partitions the classes by Hamming distance.  A node keeps a vantage fingerprint and a
radius; what lies within the radius goes inside, the rest outside.  By the triangle inequality two
fingerprints within ``max_bits`` of each other differ by at most ``max_bits`` in their distance to any
vantage, so only the outer ones within ``max_bits`` of the boundary are also sent inside, as guests, and
every other branch is pruned.

Each level makes some more guests, so the tree by which classes are shuffled is shallow and its leaves are large shards; the
owner of a shard grows the tree on over what it holds, down to small leaves, where homes are compared with homes and
guests, which meets each pair exactly once.  Links become components by alternating star contractions over shared tables.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import free_name, hex64, lookup, released, shared_table, ship, without_rows

#: At most so many fingerprints are fetched to choose vantage points and radii, and at most half of all.
TREE_SAMPLE = 8192
#: Mean number of classes that have their home in a shard, and in a leaf of its own tree.
SHARD_TARGET = 1 << 16
LEAF_TARGET = 256
#: Levels of the tree of shards: enough for some dozens of tasks, and no more than a broadcast tree of some MB.
MIN_DEPTH, MAX_DEPTH = 6, 18


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``width``-word shingle; ASCII lower case, words split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    grams = zip(*(words[i:] for i in range(width)), strict=False)
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", width: int = 3) -> DataFrame:
    """All columns of ``docs`` and after them, under ``name``, the unsigned fingerprint of each row's text as a signed long."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = (t for k in range(0, b.num_rows, 256) for t in b.column(at).slice(k, 256).cast(pa.binary()).to_pylist())
            fps = np.array([fingerprint(shingle_hashes(t, width)) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, name])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_fingerprint(picked, "fp", "text", width).select("doc_id", "fp")


class VantageTree:
    """A complete binary tree of ``depth`` levels: node i has children 2i+1 (inside) and 2i+2 (outside)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        size = (1 << depth) - 1
        self.vantage = np.empty(size, np.uint64)
        self.radius = np.empty(size, np.int16)
        parts: dict[int, np.ndarray] = {0: sample}
        for node in range(size):
            own = parts.pop(node, sample[:0])
            if len(own) >= 8:
                # of a few candidates, the one whose distances spread most tells most points apart
                tries = own[:: max(1, len(own) // 8)][:8]
                apart = [np.bitwise_count(own ^ v) for v in tries]
                best = int(np.argmax([d.std() for d in apart]))
                self.vantage[node], d = tries[best], apart[best]
                self.radius[node] = int(np.median(d))
            else:
                # below the sample: a pseudo-random vantage, which halves fingerprints that differ at random
                z = (node * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)
                z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
                z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
                self.vantage[node] = z ^ (z >> 31)
                self.radius[node] = 31
                d = np.bitwise_count(own ^ self.vantage[node])
            inside = d <= self.radius[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[inside], own[~inside]

    def route(self, fps: np.ndarray, max_bits: int, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for every leaf that a fingerprint lives in or visits as a guest; those not ``at_home`` only visit."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool) if at_home is None else at_home
        for _ in range(self.depth):
            d = np.bitwise_count(fps[row] ^ self.vantage[node]).astype(np.int16)
            r = self.radius[node]
            inside = d <= r
            guest_in = np.where(home, ~inside & (d <= r + max_bits), d <= r + max_bits)
            guest_out = ~home & (d > r - max_bits)
            stay, gi, go = np.flatnonzero(home), np.flatnonzero(guest_in), np.flatnonzero(guest_out)
            row_, node_ = row, node
            row = np.concatenate([row_[stay], row_[gi], row_[go]])
            node = np.concatenate([np.where(inside[stay], 2 * node_[stay] + 1, 2 * node_[stay] + 2), 2 * node_[gi] + 1, 2 * node_[go] + 2])
            home = np.concatenate([np.ones(len(stay), bool), np.zeros(len(gi) + len(go), bool)])
        return row, node, home


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in ``label``, which holds the smallest member of each one's set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def leaf_links(fp: np.ndarray, home: np.ndarray, label: np.ndarray, max_bits: int) -> None:
    """Join in ``label`` what is linked among the homes, and between them and the guests, of one leaf."""
    order = np.argsort(~home, kind="stable")
    fp, n_home = fp[order], int(home.sum())
    step = max(1, (1 << 22) // max(1, len(fp)))
    for at in range(0, n_home, step):
        block = fp[at : min(at + step, n_home), None]
        x, y = np.nonzero(np.bitwise_count(block ^ fp[None, at:]) <= max_bits)
        keep = y > x
        _union(label, order[at + x[keep]], order[at + y[keep]])


def shard_links(fp: np.ndarray, home: np.ndarray, max_bits: int, leaf_target: int = LEAF_TARGET) -> np.ndarray:
    """The smallest member of each one's set, after linking homes with homes and guests by a tree of the shard's own."""
    depth = max(0, int(np.ceil(np.log2(max(1, home.sum()) / leaf_target))))
    own = fp[home]
    tree = VantageTree(own[:: max(1, len(own) // TREE_SAMPLE)], depth)
    row, leaf, at_home = tree.route(fp, max_bits, home)
    order = np.argsort(leaf, kind="stable")
    row, leaf, at_home = row[order], leaf[order], at_home[order]
    cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]])) if len(leaf) else np.zeros(1, np.int64)
    label = np.arange(len(fp))
    for a, z in zip(cuts, cuts[1:], strict=False):
        members = row[a:z]
        inner = np.arange(z - a)
        leaf_links(fp[members], at_home[a:z], inner, max_bits)
        linked = np.flatnonzero(inner != np.arange(z - a))
        if len(linked):
            _union(label, members[linked], members[inner[linked]])
    return label


def near_links(classes: DataFrame, max_bits: int = 2, tree_sample: int = TREE_SAMPLE, leaf_target: int = SHARD_TARGET) -> DataFrame:
    """(a, b): links that join what fingerprints differing in at most ``max_bits`` bits join, of classes (rep, fp; both unique).

    Within a shard of about ``leaf_target`` homes, pairs are joined to sets at once, so a shard gives no more links than it has rows.
    """
    ship(classes.sparkSession)
    n = classes.count()
    # a bound on a hash takes about so many; sorting would send as many from every task
    rank = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = classes.select("fp").filter(rank < min(0.5, 0.9 * tree_sample / max(1, n))).limit(tree_sample).collect()
    depth = min(MAX_DEPTH, max(MIN_DEPTH, int(np.ceil(np.log2(max(1, n) / leaf_target)))))
    tree = VantageTree(np.array([r.fp for r in taken], np.int64).view(np.uint64), depth)

    def route(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1 << 14):
                rep, fp = b.column(0).slice(k, 1 << 14), b.column(1).slice(k, 1 << 14)
                at, leaf, home = tree.route(fp.to_numpy(zero_copy_only=False).view(np.uint64), max_bits)
                for j in range(0, len(at), 1 << 16):
                    take = pa.array(at[j : j + (1 << 16)])
                    yield pa.record_batch([pa.array(leaf[j : j + (1 << 16)].astype(np.int32)), rep.take(take), fp.take(take), pa.array(home[j : j + (1 << 16)])], ["leaf", "rep", "fp", "home"])

    def shard(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        label = shard_links(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False), max_bits)
        linked = np.flatnonzero(label != np.arange(len(rep)))
        return pa.table({"a": rep[linked], "b": rep[label[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    shards = classes.select("rep", "fp").mapInArrow(released(route), "leaf int, rep long, fp long, home boolean")
    return shards.groupBy("leaf").applyInArrow(shard, "a long, b long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of a link its smallest reachable node.

    Alternating large and small stars until nothing changes; each round is a table in the shared folder,
    so neither links nor components reach the driver, only one count and one checksum a round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = shared_table(edges, "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _components_of(prints: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Classes (fp, rep, rows) of prints (doc_id, fp), and (fp, component) of those that are linked; ``rep`` is the smallest id."""
    classes = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    linked = components(near_links(classes.select(F.col("fp").alias("rep"), "fp"), max_bits))
    return classes, shared_table(linked.select(F.col("node").alias("fp"), "component"), "linked-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    A null or empty text has fingerprint zero and is linked like any other.  A null id keeps its row and links others, but
    names no component; its component is the smallest id that its fingerprint reaches, or null.  Rows are linked by their
    texts, so those of one id may be in several components; repeated rows give repeated results.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    prints = shared_table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes, linked = _components_of(prints, max_bits)
    near = linked.join(classes, "fp")
    names = near.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = lookup(near, names, ["component"], "members", linked.count()).select("fp", "component_id", "rows")
    # a class of several rows that isn't linked; a single row that isn't linked needs no lookup
    alone = classes.filter("rows > 1").join(linked, "fp", "left_anti").select("fp", F.col("rep").alias("component_id"), "rows")
    joined = lookup(prints, named.unionByName(alone).withColumn("met", F.lit(True)), ["fp"], "rows", prints.count())
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), component.alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    A row is known by its id and fingerprint, so of a repeated id only the texts go that are near another; where one id has several
    of a component, the smallest fingerprint stays.  Rows with a null id and repeats of a row that stays are all kept.
    """
    prints = shared_table(fingerprints(docs, id_col, text_col, width).filter("doc_id is not null").distinct(), "fingerprints")
    _, linked = _components_of(prints, max_bits)
    member = F.struct("doc_id", "fp")
    rows = shared_table(prints.join(linked, "fp", "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("component")), "near-rows")
    kept = rows.groupBy("component").agg(F.min(member).alias("kept"), F.count("*").alias("members")).filter("members > 1")
    gone = lookup(rows, kept, ["component"], "members", rows.count()).filter(F.col("kept").isNotNull() & (member != F.col("kept"))).select("doc_id", "fp")
    name = free_name(docs.columns, "fingerprint")
    marked = with_fingerprint(docs.withColumn(text_col, F.col(text_col).cast("string")), name, text_col, width)
    return without_rows(marked, gone, [F.col(id_col).cast("long"), F.col(name)]).drop(name)
