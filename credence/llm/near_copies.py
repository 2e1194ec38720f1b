"""Near copies by SimHash, MinHash bands and an exact check: pairs whose 5-word shingles have a Jaccard similarity of 0.8.

The first links come as in op1, from 64-bit SimHashes that a vantage-point tree finds to differ in at most 2 bits, here those of the
distinct 5-word shingles.  A pair at the least similarity differs in 10 bits on average, a radius at which a tree prunes
nothing, so pairs beyond 2 bits are met in buckets: a document has 192 MinHashes in 32 bands of 6, and documents that agree in
a band share a bucket.  A pair at the least similarity shares none with a probability of 6e-5, a closer one with less.  Buckets are not compared pair by pair
at once: each member that its fingerprint hasn't linked is first checked against one for all its buckets, then, if it isn't known to belong with it, against a random member of
the commonest component of each of its buckets, which joins large groups of copies with few checks; at last all
pairs of a bucket are checked whose members are still in different components.  A check, also of what fingerprints link, compares the full sets of
shingle hashes, so what is linked is similar and no pair that shares a bucket is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import lookup, released, row_hash, shared_table, ship, without_rows
from credence.llm.simhash import components, fingerprint, near_links, shingle_hashes

WIDTH = 5
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 6
#: Fingerprints of so many different bits are near.
MAX_BITS = 2
#: Buckets of so many members are compared in full.
SMALL_BUCKET = 32
#: How often members go that have too few shingles in common with others, as each time the others are fewer.
NARROWINGS = 2


def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhashes(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(best, (short[None, at : at + 512] * multipliers).min(axis=1), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, rows by bands; bands have keys of their own."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = (key ^ parts[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def sketches(rows: DataFrame) -> DataFrame:
    """node, doc_id, n (distinct shingles), fp (their SimHash), keys of rows (node, doc_id, text); texts without words have none."""
    ship(rows.sparkSession)

    def run(batches):
        multipliers = _multipliers()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                hashes = [np.unique(shingle_hashes(t or b"", WIDTH)) for t in part.column(2).cast(pa.binary()).to_pylist()]
                has = [i for i, h in enumerate(hashes) if len(h)]
                if has:
                    keys = band_keys(np.stack([minhashes(hashes[i], multipliers) for i in has])).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                    sizes = pa.array([len(hashes[i]) for i in has], pa.int32())
                    prints = pa.array(np.array([fingerprint(hashes[i]) for i in has], np.uint64).view(np.int64))
                    yield pa.record_batch([part.column(0).take(pa.array(has)), part.column(1).take(pa.array(has)), sizes, prints, lists], ["node", "doc_id", "n", "fp", "keys"])

    return rows.mapInArrow(released(run), "node long, doc_id long, n int, fp long, keys array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """node and its distinct shingle hashes, of rows (node, text)."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return rows.mapInArrow(released(run), "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets are similar enough.

    Sets are compared one pair at a time, so that no batch of long ones is held; a node of very many pairs is a skewed join,
    which adaptive execution splits.
    """
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    n = F.size("of_a") + F.size("of_b")
    shared = both.select("a", "b", n.alias("n"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return shared.filter(F.col("shared") * LEAST[1] >= (F.col("n") - F.col("shared")) * LEAST[0]).select("a", "b")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): links between nodes of ``prints`` (node, n, fp) by equal fingerprints and by those that the vantage-point tree links.

    Each node meets one of its fingerprint's, and these meet along the tree's links, so there are at most two for a node.
    """
    one = F.min(F.struct("node", "n")).alias("one")
    classes = shared_table(prints.groupBy("fp").agg(one, F.count("*").alias("rows")).select("fp", F.col("one.node").alias("centre"), F.col("one.n").alias("m"), "rows"), "fingerprint-classes")
    same = lookup(prints.select("node", "n", "fp"), classes.filter("rows > 1"), ["fp"], "rows", prints.count()).filter("node <> centre")
    linked = near_links(classes.select(F.col("fp").alias("rep"), "fp"), MAX_BITS)
    of_a = classes.select(F.col("fp").alias("a"), F.col("centre").alias("node"), F.col("m").alias("n"))
    near = linked.join(of_a, "a").join(classes.select(F.col("fp").alias("b"), "centre", "m"), "b")
    return _pairs(same, "node", "centre").unionByName(_pairs(near, "node", "centre"))


def _labelled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    return buckets.join(found, "node", "left").select(*buckets.columns, F.coalesce("component", "node").alias("label"))


def _size(members: DataFrame) -> Column:
    """The sizes of the members' sets, where they are known."""
    return F.col("n") if "n" in members.columns else F.lit(None).cast("int")


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) of ``met``, but for those whose sets (of n and m) are known to differ too much in size to be similar."""
    near = F.least(_size(met), "m") * LEAST[1] >= F.greatest(_size(met), "m") * LEAST[0]
    return met.filter(F.coalesce(near, F.lit(True))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _commonest(members: DataFrame) -> DataFrame:
    """Of each bucket with several labels: key, its rows, the commonest label, and as ``c`` a random one of that label's members."""
    one = F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("centre"), _size(members).alias("m"))).alias("c")
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("held"), one)
    most = F.max(F.struct("held", "label", "c"))
    found = sizes.groupBy("key").agg(F.sum("held").alias("rows"), F.count("*").alias("labels"), most.alias("most")).filter("labels > 1")
    return found.select("key", "rows", F.col("most.label").alias("common"), F.col("most.c").alias("c"))


def star_pairs(members: DataFrame, n: int) -> DataFrame:
    """(a, b): each member of a bucket that hasn't its commonest label, and a random member that has.

    Where all have labels of their own that is the largest label's, so members that share many buckets have few such pairs.
    """
    centres = _commonest(members).select("key", "common", "c.centre", "c.m", "rows")
    return _pairs(lookup(members, centres, ["key"], "rows", n).filter("label <> common"), "node", "centre")


def cross_pairs(members: DataFrame, n: int, sets: DataFrame | None = None) -> DataFrame:
    """(a, b): all members of a bucket whose labels differ; those of its commonest label only with others.

    With ``sets``, pairs of large buckets go that can't be similar as too few of their shingles are anywhere else, and such a pair
    comes from one bucket.  The pairs of a small bucket are few for each member.
    """
    if sets is None:
        return _crossed(lookup(members, _commonest(members).drop("c"), ["key"], "rows", n), False)
    commonest = shared_table(_commonest(members).drop("c"), "commonest-labels")
    few = _crossed(lookup(members, commonest.filter(F.col("rows") <= SMALL_BUCKET), ["key"], "rows", n), False)
    large = commonest.filter(F.col("rows") > SMALL_BUCKET)
    if large.isEmpty():
        return few
    mixed = lookup(members, large, ["key"], "rows", n).filter("common is not null").drop("common")
    for _ in range(NARROWINGS):
        mixed = shared_table(_viable(mixed, n, sets), "viable-members")
    mixed = shared_table(lookup(mixed, _commonest(mixed).drop("c"), ["key"], "rows", n).filter("common is not null"), "mixed-members")
    mixed = mixed.join(mixed.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")  # of a node's bands
    return few.unionByName(_crossed(mixed, True)).distinct()


def _crossed(mixed: DataFrame, narrow: bool) -> DataFrame:
    """Pairs of members with ``common``, their bucket's commonest label; if ``narrow``, only those that may be similar, from their first bucket."""
    mixed = mixed.filter("common is not null")
    can, more = F.lit(True), []
    if narrow:
        can = _may_be_similar(F.col("n"), F.col("m"), F.col("s"), F.col("t")) & (F.array_min(F.array_intersect("keys", "others")) == F.col("key"))
        more = [F.col("s").alias("t"), F.col("keys").alias("others")]
    few = mixed.filter("label <> common").select("key", F.col("node").alias("other"), F.col("label").alias("of"), _size(mixed).alias("m"), *more)
    return _pairs(mixed.join(few, "key").filter("label <> of and (label = common or node < other)").filter(can), "node", "other")


def _viable(members: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """The members of buckets with several labels that may be similar to something in their bucket, and s, what others may share."""
    mixed = lookup(members.drop("s"), _commonest(members).select("key", "rows", F.lit(True).alias("several")), ["key"], "rows", n).filter("several").drop("several")
    mixed = shared_table(mixed.join(shareable(mixed.select("node", "label").distinct(), sets), "node"), "mixed-members")
    # what there is in each bucket: for each s the least size, so as many as there are sizes and not members
    least = mixed.groupBy("key", "s").agg(F.min("n").alias("m"), F.count("*").alias("held"))
    there = least.groupBy("key").agg(F.collect_list(F.struct(F.col("s").alias("t"), "m")).alias("there"), F.sum("held").alias("rows"))
    kept = lookup(mixed, there, ["key"], "rows", n).filter(F.exists("there", lambda x: _may_be_similar(F.col("n"), x["m"], F.col("s"), x["t"])))
    return kept.drop("there")


def _may_be_similar(n: Column, m: Column, s: Column, t: Column) -> Column:
    """Whether sets of sizes n and m may be similar, of which s and t elements are all that others have.

    What they share is at most the smaller of these, and the rest of both is in their union.
    """
    shared = F.least(s, t)
    return shared * LEAST[1] >= (n + m - shared) * LEAST[0]


def shareable(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node and s, the number of its shingles that a node of another label has, of nodes (node, label) that have any."""
    each = nodes.join(sets, "node").select("node", "label", F.explode("shingles").alias("x"))
    met = each.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("x")
    return each.join(met, "x", "left_semi").groupBy("node").agg(F.count("*").cast("int").alias("s"))


def _near(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes, by one link of each: the largest of its neighbours and itself."""
    near = links.unionByName(links.toDF("b", "a")).groupBy("a").agg(F.max("b").alias("b"))
    return near.select(F.col("a").alias("node"), F.greatest("a", "b").alias("component"))


def _checked(pairs: DataFrame, sets: DataFrame, links: DataFrame | None) -> DataFrame:
    """``links``, and the similar ones of ``pairs``."""
    more = similar(shared_table(pairs, "near-pairs"), sets)
    return shared_table(more if links is None else more.unionByName(links), "near-links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component of near copies, with all their columns.

    A row is known by its id and text, so of repeated ids only the texts that are copies go; equal rows stay or go
    together.  Rows with a null id and texts without words stay.
    """
    node = row_hash(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    named = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(node.alias("node"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = shared_table(sketches(named), "sketches")
    each = prints.select("node", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("size", F.col("rows"))
    buckets = lookup(each, shared, ["key"], "rows", prints.count() * BANDS).filter("size is not null")
    buckets = shared_table(buckets.select("key", "node", "n").distinct(), "buckets")
    n = buckets.count()
    met = shared_table(fingerprint_pairs(prints.select("node", "n", "fp")), "fingerprint-pairs")
    inside = buckets.select("node").unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = shared_table(shingle_sets(named.join(inside, "node", "left_semi").dropDuplicates(["node"]).select("node", "text")), "shingle-sets")
    # a label stands for nodes that are known to be in one component; finer ones only cost more checks
    links = _checked(met, sets, None)
    for choose, label in ((star_pairs, _near), (star_pairs, _near), (cross_pairs, components)):
        members = shared_table(_labelled(buckets, shared_table(label(links), "near-components")), "bucket-members")
        links = _checked(star_pairs(members, n) if choose is star_pairs else cross_pairs(members, n, sets), sets, links)
    found = shared_table(components(links), "near-components")
    ids = found.join(prints.select("node", "doc_id").distinct(), "node")
    kept = ids.groupBy("component").agg(F.min(F.struct("doc_id", "node"))["node"].alias("kept"))
    gone = ids.join(kept, "component").filter("node <> kept").select("node")
    return without_rows(docs, gone, [node])
