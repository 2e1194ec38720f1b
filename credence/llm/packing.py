"""Vector bin packing of token sequences under simultaneous limits.

Each example has a demand vector (tokens, segments, loss-bearing tokens) and each sequence a capacity vector.
One sequence is filled at a time: of the examples that still fit, the one whose demand has the largest dot
product with what is left of the capacity goes in, until nothing fits.  Examples with equal demand are
interchangeable, so the choice is made among distinct demands, not among examples.

A map task tokenizes and packs what it reads, in flushes of bounded size; nothing is shuffled, and only
the last sequences of a flush carry padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import released, ship

#: Examples packed together; bounds a task's memory.
FLUSH_ITEMS = 20_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.int64)


def dot_product_pack(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item; ``demand`` is (items, dimensions), each row within ``capacity``."""
    if len(demand) == 0:
        return np.empty(0, np.int64)
    if (demand > capacity).any():
        raise ValueError("an item exceeds the capacity")
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    members = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    next_at = np.concatenate([[0], np.cumsum(left)[:-1]])
    scaled = kinds / capacity
    bins = np.empty(len(demand), np.int64)
    open_kinds, number = np.arange(len(kinds)), 0
    while len(open_kinds):
        rest = capacity.copy()
        while True:
            fits = open_kinds[(kinds[open_kinds] <= rest).all(axis=1)]
            if not len(fits):
                break
            best = int(fits[np.argmax(scaled[fits] @ (rest / capacity))])
            bins[members[next_at[best]]] = number
            next_at[best] += 1
            left[best] -= 1
            rest = rest - kinds[best]
            if left[best] == 0:
                open_kinds = open_kinds[open_kinds != best]
        number += 1
    return bins


def _packed_bins(demand: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items in the order of their bins, their bins, and the tokens before each in its bin."""
    bins = dot_product_pack(demand, limits.vector())
    order = np.argsort(bins, kind="stable")
    length = demand[order, 0]
    run_end = np.cumsum(length)
    at = bins[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    base = np.maximum.accumulate(np.where(first, run_end - length, 0))
    return order, at, run_end - length - base


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits, end_id: int = 0, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", flush_items: int = FLUSH_ITEMS) -> DataFrame:
    """One row per piece of a conversation: conv_id, start, length, loss_tokens, conv_tokens, sequence_id, offset.

    A conversation's ids are those of its turns in order, each ended by ``end_id``; only ids of turns of ``loss_role`` bear loss.  A
    piece ends where a limit on tokens or loss is reached or the conversation ends.  Null texts are the end id alone; turns of a null
    id make one conversation, and repeated turns all stay.  Extra columns are ignored; an empty table gives no rows.
    Sequences hold at most ``limits`` of tokens, pieces and loss-bearing tokens at once.
    """
    ship(turns.sparkSession)
    if limits.segments < 1 or limits.tokens < 1 or limits.loss_tokens < 1:
        raise ValueError("limits must be positive")
    schema = "conv_id long, start long, length long, loss_tokens long, conv_tokens long, sequence_id long, offset long"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        from credence.llm.tokens import bounded, encoder

        enc, next_id, rest = encoder(tokenizer_path), TaskContext.get().partitionId() << 40, []
        conv, at, begin, loss = None, 0, 0, 0  # of the conversation that is being read
        pieces: list[tuple] = []  # of it, (start, length, loss)

        def close():
            nonlocal begin, loss
            if at > begin:
                pieces.append((begin, at - begin, loss))
            rest.extend((conv, a, n, x, at) for a, n, x in pieces)
            pieces.clear()

        def packed():
            nonlocal next_id
            demand = np.array([(r[2], 1, r[3]) for r in rest], np.int64).reshape(-1, 3)
            order, bins, offset = _packed_bins(demand, limits)
            cols = [pa.array(c, pa.int64()) for c in zip(*(rest[i] for i in order.tolist()), strict=True)]
            out = pa.record_batch([*cols, pa.array(bins + next_id), pa.array(offset)], fields)
            next_id += int(bins.max()) + 1
            rest.clear()
            return out

        seen = False
        for b in batches:
            for k, n in bounded(b.column(2)):
                part = b.slice(k, n)
                ids = enc.encode([t or "" for t in part.column(2).to_pylist()])
                for name, role, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids, strict=True):
                    if not seen or name != conv:
                        if seen:
                            close()
                        conv, at, begin, loss, seen = name, 0, 0, 0, True
                    left, bears = len(own) + 1, role == loss_role
                    while left:
                        room = limits.tokens - (at - begin)
                        if bears:
                            room = min(room, limits.loss_tokens - loss)
                        if room == 0:
                            pieces.append((begin, at - begin, loss))
                            begin, loss = at, 0
                            continue
                        take = min(left, room)
                        at, left, loss = at + take, left - take, loss + take * bears
                if len(rest) >= flush_items:
                    yield packed()
        if seen:
            close()
            if rest:
                yield packed()

    picked = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    # a conversation's turns come together and in order
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(released(run), schema)


def pack_tokens(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", flush_items: int = FLUSH_ITEMS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document's ids end with ``end_id``, which bears no loss.  Whole sequences are cut off a long document
    first; its rest is packed with others.  A null or empty text has the end id only; null and repeated ids
    keep their rows.  Extra columns are ignored; an empty table gives no rows.  ``sequence_id`` holds the map
    task in its upper bits, so a task that is run again numbers its sequences alike.
    """
    ship(docs.sparkSession)
    if limits.segments < 1 or limits.tokens < 1 or limits.loss_tokens < 1:
        raise ValueError("limits must be positive")
    room = min(limits.tokens, limits.loss_tokens)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        from credence.llm.tokens import bounded, encoder

        enc = encoder(tokenizer_path)
        state = {"next": TaskContext.get().partitionId() << 40}
        rest: list[tuple] = []

        def packed(rows: list[tuple]):
            """Rests of documents, packed; (doc_id, start, length, crc, doc_tokens, loss)."""
            demand = np.array([(r[2], 1, r[5]) for r in rows], np.int64).reshape(-1, 3)
            order, at, offset = _packed_bins(demand, limits)
            cols = list(zip(*(rows[i] for i in order.tolist()), strict=True))
            sequence = at + state["next"]
            state["next"] += int(at.max()) + 1
            return pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(cols[k], pa.int64()) for k in range(1, 5)), pa.array(sequence), pa.array(offset), pa.array(cols[5], pa.int64())], fields)

        for b in batches:
            full: list[tuple] = []
            for at, n in bounded(b.column(1)):
                doc_ids, texts = b.column(0).slice(at, n).to_pylist(), b.column(1).slice(at, n).to_pylist()
                for doc_id, ids in zip(doc_ids, enc.encode([t or "" for t in texts]), strict=True):
                    n = len(ids) + 1
                    data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    start = 0
                    while n - start >= room:
                        loss = room - (start + room == n)
                        full.append((doc_id, start, room, zlib.crc32(data[4 * start : 4 * (start + room)]), n, state["next"], 0, loss))
                        state["next"] += 1
                        start += room
                    if start < n:
                        rest.append((doc_id, start, n - start, zlib.crc32(data[4 * start :]), n, n - start - 1))
                if len(rest) >= flush_items:
                    yield packed(rest)
                    rest.clear()
            if full:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*full, strict=True)], fields)
        if rest:
            yield packed(rest)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(released(run), schema)
