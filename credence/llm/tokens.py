"""Token ids of whole texts, with the ids of each word kept for reuse.

The tokenizer splits a text at its white space before merging, so a text whose white space is single blanks
and line ends is the sequence of its words with what precedes them, each encoded on its own.  Most words of a
corpus come again, so their ids are kept, up to a bound, under 128-bit hashes in sorted arrays, which take a tenth of a
dictionary's memory.  Texts with other or repeated white space, or with a special token spelled out, go to the
tokenizer whole; the ids are the same either way.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps (about 60 MB); more are encoded each time they come.
KEPT_WORDS = 1_000_000
BATCH_CHARS = 2_000_000
#: Distinct words that are Python strings at a time.
WORDS_AT_ONCE = 1 << 15
#: White space that may not be cut before: runs, and all but blank and line end (fixed list).
_ODD_SPACE = ["  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "\0"]
_PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)?([.,;:!?|]+|[*]+|[#]+|[$]+|[&]+|[%]+)?")


def bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, count) of pieces of a column of some BATCH_CHARS bytes each; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, done + BATCH_CHARS, "right")))
        yield at, end - at
        at, done = end, int(ends[end - 1])


class Encoder:
    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens of the vocabulary that a text may hold literally; only the tokenizer finds them in it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.kept_words = kept_words
        # of each word kept: its hash in two halves, in the order of the first, and its row
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.row = np.empty(0, np.int32)
        # of each row: its ids, from one start in the pool to the next
        self.pool, self.starts = array("I"), array("q", [0])
        spare = iter(range(256, 512))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # the byte-level alphabet of the model: shown bytes as they are, others from 256 up in order
        self.alphabet = {b: chr(b if b in shown else next(spare)) for b in range(256)}

    def _piece(self, text: str) -> list[int]:
        """Ids of one pre-token, without another split."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))]

    @staticmethod
    def _pieces(word: str) -> list[str] | None:
        """The pre-tokens of a plain word; None of others."""
        m = _PLAIN.fullmatch(word)
        if m is None:
            return None
        space, letters, marks = m.groups("")
        if space == "\n":  # a line end is a pre-token of its own
            return [p for p in (space, letters, marks) if p]
        return [space + letters, marks] if letters and marks else [word] if word else []

    def _rows(self, words: list[str], whole: bool) -> np.ndarray:
        """The rows of distinct words, made for those that have none; ``whole`` words may be split into pre-tokens."""
        from xxhash import xxh3_128_digest

        hashes = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        rows = np.full(len(words), -1, np.int64)
        if len(self.first):
            at = np.minimum(np.searchsorted(self.first, hashes[:, 0]), len(self.first) - 1)
            hit = (self.first[at] == hashes[:, 0]) & (self.second[at] == hashes[:, 1])
            rows[hit] = self.row[at[hit]]
        missing = np.flatnonzero(rows < 0)
        if not len(missing):
            return rows
        if whole:
            made = [self._pieces(words[k]) for k in missing.tolist()]
            named = list(dict.fromkeys(p for parts in made if parts for p in parts))
            of = dict(zip(named, self._rows(named, False).tolist(), strict=True)) if named else {}
        begin = len(self.starts) - 1
        pool, starts, again = self.pool, self.starts, []
        for n, k in enumerate(missing.tolist()):
            parts = made[n] if whole else [words[k]]
            if parts is None:
                pool.extend(self.tokenizer.encode(words[k], add_special_tokens=False).ids)
            elif not whole:
                pool.extend(self._piece(words[k]))
            elif parts == [words[k]]:  # it is its only pre-token, which has a row now
                rows[k] = of[words[k]]
                again.append(n)
                continue
            else:
                for p in parts:
                    pool.extend(pool[starts[of[p]] : starts[of[p] + 1]])
            rows[k] = len(starts) - 1
            starts.append(len(pool))
        new = np.delete(missing, again) if again else missing
        keep = new[: max(0, self.kept_words - len(self.first))]
        keep = keep[rows[keep] >= begin]
        if len(keep):
            order = keep[np.argsort(hashes[keep, 0])]
            at = np.searchsorted(self.first, hashes[order, 0])
            self.first = np.insert(self.first, at, hashes[order, 0])
            self.second = np.insert(self.second, at, hashes[order, 1])
            self.row = np.insert(self.row, at, rows[order].astype(np.int32))
        return rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text; the end id is not added."""
        out: list[np.ndarray | None] = [None] * len(texts)
        easy: list[int] = []
        for i, t in enumerate(texts):
            if any(x in t for x in _ODD_SPACE) or any(x in t for x in self.added):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                easy.append(i)
        at = 0
        while at < len(easy):  # some millions of characters at a time
            end, size = at, 0
            while end < len(easy) and (size < BATCH_CHARS or end == at):
                size += len(texts[easy[end]])
                end += 1
            self._batch(texts, easy[at:end], out)
            at = end
        return out

    def _batch(self, texts: list[str], rows: list[int], out: list) -> None:
        joined = "\0\0".join(texts[i] for i in rows).replace("\n", "\0\n").replace(" ", "\0 ")
        coded = pc.split_pattern(pa.array([joined], pa.large_string()), "\0").flatten().dictionary_encode()
        some = range(0, len(coded.dictionary), WORDS_AT_ONCE)
        row = np.concatenate([self._rows(coded.dictionary.slice(at, WORDS_AT_ONCE).to_pylist(), True) for at in some])
        # views, not copies; they go before the arrays are cut back
        pool, starts = np.frombuffer(self.pool, np.uint32), np.frombuffer(self.starts, np.int64)
        word = coded.indices.to_numpy()
        first, count = starts[row][word], (starts[row + 1] - starts[row])[word]
        ends = np.cumsum(count)
        ids = pool[np.arange(int(ends[-1])) + np.repeat(first - (ends - count), count)] if len(pool) else np.empty(0, np.uint32)
        del pool, starts
        cuts = self._cuts(texts, rows, ends)
        for i, a, b in zip(rows, cuts, cuts[1:], strict=False):
            out[i] = ids[a:b]
        # rows beyond what is kept go; those kept were made first
        last = int(self.row.max()) + 1 if len(self.row) else 0
        del self.starts[last + 1 :]
        del self.pool[self.starts[last] :]

    @staticmethod
    def _cuts(texts, rows, ends) -> list[int]:
        """Where each text's ids begin, from its number of words."""
        at, cuts = 0, [0]
        for i in rows:
            t = texts[i]
            at += t.count(" ") + t.count("\n") + 1
            cuts.append(int(ends[at - 1]))
            at += 1  # the empty word between two texts
        return cuts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept over tasks."""
    return Encoder(path)
