"""Language identification with error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over hashed byte n-grams says on which side
of the bit's dichotomy a text lies.  Decoding sums the logistic losses of the bits against each codeword, weighted by
how well a bit's classifier did on held-back training rows, and takes the codeword of least loss.  A text
whose two nearest codewords are close is flagged as ambiguous; one without any letter is ``und``.  A text is rejected
if it has no letter, or if no codeword is nearer to it than to a text of which the bits' classifiers know nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import free_name, released, ship

UNDETERMINED = "und"
#: Labelled rows that a model is fitted on, over all languages together; the one bounded sample.
TRAIN_ROWS = 3000
DIM_BITS = 13
#: Languages are codewords of this many bits at least.
MIN_BITS = 7
#: Columns of predictions.
NAMES = ("lang_pred", "lang_score", "lang_ambiguous", "lang_rejected")
#: Ambiguous if the best language's probability is not so much larger than the second's.
MARGIN = 0.2
_CHUNK = 1 << 19


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(languages, bits) of +1 and -1: all dichotomies up to five languages, beyond that the best of random codes."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        code = np.array([[1 if (k >> (n - 1 - row)) & 1 else -1 for k in range(1, bits + 1)] for row in range(n)])
        return np.repeat(code, -(-MIN_BITS // bits), axis=1)[:, : max(bits, MIN_BITS)]
    rng = np.random.default_rng(seed)
    bits, best, far = max(MIN_BITS, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # a bit that tells nothing apart
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


def ngram_slots(data: bytes) -> np.ndarray:
    """Slots of the byte bigrams, trigrams and 4-grams of ``data``."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = []
    key = b
    for n in (2, 3, 4):
        key = key[:-1] * np.uint32(257) + b[n - 1 :] if len(key) else key
        out.append((key * np.uint32(2654435761) + np.uint32(n * 0x9E37)) >> np.uint32(32 - DIM_BITS))
    return np.concatenate(out)


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # (slots, bits)
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    scale: float

    def margins(self, text: str) -> np.ndarray:
        data = _bytes(text)
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, len(data), _CHUNK):
            slots = ngram_slots(data[at : at + _CHUNK + 3])
            total += np.bincount(slots, minlength=1 << DIM_BITS) @ self.weights if len(slots) > 4096 else self.weights[slots].sum(axis=0)
            n += len(slots)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Language, score from 0 to 1, whether it is ambiguous, and whether the text is rejected."""
        if not has_letter(text):
            return UNDETERMINED, 0.0, False, True
        if self.languages == (UNDETERMINED,):  # nothing was learned, so nothing can be told
            return UNDETERMINED, 0.0, False, False
        loss = np.logaddexp(0, -self.code * self.margins(text)) @ self.trust
        p = np.exp(-self.scale * (loss - loss.min()))
        p /= p.sum()
        best = int(np.argmax(p))
        others = np.delete(p, best)
        unlike_all = loss[best] >= np.log(2) * self.trust.sum()  # the loss where all margins are 0
        return self.languages[best], float(p[best]), bool(len(others) and p[best] - others.max() < MARGIN), bool(unlike_all)


def fit(rows: list[tuple[str, str]], rounds: int = 300, seed: int = 11) -> Model:
    """A model of (text, language) rows; every fifth row is held back to weigh the bits and scale the scores."""
    rows = [(t, x) for t, x in rows if has_letter(t) and x is not None]
    languages = tuple(sorted({x for _, x in rows}))
    if not languages:
        return Model((UNDETERMINED,), np.ones((1, 1)), np.zeros((1 << DIM_BITS, 1), np.float32), np.zeros(1), np.ones(1), 1.0)
    code = codewords(len(languages))
    x = np.zeros((len(rows), 1 << DIM_BITS), np.float32)
    for k, (t, _) in enumerate(rows):
        slots = ngram_slots(_bytes(t))
        x[k] = np.bincount(slots, minlength=1 << DIM_BITS) / len(slots)
    y = np.array([languages.index(z) for _, z in rows])
    back = np.arange(len(rows)) % 5 == 4
    if back.all() or not back.any():
        back = np.zeros(len(rows), bool)
    spread = np.sqrt(x[~back].mean(axis=0) / len(x) ** 0.5 + 1e-6)
    x /= spread
    size = 1 / np.sqrt((x * x).sum(axis=1).mean())
    x *= size
    share = np.bincount(y, minlength=len(languages)) / len(y)
    row_weight = (1 / (len(languages) * share))[y]
    w, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    xt, target, rw = x[~back], code[y[~back]].astype(np.float32), row_weight[~back, None]
    velocity, rate, keep = np.zeros_like(w), 4.0, 1e-4
    for _ in range(rounds):
        pull = -target / (1 + np.exp(np.clip(target * (xt @ w + bias), -30, 30))) * rw / len(xt)
        velocity = 0.9 * velocity - rate * (xt.T @ pull.astype(np.float32) + keep * w)
        w = w + velocity
        bias = bias - pull.sum(axis=0)
    held = x[back] if back.any() else xt
    truth = y[back] if back.any() else y[~back]
    margin = held @ w + bias
    right = (np.sign(margin) == code[truth]).mean(axis=0)
    trust = np.maximum(0.05, 2 * right - 1)
    trust = trust / trust.mean()
    loss = np.stack([np.logaddexp(0, -code[c] * margin) @ trust for c in range(len(languages))], axis=1)

    def surprise(scale: float) -> float:
        z = -scale * loss
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    # the mildest scale that is about as good as the best: rows that are all right would call for ever larger ones
    surprises = {k: surprise(k) for k in (0.1, 0.2, 0.5, 1.0, 2.0, 4.0)}
    scale = min(k for k, v in surprises.items() if v <= min(surprises.values()) + 0.01)
    return Model(languages, code, (w * (size / spread)[:, None]).astype(np.float32), bias, trust, scale)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that aren't held out, about as many of each language.

    The sample is the rows with the smallest hashes within each language, so it doesn't depend on their order.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    each = max(1, rows // max(1, len(counts)))
    rank = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col(lang_col) == lang) & (rank < each / n))
    # about `each` of each language lie below its bound; twice that is never passed, whatever the hash
    picked = usable.filter(chosen).select(text_col, lang_col, F.xxhash64(id_col).alias("h")).limit(2 * rows).collect()
    picked.sort(key=lambda r: (r[2], r[0]))
    return fit([(r[0], r[1]) for r in picked[:rows]])


def predictions(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """All columns of ``docs`` but those called ``names``, and then predictions under ``names``: language, score, ambiguity, rejection.

    Null and empty texts, and others without a letter, are ``und`` with score 0 and rejected.  Every row has its own
    prediction, whatever its id, so repeated rows and null ids keep theirs; a tie of codewords goes to the first language in
    order.  Very long texts are read whole, in pieces.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    replaced = {n.lower() for n in names}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in replaced])
    at = kept.columns.index(text_col)

    def run(batches):
        for b in batches:
            made = [model.predict(t) for k in range(0, b.num_rows, 256) for t in b.column(at).slice(k, 256).to_pylist()]
            cols = list(zip(*made, strict=True)) or [(), (), (), ()]
            new = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    types = (T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType())
    return kept.mapInArrow(released(run), T.StructType([*kept.schema.fields, *map(T.StructField, names, types)]))


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, whatever those are called."""
    names = tuple(free_name(docs.columns, n) for n in NAMES)
    found = predictions(docs, model, text_col, names)
    return found.filter(~F.col(names[3])).select(*[F.col(f"`{c}`") for c in docs.columns])
