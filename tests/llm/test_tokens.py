"""Ids of texts that spell out a special token, against a tokenizer of its own."""

import zlib

import numpy as np
import pytest
from credence.llm import packing, wavelet
from credence.llm.catalog import tokenizer_path
from credence.llm.tokens import Encoder
from tokenizers import Tokenizer

TEXTS = ["<|endoftext|>", "a <|endoftext|> b", "one two<|endoftext|>three\nfour", "\n<|endoftext|>\n", "x  <|endoftext|>  y", "<|endoftext|><|endoftext|> .", "<|endoftext|", "plain"]


def plain(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_special_tokens_have_the_plain_encodings_ids(spark):
    assert plain(TEXTS[0]) == [50256]
    for kept in (0, 50):
        coder = Encoder(tokenizer_path(), kept_words=kept)
        assert [x.tolist() for x in coder.encode(TEXTS)] == [plain(t) for t in TEXTS]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = {i: [*plain(t), 0] for i, t in enumerate(TEXTS)}
    want = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.items()}
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack_tokens(docs, tokenizer_path()).collect()} == want
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in wavelet.token_files(docs, tokenizer_path()).collect()} == want


@pytest.mark.parametrize("most", [1, 2, 50_000, 70_000])
def test_wavelet_parts(monkeypatch, most):
    """Files are the same however many ids are moved at a time, and give them back."""
    ids = np.random.default_rng(3).integers(0, most, 1000).astype(np.uint32)
    lengths = np.array([400, 0, 600])
    whole = wavelet.build(ids, lengths, [1, None, 2])
    for part in (1, 7, 64, 999, 1000):
        monkeypatch.setattr(wavelet, "PART", part)
        made = wavelet.build(ids, lengths, [1, None, 2])
        file = wavelet.WaveletMatrix(made)
        assert made == whole and np.array_equal(file.decode(), ids) and [file.access(i) for i in range(0, 1000, 99)] == ids[::99].tolist()
    empty = wavelet.WaveletMatrix(wavelet.build(ids[:0], lengths[:0], []))
    assert len(empty.decode()) == 0
