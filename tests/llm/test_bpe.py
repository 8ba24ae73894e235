import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute import TEXTS
from tokenizers import Tokenizer

from quire.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(codec, texts):
    flat, n = codec.encode_batch(texts)
    out, at = [], 0
    for k in n.tolist():
        out.append(flat[at : at + k].tolist())
        at += k
    return out, codec.decode_batch(flat, n)


def test_ids_and_decoding_equal_the_library(library):
    random.seed(5)
    signs = "abst'  \n\t1é日-! \u0085rel<|>\x1c\x00᠎﻿"
    texts = [t or "" for t in TEXTS] + ["".join(random.choice(signs) for _ in range(random.randint(0, 80))) for _ in range(3000)]
    ids, back = encoded(bpe.Codec(bpe.Spec.load(PATH)), texts)
    for t, i, b, want in zip(texts, ids, back, library.encode_batch(texts, add_special_tokens=False)):
        assert i == want.ids, repr(t[:80])
        assert b.decode() == library.decode(want.ids, skip_special_tokens=False) == t


def test_long_texts_are_cut_where_words_begin(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    text = "  a b'll\n\n c's   dd " * 40
    ids, _ = encoded(bpe.Codec(bpe.Spec.load(PATH)), [text])
    assert ids[0] == library.encode(text, add_special_tokens=False).ids


def test_table_is_emptied_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    codec = bpe.Codec(bpe.Spec.load(PATH))
    for k in range(6):
        text = " ".join(f"q{k}z{i}" for i in range(40))
        assert encoded(codec, [text])[0][0] == library.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_to_replacement_characters(library):
    codec = bpe.Codec(bpe.Spec.load(PATH))
    ids = library.encode("日", add_special_tokens=False).ids[:1]
    assert codec.decode_batch(*np.array([ids, [1]], dtype="int64"))[0].decode() == library.decode(ids)


def test_operators(spark, library):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, "one", "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.round_trip_digests(df, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            t = TEXTS[r.doc_id] or ""
            want = library.encode(t, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    coded = bpe.encode(df, PATH)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert {(r.doc_id, r.text or "") for r in coded.collect()} == {(r.doc_id, r.text) for r in bpe.decode(coded, PATH).collect()}
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_very_many_special_tokens(library):
    text = "a<|endoftext|>" * 10_000 + "<|endoftext|>" * 3_000
    ids, back = encoded(bpe.Codec(bpe.Spec.load(PATH)), [text, "b"])
    assert ids[0] == library.encode(text, add_special_tokens=False).ids and back[0].decode() == text
    assert ids[1] == library.encode("b", add_special_tokens=False).ids


def test_words_with_equal_hashes_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(bpe, "_powers", lambda n: [np.zeros(n, dtype=np.uint64)] * 2)  # all words of a size have one hash
    codec = bpe.Codec(bpe.Spec.load(PATH))
    for text in ("one two six ten", "six ten two one", "fourteen hundred hundreds"):
        assert encoded(codec, [text])[0][0] == library.encode(text, add_special_tokens=False).ids
