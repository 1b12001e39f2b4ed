"""Byte-level BPE against the tiktoken library, and decoding against the texts."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm import docs, odd

from sigrel.llm import byte_bpe

VOCABULARY = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_texts_of_all_kinds(library):
    coder, rng = byte_bpe.Coder(VOCABULARY, public_tokenizers.PATTERN), random.Random(1)
    letters = "".join(rng.choice("abcdeéstя") for _ in range(700))
    texts = ["", " ", "\n\n  x", "a  b   c \n", "it's 'tis we'll  'LL", "été où là Ａ \x85\xa0 \x1c\x1d x\x1fy", "日本語 text ½ ² ⅷ 12 345", "<|endoftext|> <|im_start|>", "😀😀 🏳️‍🌈", "a" * 5000, "=" * 777 + "ab" * 500, letters, letters + " " + letters[::-1], "\t\r\n\x0b\x0c 　x", "x" + " " * 3000 + "y", "​﻿ ᠎ z"]
    assert coder.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \n'stdmrevl aAéß0½\x1c ")), max_size=40), max_size=20))
def test_any_text(texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    coder = byte_bpe._coder(VOCABULARY, public_tokenizers.PATTERN)
    got = coder.encode(texts)
    assert got == [packed(library.encode_ordinary(t)) for t in texts] and coder.decode(got) == [t.encode() for t in texts]


def test_tables_and_bounds(spark, library, monkeypatch):
    d = odd(spark).withColumn("ids", F.lit(3)).withColumn("decoded", F.lit("x"))
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(d, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY).collect()
    assert len(out) == 8 and all(r["_n"] == "x" and r["score"] == 1.0 for r in out)
    for r in out:
        ids = library.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) == (len(ids), packed(ids), (r["text"] or "").encode())
    assert byte_bpe.encode_texts(docs(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    for name, n in (("CHARS", 50), ("IDS", 7), ("KEPT", 5), ("SHORT", 3), ("LOT", 2)):
        monkeypatch.setattr(byte_bpe, name, n)
    coder = byte_bpe.Coder(VOCABULARY, public_tokenizers.PATTERN)
    texts = ["one two three onetwothree", "", "aaaaaaaaaaaaaaaa bbbbabbba", "one two"] * 3
    for _ in range(2):
        got = coder.encode(texts)
        assert got == [packed(library.encode_ordinary(t)) for t in texts] and coder.decode(got) == [t.encode() for t in texts]


def test_another_vocabulary(spark):
    """The merge table follows the file, pairs of lesser rank than their parts included."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"aa", b"aaa", b"abab", b"aab"]
    text = "\n".join(f"{base64.b64encode(t).decode()} {k}" for k, t in enumerate(tokens)).encode()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice((3, 9, 80, 300)))) for _ in range(60)]
    got = byte_bpe.encode_texts(docs(spark, texts), text, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r["ids"]) for r in got] == [packed(library.encode_ordinary(t)) for t in texts]
    assert hashlib.sha256(bytes(got[0]["ids"])).hexdigest() == hashlib.sha256(packed(library.encode_ordinary(texts[0]))).hexdigest()
