"""Byte-level BPE against the encoding library, and back."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillscope.llm import bpe as BP
from quillscope.llm.queries import QUERIES
from tests.conftest import SF001

TEXTS = [
    None, "", " ", "a", "  a", "it's we'LL 'd", "x" * 3000, "ab" * 40_000, "word " * 30_000, " \n\n \t x", "é" * 500, "12 345,678 ٣", "a\x00b\r\n",
    "<|endoftext|> <|endoftext|>", "\U0001f600‍ ﬁ 中文字 ﻿", " " * 5000 + "z", "The cat's hat. " * 3, "࢏\U00011de0x 9",
]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BP.read_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    ranks, table, newer, pattern = BP._parts(BP.read_ranks(), P.PATTERN)
    return BP.Coder(ranks, table, BP.Splitter(pattern, newer), cache=50)


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = BP.PerfectHash(keys)
    assert sorted(table.key.tolist()) == list(range(3000))
    probe = [*keys, b"k3000", b"", b"other"]
    size = np.array([len(x) for x in probe])
    found = table.find(np.frombuffer(b"".join(probe), np.uint8), np.cumsum(size) - size, np.cumsum(size))
    assert found.tolist() == [*range(3000), -1, -1, -1]
    with pytest.raises(ValueError):
        BP.PerfectHash([b"a", b"a"])


def test_every_character_is_cut_as_the_library_does(coder, library):
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}. {c}{c}\n" for c in chars[i : i + 512]) for i in range(0, len(chars), 512)]
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        assert [x.tolist() for x in coder.encode(pa.array(part))] == library.encode_ordinary_batch(part)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(coder, library, text):
    assert coder.encode(pa.array([text, text]))[1].tolist() == library.encode_ordinary(text)


def test_blocks_of_a_long_text_join_without_a_seam(coder):
    text = "it's   a\n\n  12 b" * 50 + "q" * 400 + "  \n"
    for size in (1, 2, 7, 64):
        assert sum(coder.splitter.blocks(text, False, size), []) == coder.splitter.plain.findall(text)


def test_encode_and_decode(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*docs, *((None, t) for t in TEXTS), (7, TEXTS[6]), (7, TEXTS[6])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, IDS string, Decoded int").repartition(3)
    out = BP.decode(BP.encode(df))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or ""), r["text"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    packed = BP.decode(BP.encode(df, packed=True, keep=["text"]), keep=["text", "ids"]).collect()
    for r in packed:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert BP.decode(BP.encode(df.limit(0))).count() == 0
    assert BP.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).select("decoded").collect() == [(bytearray(),), (bytearray(),)]
    with pytest.raises(Exception, match="without a token"):
        BP.decode(spark.createDataFrame([([60_000],)], "ids array<int>")).collect()
    with pytest.raises(ValueError, match="single bytes"):
        BP.encode(df, vocabulary={b"a": 0})


def test_query(spark, library):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op11_byte_bpe"](spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
