"""Token counts against the library; language ID against a plain PPM model and held-out labels."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillscope.llm import langid as LI
from quillscope.llm import tokens as TC
from quillscope.llm.queries import QUERIES
from tests.conftest import SF001

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", " a  b ", "a\n b\t", "▁a", "a▁ b▁", "<s> hi </s><unk><0x0A>", "ﬁ Å 　x", "  \U0001f600",
    "word " * 4000, "x" * 30000, "Ünïcödé   runs    of     spaces\n\n\n end", "a\x00b",
]


@pytest.mark.parametrize("cache", [TC.CACHE, 3])
def test_counts_equal_the_library(spark, monkeypatch, cache):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=TC.model_bytes())
    lengths = TC.Lengths(TC.model_bytes(), {"word": len(sp.encode("word"))}, cache)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [(None, t) for t in TEXTS] + [tuple(r) for r in docs.collect()]
    for _, t in rows:
        assert lengths.count(t or "") == len(sp.encode(t or "")), t
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in TC.count_tokens(df).collect() if r["text"] is not None and r["doc_id"] is None)
    assert [(t, b, n, o) for _, t, b, n, o in got] == sorted((t, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for t in TEXTS if t is not None)
    assert TC.count_tokens(df.limit(0)).count() == 0


def test_summary_keeps_heavy_hitters():
    s = TC.Summary(4)
    for i in range(2000):
        s.add([f"x{i}", "hot", "warm" if i % 2 else f"y{i}"])
    s.shrink()
    assert "hot" in s.counts and "warm" in s.counts and len(s.counts) <= 4


def _plain_bits(train, langs, text):
    """Code length by walking contexts from the longest, escaping down to a uniform byte."""
    out = []
    for lang in langs:
        follow = defaultdict(lambda: defaultdict(int))
        for t, l in train:
            if l == lang:
                b = b"   " + t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
                for i in range(3, len(b)):
                    for k in range(4):
                        follow[b[i - k : i]][b[i]] += 1
        b = b"   " + text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        bits = 0.0
        for i in range(3, len(b)):
            for k in (3, 2, 1, 0):
                f = follow.get(b[i - k : i])
                if f is None:
                    continue
                n, t = sum(f.values()), len(f)
                if b[i] in f:
                    bits -= math.log2(f[b[i]] / (n + t))
                    break
                bits -= math.log2(t / (n + t))
            else:
                bits += 8
        out.append(bits)
    return out


def test_code_lengths_match_a_plain_walk(spark):
    train = [("the cat sat on the mat. A hat!", "en"), ("le chat était sur la table", "fr"), ("der Hund läuft über die Straße", "de"), ("", "de"), ("then that", "en")]
    df = spark.createDataFrame([*train, (None, "en"), ("zz", None)], "text string, lang string").repartition(3)
    tree = LI.train(df)
    langs = ["de", "en", "fr"]
    assert tree.langs == langs
    tests = ["the chat", "Straße", "q", "", "a b  c", "中 hat", "THAT MAT"]
    got = tree.lengths(pa.array(tests))
    assert np.allclose(got, [_plain_bits(train, langs, t) for t in tests], atol=1e-3)
    rows = spark.createDataFrame([(t, "x") for t in [*tests, None, "123 .", "le chat " * 20_000, "THAT MAT"]], "text string, score string")
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in LI.predict(rows, tree).collect()}
    assert out["Straße"][0] == "de" and out["THAT MAT"][0] == "en" and out[None] == ("und", 0.0) and out["123 ."] == ("und", 0.0) and out[""] == ("und", 0.0)
    assert out["le chat " * 20_000][0] == "fr" and LI.predict(rows, tree).count() == len(tests) + 4
    assert LI.predict(rows, LI.train(df.limit(0))).where("lang_pred != 'und'").count() == 0
    assert LI.predict(rows.limit(0), tree).count() == 0


def _languages(spark, n, per=12):
    """Texts of ``n`` made-up languages, each with an alphabet and words of its own."""
    import random

    rows = []
    for k in range(n):
        rng = random.Random(k)
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñøåбвгдж") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
        rows += [(" ".join(rng.choice(words) for _ in range(30)), f"l{k:02}") for _ in range(per)]
    return rows


@pytest.mark.parametrize("block_bytes", [LI.BLOCK_BYTES, 150_000])
def test_24_languages_equal_a_plain_walk(spark, block_bytes):
    """Every counted context is kept, whatever the number of languages and of their blocks."""
    rows = _languages(spark, 24, 3)
    tree = LI.train(spark.createDataFrame(rows, "text string, lang string").repartition(3), block_bytes=block_bytes)
    assert (len(tree.ranges) == 1) == (block_bytes == LI.BLOCK_BYTES) and len(tree.ranges) < 24
    tests = [rows[0][0], rows[-1][0][:50], "жж äö zz", "\u4e2d x"]
    want = np.array([_plain_bits(rows, tree.langs, t) for t in tests])
    assert np.allclose(tree.lengths(pa.array(tests)), want, rtol=1e-5, atol=1e-2)
    got = LI.predict(spark.createDataFrame([(t, 1) for t in tests], "text string, _BITS0 int"), tree).collect()
    assert {r["text"]: r["lang_pred"] for r in got} == {t: tree.langs[i] for t, i in zip(tests, want.argmin(axis=1))}


@pytest.mark.parametrize("n", [2, 24])
def test_accuracy_by_number_of_languages(spark, n):
    rows = _languages(spark, n)
    df = spark.createDataFrame([(*r, i % 4 == 0) for i, r in enumerate(rows)], "text string, truth string, test boolean")
    tree = LI.train(df.where("not test"), lang_col="truth")
    out = LI.predict(df.where("test"), tree).collect()
    assert sum(r["lang_pred"] == r["truth"] for r in out) / len(out) >= 0.98


def test_held_out_accuracy(spark):
    got = QUERIES["op7_language_id"](spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out and length(lang_pred) = 2 and lang is not null").collect()
    assert got.count() == docs.count() and len(rows) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
