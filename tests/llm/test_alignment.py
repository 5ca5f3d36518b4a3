"""Alignment of two tokenizers against a plain walk over all token pairs."""

import pytest

from quillscope.llm import alignment as AL
from quillscope.llm.queries import QUERIES
from tests.conftest import SF001

TEXTS = [
    None, "", " ", "a", " a", "the cat", "the cat", "The cat's hat\n\n  12", "été été", "中文 \U0001f600", "a▁b", "<|endoftext|> <s></s><unk>", "x" * 500,
    "the cat sat on the mat " * 800, "‍﻿", "a\x00b\t", "<0x0A> ﬁ Å",
]
OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [AL.HEAD, 60, 0])
def test_equals_brute_force(spark, head):
    rows = list(enumerate([*TEXTS, *["the cat sat"] * 40, None, None]))
    df = spark.createDataFrame([(*r, 3, "g") for r in rows], "doc_id long, text string, N_A int, other string").repartition(4)
    docs, pairs = AL.align(df, groups=True, head=head)
    assert docs.columns == ["doc_id", "text", "other", *OUT, "groups"]
    want = AL.brute_force(rows)
    got = docs.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in OUT) == want[r["doc_id"]], r["text"]
        assert (r["groups"] == "") == (r["n_a"] == 0)
    assert pairs.where("count < 1 or a < 0").count() == 0
    assert pairs.groupBy().sum("count").head()[0] == sum(x[3] for x in want.values())
    assert pairs.where("best").select("b").distinct().count() == pairs.select("b").distinct().count()


def test_special_strings_and_texts_that_are_not_spelled():
    want = AL.brute_force([(0, "a▁b"), (1, "<|endoftext|>")])
    assert want[0] == (0, 0, 0, 0, 0, 0, "") and want[1][0] > 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, None)], "doc_id long, text string")
    docs, pairs = AL.align(df, keep=["doc_id"])
    rows = docs.collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2 and pairs.agg({"count": "min"}).head()[0] == 2
    docs, pairs = AL.align(df.limit(0))
    assert docs.count() == 0 and pairs.count() == 0


def test_head_is_bounded(spark):
    df = spark.createDataFrame([(i, c, True) for i, c in enumerate([100, 90, 8, 8, 8, 1, 1])], "pair long, count long, best boolean")
    assert [AL.head_of(df, n).count() for n in (0, 1, 2, 4, 5, 6, 7)] == [0, 1, 2, 2, 5, 5, 7]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = AL.brute_force(rows)
    got = {r["doc_id"]: tuple(r[c] for c in OUT) for r in QUERIES["op13_token_alignment"](spark, SF001).collect()}
    assert got == want


def test_words_are_encoded_once_and_as_in_the_whole_text():
    """A word that many texts hold goes to the tokenizer once; the tokens are those of whole texts, also around odd blanks."""
    import random

    rng = random.Random(4)
    al = AL.Aligner(AL.model_bytes(AL.MODEL_A), AL.model_bytes(AL.MODEL_B))
    units = [*" \n\t\x0b\x1c\x85 　 a1é中.'~\x00́", "'s", "don't", " a", "a ", "  ", " 's", "é é", "­ ", " !", "<|endoftext|>", "word and word"]
    odd = ["".join(rng.choice(units) for _ in range(rng.randrange(25))) for _ in range(3000)]
    plain = [" ".join(rng.choice(["one", "two,", "three.", "vier", "fünf"]) for _ in range(200)) for _ in range(50)]
    seen, encode = [], al.words.encode
    al.words.encode = lambda texts: seen.extend(texts) or encode(texts)
    for texts in (odd, plain, []):
        ids, sizes = al.words.tokens(texts)
        want = [x.ids for x in al.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    seen.clear()
    ids = al.tokens(plain)[0]
    assert not seen and len(ids) > 10_000  # kept since the last call
    al.words.chars = AL.KEPT_CHARS + 1
    assert (al.tokens(plain)[0] == ids).all() and sum(map(len, seen)) < 100
