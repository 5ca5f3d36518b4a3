"""Text features on inline edge rows against plain-Python definitions."""

import math

import pytest
from pyspark.sql import functions as F

from quillscope.functions import text as X
from quillscope.operators import features as FE

EDGE = [
    "",
    "   ",
    "one",
    "a b　c",
    "nbsp split and\x1cfile sep",
    "emoji 😀 word",
    "Is it? Yes! Wait... ok…",
    "back\\?slash \\? twice",
    "lit \\.\\.\\.|… once",
    "[removed]",
    "The cat and the dog. The cat and the dog.\nNew line here",
    "x" * 250 + " y",
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(EDGE)] + [(len(EDGE), None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_words_match_str_split(edge):
    got = {r.doc_id: list(r.w) for r in edge.where("text is not null").select("doc_id", X.words("text").alias("w")).collect()}
    for i, t in enumerate(EDGE):
        assert got[i] == t.split(), t


def test_basic_features(edge):
    rows = {r.doc_id: r for r in FE.basic_features(edge).collect()}
    assert len(rows) == len(EDGE)  # null text dropped
    for i, t in enumerate(EDGE):
        w = t.split()
        r = rows[i]
        awl = sum(len(x) for x in w) / len(w) if w else 0
        assert math.isclose(r.avg_word_length, awl)
        assert r.vocab_size == len(set(w))
        dens = len(set(w)) / len(w) if w else 0
        assert math.isclose(r.word_density, dens) and r.lexical_diversity == r.word_density
        assert r.question_count == t.count(r"\?")
        assert r.exclamation_count == t.count("!")
        assert r.ellipsis_count == t.count(r"\.\.\.|…")


def test_regex_mode_counts(spark):
    df = spark.createDataFrame([("Is it? Yes! Wait... ok… ...",)], "text string")
    r = df.select(X.question_count("text", "regex").alias("q"), X.ellipsis_count("text", "regex").alias("e")).first()
    assert r.q == 1 and r.e == 3


def test_tokens_and_repetition(spark):
    df = spark.createDataFrame([("The cat, the cat, the cat!",), ("",), ("solo",)], "text string")
    rows = df.select(
        X.tokens("text").alias("t"),
        X.token_repetition_count(X.tokens("text")).alias("tr"),
        X.bigram_repetition_count(X.tokens("text")).alias("br"),
    ).collect()
    assert list(rows[0].t) == ["The", "cat", ",", "the", "cat", ",", "the", "cat", "!"]
    assert rows[0].tr == 9 - 5
    # bigrams: The-cat cat-, ,-the the-cat cat-, ,-the the-cat cat-!  -> 8 bigrams, 5 distinct
    assert rows[0].br == 3
    assert rows[1].tr == 0 and rows[1].br == 0 and rows[2].br == 0


def test_sentences_and_lengths(spark):
    df = spark.createDataFrame([("One two. Three four five! Six\nSeven eight",), ("   ",), ("",)], "text string")
    out = FE.english_features(df).collect()
    assert math.isclose(out[0].avg_sent_len_word, (3 + 4 + 1 + 2) / 4)
    s = df.select(X.sentences("text").alias("s")).collect()
    assert list(s[0].s) == ["One two.", "Three four five!", "Six", "Seven eight"]
    assert out[1].avg_sent_len_word == 0 and out[2].avg_sent_len_char == 0
    assert math.isclose(out[0].avg_sent_len_char, (8 + 16 + 3 + 11) / 4)


def test_function_words_and_nouns(spark):
    df = spark.createDataFrame([("The nation of Paris is in France. Paris has a government.",)], "text string")
    r = FE.english_features(df).first()
    # function words: The of is in has a -> 'has' is an auxiliary too
    assert r.func_word_count == 6
    # nouns: nation (suffix), Paris (mid-sentence capital), France, government; 2nd Paris starts a sentence
    assert r.noun_count == 4


def test_outlier_filter(edge):
    b = FE.basic_features(edge)
    kept = {r.doc_id for r in FE.remove_outliers(b).select("doc_id").collect()}
    assert EDGE.index("[removed]") not in kept
    assert len(EDGE) - 1 not in kept  # average word length above 120
    assert 0 in kept
    reasons = {r.doc_id: r.reason for r in FE.outlier_columns(b).collect()}
    assert reasons[EDGE.index("[removed]")] == "bracket_prefix"
    assert reasons[len(EDGE) - 1] == "long_words"


def test_token_limit(spark):
    long_text = " ".join(["w"] * 767)  # 767 tokens + 2 special = 769
    df = spark.createDataFrame([(long_text,), ("w " * 10,)], "text string")
    tc = [r.tc for r in df.select(X.token_count(X.tokens("text")).alias("tc")).collect()]
    assert tc == [769, 12]
    assert df.where(X.token_count(X.tokens("text")) <= X.TOKEN_LIMIT).count() == 1


def test_feature_projection_has_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = FE.english_features(FE.basic_features(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_noun_ratio_zero_tokens(spark):
    df = spark.createDataFrame([("",)], "text string")
    r = df.select(X.noun_ratio(X.tokens("text")).alias("nr")).first()
    assert r.nr == 0.0
    assert df.select(F.lit(1)).count() == 1


@pytest.mark.parametrize("first", [2, 5, 1000])
def test_top_pairs_match_a_plain_count(spark, monkeypatch, first):
    """Whether the first tokens settle it, the tokens that reach the bound do, or all pairs are counted by text."""
    import random
    from collections import Counter

    from quillscope.operators import bigrams as BG

    rng = random.Random(first)
    rows = [[f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.choice([0, 1, 2, 40]))] for _ in range(200)] + [["x", "y"]] * 90
    want = Counter(f"{a}\x01{b}" for r in rows for a, b in zip(r, r[1:]))
    want = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]
    tokens = spark.createDataFrame([(r,) for r in rows], "tokens array<string>")
    monkeypatch.setattr(BG, "FIRST", first)
    for most in (BG.MOST, 3):
        monkeypatch.setattr(BG, "MOST", most)
        assert [tuple(r) for r in BG.top_pairs(tokens, 20, "\x01").collect()] == want
    assert BG.top_pairs(tokens.limit(0), 20, "\x01").count() == 0
