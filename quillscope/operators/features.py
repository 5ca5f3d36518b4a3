"""Feature labelling: the extended table (16 features) as one projection, no UDF.

Word and token arrays are projected once per row and every feature reads them,
so each regex runs once per text. Outlier rows are removed between the basic and
the linguistic features, so the more expensive part sees fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.functions import text as X

BASIC_FEATURES = [
    "avg_word_length",
    "vocab_size",
    "word_density",
    "lexical_diversity",
    "question_count",
    "exclamation_count",
    "ellipsis_count",
]
ENGLISH_FEATURES = [
    "func_word_count",
    "noun_count",
    "noun_ratio",
    "token_repetition_count",
    "bigram_repetition_count",
    "avg_sent_len_word",
    "avg_sent_len_char",
]
SENTIMENT_FEATURES = ["sentiment_label", "sentiment_score"]
NUMERIC_FEATURES = BASIC_FEATURES + ENGLISH_FEATURES


def non_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null text cannot be split; such rows are dropped (count them with ``row_counts``)."""
    return df.where(F.col(text).isNotNull())


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_w", X.words(text))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_t", X.tokens(text))


def basic_features(df: DataFrame, text: str = "text", mode: str = "literal") -> DataFrame:
    """Input columns + the seven word/punctuation features (two projections)."""
    keep = [F.col(c) for c in df.columns]
    w = F.col("_w")
    out = non_null_text(df, text).select(*keep, X.words(text).alias("_w"))
    density = X.word_density(w)
    return out.select(
        *keep,
        X.avg_word_length(text, w).alias("avg_word_length"),
        X.vocab_size(w).alias("vocab_size"),
        density.alias("word_density"),
        density.alias("lexical_diversity"),
        X.question_count(text, mode).alias("question_count"),
        X.exclamation_count(text).alias("exclamation_count"),
        X.ellipsis_count(text, mode).alias("ellipsis_count"),
    )


def english_features(df: DataFrame, text: str = "text", keep_tokens: bool = False) -> DataFrame:
    """Seven linguistic features. Expects ``_t`` (tokens) or computes it."""
    base = [c for c in df.columns if c != "_t"]
    src = df if "_t" in df.columns else with_tokens(df, text)
    t, sents, k = F.col("_t"), F.col("_s"), F.col("_k")
    # token arrays, their class codes and the sentences are projected once; every feature reads them
    out = src.select(*base, "_t", X.sentences(text).alias("_s"), X.token_classes(t).alias("_k"))
    nouns = X.noun_count(t, k)
    cols = [
        X.func_word_count(t, k).alias("func_word_count"),
        nouns.alias("noun_count"),
        X.noun_ratio(t, nouns).alias("noun_ratio"),
        X.token_repetition_count(t).alias("token_repetition_count"),
        X.bigram_repetition_count(t).alias("bigram_repetition_count"),
        X.avg_sent_len_word(t, sents).alias("avg_sent_len_word"),
        X.avg_sent_len_char(sents).alias("avg_sent_len_char"),
    ]
    return out.select(*base, *(["_t"] if keep_tokens else []), *cols)


def with_token_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``token_count`` behind a barrier, so a filter on it does not tokenize again; null texts go."""
    return materialize(non_null_text(df, text).withColumn("token_count", X.token_count(X.tokens(text))))


def outlier_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_t`` tokens, ``token_count`` and the outlier ``reason`` (NULL = kept)."""
    out = df if "_t" in df.columns else with_tokens(df, text)
    out = out.withColumn("token_count", X.token_count(F.col("_t")))
    return out.withColumn(
        "reason", X.outlier_reason(text, F.col("token_count"), F.col("avg_word_length"))
    )


def materialize(df: DataFrame) -> DataFrame:
    """Row-for-row barrier: a one-element ``inline`` (Generate).

    The optimizer pushes a filter through a projection by inlining the projected
    expressions, so a filter on a token-array column would tokenize every text a
    second time (and run below any exchange). Predicates on a generator's output
    stay above it, so the arrays below are computed once.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def remove_outliers(df: DataFrame, text: str = "text", allow_outliers: bool = False) -> DataFrame:
    """Keep rows with token_count <= 768, no '[' prefix and avg word length <= 120."""
    if allow_outliers:
        return with_tokens(df, text)
    out = materialize(df.withColumn("_t", X.tokens(text)))
    return out.where(X.is_kept(text, X.token_count(F.col("_t")), F.col("avg_word_length")))


def extended_features(
    df: DataFrame, text: str = "text", mode: str = "literal", allow_outliers: bool = False
) -> DataFrame:
    """Input columns + 14 numeric features; sentiment columns come from ``learn.sentiment``."""
    basic = basic_features(df, text, mode)
    kept = remove_outliers(basic, text, allow_outliers)
    return english_features(kept, text)
