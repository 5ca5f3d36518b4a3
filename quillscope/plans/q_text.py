"""Queries: sources, text features, outlier filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.functions import lexicon
from quillscope.functions import text as X
from quillscope.operators import bigrams as BG
from quillscope.operators import features as FE
from quillscope.operators import textmodel as TM
from quillscope.plans import sqltext as S
from quillscope.plans.registry import register
from quillscope.sources import tables

BASIC_D = ("avg_word_length", "word_density", "lexical_diversity")
ENGLISH_D = ("noun_ratio", "avg_sent_len_word", "avg_sent_len_char")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return tables.labelled(spark, d)


def extended(spark: SparkSession, d: str, allow_outliers: bool = False) -> DataFrame:
    """The labelled extended feature table (no text column)."""
    return tables.features_then_labels(spark, d, lambda df: FE.extended_features(df, allow_outliers=allow_outliers))


# ------------------------------------------------------------------ S1
@register(
    "scan_documents",
    sql="SELECT lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars, "
    "sum(length(text))::BIGINT AS text_chars FROM documents GROUP BY lang",
)
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_chars").cast("bigint").alias("n_chars"),
        F.sum(F.length("text")).cast("bigint").alias("text_chars"),
    )


# ------------------------------------------------------------------ X1
@register(
    "words",
    sql=f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, w[1] AS first_word, w[-1] AS last_word,
    CAST({S.word_chars()} AS BIGINT) AS word_chars
    FROM (SELECT doc_id, text, {S.words()} AS w FROM documents WHERE text IS NOT NULL)""",
)
def words(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    w = docs.select("doc_id", "text", X.words("text").alias("w"))
    return w.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.try_element_at("w", F.lit(1)).alias("first_word"),
        F.try_element_at("w", F.lit(-1)).alias("last_word"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
    )


# ------------------------------------------------------------------ X2-X8
BASIC_SQL = f"""WITH {S.extended_cte(allow_outliers=True).split('_bt AS')[0].rstrip().rstrip(',')}
SELECT doc_id, label, avg_word_length, vocab_size, word_density, lexical_diversity,
       question_count, exclamation_count, ellipsis_count FROM b"""


@register("basic_features", sql=BASIC_SQL, doubles=BASIC_D)
def basic_features(spark: SparkSession, d: str) -> DataFrame:
    return tables.features_then_labels(spark, d, FE.basic_features).select("doc_id", "label", *FE.BASIC_FEATURES)


@register(
    "punct_counts",
    sql=f"""SELECT doc_id,
    {S.count_literal('text', X.QUESTION_LITERAL)} AS question_literal,
    {S.count_regex('text', X.QUESTION_REGEX)} AS question_regex,
    {S.count_literal('text', '!')} AS exclamation_count,
    {S.count_literal('text', X.ELLIPSIS_LITERAL)} AS ellipsis_literal,
    {S.count_regex('text', X.ELLIPSIS_REGEX)} AS ellipsis_regex
    FROM conversations WHERE text IS NOT NULL""".replace("doc_id,", "conv_id, turn,", 1),
)
def punct_counts(spark: SparkSession, d: str) -> DataFrame:
    conv = tables.load(spark, d, "conversations").where(F.col("text").isNotNull())
    t = F.col("text")
    return conv.select(
        "conv_id",
        "turn",
        X.question_count(t, "literal").alias("question_literal"),
        X.question_count(t, "regex").alias("question_regex"),
        X.exclamation_count(t).alias("exclamation_count"),
        X.ellipsis_count(t, "literal").alias("ellipsis_literal"),
        X.ellipsis_count(t, "regex").alias("ellipsis_regex"),
    )


# ------------------------------------------------------------------ X9
@register(
    "tokens",
    sql=f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, t[1] AS first_token, t[-1] AS last_token,
    CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct
    FROM (SELECT doc_id, {S.tokens()} AS t FROM documents WHERE text IS NOT NULL)""",
)
def tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    t = docs.select("doc_id", X.tokens("text").alias("t"))
    return t.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.try_element_at("t", F.lit(1)).alias("first_token"),
        F.try_element_at("t", F.lit(-1)).alias("last_token"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
    )


# ------------------------------------------------------------------ X1 / X9 / X20 on markup and short items
def _token_profile_sql(table: str, key: str, column: str) -> str:
    return f"""SELECT {key}, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(t) + {X.SPECIAL_TOKENS} AS BIGINT) AS token_count,
    CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_token, t[-1] AS last_token
    FROM (SELECT {key}, {S.tokens(column)} AS t, {S.words(column)} AS w FROM {table} WHERE {column} IS NOT NULL)"""


def _token_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    t = df.where(F.col(column).isNotNull()).select(key, X.tokens(column).alias("t"), X.words(column).alias("w"))
    return t.select(
        key,
        F.size("t").cast("bigint").alias("n_tokens"),
        X.token_count(F.col("t")).alias("token_count"),
        F.size("w").cast("bigint").alias("n_words"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.try_element_at("t", F.lit(1)).alias("first_token"),
        F.try_element_at("t", F.lit(-1)).alias("last_token"),
    )


@register("tokens_pages", sql=_token_profile_sql("pages", "page_id", "html"))
def tokens_pages(spark: SparkSession, d: str) -> DataFrame:
    """Tokenizer and word split over raw HTML pages (markup, entities, scripts), whole pages."""
    return _token_profile(tables.load(spark, d, "pages"), "page_id", "html")


@register("tokens_benchmark", sql=_token_profile_sql("benchmark", "item_id", "text"))
def tokens_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _token_profile(tables.load(spark, d, "benchmark"), "item_id", "text")


# ------------------------------------------------------------------ X10 / J7: part-of-speech histogram
@register(
    "pos_histogram",
    sql=f"""WITH lex(token, pos) AS (VALUES {', '.join(f"({S.q(t)}, {S.q(p)})" for t, p in lexicon.lexicon_rows())}),
    tok AS (SELECT lower(unnest({S.tokens()})) AS token FROM documents WHERE text IS NOT NULL)
    SELECT pos, count(*)::BIGINT AS n FROM tok JOIN lex USING (token) GROUP BY pos""",
)
def pos_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    lex = spark.createDataFrame(lexicon.lexicon_rows(), "token string, pos string")
    # the lexicon is a fixed closed-class list (< 300 rows): a size-bounded broadcast
    tok = docs.select(F.explode(X.tokens("text")).alias("token")).select(F.lower("token").alias("token"))
    return tok.join(F.broadcast(lex), "token").groupBy("pos").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ X11-X19 on the whole corpus
ENGLISH_ALL_SQL = f"""SELECT doc_id, {S.english_cols()}
FROM (SELECT doc_id, text, {S.tokens()} AS _t, {S.sentences()} AS _s FROM documents WHERE text IS NOT NULL)"""


def _english_all(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return FE.english_features(docs)


@register("func_word_count", sql=f"SELECT doc_id, func_word_count FROM ({ENGLISH_ALL_SQL})")
def func_word_count(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", X.func_word_count(X.tokens("text")).alias("func_word_count"))


@register(
    "noun_features",
    sql=f"SELECT doc_id, noun_count, noun_ratio FROM ({ENGLISH_ALL_SQL})",
    doubles=("noun_ratio",),
)
def noun_features(spark: SparkSession, d: str) -> DataFrame:
    return _english_all(spark, d).select("doc_id", "noun_count", "noun_ratio")


@register(
    "repetition",
    sql=f"SELECT doc_id, token_repetition_count, bigram_repetition_count FROM ({ENGLISH_ALL_SQL})",
)
def repetition(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    t = docs.select("doc_id", X.tokens("text").alias("t"))
    return t.select(
        "doc_id",
        X.token_repetition_count(F.col("t")).alias("token_repetition_count"),
        X.bigram_repetition_count(F.col("t")).alias("bigram_repetition_count"),
    )


@register(
    "sentences",
    sql=f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, s[1] AS first_sentence
    FROM (SELECT doc_id, {S.sentences()} AS s FROM documents WHERE text IS NOT NULL)""",
)
def sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    s = docs.select("doc_id", X.sentences("text").alias("s"))
    return s.select(
        "doc_id",
        F.size("s").cast("bigint").alias("n_sentences"),
        F.try_element_at("s", F.lit(1)).alias("first_sentence"),
    )


@register(
    "sentence_lengths",
    sql=f"SELECT doc_id, avg_sent_len_word, avg_sent_len_char FROM ({ENGLISH_ALL_SQL})",
    doubles=("avg_sent_len_word", "avg_sent_len_char"),
)
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _english_all(spark, d).select("doc_id", "avg_sent_len_word", "avg_sent_len_char")


# ------------------------------------------------------------------ X20 / P8 / F3
@register(
    "token_counts",
    sql=f"""SELECT doc_id, {S.token_count('t')} AS token_count
    FROM (SELECT doc_id, {S.tokens()} AS t FROM documents WHERE text IS NOT NULL)""",
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", X.token_count(X.tokens("text")).alias("token_count"))


@register(
    "token_limit_filter",
    sql=f"""SELECT doc_id, label FROM (SELECT doc_id, label, {S.tokens()} AS t FROM {S.LABELLED} WHERE text IS NOT NULL)
    WHERE {S.token_count('t')} <= {X.TOKEN_LIMIT}""",
)
def token_limit_filter(spark: SparkSession, d: str) -> DataFrame:
    counts = tables.features_then_labels(spark, d, FE.with_token_count)
    return counts.where(F.col("token_count") <= X.TOKEN_LIMIT).select("doc_id", "label")


# ------------------------------------------------------------------ P9 / P10 / J5
@register(
    "outlier_filter",
    sql=f"WITH {S.extended_cte()} SELECT doc_id, label FROM k",
)
def outlier_filter(spark: SparkSession, d: str) -> DataFrame:
    # the token array is dropped before any join: only ids (and labels) move
    kept = tables.features_then_labels(spark, d, lambda df: FE.remove_outliers(FE.basic_features(df)).drop("_t"))
    return kept.select("doc_id", "label")


@register(
    "outlier_reasons",
    sql=f"""WITH {S.extended_cte(allow_outliers=True)}
    SELECT coalesce({S.reason()}, 'kept') AS reason, label, count(*)::BIGINT AS n FROM _bt GROUP BY ALL""",
)
def outlier_reasons(spark: SparkSession, d: str) -> DataFrame:
    b = tables.features_then_labels(spark, d, lambda df: FE.outlier_columns(FE.basic_features(df)).drop("_t"))
    return b.groupBy(F.coalesce(F.col("reason"), F.lit("kept")).alias("reason"), "label").agg(
        F.count("*").alias("n")
    )


# ------------------------------------------------------------------ X25 / F1
EXT_COLS = ["doc_id", "label", *FE.NUMERIC_FEATURES]
EXT_D = BASIC_D + ENGLISH_D


@register(
    "extended_features",
    sql=f"WITH {S.extended_cte()} SELECT {', '.join(EXT_COLS)} FROM x",
    doubles=EXT_D,
)
def extended_features(spark: SparkSession, d: str) -> DataFrame:
    return extended(spark, d).select(*EXT_COLS)


_CONV = """(SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label,
  conv_id::VARCHAR || '/' || turn::VARCHAR AS doc_id FROM conversations WHERE role IN ('user', 'assistant'))"""


@register(
    "extended_conversations",
    sql=f"WITH {S.extended_cte(source=_CONV)} SELECT split_part(doc_id, '/', 1)::BIGINT AS conv_id, split_part(doc_id, '/', 2)::BIGINT AS turn, "
    f"{', '.join(EXT_COLS[1:])} FROM x",
    doubles=EXT_D,
)
def extended_conversations(spark: SparkSession, d: str) -> DataFrame:
    return FE.extended_features(tables.conversation_corpus(spark, d)).select("conv_id", "turn", *EXT_COLS[1:])


# ------------------------------------------------------------------ W2 / X15: most frequent adjacent pairs
@register(
    "bigram_top",
    sql=f"""WITH t AS (SELECT {S.tokens()} AS _t FROM documents WHERE text IS NOT NULL),
    b AS (SELECT unnest({S.bigrams()}) AS bg FROM t)
    SELECT replace(bg, chr(1), ' ') AS bigram, count(*)::BIGINT AS n FROM b GROUP BY bg ORDER BY n DESC, bg LIMIT 20""",
)
def bigram_top(spark: SparkSession, d: str) -> DataFrame:
    # a top-k report: the limit is the operator (planned as a distributed take-ordered)
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    top = BG.top_pairs(TM.written(docs.select(X.tokens("text").alias("tokens")), "bigram-tokens"), 20, X.BIGRAM_SEP)
    return top.select(F.replace("bg", F.lit(X.BIGRAM_SEP), F.lit(" ")).alias("bigram"), "n")
