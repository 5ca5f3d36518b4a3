"""Stylometric text features as native Spark Column expressions.

Every function here is a pure Column -> Column builder: no UDF, so the work stays
in the JVM. Patterns use only constructs that behave the same in Java regex and
RE2 (explicit code-point classes, ``\\p{..}`` categories, no look-around), so the
same pattern text drives the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscope.functions import lexicon

# --- fixed values: the Unicode whitespace set of Python's str.split() ---
WS = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# --- end of fixed values ---

# the same set as literal characters (for btrim)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

WORD_RE = f"[^{WS}]+"
WS_RUN_RE = f"[{WS}]+"
NONBLANK_RE = f"[^{WS}]"
TRIM_RE = f"^[{WS}]+|[{WS}]+$"
# a token is a run of letters/marks/digits/underscore, or one other non-space character
TOKEN_RE = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{WS}]"
# sentence boundary: a run of terminal punctuation followed by whitespace, or a line break
SENT_BOUNDARY_RE = rf"([.!?…]+)[{WS}]+|[{WS}]*\n[{WS}]*"
SENT_MARK = "\u0001"
BIGRAM_SEP = "\u0001"

# literal strings counted by the question / ellipsis features (see divergence D1)
QUESTION_LITERAL = r"\?"
ELLIPSIS_LITERAL = r"\.\.\.|…"
QUESTION_REGEX = r"\?"
ELLIPSIS_REGEX = r"\.\.\.|…"

TOKEN_LIMIT = 768
SPECIAL_TOKENS = 2
MAX_AVG_WORD_LENGTH = 120


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when den is 0 (never raises under ANSI)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- words
def words(text: Column | str) -> Column:
    """Whitespace-separated words, like Python ``str.split()`` (no empty strings).

    Trim, then split on whitespace runs: a positive-class split is several times
    faster than extracting matches of the negated class.
    """
    trimmed = F.btrim(_c(text), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN_RE))


def word_chars(text: Column | str, w: Column | None = None) -> Column:
    """Total code points over all words = length of the words joined."""
    w = words(text) if w is None else w
    return F.length(F.array_join(w, ""))


def avg_word_length(text: Column | str, w: Column | None = None) -> Column:
    w = words(text) if w is None else w
    return _ratio(word_chars(text, w), F.size(w))


def vocab_size(w: Column) -> Column:
    return F.size(F.array_distinct(w)).cast("bigint")


def word_density(w: Column) -> Column:
    return _ratio(F.size(F.array_distinct(w)), F.size(w))


def count_literal(text: Column | str, literal: str) -> Column:
    """Non-overlapping occurrences of a literal string (Python ``str.count``)."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast(
        "bigint"
    )


def count_regex(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(text), F.lit(pattern)).cast("bigint")


def question_count(text: Column | str, mode: str = "literal") -> Column:
    if mode == "literal":
        return count_literal(text, QUESTION_LITERAL)
    return count_regex(text, QUESTION_REGEX)


def exclamation_count(text: Column | str) -> Column:
    return count_literal(text, "!")


def ellipsis_count(text: Column | str, mode: str = "literal") -> Column:
    if mode == "literal":
        return count_literal(text, ELLIPSIS_LITERAL)
    return count_regex(text, ELLIPSIS_REGEX)


# ---------------------------------------------------------------- tokens
def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), 0)


def is_function_word(tok: Column) -> Column:
    return F.lower(tok).isin(lexicon.function_words())


# token classes: 0 other, 1 function word, 2 suffix noun, 3 capitalised (a proper noun
# unless it opens a sentence)
FUNC, SUFFIX_NOUN, CAPITALISED = 1, 2, 3


def token_classes(t: Column) -> Column:
    """One class code per token; lower-casing and the lexicon lookup run once per token.

    Cheap tests first: CASE branches short-circuit, so most tokens never reach a regex.
    """

    def code(x: Column) -> Column:
        lx = F.lower(x)
        return (
            F.when(lx.isin(lexicon.function_words()), FUNC)
            .when((F.length(x) >= lexicon.MIN_NOUN_SUFFIX_LEN) & lx.rlike(lexicon.noun_suffix_regex()), SUFFIX_NOUN)
            .when(x.rlike(r"^\p{Lu}\p{Ll}"), CAPITALISED)
            .otherwise(0)
        )

    return F.transform(t, code)


def func_word_count(t: Column, k: Column | None = None) -> Column:
    k = token_classes(t) if k is None else k
    return F.size(F.filter(k, lambda c: c == FUNC)).cast("bigint")


def previous_tokens(t: Column) -> Column:
    """[NULL, t1, ..., t(n-1)]: the token before each position, aligned with ``t``."""
    return F.concat(F.array(F.lit(None).cast("string")), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))))


def noun_count(t: Column, k: Column | None = None) -> Column:
    """Suffix nouns plus capitalised tokens that follow a token other than a sentence end."""
    k = token_classes(t) if k is None else k
    # the codes are paired with the shifted tokens outside the lambda: a lambda that indexes
    # back into ``t`` would re-evaluate the whole token array once per element
    ends = lexicon.sentence_end_tokens()

    def is_noun(c: Column, prev: Column) -> Column:
        proper = (c == CAPITALISED) & prev.isNotNull() & ~prev.isin(ends)
        return F.when((c == SUFFIX_NOUN) | proper, 1).otherwise(0)

    return F.aggregate(F.zip_with(k, previous_tokens(t), is_noun), F.lit(0).cast("bigint"), lambda acc, f: acc + f)


def noun_ratio(t: Column, nouns: Column | None = None) -> Column:
    nouns = noun_count(t) if nouns is None else nouns
    return _ratio(nouns, F.size(t))


def token_repetition_count(t: Column) -> Column:
    return (F.size(t) - F.size(F.array_distinct(t))).cast("bigint")


def bigrams(t: Column) -> Column:
    """Adjacent token pairs as 'a<SEP>b' strings; empty for fewer than two tokens.

    Two equal-length slices are zipped, so no padding NULL needs filtering afterwards.
    """
    n1 = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n1), F.slice(t, 2, n1), lambda a, b: F.concat(a, F.lit(BIGRAM_SEP), b))


def bigram_repetition_count(t: Column) -> Column:
    """sum(c - 1) over bigram counts c > 1 = bigrams - distinct bigrams."""
    bg = bigrams(t)
    return (F.size(bg) - F.size(F.array_distinct(bg))).cast("bigint")


# ---------------------------------------------------------------- sentences
def sentences(text: Column | str) -> Column:
    marked = F.regexp_replace(_c(text), SENT_BOUNDARY_RE, "$1" + SENT_MARK)
    pieces = F.split(marked, SENT_MARK)
    return F.filter(pieces, lambda p: p.rlike(NONBLANK_RE))


def sentence_count(s: Column) -> Column:
    return F.size(s).cast("bigint")


def avg_sent_len_word(t: Column, s: Column) -> Column:
    """Mean tokens per sentence; sentences partition the tokens, so total / count."""
    return _ratio(F.size(t), F.size(s))


def avg_sent_len_char(s: Column) -> Column:
    total = F.aggregate(
        s,
        F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.length(F.btrim(p, F.lit(WS_CHARS))).cast("bigint"),
    )
    return _ratio(total, F.size(s))


# ---------------------------------------------------------------- token counts
def token_count(t: Column) -> Column:
    """Tokens plus the two special tokens of an encoder input."""
    return (F.size(t) + F.lit(SPECIAL_TOKENS)).cast("bigint")


def outlier_reason(text: Column | str, tok_count: Column, avg_wlen: Column) -> Column:
    """First failing outlier check in the order token limit, "[" prefix, word length; NULL if kept."""
    t = _c(text)
    return (
        F.when(tok_count > TOKEN_LIMIT, F.lit("token_limit"))
        .when(t.startswith("["), F.lit("bracket_prefix"))
        .when(avg_wlen > MAX_AVG_WORD_LENGTH, F.lit("long_words"))
    )


def is_kept(text: Column | str, tok_count: Column, avg_wlen: Column) -> Column:
    t = _c(text)
    return ~(t.startswith("[") | (avg_wlen > MAX_AVG_WORD_LENGTH) | (tok_count > TOKEN_LIMIT))
