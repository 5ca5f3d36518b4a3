"""DuckDB SQL fragments equal to the Column builders in ``functions.text``.

These are the independent oracle side: same pattern text, but DuckDB functions
(``regexp_extract_all``, ``list_filter``, ``list_transform``, ``string_split``).
"""

from __future__ import annotations

from quillscope.functions import lexicon
from quillscope.functions import text as X


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0.0)"


def words(text: str = "text") -> str:
    return f"regexp_extract_all({text}, {q(X.WORD_RE)}, 0)"


def tokens(text: str = "text") -> str:
    return f"regexp_extract_all({text}, {q(X.TOKEN_RE)}, 0)"


def word_chars(text: str = "text") -> str:
    return f"length(regexp_replace({text}, {q(X.WS_RUN_RE)}, '', 'g'))"


def count_literal(text: str, literal: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {q(literal)}, ''))) / {len(literal)} AS BIGINT)"


def count_regex(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(pattern)}, 0)) AS BIGINT)"


def basic_cols(text: str = "text", w: str = "_w", mode: str = "literal") -> str:
    qc = count_literal(text, X.QUESTION_LITERAL) if mode == "literal" else count_regex(text, X.QUESTION_REGEX)
    ec = count_literal(text, X.ELLIPSIS_LITERAL) if mode == "literal" else count_regex(text, X.ELLIPSIS_REGEX)
    return ",\n".join(
        [
            f"{ratio(word_chars(text), f'len({w})')} AS avg_word_length",
            f"CAST(len(list_distinct({w})) AS BIGINT) AS vocab_size",
            f"{ratio(f'len(list_distinct({w}))', f'len({w})')} AS word_density",
            f"{ratio(f'len(list_distinct({w}))', f'len({w})')} AS lexical_diversity",
            f"{qc} AS question_count",
            f"{count_literal(text, '!')} AS exclamation_count",
            f"{ec} AS ellipsis_count",
        ]
    )


def is_function_word(x: str) -> str:
    return f"(lower({x}) IN {in_list(lexicon.function_words())})"


def func_word_count(t: str = "_t") -> str:
    return f"CAST(len(list_filter({t}, lambda x: {is_function_word('x')})) AS BIGINT)"


def noun_count(t: str = "_t") -> str:
    ends = in_list(lexicon.sentence_end_tokens())
    pred = (
        f"NOT {is_function_word('x')} AND ("
        f"regexp_matches(lower(x), {q(lexicon.noun_suffix_regex())}) OR "
        f"(regexp_matches(x, {q(r'^\p{Lu}\p{Ll}')}) AND i > 1 AND NOT ({t}[i - 1] IN {ends})))"
    )
    return f"CAST(len(list_filter({t}, lambda x, i: {pred})) AS BIGINT)"


def bigrams(t: str = "_t") -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || chr(1) || {t}[i + 1])"


def sentences(text: str = "text") -> str:
    marked = f"regexp_replace({text}, {q(X.SENT_BOUNDARY_RE)}, '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda p: regexp_matches(p, {q(X.NONBLANK_RE)}))"


def english_cols(t: str = "_t", s: str = "_s") -> str:
    bg = bigrams(t)
    sent_chars = f"list_sum(list_transform({s}, lambda p: length(regexp_replace(p, {q(X.TRIM_RE)}, '', 'g'))))"
    return ",\n".join(
        [
            f"{func_word_count(t)} AS func_word_count",
            f"{noun_count(t)} AS noun_count",
            f"{ratio(noun_count(t), f'len({t})')} AS noun_ratio",
            f"CAST(len({t}) - len(list_distinct({t})) AS BIGINT) AS token_repetition_count",
            f"CAST(len({bg}) - len(list_distinct({bg})) AS BIGINT) AS bigram_repetition_count",
            f"{ratio(f'len({t})', f'len({s})')} AS avg_sent_len_word",
            f"{ratio(f'coalesce({sent_chars}, 0)', f'len({s})')} AS avg_sent_len_char",
        ]
    )


def token_count(t: str = "_t") -> str:
    return f"CAST(len({t}) + {X.SPECIAL_TOKENS} AS BIGINT)"


def kept(text: str = "text", t: str = "_t", awl: str = "avg_word_length") -> str:
    return (
        f"NOT ({token_count(t)} > {X.TOKEN_LIMIT} OR starts_with({text}, '[') "
        f"OR {awl} > {X.MAX_AVG_WORD_LENGTH})"
    )


def reason(text: str = "text", t: str = "_t", awl: str = "avg_word_length") -> str:
    return (
        f"CASE WHEN {token_count(t)} > {X.TOKEN_LIMIT} THEN 'token_limit' "
        f"WHEN starts_with({text}, '[') THEN 'bracket_prefix' "
        f"WHEN {awl} > {X.MAX_AVG_WORD_LENGTH} THEN 'long_words' END"
    )


LABELLED = "(SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def extended_cte(source: str = LABELLED, allow_outliers: bool = False, mode: str = "literal") -> str:
    """CTEs b (basic), k (kept, with tokens), x (extended) over a (doc_id, text, label) source."""
    where = "" if allow_outliers else f"WHERE {kept()}"
    return f"""
_src AS (SELECT * FROM {source} WHERE text IS NOT NULL),
_bw AS (SELECT *, {words()} AS _w FROM _src),
b AS (SELECT * EXCLUDE (_w), {basic_cols(mode=mode)} FROM _bw),
_bt AS (SELECT *, {tokens()} AS _t FROM b),
k AS (SELECT * FROM _bt {where}),
_ks AS (SELECT *, {sentences()} AS _s FROM k),
x AS (SELECT * EXCLUDE (_t, _s), {english_cols()} FROM _ks)
"""


# ------------------------------------------------------------------ distribution tails by quadrature
_POINTS = 100000


def beta_inc(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta I_x(a, b) as a scalar subquery: the midpoint rule on
    x = sin^2(u), scaled by the integrand's maximum (no gamma function involved)."""

    def area(to: str) -> str:
        u = f"((k + 0.5) * ({to}) / {_POINTS})"
        power = f"(2 * ({a}) - 1) * ln(sin({u})) + (2 * ({b}) - 1) * ln(cos({u}))"
        s2 = f"((2 * ({a}) - 1) / (2 * ({a}) + 2 * ({b}) - 2))"
        top = (
            f"0.5 * ((2 * ({a}) - 1) * ln(greatest({s2}, 1e-300)) + "
            f"CASE WHEN ({b}) > 0.5 THEN (2 * ({b}) - 1) * ln(greatest(1 - {s2}, 1e-300)) ELSE 0 END)"
        )
        return f"(SELECT sum(exp(greatest({power} - ({top}), -700))) * ({to}) FROM range({_POINTS}) _r(k))"

    return f"({area(f'asin(sqrt({x}))')} / {area('pi() / 2')})"


def t_two_sided(t: str, df: str) -> str:
    return beta_inc(f"({df}) / 2.0", "0.5", f"({df}) / (({df}) + ({t}) * ({t}))")


def f_cdf(f: str, d1: str, d2: str) -> str:
    return beta_inc(f"({d1}) / 2.0", f"({d2}) / 2.0", f"({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))")


def t_critical95(df: str) -> str:
    """Two-sided 5 % point of t by its expansion around the normal one (1e-9 from df = 50)."""
    z = 1.959963984540054
    c1, c2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    c3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    c4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    c5 = (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640
    return f"({z!r} + {c5!r} / pow({df}, 5) + {c1!r} / ({df}) + {c2!r} / pow({df}, 2) + {c3!r} / pow({df}, 3) + {c4!r} / pow({df}, 4))"
