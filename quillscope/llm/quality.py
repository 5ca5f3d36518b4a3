"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured in one narrow projection. Rule failures are summed by host (the domain
or source of a document); a host's failure rate is shrunk towards a beta prior whose two
parameters are fitted to all hosts' rates by the method of moments, so a host of three documents
isn't judged by them alone. Hosts whose shrunken rate reaches ``HOST_LIMIT`` for a rule are
rejected, and the verdict goes back to their documents.

Repeated five-word windows are found inside a row: windows are hashed (64 bits), and only
a text with equal hashes has them sorted to find the places. Nothing but (host, counts) is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscope.llm.common import prepare, stored
from quillscope.llm.components import small
from quillscope.operators.features import materialize

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10  # symbols per 100 words
DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.8
PRIOR_MAX = 1e6  # weight of the prior, in documents, if all hosts have the same rate
RULES = ("short", "repeats", "symbols", "lines")
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _windows(w: Column) -> Column:
    """A hash of each window of words."""
    n = F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(w, F.lit(j + 1), n) for j in range(WINDOW)])
    return F.transform(parts, lambda s: F.xxhash64(*[s[str(j)] for j in range(WINDOW)]))


def _covered(g: Column) -> Column:
    """Words in windows whose hash occurs twice or more (the array has such)."""
    s = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    m = F.size(g) - 1

    def places(s: Column) -> Column:
        h, none = s["h"], F.array(F.lit(None).cast("bigint"))
        same = F.zip_with(
            F.zip_with(h, F.concat(none, F.slice(h, F.lit(1), m)), lambda a, b: a == b),
            F.zip_with(h, F.concat(F.slice(h, F.lit(2), m), none), lambda a, b: a == b),
            lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
        )
        return F.sort_array(F.array_compact(F.zip_with(same, s["p"], lambda k, p: F.when(k, p))))

    def total(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    # one-element arrays bind a value once for the lambdas that use it several times
    return F.transform(F.transform(F.array(s), places), total)[0]


def measure(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``(_in, _host, n_words, ..., base_failed, _short, ... )``: ``_in`` has the columns ``keep`` (all).

    Null texts count as empty ones: no words, so they fail the rule on length.
    """
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("_"))
    a = docs.select(row.alias("_in"), F.col(f"`{host_col}`").cast("string").alias("_host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    a = a.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = a.withColumns({"_g": _windows(F.col("_w")), "_l": lines})
    a = a.select(
        "_in",
        "_host",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size("_l").cast("bigint").alias("_lines"),
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), _covered(F.col("_g"))).otherwise(0).cast("bigint").alias("n_repeat_words"),
    )
    short = F.col("n_words") < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    return a.withColumns(
        {
            "base_failed": short | repeats,
            "_short": short,
            "_repeats": repeats,
            "_symbols": F.col("n_symbols") * 100 > F.col("n_words") * SYMBOL_PERCENT,
            "_lines": F.col("n_dup_lines") * 100 > F.col("_lines") * DUP_LINE_PERCENT,
        }
    )


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(host, n, <rule>_rate..., host_kept)``: shrunken failure rates; a null host has none."""
    per = stored(
        measured.where("_host is not null")
        .groupBy(F.col("_host").alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(F.col(f"_{r}").cast("bigint")).alias(r) for r in RULES]),
        "hosts",
    )
    sums = [F.sum("n").alias("n")]
    for r in RULES:
        sums += [F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq")]
    all_ = per.agg(*sums)
    prior = []
    for r in RULES:
        mean = F.col(r) / F.col("n")
        spread = F.col(f"{r}_sq") / F.col("n") - mean * mean
        weight = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(PRIOR_MAX)
        prior += [mean.alias(f"{r}_mean"), F.least(F.greatest(weight, F.lit(1.0)), F.lit(PRIOR_MAX)).alias(f"{r}_weight")]
    p = all_.select(*prior).first().asDict()  # one row: literals of the rates
    p = {name: F.lit(value).cast("double") for name, value in p.items()}
    rates = {r: (F.col(r) + p[f"{r}_mean"] * p[f"{r}_weight"]) / (F.col("n") + p[f"{r}_weight"]) for r in RULES}
    out = per.select("host", "n", *[x.alias(f"{r}_rate") for r, x in rates.items()])
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    return out.withColumn("host_kept", worst < limit)


def quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with the measures, ``base_failed`` and ``kept`` (such columns are replaced).

    Texts are measured once; the measures, without the text unless it is kept, are written before
    hosts are judged. A document of a null host stands by its own rules. An empty table gives none.
    """
    prepare(docs.sparkSession)
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {*MEASURES, "kept"}]
    measured = stored(measure(docs, text_col, host_col, own), "measured")
    judged = _with_verdicts(measured, host_verdicts(measured))
    return judged.select(*([] if not own else ["_in.*"]), *MEASURES, "kept")


def filter_rejected(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, in its columns. Two narrow passes over the texts: one for
    the hosts' counts, one for the verdicts; no text is shuffled or written."""
    prepare(docs.sparkSession)
    verdicts = host_verdicts(measure(docs, text_col, host_col, []))
    # the barrier keeps the optimizer from pushing the filter below the measures, which would
    # compute them once more for each use in the condition
    rows = materialize(measure(docs, text_col, host_col))
    return _with_verdicts(rows, verdicts).where("kept").select("_in.*")


def _with_verdicts(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    bad = stored(verdicts.where("not host_kept").select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "verdicts")
    return measured.join(small(bad), "_host", "left").withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull())


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, p, w[p:p + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
c AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(s) AS n_repeat_words FROM (
  SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS s FROM c) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
  100 * n_symbols > 10 * n_words AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS k,
  unnest([sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)]) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT k, sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)) AS v FROM h GROUP BY k),
p AS (SELECT k, mean, least(greatest(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1e6 END, 1.0), 1e6) AS wt FROM a),
b AS (SELECT DISTINCT source FROM h JOIN p USING (k) WHERE (x + mean * wt) / (n + wt) >= 0.8)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (f1 OR f2) AS base_failed,
  NOT (f1 OR f2) AND NOT coalesce(source IN (SELECT source FROM b), false) AS kept FROM f
"""
