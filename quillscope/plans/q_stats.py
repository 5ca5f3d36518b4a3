"""Queries: feature analysis and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.operators import features as FE
from quillscope.operators import learn as LN
from quillscope.operators import prep, ranking, stats
from quillscope.plans import sqltext as S
from quillscope.plans.q_text import extended
from quillscope.plans.registry import register
from quillscope.session import cut
from quillscope.sources import tables

FEATS = FE.NUMERIC_FEATURES
X_COL, Y_COL = "avg_word_length", "func_word_count"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return stats.features_long(extended(spark, d), FEATS)


def _long_written(spark: SparkSession, d: str) -> DataFrame:
    """Long rows as a lazy unpivot over the checkpointed wide feature table (16 values per
    document are written once; every quantile round re-expands them on read)."""
    wide = cut(extended(spark, d).select("doc_id", "label", *FEATS))
    return stats.features_long(wide, FEATS)


def _tc(spark: SparkSession, d: str) -> DataFrame:
    return stats.two_class_moments(extended(spark, d), FEATS)


# ---------------------------------------------------------------- SQL building blocks
EXT = S.extended_cte()
LONG_SQL = f"""{EXT},
xl AS (SELECT doc_id, label, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)} FROM x),
lg AS (UNPIVOT xl ON {', '.join(FEATS)} INTO NAME feature VALUE value)"""
TC_SQL = f"""{LONG_SQL},
m AS (SELECT feature, label, count(value)::BIGINT AS n, avg(value) AS mean, var_samp(value) AS var FROM lg GROUP BY ALL),
tc AS (SELECT a.feature, a.n AS n0, a.mean AS mean0, a.var AS var0, b.n AS n1, b.mean AS mean1, b.var AS var1
       FROM m a JOIN m b ON a.feature = b.feature AND a.label = 0 AND b.label = 1)"""


def _sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


WELCH_T = _sdiv("mean0 - mean1", f"sqrt({_sdiv('var0', 'n0')} + {_sdiv('var1', 'n1')})")
WELCH_DF = _sdiv(
    f"pow({_sdiv('var0', 'n0')} + {_sdiv('var1', 'n1')}, 2)",
    f"pow({_sdiv('var0', 'n0')}, 2) / (n0 - 1) + pow({_sdiv('var1', 'n1')}, 2) / (n1 - 1)",
)
SP2 = _sdiv("(n0 - 1) * var0 + (n1 - 1) * var1", "n0 + n1 - 2")
STUDENT_T = _sdiv("mean0 - mean1", f"sqrt({SP2} * ({_sdiv('1', 'n0')} + {_sdiv('1', 'n1')}))")


# ---------------------------------------------------------------- R1 / U3
@register(
    "features_long",
    sql=f"WITH {LONG_SQL} SELECT feature, label, count(*)::BIGINT AS n, sum(value) AS total FROM lg GROUP BY ALL",
    doubles=("total",),
)
def features_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).groupBy("feature", "label").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register(
    "features_long_named",
    sql=f"""WITH {LONG_SQL} SELECT CASE WHEN label = 0 THEN 'Human' WHEN label = 1 THEN 'AI' END AS label_name,
    feature, count(*)::BIGINT AS n, avg(value) AS mean FROM lg GROUP BY ALL""",
    doubles=("mean",),
)
def features_long_named(spark: SparkSession, d: str) -> DataFrame:
    lg = _long(spark, d).withColumn("label_name", stats.class_name(F.col("label")))
    return lg.groupBy("label_name", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@register("distinct_features", sql=f"WITH {LONG_SQL} SELECT DISTINCT feature FROM lg")
def distinct_features(spark: SparkSession, d: str) -> DataFrame:
    # a feature is listed if the table has rows at all: one narrow count, no row per feature
    n = extended(spark, d).select("doc_id").agg(F.count("*").alias("n"))
    return n.where("n > 0").select(F.explode(F.array(*[F.lit(f) for f in FEATS])).alias("feature"))


# ---------------------------------------------------------------- A2
@register(
    "class_summary",
    sql=f"""WITH {LONG_SQL} SELECT feature, label, min(value) AS min, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS max
    FROM lg WHERE value IS NOT NULL GROUP BY ALL""",
    doubles=("min", "q1", "median", "mean", "q3", "max"),
)
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_summary(_long_written(spark, d), persisted=True)


# ---------------------------------------------------------------- A7-A11, A16
@register(
    "variance_test",
    sql=f"WITH {TC_SQL} SELECT feature, {_sdiv('var0', 'var1')} AS f, (n0 - 1)::DOUBLE AS df1, (n1 - 1)::DOUBLE AS df2 FROM tc",
    doubles=("f", "df1", "df2"),
)
def variance_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.variance_test(_tc(spark, d)).select("feature", "f", "df1", "df2")


@register(
    "t_student",
    sql=f"WITH {TC_SQL} SELECT feature, {STUDENT_T} AS t, (n0 + n1 - 2)::DOUBLE AS df FROM tc",
    doubles=("t", "df"),
)
def t_student(spark: SparkSession, d: str) -> DataFrame:
    return stats.student(_tc(spark, d)).select("feature", "t", "df")


@register(
    "t_welch",
    sql=f"WITH {TC_SQL} SELECT feature, n0, n1, mean0, mean1, {WELCH_T} AS t, {WELCH_DF} AS df FROM tc",
    doubles=("mean0", "mean1", "t", "df"),
)
def t_welch(spark: SparkSession, d: str) -> DataFrame:
    return stats.welch(_tc(spark, d)).select("feature", "n0", "n1", "mean0", "mean1", "t", "df")


_F = _sdiv("var0", "var1")
_F_LOW = S.f_cdf("f", "n0 - 1", "n1 - 1")


@register(
    "t_adaptive",
    sql=f"""WITH {TC_SQL}, v AS (SELECT *, {_F} AS f FROM tc),
    c AS (SELECT *, CASE WHEN f IS NOT NULL THEN {_F_LOW} END AS cdf FROM v),
    p AS (SELECT *, CASE WHEN cdf IS NOT NULL THEN least(1.0, 2 * least(cdf, 1 - cdf)) END AS f_p_value FROM c),
    u AS (SELECT *, CASE WHEN f_p_value IS NULL OR f_p_value < 0.05 THEN 'welch' ELSE 'student' END AS method FROM p),
    t AS (SELECT *, CASE WHEN method = 'welch' THEN {WELCH_T} ELSE {STUDENT_T} END AS t,
      CASE WHEN method = 'welch' THEN {WELCH_DF} ELSE (n0 + n1 - 2)::DOUBLE END AS df FROM u)
    SELECT feature, f, f_p_value, method, t, df, CASE WHEN t IS NOT NULL AND df > 0 THEN {S.t_two_sided("t", "df")} END AS p_value,
      CASE WHEN t IS NULL THEN 'not_comparable' ELSE 'ok' END AS status, mean0, mean1 FROM t""",
    doubles=("f", "f_p_value", "t", "df", "p_value", "mean0", "mean1"),
)
def t_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return stats.adaptive_t(_tc(spark, d))


_SE = f"sqrt({_sdiv('var0', 'n0')} + {_sdiv('var1', 'n1')})"


@register(
    "t_welch_interval",
    sql=f"""WITH {TC_SQL}, w AS (SELECT *, {WELCH_T} AS t, {WELCH_DF} AS df, {_SE} AS se FROM tc)
    SELECT feature, t, df, CASE WHEN t IS NOT NULL THEN {S.t_two_sided("t", "df")} END AS p_value,
      mean0 - mean1 - {S.t_critical95("df")} * se AS lo, mean0 - mean1 + {S.t_critical95("df")} * se AS hi FROM w""",
    doubles=("t", "df", "p_value", "lo", "hi"),
)
def t_welch_interval(spark: SparkSession, d: str) -> DataFrame:
    return stats.welch_interval(_tc(spark, d))


@register(
    "feature_ranking",
    sql=f"""WITH {TC_SQL}, w AS (SELECT feature, mean0, mean1, {WELCH_T} AS t FROM tc)
    SELECT feature, t, mean1 - mean0 AS mean_gap, dense_rank() OVER (ORDER BY abs(t) DESC, feature)::BIGINT AS rank
    FROM w WHERE t IS NOT NULL AND feature <> 'sentiment_label'""",
    doubles=("t", "mean_gap"),
)
def feature_ranking(spark: SparkSession, d: str) -> DataFrame:
    return stats.feature_ranking(_tc(spark, d))


# ---------------------------------------------------------------- all 16 features
ALL_FEATS = FEATS + FE.SENTIMENT_FEATURES
_SENT_SQL = f"""{EXT}, se AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
sp AS (SELECT doc_id, (list_position(z, list_max(z)) - 1)::BIGINT AS sentiment_label,
  1.0 / list_reduce(list_transform(z, lambda v: exp(v - list_max(z))), lambda a, b: a + b) AS sentiment_score FROM se),
x16 AS (SELECT x.*, sentiment_label, sentiment_score FROM x LEFT JOIN sp USING (doc_id)),
xl AS (SELECT doc_id, label, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in ALL_FEATS)} FROM x16),
lg AS (FROM xl UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(ALL_FEATS)})))"""
TC16_SQL = f"""{_SENT_SQL},
m AS (SELECT feature, label, count(value)::BIGINT AS n, avg(value) AS mean, var_samp(value) AS var FROM lg GROUP BY ALL),
tc AS (SELECT a.feature, a.n AS n0, a.mean AS mean0, a.var AS var0, b.n AS n1, b.mean AS mean1, b.var AS var1
       FROM m a JOIN m b ON a.feature = b.feature AND a.label = 0 AND b.label = 1)"""


def _extended16(spark: SparkSession, d: str) -> DataFrame:
    """The feature table with sentiment label and score: class and probability of the encoder's
    output vector of the same id (null for documents without one)."""
    e = tables.load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("z"))
    label, score = LN.softmax_argmax(F.col("z"))
    return extended(spark, d).join(e.select("doc_id", label.alias("sentiment_label"), score.alias("sentiment_score")), "doc_id", "left")


@register(
    "extended16",
    sql=f"WITH {_SENT_SQL} SELECT doc_id, label, {', '.join(ALL_FEATS)} FROM x16",
    doubles=("avg_word_length", "word_density", "lexical_diversity", "noun_ratio", "avg_sent_len_word", "avg_sent_len_char", "sentiment_score"),
)
def extended16(spark: SparkSession, d: str) -> DataFrame:
    return _extended16(spark, d).select("doc_id", "label", *ALL_FEATS)


@register(
    "t_welch16",
    sql=f"WITH {TC16_SQL} SELECT feature, n0, n1, mean0, mean1, {WELCH_T} AS t, {WELCH_DF} AS df FROM tc",
    doubles=("mean0", "mean1", "t", "df"),
)
def t_welch16(spark: SparkSession, d: str) -> DataFrame:
    tc = stats.two_class_moments(_extended16(spark, d), ALL_FEATS)
    return stats.welch(tc).select("feature", "n0", "n1", "mean0", "mean1", "t", "df")


@register(
    "feature_ranking16",
    sql=f"""WITH {TC16_SQL}, w AS (SELECT feature, mean0, mean1, {WELCH_T} AS t FROM tc)
    SELECT feature, t, mean1 - mean0 AS mean_gap, dense_rank() OVER (ORDER BY abs(t) DESC, feature)::BIGINT AS rank
    FROM w WHERE t IS NOT NULL AND feature <> 'sentiment_label'""",
    doubles=("t", "mean_gap"),
)
def feature_ranking16(spark: SparkSession, d: str) -> DataFrame:
    return stats.feature_ranking(stats.two_class_moments(_extended16(spark, d), ALL_FEATS))


@register(
    "class_summary16",
    sql=f"""WITH {_SENT_SQL} SELECT feature, label, min(value) AS min, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.75) AS q3, max(value) AS max
    FROM lg WHERE value IS NOT NULL GROUP BY ALL""",
    doubles=("min", "q1", "median", "mean", "q3", "max"),
)
def class_summary16(spark: SparkSession, d: str) -> DataFrame:
    wide = cut(_extended16(spark, d).select("doc_id", "label", *ALL_FEATS))
    return stats.class_summary(stats.features_long(wide, ALL_FEATS), persisted=True)


# ---------------------------------------------------------------- A13-A15
BOX_SQL = f"""WITH {LONG_SQL},
    r AS (SELECT feature, label, value, row_number() OVER (PARTITION BY feature, label ORDER BY value) AS rn,
                 count(*) OVER (PARTITION BY feature, label) AS n FROM lg WHERE value IS NOT NULL),
    sp AS (SELECT feature, label, n, floor((n + 3) / 2) / 2.0 AS n4 FROM r GROUP BY ALL),
    h AS (SELECT sp.feature, sp.label, sp.n::BIGINT AS n,
      (max(CASE WHEN rn = floor(n4) THEN value END) + max(CASE WHEN rn = ceil(n4) THEN value END)) / 2 AS lower_hinge,
      (max(CASE WHEN rn = floor((sp.n + 1) / 2.0) THEN value END) + max(CASE WHEN rn = ceil((sp.n + 1) / 2.0) THEN value END)) / 2 AS median,
      (max(CASE WHEN rn = sp.n + 1 - floor(n4) THEN value END) + max(CASE WHEN rn = sp.n + 1 - ceil(n4) THEN value END)) / 2 AS upper_hinge
      FROM sp JOIN r USING (feature, label) GROUP BY ALL),
    f AS (SELECT *, lower_hinge - 1.5 * (upper_hinge - lower_hinge) AS lo_f, upper_hinge + 1.5 * (upper_hinge - lower_hinge) AS hi_f FROM h)"""


@register(
    "boxplot_stats",
    sql=f"""{BOX_SQL}
    SELECT f.feature, f.label, f.n, min(CASE WHEN value BETWEEN lo_f AND hi_f THEN value END) AS lower_whisker,
      lower_hinge, median, upper_hinge, max(CASE WHEN value BETWEEN lo_f AND hi_f THEN value END) AS upper_whisker,
      sum(CASE WHEN value BETWEEN lo_f AND hi_f THEN 0 ELSE 1 END)::BIGINT AS n_outliers
    FROM f JOIN lg USING (feature, label) WHERE value IS NOT NULL
    GROUP BY f.feature, f.label, f.n, lower_hinge, median, upper_hinge""",
    doubles=("lower_whisker", "lower_hinge", "median", "upper_hinge", "upper_whisker"),
)
def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.boxplot_stats(_long_written(spark, d), persisted=True)


@register(
    "boxplot_outliers",
    sql=f"""{BOX_SQL}
    SELECT doc_id, f.feature, f.label, value FROM f JOIN lg USING (feature, label) WHERE value < lo_f OR value > hi_f""",
    doubles=("value",),
)
def boxplot_outliers(spark: SparkSession, d: str) -> DataFrame:
    return stats.boxplot_outliers(_long_written(spark, d))


@register(
    "histogram40",
    sql=f"""WITH {LONG_SQL}, rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg GROUP BY feature)
    SELECT feature, label, bin, lo + bin * (hi - lo) / 40 AS bin_start, count(*)::BIGINT AS n FROM (
      SELECT lg.*, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(39, floor((value - lo) / ((hi - lo) / 40))) END AS BIGINT) AS bin
      FROM lg JOIN rg USING (feature) WHERE value IS NOT NULL) GROUP BY feature, label, bin, lo, hi""",
    doubles=("bin_start",),
)
def histogram40(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_long_written(spark, d), 40, persisted=True)


DENSITY_SQL = f"""WITH {LONG_SQL},
    p0 AS (SELECT feature, label, count(*) AS n, stddev_samp(value) AS sd, min(value) AS vmin, max(value) AS vmax,
           quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg WHERE value IS NOT NULL GROUP BY ALL),
    p1 AS (SELECT *, CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                          WHEN sd > 0 THEN sd WHEN abs(vmin) > 0 THEN abs(vmin) ELSE 1.0 END AS lo FROM p0),
    p2 AS (SELECT *, 0.9 * lo * pow(n::DOUBLE, -0.2) AS bw FROM p1),
    p AS (SELECT *, vmin - 3.0 * bw AS g0, (vmax + 3.0 * bw - (vmin - 3.0 * bw)) / 511 AS dx FROM p2),
    u AS (SELECT lg.feature, lg.label, (value - g0) / dx AS u FROM lg JOIN p USING (feature, label) WHERE value IS NOT NULL),
    c AS (SELECT feature, label, cell, sum(w) AS w FROM (
            SELECT feature, label, floor(u)::BIGINT AS cell, 1 - (u - floor(u)) AS w FROM u
            UNION ALL SELECT feature, label, floor(u)::BIGINT + 1, u - floor(u) FROM u) GROUP BY ALL),
    g AS (SELECT feature, label, n, bw, g0, dx, unnest(range(0, 512)) AS gi FROM p)"""


@register(
    "density_grid",
    sql=f"""{DENSITY_SQL}
    SELECT g.feature, g.label, gi::BIGINT AS gi, g0 + gi * dx AS x,
      sum(w * exp(-0.5 * pow((gi - cell) * dx / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density
    FROM g JOIN c USING (feature, label) GROUP BY g.feature, g.label, gi, g0, dx, n, bw""",
    doubles=("x", "density"),
)
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    return stats.density_grid(_long_written(spark, d), persisted=True)


@register(
    "density_markers",
    sql=f"""{DENSITY_SQL},
    y AS (SELECT g.feature, g.label, gi, sum(w * exp(-0.5 * pow((gi - cell) * dx / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density
      FROM g JOIN c USING (feature, label) GROUP BY g.feature, g.label, gi, g0, dx, n, bw),
    t AS (SELECT feature, max(density) AS y_max FROM y GROUP BY feature)
    SELECT feature, label, avg(value) AS mean, any_value(y_max) AS y_max FROM lg JOIN t USING (feature) GROUP BY feature, label""",
    doubles=("mean", "y_max"),
)
def density_markers(spark: SparkSession, d: str) -> DataFrame:
    long = _long_written(spark, d)
    return stats.density_markers(long, stats.density_grid(long, persisted=True), persisted=True)


# ---------------------------------------------------------------- A3 / A4 / W1
PAIR_SQL = f"{EXT}, pr AS (SELECT doc_id, CAST({X_COL} AS DOUBLE) AS x, CAST({Y_COL} AS DOUBLE) AS y FROM x WHERE {X_COL} IS NOT NULL AND {Y_COL} IS NOT NULL)"


@register("pearson", sql=f"WITH {PAIR_SQL} SELECT count(*)::BIGINT AS n, corr(x, y) AS r FROM pr", doubles=("r",))
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson(extended(spark, d), X_COL, Y_COL)


RANK_SQL = f"""{PAIR_SQL},
rk AS (SELECT doc_id, x, y,
  rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pr)"""


_MATRIX_PAIRS = [(a, b) for i, a in enumerate(ALL_FEATS) for b in ALL_FEATS[i:]]


@register(
    "pearson_matrix",
    sql=f"WITH {_SENT_SQL.replace('x16 AS (', 'x16 AS MATERIALIZED (')} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, count(*)::BIGINT AS n, "
        + (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END" if a == b else f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END")
        + f" AS r FROM x16 WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in _MATRIX_PAIRS
    ),
    doubles=("r",),
)
def pearson_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.pearson_matrix(_extended16(spark, d), ALL_FEATS)


@register("spearman", sql=f"WITH {RANK_SQL} SELECT count(*)::BIGINT AS n, corr(rx, ry) AS rho FROM rk", doubles=("rho",))
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(extended(spark, d), X_COL, Y_COL)


@register(
    "spearman_test",
    sql=f"""WITH {RANK_SQL}, s AS (SELECT count(*)::BIGINT AS n, corr(rx, ry) AS rho FROM rk),
    t AS (SELECT n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM s)
    SELECT n, rho, {S.t_two_sided("t", "(n - 2)::DOUBLE")} AS p_value FROM t""",
    doubles=("rho", "p_value"),
)
def spearman_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman_test(extended(spark, d), X_COL, Y_COL)


@register(
    "avg_rank",
    sql="""SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS avg_rank
    FROM events WHERE value IS NOT NULL""",
    doubles=("avg_rank",),
)
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    from quillscope.operators import ranking
    from quillscope.sources import tables

    ev = tables.load(spark, d, "events").select("event_id", "value").where(F.col("value").isNotNull())
    return ranking.average_rank(ev, "value", "avg_rank").select("event_id", "avg_rank")


# ---------------------------------------------------------------- P11-P14, A5, A6, W4
LOG_SQL = f"{PAIR_SQL}, lgx AS (SELECT doc_id, ln(x) AS log_x, ln(y) AS log_y FROM pr WHERE x > 0 AND y > 0)"


@register("log_transform", sql=f"WITH {LOG_SQL} SELECT doc_id, log_x, log_y FROM lgx", doubles=("log_x", "log_y"))
def log_transform(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_log_input(extended(spark, d), X_COL, Y_COL).select("doc_id", "log_x", "log_y")


OLS_COLS = ("slope", "intercept", "r2", "adj_r2", "se_slope", "se_intercept", "f_stat", "log_lik", "aic", "bic")


@register(
    "loglog_ols",
    sql=f"""WITH {LOG_SQL}, s AS (SELECT regr_count(log_y, log_x)::DOUBLE AS n, regr_slope(log_y, log_x) AS slope,
      regr_intercept(log_y, log_x) AS intercept, regr_r2(log_y, log_x) AS r2, regr_sxx(log_y, log_x) AS sxx,
      regr_syy(log_y, log_x) AS syy, regr_sxy(log_y, log_x) AS sxy, regr_avgx(log_y, log_x) AS xbar FROM lgx),
    t AS (SELECT *, syy - slope * sxy AS ssr FROM s),
    u AS (SELECT *, {_sdiv('ssr', 'n - 2')} AS s2, -n / 2 * (ln(2 * pi()) + ln({_sdiv('ssr', 'n')}) + 1) AS ll FROM t)
    SELECT n::BIGINT AS n, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, slope, intercept, r2, 1 - (1 - r2) * {_sdiv('n - 1', 'n - 2')} AS adj_r2,
      sqrt({_sdiv('s2', 'sxx')}) AS se_slope, sqrt(s2 * ({_sdiv('1', 'n')} + {_sdiv('xbar * xbar', 'sxx')})) AS se_intercept,
      {_sdiv('slope * sxy', 's2')} AS f_stat, ll AS log_lik, -2 * ll + 4 AS aic, -2 * ll + 2 * ln(n) AS bic FROM u""",
    doubles=OLS_COLS,
)
def loglog_ols(spark: SparkSession, d: str) -> DataFrame:
    return stats.ols_fit(stats.log_log_input(extended(spark, d), X_COL, Y_COL))


RESID_SQL = f"""{LOG_SQL}, fit AS (SELECT regr_slope(log_y, log_x) AS b, regr_intercept(log_y, log_x) AS a FROM lgx),
e AS (SELECT doc_id, log_y - a - b * log_x AS e FROM lgx, fit)"""


@register(
    "ols_residuals",
    sql=f"""WITH {RESID_SQL}, m AS (SELECT count(*) AS n, avg(pow(e, 2)) AS m2, avg(pow(e, 3)) AS m3, avg(pow(e, 4)) AS m4 FROM e),
    kk AS (SELECT n, {_sdiv("m3", "pow(m2, 1.5)")} AS skew, {_sdiv('m4', 'm2 * m2')} AS kurtosis FROM m)
    SELECT skew, kurtosis, n / 6.0 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) AS jarque_bera FROM kk""",
    doubles=("skew", "kurtosis", "jarque_bera"),
)
def ols_residuals(spark: SparkSession, d: str) -> DataFrame:
    inp = cut(stats.log_log_input(extended(spark, d), X_COL, Y_COL).select("doc_id", "log_x", "log_y"))
    return stats.ols_residual_stats(inp, stats.ols_fit(inp))


_OMNI_SQL = f"""o1 AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
  (kurtosis - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS xk,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1 FROM al),
o2 AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / sb1 * (2 / sb1 + sqrt(1 + 4 / (sb1 * sb1))) AS aa FROM o1),
o3 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / aa) / (1 + xk * sqrt(2 / (aa - 4))) AS inr FROM o2),
o4 AS (SELECT *, (1 - 2 / (9 * aa) - sign(inr) * pow(abs(inr), 1.0 / 3)) / sqrt(2 / (9 * aa)) AS z2 FROM o3),
o5 AS (SELECT *, z1 * z1 + z2 * z2 AS k2, sxx + n * xbar * xbar AS s22 FROM o4)"""


@register(
    "ols_summary",
    sql=f"""WITH {RESID_SQL}, m AS (SELECT avg(pow(e, 2)) AS m2, avg(pow(e, 3)) AS m3, avg(pow(e, 4)) AS m4 FROM e),
    s AS (SELECT regr_count(log_y, log_x)::DOUBLE AS n, regr_slope(log_y, log_x) AS slope, regr_intercept(log_y, log_x) AS intercept,
      regr_sxx(log_y, log_x) AS sxx, regr_syy(log_y, log_x) AS syy, regr_sxy(log_y, log_x) AS sxy, regr_avgx(log_y, log_x) AS xbar FROM lgx),
    q AS (SELECT *, (syy - slope * sxy) / (n - 2) AS s2 FROM s),
    al AS (SELECT q.*, n - 2 AS df, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) AS kurtosis, sqrt(s2 / sxx) AS se_s,
      sqrt(s2 * (1 / n + xbar * xbar / sxx)) AS se_i, slope * sxy / s2 AS f_stat, {S.t_critical95("(n - 2)")} AS crit FROM q, m),
    {_OMNI_SQL},
    r AS (SELECT *, slope / se_s AS t_s, intercept / se_i AS t_i, n / 6 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) AS jb,
      (n + s22) / 2 AS hf, sqrt(pow((n - s22) / 2, 2) + pow(n * xbar, 2)) AS rt FROM o5)
    SELECT n::BIGINT AS n, df, t_s AS t_slope, {S.t_two_sided("t_s", "df")} AS p_slope, slope - crit * se_s AS lo_slope, slope + crit * se_s AS hi_slope,
      t_i AS t_intercept, {S.t_two_sided("t_i", "df")} AS p_intercept, intercept - crit * se_i AS lo_intercept, intercept + crit * se_i AS hi_intercept,
      f_stat, {S.t_two_sided("sqrt(f_stat)", "df")} AS p_f, k2 AS omnibus, exp(-k2 / 2) AS p_omnibus, jb AS jarque_bera,
      exp(-jb / 2) AS p_jarque_bera, sqrt((hf + rt) / (hf - rt)) AS cond_no FROM r""",
    doubles=(
        "df", "t_slope", "p_slope", "lo_slope", "hi_slope", "t_intercept", "p_intercept", "lo_intercept", "hi_intercept",
        "f_stat", "p_f", "omnibus", "p_omnibus", "jarque_bera", "p_jarque_bera", "cond_no",
    ),
)
def ols_summary(spark: SparkSession, d: str) -> DataFrame:
    inp = cut(stats.log_log_input(extended(spark, d), X_COL, Y_COL).select("doc_id", "log_x", "log_y"))
    fit = cut(stats.ols_fit(inp, moments=True))
    return stats.ols_summary(fit, stats.ols_residual_stats(inp, fit))


@register(
    "durbin_watson",
    sql=f"""WITH {RESID_SQL}, l AS (SELECT e, lag(e) OVER (ORDER BY doc_id) AS p FROM e)
    SELECT {_sdiv('sum(CASE WHEN p IS NOT NULL THEN pow(e - p, 2) END)', 'sum(e * e)')} AS durbin_watson FROM l""",
    doubles=("durbin_watson",),
)
def durbin_watson(spark: SparkSession, d: str) -> DataFrame:
    inp = cut(stats.log_log_input(extended(spark, d), X_COL, Y_COL).select("doc_id", "log_x", "log_y"))
    return stats.durbin_watson(inp, stats.ols_fit(inp), "doc_id")


@register(
    "poly_features",
    sql=f"WITH {PAIR_SQL} SELECT doc_id, x, x * x AS x2 FROM pr",
    doubles=("x", "x2"),
)
def poly_features(spark: SparkSession, d: str) -> DataFrame:
    e = extended(spark, d).na.drop("any", subset=[X_COL, Y_COL])
    x = F.col(X_COL).cast("double")
    return e.select("doc_id", x.alias("x"), (x * x).alias("x2"))


@register(
    "poly_regression",
    sql=f"""WITH {PAIR_SQL},
    o AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS pos, count(*) OVER () AS n FROM pr),
    tr AS (SELECT * FROM o WHERE pos > ceil(0.2 * n)), te AS (SELECT * FROM o WHERE pos <= ceil(0.2 * n)),
    z AS (SELECT x - (SELECT avg(x) FROM tr) AS z, y FROM tr),
    g AS (SELECT regr_slope(z * z, z) AS a1, regr_intercept(z * z, z) AS a0 FROM z),
    q AS (SELECT regr_slope(y, z * z - a0 - a1 * z) AS b2 FROM z, g),
    l AS (SELECT regr_slope(y - b2 * z * z, z) AS b1, regr_intercept(y - b2 * z * z, z) AS b0, any_value(b2) AS b2, (SELECT avg(x) FROM tr) AS mx FROM z, q),
    fit AS (SELECT b0 - b1 * mx + b2 * mx * mx AS intercept, b1 - 2 * b2 * mx AS coef_x, b2 AS coef_x2 FROM l),
    r AS (SELECT count(*)::BIGINT AS n_test, 1 - {_sdiv('sum(pow(y - (intercept + coef_x * x + coef_x2 * x * x), 2))', 'var_pop(y) * count(*)')} AS r2_test FROM te, fit),
    st AS (SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) <= 5 THEN 'insufficient' ELSE 'ok' END AS status FROM pr)
    SELECT status, intercept, coef_x, coef_x2, n_test, r2_test FROM fit, r, st""",
    doubles=("intercept", "coef_x", "coef_x2", "r2_test"),
)
def poly_regression(spark: SparkSession, d: str) -> DataFrame:
    e = cut(extended(spark, d).na.drop("any", subset=[X_COL, Y_COL]).select("doc_id", X_COL, Y_COL))
    split = prep.split_random(e, "doc_id", test_fraction=0.2, seed=42)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    fit = cut(stats.poly2_fit(train, X_COL, Y_COL))  # one row, read twice
    status = e.agg(stats.sufficiency(F.count("*"), 5)).scalar()
    f = ranking.one_row(fit)
    return stats.r2_score(test, fit, X_COL, Y_COL).select(
        status.alias("status"),
        f["intercept"].alias("intercept"),
        f["coef_x"].alias("coef_x"),
        f["coef_x2"].alias("coef_x2"),
        "n_test",
        "r2_test",
    )
