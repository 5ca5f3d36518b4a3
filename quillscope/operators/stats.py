"""Feature analysis: class summaries, variance / mean tests, correlations, regressions,
distribution summaries. Moments come from one wide aggregate (partial + final
aggregation, no row-level unpivot); order statistics use the exact distributed
selection in ``quantiles``; p-values are computed on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.functions import tails
from quillscope.operators import quantiles, ranking, scan
from quillscope.operators.textmodel import written
from quillscope.session import cut, ship_package

CLASS_NAMES = {0: "Human", 1: "AI"}


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _num(c: Column) -> Column:
    """Double value, NaN as NULL (statistics ignore both)."""
    v = c.cast("double")
    return F.when(~F.isnan(v), v)


# ------------------------------------------------------------------ reshape
def features_long(wide: DataFrame, features: list[str], id_cols: list[str] = ("doc_id", "label")) -> DataFrame:
    """Wide -> long ``(id..., feature, value double)``."""
    cast = wide.select(*id_cols, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot(list(id_cols), features, "feature", "value")


def class_name(label: Column) -> Column:
    return F.when(label == 0, F.lit(CLASS_NAMES[0])).when(label == 1, F.lit(CLASS_NAMES[1]))


# ------------------------------------------------------------------ moments (one pass)
def two_class_moments(wide: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row per feature with class-0 (human) and class-1 (AI) n, mean, var.

    A single global aggregate with class-conditional inputs (partial aggregation on
    every task, one tiny final merge); the features table is read once.
    """
    aggs = []
    for f in features:
        for c in (0, 1):
            v = F.when(F.col(label) == c, _num(F.col(f)))
            aggs += [
                F.count(v).alias(f"{f}__n{c}"),
                F.avg(v).alias(f"{f}__mean{c}"),
                F.var_samp(v).alias(f"{f}__var{c}"),
            ]
    g = wide.agg(*aggs)
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"{f}__{m}{c}").alias(f"{m}{c}") for c in (0, 1) for m in ("n", "mean", "var")],
        )
        for f in features
    ]
    return g.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


def welch(tc: DataFrame) -> DataFrame:
    s0 = _div(F.col("var0"), F.col("n0"))
    s1 = _div(F.col("var1"), F.col("n1"))
    se2 = s0 + s1
    t = _div(F.col("mean0") - F.col("mean1"), F.sqrt(se2))
    df = _div(se2 * se2, s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1))
    return tc.withColumns({"t": t, "df": df})


def welch_interval(tc: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Welch's t with its p-value and the confidence limits of the difference of means."""
    se = F.sqrt(_div(F.col("var0"), F.col("n0")) + _div(F.col("var1"), F.col("n1")))
    w = with_t_pvalue(welch(tc)).withColumns({"se": se, "crit": tails.t_critical(alpha, F.col("df"))})
    gap = F.col("mean0") - F.col("mean1")
    return w.select(
        "feature", "t", "df", "p_value", (gap - F.col("crit") * F.col("se")).alias("lo"), (gap + F.col("crit") * F.col("se")).alias("hi")
    )


def student(tc: DataFrame) -> DataFrame:
    dfree = F.col("n0") + F.col("n1") - 2
    sp2 = _div((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1"), dfree)
    se = F.sqrt(sp2 * (_div(F.lit(1.0), F.col("n0")) + _div(F.lit(1.0), F.col("n1"))))
    t = _div(F.col("mean0") - F.col("mean1"), se)
    return tc.withColumns({"t": t, "df": dfree.cast("double")})


def variance_test(tc: DataFrame) -> DataFrame:
    return tc.withColumns(
        {
            "f": _div(F.col("var0"), F.col("var1")),
            "df1": (F.col("n0") - 1).cast("double"),
            "df2": (F.col("n1") - 1).cast("double"),
        }
    )


def with_t_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.t_pvalue(F.col("t"), F.col("df")))


def with_f_pvalue(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", tails.f_pvalue(F.col("f"), F.col("df1"), F.col("df2")))


def adaptive_t(tc: DataFrame, alpha: float = 0.05) -> DataFrame:
    """F-test first; p < alpha or no F -> Welch, else Student; not-finite t -> not comparable."""
    ft = with_f_pvalue(variance_test(tc)).withColumnRenamed("p_value", "f_p_value")
    w = welch(ft).select("feature", F.col("t").alias("t_welch"), F.col("df").alias("df_welch"))
    s = student(ft).select("feature", F.col("t").alias("t_student"), F.col("df").alias("df_student"))
    j = ft.join(w, "feature").join(s, "feature")
    use_welch = F.col("f_p_value").isNull() | (F.col("f_p_value") < alpha)
    j = j.withColumns(
        {
            "method": F.when(use_welch, F.lit("welch")).otherwise(F.lit("student")),
            "t": F.when(use_welch, F.col("t_welch")).otherwise(F.col("t_student")),
            "df": F.when(use_welch, F.col("df_welch")).otherwise(F.col("df_student")),
        }
    )
    j = with_t_pvalue(j)
    status = F.when(F.col("t").isNull() | F.isnan(F.col("t")), F.lit("not_comparable")).otherwise(F.lit("ok"))
    return j.withColumn("status", status).select(
        "feature", "f", "f_p_value", "method", "t", "df", "p_value", "status", "mean0", "mean1"
    )


def feature_ranking(tc: DataFrame, exclude: list[str] = ("sentiment_label",)) -> DataFrame:
    """Rank comparable features by |Welch t| (largest first); rows = number of features."""
    w = welch(tc).where(F.col("t").isNotNull() & ~F.col("feature").isin(list(exclude)))
    # one row per feature: this window is over a feature-sized table
    order = Window.orderBy(F.abs(F.col("t")).desc(), F.col("feature"))
    return w.select(
        "feature",
        F.col("t"),
        (F.col("mean1") - F.col("mean0")).alias("mean_gap"),
        F.dense_rank().over(order).cast("bigint").alias("rank"),
    )


# ------------------------------------------------------------------ order statistics
def _values(long: DataFrame, keys: list[str], persisted: bool) -> DataFrame:
    """``(keys..., value)`` rows without nulls and NaN, read more than once below.

    ``persisted=True`` says ``long`` already starts from written data (e.g. an unpivot over
    a checkpointed wide table, 14x fewer rows to write than the long form); otherwise the
    long rows are checkpointed here so the text pipeline is not recomputed per pass.
    """
    v = long.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*keys, "value")
    return v if persisted else cut(v)


def class_summary(long: DataFrame, persisted: bool = False) -> DataFrame:
    """min, Q1, median, mean, Q3, max per (feature, label), NULLs removed (R type-7 quantiles)."""
    keys = ["feature", "label"]
    vals = _values(long, keys, persisted)
    q = quantiles.quantiles_type7(vals, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    m = vals.groupBy(*keys).agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max")
    )
    return m.join(q, keys).select(*keys, "min", "q1", "median", "mean", "q3", "max")


def _hinges(vals: DataFrame, keys: list[str]) -> DataFrame:
    """Tukey hinges, median and the fences 1.5 hinge spreads beyond, one row per group."""
    n = vals.groupBy(*keys).agg(F.count("*").alias("n"))
    n4 = F.floor((F.col("n") + 3) / 2) / 2.0
    spec = n.select(
        *keys,
        "n",
        F.floor(n4).cast("bigint").alias("l1"),
        F.ceil(n4).cast("bigint").alias("l2"),
        (F.col("n") + 1 - F.floor(n4)).cast("bigint").alias("u1"),
        (F.col("n") + 1 - F.ceil(n4)).cast("bigint").alias("u2"),
        F.floor((F.col("n") + 1) / 2.0).cast("bigint").alias("m1"),
        F.ceil((F.col("n") + 1) / 2.0).cast("bigint").alias("m2"),
    )
    names = ["l1", "l2", "u1", "u2", "m1", "m2"]
    spec = cut(spec)
    ranks = spec.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("pos"), F.col(c).alias("k")) for c in names])).alias("_r"))
    ranks = ranks.select(*keys, "_r.pos", "_r.k")
    stats = quantiles.order_statistics(vals, keys, "value", ranks.select(*keys, "k"))
    x = ranks.join(stats, keys + ["k"]).groupBy(*keys).pivot("pos", names).agg(F.first("kth"))
    h = spec.select(*keys, "n").join(x, keys).select(
        *keys,
        "n",
        ((F.col("l1") + F.col("l2")) / 2).alias("lower_hinge"),
        ((F.col("m1") + F.col("m2")) / 2).alias("median"),
        ((F.col("u1") + F.col("u2")) / 2).alias("upper_hinge"),
    )
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    return h.withColumns({"lo_fence": F.col("lower_hinge") - 1.5 * spread, "hi_fence": F.col("upper_hinge") + 1.5 * spread})


def boxplot_outliers(long: DataFrame, id_cols: list[str] = ("doc_id",)) -> DataFrame:
    """The rows ``(id..., feature, label, value)`` beyond the fences. ``long``: over written data."""
    keys = ["feature", "label"]
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    h = cut(_hinges(vals.select(*keys, "value"), keys).select(*keys, "lo_fence", "hi_fence"))
    beyond = (F.col("value") < F.col("lo_fence")) | (F.col("value") > F.col("hi_fence"))
    # one row per feature and class
    return vals.join(F.broadcast(h), keys).where(beyond).select(*id_cols, *keys, "value")


def boxplot_stats(long: DataFrame, persisted: bool = False) -> DataFrame:
    """Tukey hinges (fivenum), whiskers at the extreme values within 1.5 hinge spreads, outlier count."""
    keys = ["feature", "label"]
    vals = _values(long, keys, persisted)
    h = _hinges(vals, keys)
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    wh = vals.join(F.broadcast(h), keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
    )
    return h.join(wh, keys).select(
        *keys, "n", "lower_whisker", "lower_hinge", "median", "upper_hinge", "upper_whisker", "n_outliers"
    )


def histogram(long: DataFrame, bins: int = 40, persisted: bool = False) -> DataFrame:
    """Equal-width bins over the two-class range of each feature, maximum in the last bin."""
    # two passes (ranges, then bins): read written data, not the text pipeline twice
    vals = _values(long, ["feature", "label"], persisted)
    rng = vals.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / width))
    )
    # rng has one row per feature: a bounded broadcast
    return (
        vals.join(F.broadcast(rng), "feature")
        .groupBy("feature", "label", b.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .select("feature", "label", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"), "n")
    )


def density_grid(long: DataFrame, points: int = 512, bw_cut: float = 3.0, persisted: bool = False) -> DataFrame:
    """Gaussian kernel density per (feature, label) on ``points`` grid points.

    Bandwidth is R's nrd0: 0.9 * min(sd, IQR / 1.34) * n^-0.2. Values are linearly
    binned onto the output grid first (groupBy cell, map-side combined), so each group
    has at most ``points + 1`` cell weights however many rows it holds. The kernel sums
    (points x cells per group) run vectorized in ``applyInPandas`` on those bounded
    groups: no row pairs are emitted and no data row reaches Python.
    """
    keys = ["feature", "label"]
    vals = _values(long, keys, persisted)
    q = quantiles.quantiles_type7(vals, keys, "value", {"q1": 0.25, "q3": 0.75})
    m = vals.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
        F.avg("value").alias("mean"),
    )
    p = m.join(q, keys)
    lo_sd = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    lo = (
        F.when(lo_sd > 0, lo_sd)
        .when(F.col("sd") > 0, F.col("sd"))
        .when(F.abs(F.col("vmin")) > 0, F.abs(F.col("vmin")))
        .otherwise(F.lit(1.0))
    )
    p = p.withColumn("bw", 0.9 * lo * F.pow(F.col("n").cast("double"), -0.2))
    p = p.withColumns(
        {"g0": F.col("vmin") - bw_cut * F.col("bw"), "g1": F.col("vmax") + bw_cut * F.col("bw")}
    ).withColumn("dx", (F.col("g1") - F.col("g0")) / (points - 1))
    p = cut(p)  # one row per feature and class, read twice
    u = (F.col("value") - F.col("g0")) / F.col("dx")
    j = F.floor(u).cast("bigint")
    frac = u - F.floor(u)
    # p has one row per (feature, label): bounded broadcast
    binned = vals.join(F.broadcast(p.select(*keys, "g0", "dx")), keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(j.alias("cell"), (1 - frac).alias("w")),
                F.struct((j + 1).alias("cell"), frac.alias("w")),
            )
        ).alias("_s"),
    )
    cells = binned.groupBy(*keys, F.col("_s.cell").alias("cell")).agg(F.sum("_s.w").alias("w"))
    # cell indexes lie in [0, points]: at most points + 1 weights per group whatever the
    # row count, so each group below is bounded by the grid, not by the data
    spec = p.select(*keys, "n", "bw", "g0", "dx")
    grouped = cells.join(F.broadcast(spec), keys)
    schema = f"{', '.join(f'{k} {grouped.schema[k].dataType.simpleString()}' for k in keys)}, gi bigint, x double, density double"
    return grouped.groupBy(*keys).applyInPandas(_kernel_sum(keys, points), schema)


def density_markers(long: DataFrame, grid: DataFrame, persisted: bool = False) -> DataFrame:
    """What a plot of both classes' curves adds: each class's mean and the shared upper limit of
    the density axis, per feature."""
    vals = _values(long, ["feature", "label"], persisted)
    mean = vals.groupBy("feature", "label").agg(F.avg("value").alias("mean"))
    top = grid.groupBy("feature").agg(F.max("density").alias("y_max"))
    return mean.join(top, "feature").select("feature", "label", "mean", "y_max")


def _kernel_sum(keys: list[str], points: int):
    def run(pdf):
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        gi = np.arange(points, dtype=np.float64)
        z = (gi[:, None] - pdf["cell"].to_numpy(np.float64)[None, :]) * (first["dx"] / first["bw"])
        k = np.exp(-0.5 * z * z) @ pdf["w"].to_numpy(np.float64)
        out = {key: first[key] for key in keys}
        out.update(
            gi=np.arange(points, dtype=np.int64),
            x=first["g0"] + gi * first["dx"],
            density=k / (first["n"] * first["bw"] * np.sqrt(2 * np.pi)),
        )
        return pd.DataFrame(out)

    return run


# ------------------------------------------------------------------ correlation & regression
def sufficiency(n: Column, min_rows: int) -> Column:
    """Data-sufficiency guard: 'empty' (n = 0), 'insufficient' (n <= min_rows) or 'ok'."""
    return (
        F.when(n == 0, F.lit("empty"))
        .when(n <= min_rows, F.lit("insufficient"))
        .otherwise(F.lit("ok"))
    )


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.na.drop("any", subset=[x, y])
    return d.agg(F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def pearson_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Correlations of every two features: ``(first, second, n, r)``, each over the rows that have both.

    One aggregate of Gram matrices: a task adds up counts, sums and products of its rows by matrix products (of
    values around the features' means, nulls and NaN as 0, and of the masks of present values), and only
    one row for each pair leaves it. ``r`` is null where a feature does not vary.
    """
    ship_package(df.sparkSession)
    # written once: the means and the products read numbers, not the texts that these come from
    wide = written(df.select(*[_num(F.col(f)).alias(f) for f in features]), "correlation-input")
    middle = wide.agg(*[F.avg(f).alias(f) for f in features]).first()  # one row
    centre = [middle[f] or 0.0 for f in features]
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = len(features)
        total = np.zeros((len(names), k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            there = ~np.isnan(x)
            x, m = np.where(there, x - centre, 0.0), there.astype(float)
            s, q = x.T @ m, (x * x).T @ m
            total += [m.T @ m, s, s.T, q, q.T, x.T @ x]
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t[i, j]) for t in total]], names=["i", "j", *names])

    parts = wide.mapInArrow(run, "i long, j long, " + ", ".join(f"{c} double" for c in names))
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n = F.col("n")
    sxx, syy = F.col("sxx") - _div(F.col("sx") * F.col("sx"), n), F.col("syy") - _div(F.col("sy") * F.col("sy"), n)
    r = _div(F.col("sxy") - _div(F.col("sx") * F.col("sy"), n), F.sqrt(sxx) * F.sqrt(syy))
    flat = (sxx <= 1e-12 * F.col("sxx")) | (syy <= 1e-12 * F.col("syy"))
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in features]), (F.col(c) + 1).cast("int"))
    r = F.when(flat | r.isNull(), None).when(F.col("i") == F.col("j"), 1.0).otherwise(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    return g.select(name("i").alias("first"), name("j").alias("second"), n.cast("bigint").alias("n"), r.alias("r"))


def spearman(df: DataFrame, x: str, y: str, id_col: str = "doc_id") -> DataFrame:
    """Spearman rho = Pearson correlation of tie-averaged ranks (ranks without a global window)."""
    d = cut(df.select(id_col, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop("any"))
    d = ranking.average_rank(d, "_x", "_rx")
    d = ranking.average_rank(d, "_y", "_ry")
    return d.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def spearman_test(df: DataFrame, x: str, y: str, id_col: str = "doc_id") -> DataFrame:
    s = spearman(df, x, y, id_col)
    t = F.col("rho") * F.sqrt(_div(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    s = s.withColumns({"t": t, "df": (F.col("n") - 2).cast("double")})
    return with_t_pvalue(s).select("n", "rho", "p_value")


def log_log_input(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.na.drop("any", subset=[x, y]).where((F.col(x) > 0) & (F.col(y) > 0))
    return d.withColumns({"log_x": F.ln(F.col(x).cast("double")), "log_y": F.ln(F.col(y).cast("double"))})


def ols_fit(d: DataFrame, x: str = "log_x", y: str = "log_y", moments: bool = False) -> DataFrame:
    """Simple OLS with intercept from one aggregate (numerically stable regr_* moments);
    ``moments`` adds the sum of squares and the mean of x."""
    X, Y = F.col(x), F.col(y)
    s = d.agg(
        F.regr_count(Y, X).alias("n"),
        F.regr_slope(Y, X).alias("slope"),
        F.regr_intercept(Y, X).alias("intercept"),
        F.regr_r2(Y, X).alias("r2"),
        F.regr_sxx(Y, X).alias("sxx"),
        F.regr_syy(Y, X).alias("syy"),
        F.regr_sxy(Y, X).alias("sxy"),
        F.regr_avgx(Y, X).alias("xbar"),
    )
    n = F.col("n").cast("double")
    ssr = F.col("syy") - F.col("slope") * F.col("sxy")
    s2 = _div(ssr, n - 2)
    ll = -n / 2 * (F.log(F.lit(2 * 3.141592653589793)) + F.log(_div(ssr, n)) + 1)
    return s.select(
        F.col("n").cast("bigint").alias("n"),
        sufficiency(F.col("n"), 0).alias("status"),
        "slope",
        "intercept",
        "r2",
        (1 - (1 - F.col("r2")) * _div(n - 1, n - 2)).alias("adj_r2"),
        F.sqrt(_div(s2, F.col("sxx"))).alias("se_slope"),
        F.sqrt(s2 * (_div(F.lit(1.0), n) + _div(F.col("xbar") * F.col("xbar"), F.col("sxx")))).alias("se_intercept"),
        _div(F.col("slope") * F.col("sxy"), s2).alias("f_stat"),
        ll.alias("log_lik"),
        (-2 * ll + 4).alias("aic"),
        (-2 * ll + 2 * F.log(n)).alias("bic"),
        *(["sxx", "xbar"] if moments else []),
    )


def ols_summary(fit: DataFrame, residuals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The rest of a regression summary, from the one-row results of ``ols_fit`` and
    ``ols_residual_stats``: t, p and confidence limits of both coefficients, the F test, the
    omnibus (D'Agostino-Pearson) and Jarque-Bera tests of the residuals, condition number."""
    r = ranking.one_row(residuals)
    j = fit.withColumns({c: r[c] for c in ("skew", "kurtosis", "jarque_bera")})
    n = F.col("n").cast("double")
    j = j.withColumns({"df": n - 2, "crit": tails.t_critical(alpha, n - 2)})
    cols = ["n", F.col("df")]
    for name in ("slope", "intercept"):
        b, se = F.col(name), F.col(f"se_{name}")
        j = j.withColumn(f"t_{name}", _div(b, se))
        cols += [
            f"t_{name}",
            tails.t_pvalue(F.col(f"t_{name}"), F.col("df")).alias(f"p_{name}"),
            (b - F.col("crit") * se).alias(f"lo_{name}"),
            (b + F.col("crit") * se).alias(f"hi_{name}"),
        ]
    # skewness: Johnson transform; kurtosis: Anscombe-Glynn
    g1, g2 = F.col("skew"), F.col("kurtosis")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    q = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(q + F.sqrt(q * q + 1)) / F.sqrt(0.5 * F.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    # eigenvalues of the 2 x 2 matrix of (1, x)
    sxx = F.col("sxx") + n * F.col("xbar") * F.col("xbar")
    half, root = (n + sxx) / 2, F.sqrt(F.pow((n - sxx) / 2, 2) + F.pow(n * F.col("xbar"), 2))
    cols += [
        "f_stat",
        tails.f_upper_pvalue(F.col("f_stat"), F.lit(1.0), F.col("df")).alias("p_f"),
        k2.alias("omnibus"),
        F.exp(-k2 / 2).alias("p_omnibus"),
        "jarque_bera",
        F.exp(-F.col("jarque_bera") / 2).alias("p_jarque_bera"),
        F.sqrt(_div(half + root, half - root)).alias("cond_no"),
    ]
    return j.select(*cols)


def ols_residual_stats(d: DataFrame, fit: DataFrame, x: str = "log_x", y: str = "log_y") -> DataFrame:
    """Residual skew, kurtosis, Jarque-Bera (second pass; the fit is a one-row broadcast)."""
    f = ranking.one_row(fit.select("slope", "intercept"))
    r = d.select((F.col(y) - f["intercept"] - f["slope"] * F.col(x)).alias("e"))
    m = r.agg(
        F.count("*").alias("n"),
        F.avg(F.pow("e", 2)).alias("m2"),
        F.avg(F.pow("e", 3)).alias("m3"),
        F.avg(F.pow("e", 4)).alias("m4"),
    )
    skew = _div(F.col("m3"), F.pow(F.col("m2"), 1.5))
    kurt = _div(F.col("m4"), F.col("m2") * F.col("m2"))
    return m.select(
        skew.alias("skew"),
        kurt.alias("kurtosis"),
        (F.col("n") / 6.0 * (skew * skew + (kurt - 3) * (kurt - 3) / 4)).alias("jarque_bera"),
    )


def durbin_watson(d: DataFrame, fit: DataFrame, order_col: str, x: str = "log_x", y: str = "log_y") -> DataFrame:
    """sum((e_t - e_{t-1})^2) / sum(e_t^2) in ``order_col`` order (a unique key): a prefix scan carries each
    row's residual to the next one, also from one partition to the next."""
    f = ranking.one_row(fit.select("slope", "intercept"))
    r = d.select(order_col, (F.col(y) - f["intercept"] - f["slope"] * F.col(x)).alias("e"))
    r = scan.prefix_scan(r, [F.col(order_col)], "e", previous="prev")
    sums = r.agg(F.sum(F.pow(F.col("e") - F.col("prev"), 2)).alias("num"), F.sum(F.col("e") * F.col("e")).alias("den"))
    return sums.select(_div(F.coalesce("num", F.lit(0.0)), F.col("den")).alias("durbin_watson"))


def poly2_fit(train: DataFrame, x: str, y: str) -> DataFrame:
    """y = b0 + b1 x + b2 x^2 by least squares; rows with a null or NaN in either are left out.

    A first aggregate finds means and the scale of x; the normal equations are summed and solved
    in z = (x - mean) / scale, where they are well conditioned, and the solution is
    transformed back.
    """
    d = train.select(_num(F.col(x)).alias("_x"), _num(F.col(y)).alias("_y")).na.drop("any")
    first = cut(d.agg(F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.stddev_pop("_x").alias("sx")))
    f = ranking.one_row(first)
    z = d.select(((F.col("_x") - f["mx"]) / F.when(f["sx"] > 0, f["sx"]).otherwise(1.0)).alias("z"), (F.col("_y") - f["my"]).alias("v"))
    Z, V = F.col("z"), F.col("v")
    s = z.agg(
        F.count("*").cast("double").alias("n"),
        *[F.avg(F.pow(Z, k)).alias(f"m{k}") for k in (1, 2, 3, 4)],
        F.avg(V).alias("v0"),
        F.avg(Z * V).alias("v1"),
        F.avg(Z * Z * V).alias("v2"),
    )
    c = F.col
    # centred moments: regress v on z and on z^2 - mean, both against the constant
    s11, s12, s22 = c("m2") - c("m1") * c("m1"), c("m3") - c("m1") * c("m2"), c("m4") - c("m2") * c("m2")
    t1, t2 = c("v1") - c("m1") * c("v0"), c("v2") - c("m2") * c("v0")
    det = s11 * s22 - s12 * s12
    c1, c2 = _div(t1 * s22 - t2 * s12, det), _div(t2 * s11 - t1 * s12, det)
    s = s.select(c1.alias("c1"), c2.alias("c2"), (c("v0") - c1 * c("m1") - c2 * c("m2")).alias("c0"))
    s = s.select("*", f["mx"].alias("mx"), f["my"].alias("my"), F.when(f["sx"] > 0, f["sx"]).otherwise(1.0).alias("sx"))
    m = c("mx") / c("sx")
    return s.select(
        (c("my") + c("c0") - c("c1") * m + c("c2") * m * m).alias("intercept"),
        ((c("c1") - 2 * c("c2") * m) / c("sx")).alias("coef_x"),
        (c("c2") / (c("sx") * c("sx"))).alias("coef_x2"),
    )


def r2_score(test: DataFrame, fit: DataFrame, x: str, y: str) -> DataFrame:
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    f = ranking.one_row(fit)
    pred = f["intercept"] + f["coef_x"] * X + f["coef_x2"] * X * X
    m = test.agg(
        F.sum(F.pow(Y - pred, 2)).alias("sse"),
        F.var_pop(Y).alias("vp"),
        F.count("*").alias("n"),
    )
    return m.select(F.col("n").alias("n_test"), (1 - _div(F.col("sse"), F.col("vp") * F.col("n"))).alias("r2_test"))
