"""Distributed rank / quantile / split operators against brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillscope.operators import prep, quantiles, ranking, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    g = rng.integers(0, 3, n)
    v = np.round(rng.normal(0, 10, n), 2)
    v[: n // 3] = 7.0  # a hot value holding a third of the rows
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "value": v})
    return spark.createDataFrame(pdf), pdf


def _type7(x, p):
    x = np.sort(x)
    h = (len(x) - 1) * p + 1
    lo, hi = math.floor(h), math.ceil(h)
    return x[lo - 1] + (h - lo) * (x[hi - 1] - x[lo - 1])


def test_quantiles_type7_exact(skewed):
    df, pdf = skewed
    q = quantiles.quantiles_type7(df, ["g"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0}).collect()
    for r in q:
        x = pdf[pdf.g == r.g].value.to_numpy()
        assert math.isclose(r.q1, _type7(x, 0.25))
        assert math.isclose(r.med, np.median(x))
        assert math.isclose(r.q3, _type7(x, 0.75))
        assert r.top == x.max()


def test_order_statistics_many_rounds(spark, monkeypatch):
    # force narrowing rounds (no direct sort) to exercise the iterative path
    monkeypatch.setattr(quantiles, "COLLECT_MAX", 5)
    vals = np.concatenate([np.full(50, 1.0), np.linspace(0, 1e-9, 40), np.logspace(-3, 6, 60)])
    df = spark.createDataFrame(pd.DataFrame({"k0": 0, "v": vals}))
    ks = spark.createDataFrame(pd.DataFrame({"k0": [0] * 5, "k": [1, 17, 60, 100, 150]}))
    got = {r.k: r.kth for r in quantiles.order_statistics(df, ["k0"], "v", ks).collect()}
    s = np.sort(vals)
    assert got == {k: s[k - 1] for k in [1, 17, 60, 100, 150]}


def test_average_rank(skewed):
    df, pdf = skewed
    got = ranking.average_rank(df, "value", "r").toPandas().set_index("id").r.sort_index()
    want = pdf.set_index("id").value.rank(method="average").sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_global_position_and_splits(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("label", (F.col("doc_id") % 3 == 0).cast("int"))
    pos = prep.shuffle(ids, "doc_id", 42).toPandas()
    h = ids.select("doc_id", "label", ranking.hash_key("doc_id", 42).alias("h")).toPandas()
    h = h.sort_values(["h", "doc_id"]).reset_index(drop=True)
    h["want"] = np.arange(1, len(h) + 1)
    m = h.merge(pos, on="doc_id")
    assert (m.want == m.pos).all()

    sp = prep.split_random(ids, "doc_id", 0.2, 42).toPandas()
    test_ids = set(sp[sp.split == "test"].doc_id)
    assert test_ids == set(h.doc_id[: math.ceil(0.2 * 5000)])

    st = prep.split_stratified(ids, "doc_id", "label", 0.2, 42).toPandas()
    for lab, grp in h.groupby("label"):
        want = set(grp.doc_id[: math.ceil(0.2 * len(grp))])
        assert set(st[(st.split == "test") & (st.label == lab)].doc_id) == want


def test_kth_hash_narrowing_rounds(spark, monkeypatch):
    # a tiny bucket bound forces several prefix-narrowing rounds, one group holds most rows
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 3)
    ids = spark.range(6000).withColumnRenamed("id", "doc_id").withColumn(
        "label", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    )
    h = ids.select("doc_id", "label", ranking.hash_key("doc_id", 7).alias("h")).toPandas()
    h = h.sort_values(["h", "doc_id"]).reset_index(drop=True)
    for k in (1, 2, 1234, 6000):
        got = ranking.kth_hash(ids, "doc_id", 7, F.lit(k)).collect()
        assert [(r._hk, r._idk) for r in got] == [(h.h[k - 1], h.doc_id[k - 1])]
    st = prep.split_stratified(ids, "doc_id", "label", 0.3, 7).toPandas()
    for lab, grp in h.groupby("label"):
        want = set(grp.doc_id[: math.ceil(0.3 * len(grp))])
        assert set(st[(st.split == "test") & (st.label == lab)].doc_id) == want


def test_ranks_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)  # shuffled join of the ranks
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3000, 4000).astype(float)
    pdf = pd.DataFrame({"id": np.arange(len(v)), "value": v})
    got = ranking.average_rank(spark.createDataFrame(pdf), "value", "r").toPandas().set_index("id").r.sort_index()
    assert np.allclose(got.to_numpy(), pdf.set_index("id").value.rank(method="average").sort_index().to_numpy())


def test_split_empty_and_tiny(spark):
    one = spark.createDataFrame([(1, 0)], "doc_id long, label int")
    assert [r.split for r in prep.split_random(one).collect()] == ["test"]
    none = spark.createDataFrame([], "doc_id long, label int")
    assert prep.split_random(none).count() == 0


def _fivenum(x):
    x = np.sort(x)
    n = len(x)
    n4 = math.floor((n + 3) / 2) / 2
    d = [1, n4, (n + 1) / 2, n + 1 - n4, n]
    return [0.5 * (x[math.floor(i) - 1] + x[math.ceil(i) - 1]) for i in d]


def test_boxplot_hinges(skewed):
    df, pdf = skewed
    long = df.select(F.lit("v").alias("feature"), F.col("g").alias("label"), "value")
    for r in stats.boxplot_stats(long).collect():
        x = pdf[pdf.g == r.label].value.to_numpy()
        f = _fivenum(x)
        assert math.isclose(r.lower_hinge, f[1]) and math.isclose(r.median, f[2]) and math.isclose(r.upper_hinge, f[3])
        spread = f[3] - f[1]
        inside = x[(x >= f[1] - 1.5 * spread) & (x <= f[3] + 1.5 * spread)]
        assert r.lower_whisker == inside.min() and r.upper_whisker == inside.max()
        assert r.n_outliers == len(x) - len(inside)


def test_histogram_counts_sum(skewed):
    df, pdf = skewed
    long = df.select(F.lit("v").alias("feature"), F.col("g").alias("label"), "value")
    h = stats.histogram(long, 40).toPandas()
    assert h.n.sum() == len(pdf) and h.bin.max() <= 39 and h.bin.min() >= 0


def test_density_integrates_to_one(skewed):
    df, _ = skewed
    long = df.select(F.lit("v").alias("feature"), F.col("g").alias("label"), "value")
    d = stats.density_grid(long).toPandas()
    for _, grp in d.groupby("label"):
        grp = grp.sort_values("gi")
        area = np.trapezoid(grp.density, grp.x)
        assert abs(area - 1) < 0.02


def test_variance_ratio_reciprocal(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"label": [0] * 50 + [1] * 70, "f": np.concatenate([rng.normal(0, 1, 50), rng.normal(1, 2, 70)])})
    wide = spark.createDataFrame(pdf)
    tc = stats.two_class_moments(wide, ["f"])
    r = stats.variance_test(tc).first()
    swapped = stats.two_class_moments(wide.withColumn("label", 1 - F.col("label")), ["f"])
    r2 = stats.variance_test(swapped).first()
    assert math.isclose(r.f, 1 / r2.f)
    w = stats.welch(tc).first()
    a, b = pdf[pdf.label == 0].f, pdf[pdf.label == 1].f
    se2 = a.var() / len(a) + b.var() / len(b)
    assert math.isclose(w.t, (a.mean() - b.mean()) / math.sqrt(se2))


def test_wide_ranging_values_converge(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 120_000), -(10.0 ** rng.uniform(-300, 300, 60_000)), np.zeros(500)])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "value": v}))
    got = quantiles.quantiles_type7(df, ["g"], "value", {"a": 0.01, "m": 0.5, "z": 0.99}).first()
    for name, p in (("a", 0.01), ("m", 0.5), ("z", 0.99)):
        assert math.isclose(got[name], np.quantile(v, p), rel_tol=1e-12)


def test_nan_is_ignored_by_every_statistic(spark):
    vals = [float(i) for i in range(9)] + [float("nan"), None]
    rows = [("f", c, x) for c in (0, 1) for x in vals]
    long = spark.createDataFrame(rows, "feature string, label int, value double")
    for r in stats.class_summary(long).collect():
        assert (r["min"], r["median"], r["mean"], r["max"]) == (0.0, 4.0, 4.0, 8.0)
    for r in stats.boxplot_stats(long).collect():
        assert (r["n"], r["median"], r["n_outliers"]) == (9, 4.0, 0)
    assert sum(r["n"] for r in stats.histogram(long, 4).collect()) == 18
    wide = spark.createDataFrame([(c, x) for c in (0, 1) for x in vals], "label int, f double")
    m = stats.two_class_moments(wide, ["f"]).first()
    assert (m["n0"], m["mean0"], m["n1"], m["mean1"]) == (9, 4.0, 9, 4.0)
    pair = spark.createDataFrame([(x, x) for x in vals], "x double, y double")
    assert stats.pearson(pair, "x", "y").first()["n"] == 9


@pytest.mark.parametrize("mean", [0.0, 100.0, 1000.0])
def test_poly_fit_far_from_zero(spark, mean):
    rng = np.random.default_rng(4)
    x = rng.normal(mean, 1, 20_000)
    y = 2 + 3 * x + 0.1 * x * x + rng.normal(0, 0.5, len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = stats.poly2_fit(df, "x", "y").first()
    z = x - x.mean()
    c2, c1, c0 = np.polyfit(z, y, 2)
    want = (c0 - c1 * x.mean() + c2 * x.mean() ** 2, c1 - 2 * c2 * x.mean(), c2)
    assert np.allclose([got["intercept"], got["coef_x"], got["coef_x2"]], want, rtol=1e-6, atol=1e-9)


def test_boxplot_outlier_rows(spark):
    rows = [(i, 0, "f", float(i % 10)) for i in range(100)] + [(1000, 0, "f", 99.0), (1001, 0, "f", float("nan"))]
    long = spark.createDataFrame(rows, "doc_id long, label int, feature string, value double")
    assert [(r["doc_id"], r["value"]) for r in stats.boxplot_outliers(long).collect()] == [(1000, 99.0)]


def test_average_rank_with_hot_values_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(700, 5.0), rng.integers(0, 3000, 1300).astype(float)])
    pdf = pd.DataFrame({"i": np.arange(len(v) + 1), "v": [*v, None]})
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    want = pdf.v.rank(method="average")
    for bound in (200_000, 0):
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", bound)
        got = {r["i"]: r["rank"] for r in ranking.average_rank(df, "v", "rank").collect()}
        assert len(got) == len(pdf) and got[len(v)] is None
        assert all(got[i] == want[i] for i in range(len(v)))
