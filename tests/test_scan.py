"""Prefix scans, the correlation matrix and scores side by side against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quillscope.operators import evaluate as EV
from quillscope.operators import scan, stats
from quillscope.plans import q_learn
from tests.conftest import SF001
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize("group", [scan.GROUP, 2])
def test_scan_carries_sums_counts_and_last_values(spark, monkeypatch, group):
    monkeypatch.setattr(scan, "GROUP", group)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.permutation(3000), "v": rng.integers(-5, 9, 3000)})
    pdf["w"] = np.where(pdf.k % 7 == 0, None, pdf.v * 0.5)
    df = spark.createDataFrame([tuple(None if x is None else float(x) if i == 2 else int(x) for i, x in enumerate(r)) for r in pdf.itertuples(index=False)], "k long, v long, w double").repartition(5)
    pdf = pdf.sort_values("k").reset_index(drop=True)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.prefix_scan(df, [F.col("k")], "v", before="b", rows="n", previous="p").toPandas().sort_values("k").reset_index(drop=True)
        null = scan.prefix_scan(df, [F.col("k").desc()], "w", before="b", previous="p").toPandas().sort_values("k", ascending=False).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert (got.b == pdf.v.cumsum().shift(fill_value=0)).all() and (got.n == np.arange(3000)).all()
    assert got.p.isna().sum() == 1 and (got.p[1:] == pdf.v.shift()[1:]).all()
    w = pdf.sort_values("k", ascending=False).reset_index(drop=True).w.astype(float)
    assert np.allclose(null.b, w.fillna(0).cumsum().shift(fill_value=0))
    assert null.p[1:].equals(w.shift()[1:].rename("p"))


def test_scan_of_few_rows(spark):
    one = spark.createDataFrame([(1, 5)], "k long, v long")
    assert scan.prefix_scan(one, [F.col("k")], "v", "b", "n", "p").collect() == [(1, 5, 0, 0, None)]
    assert scan.prefix_scan(one.limit(0), [F.col("k")], "v", "b").count() == 0


def test_matrix_uses_the_rows_of_each_pair(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, 500), "b": rng.normal(size=500), "c": 3.0})
    pdf["d"] = pdf.a * 2 + pdf.b
    pdf.loc[::3, "b"] = np.nan
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("e", F.lit(None).cast("double")).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(4)
    got = {(r["first"], r["second"]): (r["n"], r["r"]) for r in stats.pearson_matrix(df, list("abcde")).collect()}
    assert len(got) == 15
    for x, y in (("a", "b"), ("a", "d"), ("b", "d"), ("a", "a")):
        rows = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
        assert got[x, y][0] == len(rows)
        assert np.isclose(got[x, y][1], 1.0 if x == y else np.corrcoef(rows[x], rows[y])[0, 1], atol=1e-9)
    assert got["c", "c"][1] is None and got["a", "c"][1] is None and got["a", "e"] == (0, None)
    assert stats.pearson_matrix(df.limit(0), ["a", "b"]).count() in (0, 3)


def test_separately_scored_models_meet_without_an_exchange(spark):
    out = q_learn.separate_scores(spark, SF001)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan, plan
    df = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 1.0)], "doc_id long, prob double")
    names = {"x": EV.store_scores(df, "x", 4), "y": EV.store_scores(df.where("doc_id > 1"), "y", 4)}
    assert sorted(map(tuple, EV.side_by_side(spark, names).collect())) == [(2, 0.25, 0.25), (3, 1.0, 1.0)]


@pytest.mark.parametrize("name", ["pearson_matrix", "compare_separate", "paired_t_separate", "spearman_test", "extended16", "eval_text_source", "written_counts"])
def test_oracle(spark, name):
    ok, msg = compare(spark, duck(SF001), SF001, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, msg


def test_the_correlation_matrix_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(0, 50, 1, 2).selectExpr("id * 1.0D as a", "id * id * 1.0D as b").mapInPandas(count, "a double, b double")
    assert stats.pearson_matrix(df, ["a", "b"]).count() == 3
    assert seen.value == 50
