"""Evaluation and comparison: thresholds, verdicts, classification metrics, score
matrix (models as columns), paired t-tests between models."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.functions import tails
from quillscope.session import scratch_path

THRESHOLD = 0.5


def threshold(prob: Column, t: float | None = THRESHOLD) -> Column:
    """1 if prob >= t else 0; ``t=None`` keeps the raw probability."""
    if t is None:
        return prob
    return F.when(prob >= t, 1).otherwise(0).cast("int")


def verdict(prob: Column, t: float = THRESHOLD) -> Column:
    return F.when(prob >= t, F.lit("probably machine text")).otherwise(F.lit("probably human text"))


def prob_text(prob: Column) -> Column:
    return F.format_string("%.4f", prob)


def metrics(scored: DataFrame, by: list[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 from confusion counts; 0 on an empty denominator."""
    y, p = F.col(label), F.col(pred)
    c = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
    )

    def r(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    prec = r(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = r(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        r(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        r(2 * prec * rec, prec + rec).alias("f1"),
    )


def store_scores(scored: DataFrame, model: str, buckets: int = 64, key: str = "doc_id", prob: str = "prob") -> str:
    """A model's scores ``(key, prob)`` as a table of ``buckets`` sorted buckets in the shared folder; returns its name.

    Tables with the same number of buckets, also of separate jobs, are joined on ``key`` where they lie. A bucket is one
    file: choose them so that it fits a task (scores have 16 bytes a row).
    """
    name = f"scores_{uuid.uuid4().hex}"
    rows = scored.select(key, F.col(prob).alias("prob")).repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(scored.sparkSession, f"scores-{model}")).saveAsTable(name)
    return name


def side_by_side(spark: SparkSession, names: dict[str, str], key: str = "doc_id") -> DataFrame:
    """Models as columns: the stored tables (model -> name) joined on ``key``, bucket by bucket, without an exchange.

    Rows that every model scored are kept; a key is one row of each table.
    """
    out = None
    for model, name in names.items():
        t = spark.table(name).select(key, F.col("prob").alias(model))
        out = t if out is None else out.hint("merge").join(t.hint("merge"), key)
    return out


def paired_t(matrix: DataFrame, models: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Paired t statistics for each model pair (first minus second) from one aggregate."""
    pairs = pairs or list(combinations(models, 2))
    aggs = []
    for a, b in pairs:
        d = F.col(a) - F.col(b)
        aggs += [F.count(d).alias(f"{a}__{b}__n"), F.avg(d).alias(f"{a}__{b}__m"), F.stddev_samp(d).alias(f"{a}__{b}__s")]
    g = matrix.agg(*aggs)
    rows = [
        F.struct(
            F.lit(a).alias("first"),
            F.lit(b).alias("second"),
            F.col(f"{a}__{b}__n").alias("n"),
            F.col(f"{a}__{b}__m").alias("mean_diff"),
            F.col(f"{a}__{b}__s").alias("sd_diff"),
        )
        for a, b in pairs
    ]
    out = g.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")
    se = F.col("sd_diff") / F.sqrt(F.col("n").cast("double"))
    return out.select(
        "first",
        "second",
        F.col("n").cast("bigint").alias("n"),
        "mean_diff",
        F.try_divide(F.col("mean_diff"), se).alias("t"),
        (F.col("n") - 1).cast("double").alias("df"),
    )


def paired_t_pvalues(pt: DataFrame) -> DataFrame:
    return pt.withColumn("p_value", tails.t_pvalue(F.col("t"), F.col("df")))
