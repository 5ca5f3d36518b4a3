"""Corpus preparation: deterministic splits, shuffles, mini-batches, unions, training tables.

Random order is ``md5(id:seed)`` (tie on id), so a split or shuffle is reproducible,
identical across retries and engines, and needs no sort of the whole table: a
split is a threshold on the hash found from bucket counts (``ranking.kth_hash``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscope.operators import ranking
from quillscope.session import cut


def _in_head(id_col: str, seed: int, hk: F.Column | None = None, idk: F.Column | None = None) -> F.Column:
    hk = F.col("_hk") if hk is None else hk
    idk = F.col("_idk") if idk is None else idk
    h = ranking.hash_key(id_col, seed)
    return (h < hk) | ((h == hk) & (F.col(id_col) <= idk))


def split_random(df: DataFrame, id_col: str = "doc_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` in {train, test}; test = the first ceil(fraction * n) rows in hash order."""
    th = ranking.kth_hash(df, id_col, seed, F.ceil(F.lit(test_fraction) * F.count("*"))).first()
    # the threshold is one (hash, id) pair, found by bucket counts + one bucket; it enters the
    # plan as two literals, so the split itself is a plain filterable projection
    if th is None:  # empty input
        return df.withColumn("split", F.lit("train"))
    head = _in_head(id_col, seed, F.lit(th["_hk"]), F.lit(th["_idk"]))
    return df.withColumn("split", F.when(head, F.lit("test")).otherwise(F.lit("train")))


def split_stratified(
    df: DataFrame, id_col: str = "doc_id", label: str = "label", test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Per-class split: test = first ceil(fraction * n_class) rows of each class in hash order."""
    th = cut(ranking.kth_hash(df, id_col, seed, F.ceil(F.lit(test_fraction) * F.count("*")), by=[label]))
    # one row per class: broadcast once the class count is checked
    if th.count() <= ranking.BROADCAST_ROWS:
        th = F.broadcast(th)
    out = df.join(th, label, "left")
    split = F.when(F.col("_hk").isNotNull() & _in_head(id_col, seed), F.lit("test")).otherwise(F.lit("train"))
    return out.withColumn("split", split).drop("_hk", "_idk")


def shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = 42, pos: str = "pos") -> DataFrame:
    """Seeded full shuffle as an explicit 1-based position column."""
    return ranking.global_position(df, id_col, seed, pos).drop("_h")


def minibatches(df: DataFrame, batch_size: int, epoch: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Shuffled mini-batches for one epoch: batch_id = (position - 1) // batch_size."""
    s = shuffle(df, id_col, seed + epoch, "_pos")
    return s.withColumns(
        {
            "epoch": F.lit(epoch).cast("bigint"),
            "batch_id": F.floor((F.col("_pos") - 1) / F.lit(batch_size)).cast("bigint"),
        }
    ).drop("_pos")


def union_classes(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def training_table(ext: DataFrame) -> DataFrame:
    """text (when present), label, aux1 = avg_word_length, aux2 = func_word_count (projection + rename)."""
    text = ["text"] if "text" in ext.columns else []
    return ext.select("doc_id", *text, "label", "avg_word_length", "func_word_count").withColumnsRenamed(
        {"avg_word_length": "aux1", "func_word_count": "aux2"}
    )


def minmax_fit(train: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table of per-column min and max (the fitted scaler)."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max")]
    return train.agg(*aggs)


def minmax_apply(df: DataFrame, fit: DataFrame, cols: list[str], suffix: str = "_s") -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0; no clipping (val may leave [0, 1])."""
    s = ranking.one_row(fit)  # the fitted scaler is one row: a scalar subquery
    return df.withColumns(
        {
            f"{c}{suffix}": F.coalesce(
                F.try_divide(F.col(c).cast("double") - s[f"{c}__min"], s[f"{c}__max"] - s[f"{c}__min"]),
                F.lit(0.0),
            )
            for c in cols
        }
    )


def label_struct(df: DataFrame, main: str = "label", aux: list[str] = ("aux1_s", "aux2_s")) -> DataFrame:
    """Nested label record struct<main double, aux array<double>>."""
    return df.withColumn(
        "labels",
        F.struct(
            F.col(main).cast("double").alias("main"),
            F.array(*[F.col(a).cast("double") for a in aux]).alias("aux"),
        ),
    )
