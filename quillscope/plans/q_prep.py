"""Queries: splits, shuffles, batches, unions, sinks, training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.functions import text as X
from quillscope.operators import features as FE
from quillscope.operators import prep
from quillscope.plans import sqltext as S
from quillscope.plans.q_text import extended, labelled
from quillscope.plans.registry import register
from quillscope.session import cut, scratch_path
from quillscope.sources import tables

L = S.LABELLED


def _hash_sql(seed: int, id_col: str = "doc_id") -> str:
    return f"md5(CAST({id_col} AS VARCHAR) || ':{seed}')"


SPLIT_SQL = f"""SELECT doc_id, label, CASE WHEN row_number() OVER (ORDER BY {_hash_sql(42)}, doc_id)
    <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM {L}"""
STRAT_SQL = f"""SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_hash_sql(42)}, doc_id)
    <= ceil(0.2 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM {L}"""


# ---------------------------------------------------------------- SP1 / SP2
@register("split_random", sql=SPLIT_SQL)
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_random(labelled(spark, d).select("doc_id", "label")).select("doc_id", "label", "split")


@register("split_stratified", sql=STRAT_SQL)
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_stratified(labelled(spark, d).select("doc_id", "label")).select("doc_id", "label", "split")


# ---------------------------------------------------------------- SP4 / SP5 / W3
@register(
    "shuffle_seeded",
    sql=f"SELECT doc_id, row_number() OVER (ORDER BY {_hash_sql(42)}, doc_id)::BIGINT AS pos FROM documents",
)
def shuffle_seeded(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").select("doc_id")
    return prep.shuffle(docs, "doc_id", 42).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@register(
    "minibatches",
    sql=f"""SELECT doc_id, e AS epoch, ((row_number() OVER (PARTITION BY e ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || (42 + e)), doc_id) - 1) // 64)::BIGINT AS batch_id
    FROM documents, (SELECT unnest([0, 1])::BIGINT AS e)""",
)
def minibatches(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents").select("doc_id")
    return prep.union_classes(*[prep.minibatches(docs, 64, e) for e in (0, 1)]).select("doc_id", "epoch", "batch_id")


# ---------------------------------------------------------------- P6 / U1 / S11
@register("class_filter", sql=f"SELECT doc_id FROM {L} WHERE label = 1")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).where(F.col("label") == 1).select("doc_id")


@register(
    "union_classes",
    sql=f"SELECT doc_id, label FROM {L} WHERE label = 1 UNION ALL SELECT doc_id, label FROM {L} WHERE label = 0",
)
def union_classes(spark: SparkSession, d: str) -> DataFrame:
    lab = labelled(spark, d).select("doc_id", "label")
    return prep.union_classes(lab.where(F.col("label") == 1), lab.where(F.col("label") == 0))


@register(
    "row_counts",
    sql=f"""SELECT 'documents' AS tbl, -1 AS label, count(*)::BIGINT AS n FROM documents
    UNION ALL SELECT 'null_text', -1, count(*) FILTER (WHERE text IS NULL)::BIGINT FROM documents
    UNION ALL SELECT 'labels', -1, count(*)::BIGINT FROM labels
    UNION ALL SELECT 'labelled', label, count(*)::BIGINT FROM {L} GROUP BY label""",
)
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.load(spark, d, "documents")
    one = docs.agg(
        F.count("*").alias("documents"), F.sum(F.when(F.col("text").isNull(), 1).otherwise(0)).alias("null_text")
    )
    one = one.select(
        F.explode(
            F.array(
                F.struct(F.lit("documents").alias("tbl"), F.col("documents").cast("bigint").alias("n")),
                F.struct(F.lit("null_text").alias("tbl"), F.col("null_text").cast("bigint").alias("n")),
            )
        ).alias("s")
    ).select("s.tbl", F.lit(-1).alias("label"), "s.n")
    labs = tables.load(spark, d, "labels").agg(F.count("*").cast("bigint").alias("n"))
    labs = labs.select(F.lit("labels").alias("tbl"), F.lit(-1).alias("label"), "n")
    per = labelled(spark, d).groupBy("label").agg(F.count("*").cast("bigint").alias("n"))
    per = per.select(F.lit("labelled").alias("tbl"), "label", "n")
    return prep.union_classes(one, labs, per)


# ---------------------------------------------------------------- S4 / S1 / S5 sinks
@register(
    "csv_roundtrip",
    sql=f"SELECT doc_id, label, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM {L}",
)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv_roundtrip")
    tables.write_csv(labelled(spark, d).select("doc_id", "text", "label"), path)
    back = tables.read_text_csv(spark, path)
    return back.select(
        "doc_id", "label", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@register(
    "split_partition_counts",
    sql=f"SELECT split, label, count(*)::BIGINT AS n FROM ({SPLIT_SQL}) GROUP BY ALL",
)
def split_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "split_fanout")
    s = prep.split_random(labelled(spark, d))
    tables.write_partitioned(s, path, "split", "label")
    back = spark.read.parquet(path)
    return back.groupBy("split", "label").agg(F.count("*").cast("bigint").alias("n"))


@register("written_counts", sql=f"SELECT split, label, count(*)::BIGINT AS n FROM ({SPLIT_SQL}) GROUP BY ALL")
def written_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each split and class, counted by the fan-out write itself."""
    path = scratch_path(spark, "written_counts")
    s = prep.split_random(labelled(spark, d))
    n = tables.write_counted(
        s, lambda df: tables.write_partitioned(df, path, "split", "label"), "split", "label", values={"split": ["train", "test"], "label": [0, 1]}
    )
    return spark.createDataFrame([(r["split"], r["label"], r["n"]) for r in n if r["n"]], "split string, label int, n long")


# ---------------------------------------------------------------- SP7 final test set
@register(
    "test_set_final",
    sql=f"""WITH s AS ({SPLIT_SQL.replace('SELECT doc_id, label,', 'SELECT doc_id, label, text,', 1).replace(f'FROM {L}', f'FROM {L} AS lt')}),
    t AS (SELECT doc_id, label FROM s WHERE split = 'test' AND {S.token_count(S.tokens())} <= {X.TOKEN_LIMIT})
    SELECT doc_id, label, row_number() OVER (ORDER BY {_hash_sql(42)}, doc_id)::BIGINT AS pos FROM t""",
)
def test_set_final(spark: SparkSession, d: str) -> DataFrame:
    # the split needs ids and labels only; token counts are per-document values, so no text
    # has to travel to the labels
    s = prep.split_random(tables.labelled_ids(spark, d))
    test = cut(s.where(F.col("split") == "test").select("doc_id", "label"))
    counts = tables.features_then_labels(spark, d, FE.with_token_count, labels=test)
    # ids and labels of the kept rows are written once; numbering them reads no text again
    both = cut(counts.where((F.col("token_count") <= X.TOKEN_LIMIT) & F.col("label").isin(0, 1)).select("doc_id", "label"))
    return prep.shuffle(both, "doc_id", 42).select("doc_id", "label", F.col("pos").cast("bigint").alias("pos"))


# ---------------------------------------------------------------- SP8 / P1 / P4 training table
TRAIN_SQL = f"""WITH {S.extended_cte()},
    s AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_hash_sql(42)}, doc_id) <= ceil(0.2 * count(*) OVER ())
          THEN 'test' ELSE 'train' END AS split FROM {L}),
    tr AS (SELECT x.doc_id, x.label, x.avg_word_length AS aux1, x.func_word_count AS aux2 FROM x JOIN s USING (doc_id) WHERE split = 'train')"""


def _train_ext(spark: SparkSession, d: str) -> DataFrame:
    """Training-split rows of the labelled feature table (no text column).

    The split needs ids and labels only; the features come from ``features_then_labels``,
    so text is never shuffled to meet the labels.
    """
    train = prep.split_random(tables.labelled_ids(spark, d)).where(F.col("split") == "train").select("doc_id")
    return extended(spark, d).join(train, "doc_id")


@register(
    "training_table",
    sql=f"{TRAIN_SQL} SELECT doc_id, label, aux1, aux2, row_number() OVER (ORDER BY {_hash_sql(128)}, doc_id)::BIGINT AS pos FROM tr",
    doubles=("aux1",),
)
def training_table(spark: SparkSession, d: str) -> DataFrame:
    # four narrow columns are written once; numbering them does not run the features again
    t = cut(prep.training_table(_train_ext(spark, d)).select("doc_id", "label", "aux1", "aux2"))
    return prep.shuffle(t, "doc_id", 128).select("doc_id", "label", "aux1", "aux2", F.col("pos").cast("bigint").alias("pos"))


# ---------------------------------------------------------------- A17 / P18
MINMAX_SQL = f"""{TRAIN_SQL},
    te AS (SELECT x.doc_id, x.label, x.avg_word_length AS aux1, x.func_word_count AS aux2 FROM x JOIN s USING (doc_id) WHERE split = 'test'),
    f AS (SELECT min(aux1) AS a1, max(aux1) AS b1, min(aux2)::DOUBLE AS a2, max(aux2)::DOUBLE AS b2 FROM tr),
    al AS (SELECT 'train' AS split, * FROM tr UNION ALL SELECT 'test', * FROM te),
    sc AS (SELECT doc_id, split, label, coalesce((aux1 - a1) / NULLIF(b1 - a1, 0), 0.0) AS aux1_s,
                  coalesce((aux2 - a2) / NULLIF(b2 - a2, 0), 0.0) AS aux2_s FROM al, f)"""


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    # split on ids and labels, features from ``extended`` (no text moves to the labels)
    s = prep.split_random(tables.labelled_ids(spark, d)).select("doc_id", "split")
    ext = cut(prep.training_table(extended(spark, d)).join(s, "doc_id"))
    fit = prep.minmax_fit(ext.where(F.col("split") == "train"), ["aux1", "aux2"])
    return prep.minmax_apply(ext, fit, ["aux1", "aux2"])


@register("minmax_scale", sql=f"{MINMAX_SQL} SELECT doc_id, split, aux1_s, aux2_s FROM sc", doubles=("aux1_s", "aux2_s"))
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d).select("doc_id", "split", "aux1_s", "aux2_s")


@register(
    "label_struct",
    sql=f"{MINMAX_SQL} SELECT doc_id, label::DOUBLE AS main, aux1_s AS aux_0, aux2_s AS aux_1 FROM sc WHERE split = 'train'",
    doubles=("main", "aux_0", "aux_1"),
)
def label_struct(spark: SparkSession, d: str) -> DataFrame:
    sc = prep.label_struct(_scaled(spark, d).where(F.col("split") == "train"))
    return sc.select(
        "doc_id",
        F.col("labels.main").alias("main"),
        F.col("labels.aux")[0].alias("aux_0"),
        F.col("labels.aux")[1].alias("aux_1"),
    )


# ---------------------------------------------------------------- P20
@register(
    "head_preview",
    sql=f"WITH {S.extended_cte()} SELECT doc_id, label, avg_word_length, vocab_size, func_word_count FROM x ORDER BY doc_id LIMIT 6",
    doubles=("avg_word_length",),
)
def head_preview(spark: SparkSession, d: str) -> DataFrame:
    # the limit is the operator (a six-row preview); Spark plans it as a distributed top-k
    ext = extended(spark, d)
    return ext.orderBy("doc_id").limit(6).select("doc_id", "label", "avg_word_length", "vocab_size", "func_word_count")
