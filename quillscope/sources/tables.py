"""Sources and sinks: Parquet fixtures, labelled corpus, CSV text tables, model globs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.operators.idfilter import maybe_in
from quillscope.sources import csvtext

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TEXT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)


# row key of tables whose rows carry CPU-heavy text/array work
SPREAD_KEYS = {
    "documents": "doc_id",
    "conversations": ("conv_id", "turn"),
    "embeddings": "vec_id",
    "benchmark": "item_id",
    "pages": "page_id",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table; column pruning and filters reach the Parquet scan.

    A small file with one row group is one split, so one task would do all the work on its texts.
    Text tables of at most ``SPREAD_BYTES`` with fewer splits than task slots are therefore
    spread by a hash of the row key. Larger tables are read as they are split and never shuffled here.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    key = SPREAD_KEYS.get(name)
    if key is not None:
        slots = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < slots and table_bytes(spark, path) <= SPREAD_BYTES:
            df = df.repartition(slots, *((key,) if isinstance(key, str) else key))
    return df


SPREAD_BYTES = 1 << 30


def table_bytes(spark: SparkSession, path: str) -> int:
    """Size of a table's files, by the file system that holds them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents JOIN labels USING (doc_id), label := quality (the two-class corpus).

    A bit table of the label ids keeps other documents from leaving their task; callers that only
    need per-document results use ``features_then_labels`` instead, which moves feature rows rather than text.
    """
    labs = label_rows(spark, sf_dir)
    return maybe_in(load(spark, sf_dir, "documents").select("doc_id", "text"), labs, "doc_id").join(labs, "doc_id", "inner")


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label)`` of the labelled corpus: the same rows as ``labelled`` without the
    text, so the join moves keys only (enough for splits and class counts)."""
    return load(spark, sf_dir, "documents").select("doc_id").join(label_rows(spark, sf_dir), "doc_id", "inner")


def features_then_labels(
    spark: SparkSession, sf_dir: str, per_document, labels: DataFrame | None = None
) -> DataFrame:
    """``per_document(documents)`` joined to the labels, without the text column.

    ``per_document`` maps a ``(doc_id, text)`` table to per-document rows and keeps the input
    columns. ``labels`` optionally replaces the label table by other ``(doc_id, label...)`` rows,
    e.g. one split. Where a text is read, a bit table of the label ids (bounded in bytes at any
    number of labels) lets labelled documents and few others through; features are computed for these,
    and only their small rows are joined exactly. The text itself never crosses the network.
    """
    if labels is None:
        labels = label_rows(spark, sf_dir)
    docs = maybe_in(load(spark, sf_dir, "documents").select("doc_id", "text"), labels, "doc_id")
    return per_document(docs).drop("text").join(labels, "doc_id", "inner")


def conversation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a second two-class corpus: user = 0 (human), assistant = 1; key ``(conv_id, turn)``."""
    conv = load(spark, sf_dir, "conversations")
    return conv.where(F.col("role").isin("user", "assistant")).select(
        "conv_id",
        "turn",
        "text",
        F.when(F.col("role") == "assistant", 1).otherwise(0).cast("int").alias("label"),
    )


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with quoted multi-line text cells, header, explicit schema (no inference pass), read by many tasks.

    Blanks belong to a text; an empty cell is null, a quoted empty one the empty text.
    """
    return csvtext.read_csv(spark, path, schema or TEXT_SCHEMA)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink without an index column: a cell with quotes, commas or line breaks is quoted, blanks are
    kept, the empty text is written as quotes and null as nothing, so that ``read_text_csv`` gives equal rows."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_counted(df: DataFrame, write: Callable[[DataFrame], None], *by: str, values: dict[str, list] | None = None) -> list[dict]:
    """``write(df)`` and the numbers of rows it wrote, observed while writing: no second read.

    With columns ``by`` and their ``values`` one count for each combination, as ``{column: value, ..., "n": rows}``;
    rows with other values are not counted. Without, one count.
    """
    groups = list(product(*[(values or {})[c] for c in by]))
    counts = [F.count(F.when(reduce(and_, [F.col(c) == v for c, v in zip(by, g)], F.lit(True)), 1)).alias(f"n{i}") for i, g in enumerate(groups)]
    seen = Observation()
    write(df.observe(seen, *counts))
    return [dict(zip(by, g)) | {"n": seen.get[f"n{i}"]} for i, g in enumerate(groups)]


def rows_of(spark: SparkSession, source: DataFrame | str, schema: T.StructType | None = None) -> DataFrame:
    """A frame as it is, or the rows of a path: CSV files with ``schema`` (a ``.csv`` path or folder), else Parquet."""
    if isinstance(source, DataFrame):
        return source
    if source.rstrip("/").endswith(".csv"):
        return read_text_csv(spark, source, schema)
    return spark.read.parquet(source)


def write_partitioned(df: DataFrame, path: str, *cols: str) -> None:
    """Fan-out sink: one directory per value combination (split x class) in a single job."""
    df.write.mode("overwrite").partitionBy(*cols).parquet(path)


def read_models(spark: SparkSession, patterns: list[str], root_depth: int = 3) -> DataFrame:
    """Weight tables from several glob patterns, concatenated; each matched path is a model.

    Every model folder is its own (partitioned) table, so files are listed recursively
    and the model id is the folder ``root_depth`` levels above the data file.
    """
    frames = [
        spark.read.option("recursiveFileLookup", "true")
        .parquet(p)
        .withColumn("model_path", F.col("_metadata.file_path"))
        .withColumn("model", F.element_at(F.split("model_path", "/"), -(root_depth + 1)))
        for p in patterns
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
