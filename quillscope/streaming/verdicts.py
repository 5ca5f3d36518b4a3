"""Continuous work on a stream: encoder output to verdicts, texts to features.

The interactive read-score-print loop becomes a stateless stream: new Parquet files arrive in
a folder, each micro-batch goes through the same projection as a batch query and is
written (append) to a Parquet sink. No state or watermark is needed; the checkpoint
lives in the shared checkpoint folder so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.operators import evaluate as EV
from quillscope.operators import features as FE
from quillscope.operators import learn as LN
from quillscope.session import scratch_path

EMBED_SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def score_stream(stream: DataFrame, weights: list[float]) -> DataFrame:
    """Row-wise transform shared by the stream and its batch twin."""
    prob = LN.score_linear(F.col("embedding"), weights)
    return stream.select(
        "vec_id",
        F.round(prob, 6).alias("prob"),
        EV.prob_text(prob).alias("prob_text"),
        EV.verdict(prob).alias("verdict"),
    )


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream: a folder of part files (the usual form) or a single file.

    The schema is given, so an empty folder is an empty stream. Without ``files_per_trigger`` a
    micro-batch takes all files that have come since the last one.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile():  # a stream reads folders: take the file by its name
        return reader.option("pathGlobFilter", hadoop.getName()).parquet(str(hadoop.getParent().toString()))
    return reader.parquet(path)


def run_available(out: DataFrame, name: str) -> str:
    """Write everything of a stream that is available now and return the sink's path."""
    spark = out.sparkSession
    sink = scratch_path(spark, name)
    q = (
        out.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return sink


def verdicts_available(spark: SparkSession, table: str, weights: list[float], **how) -> str:
    """Verdicts for all encoder output that a table holds now."""
    return run_available(score_stream(table_stream(spark, table, EMBED_SCHEMA, **how), weights), "stream-verdicts")


DOCUMENT_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def text_features_available(spark: SparkSession, table: str, **how) -> str:
    """Text features of all documents that a table holds now: the batch projection on a stream."""
    rows = FE.basic_features(table_stream(spark, table, DOCUMENT_SCHEMA, **how))
    return run_available(rows.drop("text"), "stream-features")
