"""Text in, verdict out, as one stream.

Every micro-batch is tokenized, joined with the newest published text model (a table, read again for each
batch, so a model that is published while the stream runs or rests takes effect with the next batch)
and written to the sink's folder of its batch id. A batch that is repeated after a failure overwrites its own
folder, so the sink holds every text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.functions import text as X
from quillscope.operators import evaluate as EV
from quillscope.operators import textmodel as TM
from quillscope.streaming.verdicts import DOCUMENT_SCHEMA, table_stream


def publish(model: TM.TextModel, root: str, version: int) -> None:
    """Put a model beside the older ones; it counts from when its last table is committed."""
    model.save(f"{root}/version={version}")


def newest(spark: SparkSession, root: str) -> int:
    """The highest version whose tables are complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.listStatus(path(root)) if fs.exists(path(root)) else []:
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(path(f"{root}/{name}/classes/_SUCCESS")):
            found.append(int(name.split("=")[1]))
    if not found:
        raise ValueError(f"no model in {root}")
    return max(found)


def verdict_rows(tokens: DataFrame, model: TM.TextModel, key: str = "doc_id", positive: float = 1.0) -> DataFrame:
    """``(key, prob, prob_text, verdict)`` of tokenized texts: the probability of class ``positive``; shared with the batch twin."""
    p = F.col("probabilities")[model.classes.index(positive)] if positive in model.classes else F.lit(0.0)
    rows = TM.class_probabilities(tokens, model, key).select(key, p.alias("prob"))
    return rows.select(key, "prob", EV.prob_text(F.col("prob")).alias("prob_text"), EV.verdict(F.col("prob")).alias("verdict"))


def text_verdicts(
    spark: SparkSession, table: str, models: str, sink: str, checkpoint: str, files_per_trigger: int | None = None, positive: float = 1.0
) -> None:
    """Verdicts for the texts that have come to ``table`` (a folder of Parquet files, ``doc_id, text``) since the last run.

    ``checkpoint`` holds what was read: a run with the same one goes on where the last ended, also after a failure.
    ``sink`` gets ``doc_id, prob, prob_text, verdict, model_version`` by ``batch_id``. Null texts are left out.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = newest(session, models)
        model = TM.load_text_model(session, f"{models}/version={version}")
        # written, so that a task reads a bounded part of the tokens, however the texts were split
        tokens = TM.written(batch.where(F.col("text").isNotNull()).select("doc_id", X.tokens("text").alias("tokens")), "stream-tokens")
        rows = verdict_rows(tokens, model, positive=positive).withColumn("model_version", F.lit(version))
        rows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    stream = table_stream(spark, table, DOCUMENT_SCHEMA, files_per_trigger)
    q = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
