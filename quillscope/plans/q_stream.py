"""Queries: streams with batch-twin oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillscope.operators import textmodel as TM
from quillscope.plans.q_learn import W, _dot_sql, _sig_sql, _text_model_sql, token_rows
from quillscope.plans import sqltext as S
from quillscope.plans.registry import register
from quillscope.session import scratch_path
from quillscope.sources import tables
from quillscope.streaming import textverdicts as TV
from quillscope.streaming import verdicts as V


@register(
    "stream_verdicts",
    sql=f"""WITH s AS (SELECT vec_id, {_sig_sql(_dot_sql(W['main']))} AS prob FROM embeddings)
    SELECT vec_id, prob, printf('%.4f', prob) AS prob_text,
      CASE WHEN prob >= 0.5 THEN 'probably machine text' ELSE 'probably human text' END AS verdict FROM s""",
    doubles=("prob",),
)
def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    sink = V.verdicts_available(spark, f"{d.rstrip('/')}/embeddings.parquet", W["main"])
    return spark.read.parquet(sink)


@register(
    "stream_text_features",
    sql=f"SELECT * EXCLUDE (text, _w) FROM (SELECT *, {S.basic_cols()} FROM (SELECT doc_id, text, {S.words()} AS _w FROM documents WHERE text IS NOT NULL))",
    doubles=("avg_word_length", "word_density", "lexical_diversity"),
)
def stream_text_features(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(V.text_features_available(spark, f"{d.rstrip('/')}/documents.parquet"))


@register(
    "stream_text_verdicts",
    sql=f"""WITH {_text_model_sql('quality')} SELECT doc_id, p AS prob, printf('%.4f', p) AS prob_text,
      CASE WHEN p >= 0.5 THEN 'probably machine text' ELSE 'probably human text' END AS verdict FROM pb""",
    doubles=("prob",),
)
def stream_text_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Texts to verdicts in one stream, by a text model fitted on the labelled documents and published as a table."""
    models, sink = scratch_path(spark, "text-models"), scratch_path(spark, "text-verdicts")
    TV.publish(TM.fit_text_model(token_rows(spark, d), tables.load(spark, d, "labels").select("doc_id", "quality"), "quality"), models, 1)
    TV.text_verdicts(spark, f"{d.rstrip('/')}/documents.parquet", models, sink, scratch_path(spark, "text-verdicts-ckpt"))
    return spark.read.parquet(sink).select("doc_id", "prob", "prob_text", "verdict")
