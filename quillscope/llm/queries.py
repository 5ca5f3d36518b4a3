"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.llm import alignment as AL
from quillscope.llm import bpe as BP
from quillscope.llm import decontaminate as DC
from quillscope.llm import langid as LI
from quillscope.llm import mixture as MX
from quillscope.llm import neardup as ND
from quillscope.llm import quality as QR
from quillscope.llm import ranked as RS
from quillscope.llm import secrets as SS
from quillscope.llm import substring as SD
from quillscope.llm import tokens as TC
from quillscope.llm import urls as UF
from quillscope.llm import warc as WZ
from quillscope.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return deco


@query("op10_decontaminate", DC.SQL)
def op10_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return DC.digest(DC.decontaminate(docs, read(spark, d, "benchmark"), keep=["doc_id"]))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class (the least doc_id in it), the class's size, and whether it stays."""
    documents, _ = ND.near_duplicates(read(spark, d, "documents").select("doc_id", "text"))
    return documents.select(
        F.col("id").alias("doc_id"), "class_id", "class_docs", "class_texts", F.col("is_rep").alias("kept")
    )


@query("op6_quality_rules", QR.SQL)
def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return QR.quality(read(spark, d, "documents").select("doc_id", "source", "text"), keep=["doc_id"])


@query("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return MX.mix(read(spark, d, "documents").select("doc_id", "source", "text"), keep=["doc_id"])


@query("op3_url_filter", UF.SQL)
def op3_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return UF.url_filter(read(spark, d, "pages")).withColumnRenamed("id", "page_id")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return TC.count_tokens(read(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])


@query("op7_language_id")
def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "lang").withColumn("held_out", LI.held_out())
    tree = LI.train(docs.where("not held_out").select("text", "lang"))
    return LI.predict(docs.select("doc_id", "held_out", "text"), tree, keep=["doc_id", "held_out"])


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return SS.digest(SS.scan_secrets(read(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"]))


@query("op9_warc_zip", WZ.SQL)
def op9_warc_zip(spark: SparkSession, d: str) -> DataFrame:
    return WZ.round_trip(read(spark, d, "pages").select("page_id", "url", "html"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class (the least doc_id it shares passages with), and what is removed."""
    out = SD.repeated_passages(read(spark, d, "documents").select("doc_id", "text"))
    text = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_words", "n_units", "n_removed", text.alias("spans"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ids = BP.encode(read(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"], packed=True)
    return BP.digest(BP.decode(ids))


@query("op12_ranked_search", RS.SQL)
def op12_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return RS.search(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return AL.align(read(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])[0]
