"""Sources and sinks: overloads, CSV with hostile cells, fan-out, model globs, stream = batch."""

import os

from pyspark.sql import functions as F

from quillscope.operators import learn as LN
from quillscope.session import scratch_path
from quillscope.sources import tables
from quillscope.streaming import verdicts as V
from tests.conftest import SF001


def test_csv_roundtrip_hostile_cells(spark):
    rows = [(1, 'quote " comma, newline\nend', 1), (2, "", 0), (3, None, 1), (4, "plain", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    path = scratch_path(spark, "csv-test")
    tables.write_csv(df, path)
    back = {r.doc_id: r for r in tables.read_text_csv(spark, path).collect()}
    assert back[1].text == rows[0][1] and back[4].text == "plain" and len(back) == 4
    assert back[3].text is None


def test_fanout_sink_partitions(spark):
    df = spark.createDataFrame([(1, "train", 0), (2, "test", 1), (3, "train", 1)], "doc_id long, split string, label int")
    path = scratch_path(spark, "fanout-test")
    tables.write_partitioned(df, path, "split", "label")
    assert sorted(x for x in os.listdir(path) if x.startswith("split=")) == ["split=test", "split=train"]
    assert spark.read.parquet(path).where("split = 'train'").count() == 2


def test_model_glob(spark):
    root = scratch_path(spark, "models")
    for name in ("m_epoch0", "m_epoch1", "other"):
        LN.save_model(spark, LN.Heads.init([True, False], dim=4), f"{root}/{name}/run={name}/epoch=0")
    got = tables.read_models(spark, [f"{root}/m_epoch*", f"{root}/other"])
    models = {r.model for r in got.select("model").distinct().collect()}
    assert models == {"m_epoch0", "m_epoch1", "other"}


def test_stream_equals_batch(spark):
    weights = LN.fixed_weights(1)
    sink = V.verdicts_available(spark, f"{SF001}/embeddings.parquet", weights)
    streamed = spark.read.parquet(sink)
    batch = V.score_stream(spark.read.parquet(f"{SF001}/embeddings.parquet"), weights)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0
    # prob text keeps four decimals and the verdict follows the 0.5 threshold
    r = streamed.orderBy("vec_id").first()
    assert len(r.prob_text.split(".")[1]) == 4
    assert (r.prob >= 0.5) == (r.verdict == "probably machine text")
    assert streamed.where(F.col("vec_id").isNull()).count() == 0


def test_features_then_labels_equals_a_plain_join(spark):
    from quillscope.operators import features as FE
    from quillscope.sources import tables

    got = tables.features_then_labels(spark, SF001, FE.basic_features)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    want = FE.basic_features(docs.join(tables.label_rows(spark, SF001), "doc_id")).drop("text")
    assert "text" not in got.columns
    cols = sorted(got.columns)
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    assert a == sorted(tuple(r) for r in want.select(*cols).collect()) and len(a) == 87


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    weights = LN.fixed_weights(1)
    spark.read.parquet(f"{SF001}/embeddings.parquet").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    for how in ({}, {"files_per_trigger": 3}):
        sink = V.verdicts_available(spark, f"{tmp_path}/embeddings.parquet", weights, **how)
        assert spark.read.parquet(sink).count() == 500


def test_scratch_tables_can_be_dropped(spark):
    import os

    from quillscope.session import drop_scratch, scratch_path

    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and drop_scratch(spark) >= 1 and not os.path.exists(path)


def test_large_tables_are_not_spread(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_BYTES", 0)
    plan = tables.load(spark, SF001, "documents")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
