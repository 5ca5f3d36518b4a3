"""The text classifier against a plain one; the stream of texts; the bit table of ids; the shared front block."""

import math
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quillscope.operators import learn as LN
from quillscope.operators import textmodel as TM
from quillscope.operators.idfilter import bit_table, maybe_in
from quillscope.streaming import textverdicts as TV
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

TEXTS = [
    (1, ["a", "b", "a"], 0.0), (2, ["b", "c"], 1.0), (3, ["c", "c", "d"], 1.0), (4, ["a"], 2.0), (5, [], 0.0),
    (6, ["a", "z"], None), (7, ["z"], None), (8, ["c"] * 300 + ["q"], None), (9, [], None),
]


def _plain():
    labelled = [(t, y) for _, t, y in TEXTS if y is not None]
    classes = sorted({y for _, y in labelled})
    types = {x for _, t, _ in TEXTS for x in t}
    out = {}
    for key, text, _ in TEXTS:
        logs = []
        for c in classes:
            own = Counter(x for t, y in labelled if y == c for x in t)
            logs.append(math.log(sum(y == c for _, y in labelled) / len(labelled)) + sum(math.log((own[x] + 1) / (sum(own.values()) + len(types))) for x in text))
        e = np.exp(np.array(logs) - max(logs))
        out[key] = e / e.sum()
    return out


def _tables(spark):
    tokens = spark.createDataFrame([(k, t) for k, t, _ in TEXTS], "doc_id long, tokens array<string>").repartition(3)
    return tokens, spark.createDataFrame([(k, y) for k, _, y in TEXTS if k != 9], "doc_id long, y double")


@pytest.mark.parametrize("most", [TM.HEAD_BYTES, 200, 0])
def test_probabilities_equal_a_plain_naive_bayes(spark, tmp_path, most):
    tokens, labels = _tables(spark)
    model = TM.fit_text_model(tokens, labels, "y")
    assert {r["token"]: r["seen"] for r in model.weights.collect()} == {"a": 3, "b": 2, "c": 3, "d": 1}  # no row for unlabelled words
    model.save(f"{tmp_path}/m{most}")
    want = _plain()
    for m in (model, TM.load_text_model(spark, f"{tmp_path}/m{most}")):
        got = {r["doc_id"]: r["probabilities"] for r in TM.class_probabilities(tokens, m, most=most).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert np.allclose(got[k], want[k], rtol=1e-9)


def test_sentiment_takes_the_likeliest_class(spark):
    tokens, labels = _tables(spark)
    want = _plain()
    for r in TM.sentiment(tokens, labels, "y").collect():
        assert r["sentiment_label"] == int(np.argmax(want[r["doc_id"]])) and math.isclose(r["sentiment_score"], max(want[r["doc_id"]]))
    none = TM.fit_text_model(tokens, labels.limit(0), "y")
    assert none.classes == [] and TM.class_probabilities(tokens, none).where("size(probabilities) > 0").count() == 0


def test_frequent_words_are_bounded_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, 50, [0.0]), ("y", 40, [0.0]), ("z", 1, [0.0])], "token string, seen long, w array<double>")
    assert [df.where(TM.frequent(df, 1, most)).count() for most in (0, 100, 1100, 1115, 5000)] == [0, 0, 1, 2, 3]


def test_stream_goes_on_after_a_restart_and_takes_a_new_model(spark, tmp_path):
    tokens, labels = _tables(spark)
    folder, models, sink, ckpt = (f"{tmp_path}/{x}" for x in ("in", "models", "out", "ckpt"))
    rows = [(k, " ".join(t)) for k, t, _ in TEXTS] + [(10, None)]
    spark.createDataFrame(rows[:4], "doc_id long, text string").coalesce(1).write.parquet(folder)
    with pytest.raises(ValueError, match="no model"):
        TV.newest(spark, models)
    first = TM.fit_text_model(tokens, labels, "y")
    TV.publish(first, models, 1)
    TV.text_verdicts(spark, folder, models, sink, ckpt)
    spark.createDataFrame(rows[4:], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    second = TM.fit_text_model(tokens, labels.where("doc_id <> 3"), "y")
    second.weights.write.parquet(f"{models}/version=3/tokens")  # not complete: no classes yet
    TV.publish(second, models, 2)
    for _ in range(2):  # the second run finds nothing new
        TV.text_verdicts(spark, folder, models, sink, ckpt)
    got = {r["doc_id"]: r for r in spark.read.parquet(sink).collect()}
    assert len(got) == len(TEXTS) == spark.read.parquet(sink).count()
    for model, version, ids in ((first, 1, [1, 2, 3, 4]), (second, 2, [5, 6, 7, 8, 9])):
        want = {r["doc_id"]: r["prob"] for r in TV.verdict_rows(tokens, model).collect()}
        for i in ids:
            assert got[i]["model_version"] == version and math.isclose(got[i]["prob"], want[i], rel_tol=1e-9)
            assert got[i]["batch_id"] == version - 1
    # a batch that is done again overwrites its own folder
    before = spark.read.parquet(sink).count()
    shutil.copytree(ckpt, f"{tmp_path}/ckpt2", ignore=lambda d, names: [n for n in names if d.endswith("commits") and n in ("1", ".1.crc")])
    TV.text_verdicts(spark, folder, models, sink, f"{tmp_path}/ckpt2")
    assert spark.read.parquet(sink).count() == before


def test_bit_table_lets_all_ids_and_few_others_through(spark):
    ids = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,), (0,)], "k long")
    rows = spark.range(0, 200_000).select(F.col("id").alias("k"), F.lit("t").alias("_word2"))
    out = maybe_in(rows, ids, "k")
    want = rows.join(ids.distinct(), "k")
    assert out.columns == rows.columns and out.join(ids.distinct(), "k").count() == want.count()
    assert out.count() < want.count() + 100
    assert bit_table(ids, "k").count() <= 500 and maybe_in(rows, ids.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        maybe_in(rows, ids.select(F.col("k").cast("string").alias("k")), "k")


@pytest.mark.parametrize("bound", ["-1", None])
def test_labels_never_shuffle_text(spark, bound):
    """With and without automatic broadcasts the text meets only the bit table, by a broadcast join."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if bound is not None:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        for name in ("extended_features", "epoch_loss"):
            if name == "extended_features":
                plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
                assert "_word" in plan and "BroadcastHashJoin" in plan
            ok, msg = compare(spark, duck(SF001), SF001, name, E.queries()[name], E.oracle_sql()[name])
            assert ok, msg
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


SCHEMA = "doc_id long, embedding array<double>, main int, aux array<double>"


def _rows(n, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(size=8)], int(i % 2), [float(rng.uniform()), float(rng.uniform())]) for i in range(n)]


def test_gradient_of_the_front_block_matches_finite_differences(spark):
    df = spark.createDataFrame(_rows(25), SCHEMA).repartition(3)
    w = LN.Heads.init([True, True], dim=8, shared=3).weights
    weight = {"main": 1.0, "aux_block0": 0.5, "aux_block1": 0.25}
    g, _, n = LN.gradient(df, LN.Heads(w), weight)
    assert n == 25 and {h: len(v) for h, v in g.items()} == {h: len(v) for h, v in w.items()}
    for h, i in [("front_block0", 0), ("front_block1", 5), ("front_block2", 8), ("main", 1), ("aux_block1", 3)]:
        side = []
        for e in (1e-5, -1e-5):
            moved = {k: list(v) for k, v in w.items()}
            moved[h][i] += e
            loss = LN.gradient(df, LN.Heads(moved), weight)[1]
            side.append(loss[h] if h in loss else sum(weight[k] * x for k, x in loss.items()))
        assert math.isclose(g[h][i], (side[0] - side[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_a_step_reads_its_own_batch(spark):
    df = spark.createDataFrame(_rows(400), SCHEMA).repartition(4)
    rows = LN.write_batches(df, 0, 0, 8)
    part = rows.where("_batch = 3")
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_batch" in scan
    assert all("_batch=3/" in r[0] for r in part.select("_metadata.file_path").distinct().collect())
    assert sorted(r["doc_id"] for r in part.collect()) == sorted(r["doc_id"] for r in df.where(LN.batch_of("doc_id", 0, 0, 8) == 3).collect())
    assert rows.count() == 400


def test_auxiliary_tasks_move_the_main_head(spark):
    df = spark.createDataFrame(_rows(60), SCHEMA)
    out = {}
    for spec in ("1.0", "1.0,0.5"):
        weights = LN.parse_weights(spec)
        heads = LN.Heads.init([w is not None for w in weights[1:]], dim=8, shared=3)
        out[spec] = LN.train(df, weights, epochs=2, batches_per_epoch=2, lr=1e-2, heads=heads, run=f"s{len(spec)}", checkpoint=True)
    assert out["1.0"].heads.weights["main"] != out["1.0,0.5"].heads.weights["main"]
    last = out["1.0,0.5"]
    ck = spark.read.parquet(last.checkpoint_path)
    again = LN.load_checkpoint(ck, "s7", 1)
    assert again.weights == last.heads.weights and LN.missing_heads(ck, [1.0, None, 0.5]) == [2]
    more = LN.train(df, LN.parse_weights("1.0,0.5"), epochs=1, batches_per_epoch=2, lr=1e-2, heads=again, checkpoint=False)
    assert more.history[0]["total"] < last.history[0]["total"]


@pytest.mark.parametrize("name", ["shared_forward", "train_shared", "sentiment", "sentiment_attach", "stream_text_verdicts"])
def test_oracle(spark, name):
    ok, msg = compare(spark, duck(SF001), SF001, name, E.queries()[name], E.oracle_sql()[name])
    assert ok, msg


def test_ablation_differs(spark):
    rows = E.queries()["model_ablation"](spark, SF001).collect()
    assert len(rows) == 6 and all(r["mean_diff"] != 0 and r["t"] is not None for r in rows)


def test_the_fit_does_not_depend_on_how_labels_are_joined(spark, monkeypatch):
    rows = [(i, [f"w{j}" for j in range(i % 7)]) for i in range(60)]
    tokens = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(0, 60, 3)], "doc_id long, y double")
    out = []
    for most in (TM.LABEL_ROWS, -1):
        monkeypatch.setattr(TM, "LABEL_ROWS", most)
        m = TM.fit_text_model(tokens, labels, "y")
        out.append((m.classes, m.prior, m.base, sorted(map(tuple, m.weights.collect()))))
    assert out[0] == out[1]


def test_token_rows_are_handled_in_slices():
    import pyarrow as pa

    from quillscope.operators.encoding import slices

    lists = pa.array([["a"] * n for n in (3, 0, 2, 9, 1, 1)], pa.list_(pa.string()))
    assert slices(lists, 5) == [(0, 3), (3, 4), (4, 6)]
    assert slices(lists.slice(2), 5) == [(0, 1), (1, 2), (2, 4)]
    assert slices(lists.slice(0, 0), 5) == []
