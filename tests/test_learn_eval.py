import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillscope.operators import evaluate as EV
from quillscope.operators import learn as LN


def test_parse_weights():
    assert LN.parse_weights("1.0") == [1.0, None, None]
    assert LN.parse_weights("1.0,,0.5") == [1.0, None, 0.5]
    assert LN.parse_weights("1.0,0.3,0.2") == [1.0, 0.3, 0.2]


def _rows(n, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(size=8)], int(i % 2), [float(rng.uniform()), float(rng.uniform())]) for i in range(n)]


SCHEMA = "doc_id long, embedding array<double>, main int, aux array<double>"


def test_gradient_matches_finite_differences(spark):
    df = spark.createDataFrame(_rows(30), SCHEMA).repartition(3)
    rng = np.random.default_rng(0)
    w = {h: [float(x) for x in rng.normal(size=9) / 3] for h in LN.head_names([True, True])}
    g, _, n = LN.gradient(df, LN.Heads(w))
    assert n == 30
    for h in w:
        for i in (0, 4, 8):
            side = []
            for e in (1e-5, -1e-5):
                moved = {k: list(v) for k, v in w.items()}
                moved[h][i] += e
                side.append(LN.gradient(df, LN.Heads(moved))[1][h])
            assert math.isclose(g[h][i], (side[0] - side[1]) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)


def test_training_lowers_loss(spark):
    df = spark.createDataFrame([(a, [x + c for x in b], c, d) for a, b, c, d in _rows(80)], SCHEMA)
    heads = LN.Heads.init([True, False], dim=8)
    res = LN.train(df, [1.0, 0.5, None], epochs=3, batches_per_epoch=1, lr=5e-2, checkpoint=True, run="t", heads=heads)
    totals = [h["total"] for h in res.history]
    assert totals[-1] < totals[0]
    ck = spark.read.parquet(res.checkpoint_path)
    heads = LN.checkpoint_heads(ck).collect()
    assert all(r.has_aux1 and not r.has_aux2 for r in heads) and len(heads) == 3
    assert LN.missing_heads(ck, [1.0, None, 0.5]) == [2]
    assert LN.load_checkpoint(ck, "t", 2).weights == res.heads.weights
    with pytest.raises(ValueError):
        LN.train(df, [1.0, None, 0.5], epochs=1, heads=LN.Heads.init([True, False], dim=8), checkpoint=False)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0.5, 1), (0.0, 0), (1.0, 1), (0.49999, 1)], "prob double, label int")
    s = df.withColumn("pred", EV.threshold(F.col("prob")))
    assert [r.pred for r in s.collect()] == [1, 0, 1, 0]
    m = EV.metrics(s).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 0, 1, 1)
    assert math.isclose(m.precision, 1.0) and math.isclose(m.recall, 2 / 3)
    none = df.withColumn("pred", F.lit(0))
    z = EV.metrics(none).first()
    assert z.precision == 0.0 and z.f1 == 0.0 and z.recall == 0.0
    raw = df.select(EV.threshold(F.col("prob"), None).alias("p")).collect()
    assert raw[0].p == 0.5


def test_paired_t_antisymmetric(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(size=(40, 2)))]
    m = spark.createDataFrame(rows, "doc_id long, a double, b double")
    ab = EV.paired_t(m, ["a", "b"], [("a", "b")]).first()
    ba = EV.paired_t(m, ["a", "b"], [("b", "a")]).first()
    assert math.isclose(ab.t, -ba.t) and ab.df == 39


def test_asymmetric_loss_nonnegative(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 0), (0.5, 1), (0.9, 0)], "p double, y int")
    vals = [r.l for r in df.select(LN.asymmetric_loss_terms(F.col("p"), F.col("y")).alias("l")).collect()]
    assert all(v >= 0 and math.isfinite(v) for v in vals)


def test_stored_scores_equal_the_wide_projection(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), [float(v) for v in rng.normal(size=LN.EMBED_DIM)]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, label int, embedding array<double>")
    wide = {r.doc_id: r for r in LN.score_models_wide(df).collect()}
    long = LN.score_models(df)
    names = {m: EV.store_scores(long.where(F.col("model") == m), m, 3) for m in LN.MODEL_NAMES}
    out = EV.side_by_side(spark, names).collect()
    assert len(out) == len(wide)
    for r in out:
        assert all(math.isclose(r[m], wide[r.doc_id][m]) for m in LN.MODEL_NAMES)


def test_encode_edges(spark):
    from quillscope.operators import encoding as EN

    df = spark.createDataFrame(
        [(1, ""), (2, "a a b"), (3, "c a d b e"), (4, "   ")], "doc_id long, text string"
    )
    # vocabulary of 2: 'a' (3 uses) -> 4, 'b' (2 uses) -> 5; everything else is UNK
    got = {r.doc_id: r.ids for r in EN.encode(df, "doc_id", size=2).collect()}
    C, S, U = EN.CLS, EN.SEP, EN.UNK
    assert got == {1: [C, S], 2: [C, 4, 4, 5, S], 3: [C, U, 4, U, 5, U, S], 4: [C, S]}
    cut4 = {r.doc_id: r.ids for r in EN.encode(df, "doc_id", max_len=4, size=2).collect()}
    assert cut4[3] == [C, U, 4, S] and cut4[2] == [C, 4, 4, S]
    padded = {r.doc_id: (r.input_ids, r.attention_mask) for r in EN.pad(EN.encode(df, "doc_id", size=2), "doc_id").collect()}
    assert padded[1] == ([C, S] + [EN.PAD] * 5, [1, 1] + [0] * 5)
    assert all(len(v[0]) == 7 for v in padded.values())


def test_encoding_does_not_depend_on_the_broadcast_head(spark):
    from quillscope.operators import encoding as EN

    rows = [(i, " ".join(f"t{(i * j) % 37}" for j in range(i % 23))) for i in range(60)] + [(100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = {r.doc_id: r.ids for r in EN.encode(df, "doc_id").collect()}
    assert all(EN.UNK not in ids for ids in whole.values())
    for most in (0, 20, 200, 600):
        assert {r.doc_id: r.ids for r in EN.encode(df, "doc_id", head_bytes=most).collect()} == whole
    short = {r.doc_id: r.ids for r in EN.encode(df, "doc_id", max_len=6, head_bytes=60).collect()}
    assert short == {k: v[:5] + [EN.SEP] if len(v) > 6 else v for k, v in whole.items()}
