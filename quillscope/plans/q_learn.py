"""Queries: encodings, scaled training rows, scoring, losses, evaluation, comparison,
training and sentiment (SURVEY §2.3, §2.6 X22-X24, §2.7 A12 A17-A24, §2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.functions import text as X
from quillscope.operators import evaluate as EV
from quillscope.operators.encoding import CLS, SEP, UNK, encode, pad
from quillscope.operators import features as FE
from quillscope.operators import learn as LN
from quillscope.operators import prep
from quillscope.operators import textmodel as TM
from quillscope.operators.idfilter import maybe_in
from quillscope.plans import sqltext as S
from quillscope.plans.q_text import EXT_COLS, EXT_D, extended
from quillscope.plans.registry import register
from quillscope.session import cut, scratch_path
from quillscope.sources import tables

W = {m: LN.fixed_weights(k) for k, m in enumerate(LN.MODEL_NAMES, start=1)}
# --- fixed values: encoder input limit (tokens, special tokens included) ---
TRUNCATE = 512
# --- end of fixed values ---


# ------------------------------------------------------------------ rows to score and to train on
def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Encoder output with the binary label; scoring needs no text and no join."""
    emb = tables.load(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("doc_id"), "embedding", (F.col("label") % 2).cast("int").alias("label"))


def train_rows(spark: SparkSession, d: str) -> DataFrame:
    """``score_rows`` JOIN documents ON id, with two min-max scaled text features as auxiliary targets.

    The features are computed where a text is read, for ids that have an embedding (a bit table of
    these lets few others through); only ids and two numbers meet the embeddings.
    """
    rows = score_rows(spark, d)
    docs = maybe_in(tables.load(spark, d, "documents").select("doc_id", "text"), rows.select("doc_id"), "doc_id")
    aux = FE.basic_features(docs).select(
        "doc_id", F.col("avg_word_length").alias("aux1"), X.func_word_count(X.tokens("text")).alias("aux2")
    )
    f = cut(rows.join(aux, "doc_id"))  # the scaler is fitted on and applied to the same rows
    fit = prep.minmax_fit(f, ["aux1", "aux2"])
    return prep.minmax_apply(f, fit, ["aux1", "aux2"])


SCORE_ROWS_SQL = "tr AS (SELECT vec_id AS doc_id, embedding, (label % 2) AS label FROM embeddings)"
TRAIN_ROWS_SQL = f"""
_src AS (SELECT d.doc_id, d.text, e.embedding, (e.label % 2) AS label FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.text IS NOT NULL),
_bw AS (SELECT *, {S.words()} AS _w FROM _src),
b AS (SELECT * EXCLUDE (_w), {S.basic_cols()} FROM _bw),
_ks AS (SELECT *, {S.tokens()} AS _t, {S.sentences()} AS _s FROM b),
x AS (SELECT doc_id, embedding, label, avg_word_length AS aux1, {S.func_word_count()} AS aux2 FROM _ks),
f AS (SELECT min(aux1) AS a1, max(aux1) AS b1, min(aux2)::DOUBLE AS a2, max(aux2)::DOUBLE AS b2 FROM x),
tr AS (SELECT doc_id, embedding, label, aux1, aux2, coalesce((aux1 - a1) / NULLIF(b1 - a1, 0), 0.0) AS aux1_s,
       coalesce((aux2 - a2) / NULLIF(b2 - a2, 0), 0.0) AS aux2_s FROM x, f)"""


def _dot_sql(weights: list[float], col: str = "embedding") -> str:
    arr = "[" + ", ".join(repr(float(w)) for w in weights) + "]::DOUBLE[]"
    return f"list_reduce(list_transform(list_zip(CAST({col} AS DOUBLE[]), {arr}), lambda p: p[1] * p[2]), lambda a, b: a + b)"


def _sig_sql(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


SCORES_SQL = f"""WITH {SCORE_ROWS_SQL},
sc AS (SELECT doc_id, label, {', '.join(f'{_sig_sql(_dot_sql(W[m]))} AS {m}' for m in LN.MODEL_NAMES)} FROM tr),
lg AS (UNPIVOT sc ON {', '.join(LN.MODEL_NAMES)} INTO NAME model VALUE prob)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return LN.score_models(score_rows(spark, d))


# ------------------------------------------------------------------ M2 / J6 / M6
@register(
    "score_linear",
    sql=f"WITH {SCORE_ROWS_SQL} SELECT doc_id, {_sig_sql(_dot_sql(W['main']))} AS prob FROM tr",
    doubles=("prob",),
)
def score_linear(spark: SparkSession, d: str) -> DataFrame:
    return score_rows(spark, d).select("doc_id", LN.score_linear(F.col("embedding"), W["main"]).alias("prob"))


@register("score_all_models", sql=f"{SCORES_SQL} SELECT doc_id, model, prob, label FROM lg", doubles=("prob",))
def score_all_models(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", "model", "prob", "label")


# ------------------------------------------------------------------ P15 / P16 / M10
@register(
    "threshold_predictions",
    sql=f"{SCORES_SQL} SELECT doc_id, prob, CAST(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM lg WHERE model = 'main'",
    doubles=("prob",),
)
def threshold_predictions(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).where(F.col("model") == "main")
    return s.select("doc_id", "prob", EV.threshold(F.col("prob")).alias("pred"))


@register(
    "verdicts",
    sql=f"""{SCORES_SQL} SELECT doc_id, printf('%.4f', prob) AS prob_text,
    CASE WHEN prob >= 0.5 THEN 'probably machine text' ELSE 'probably human text' END AS verdict FROM lg WHERE model = 'main'""",
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).where(F.col("model") == "main")
    return s.select("doc_id", EV.prob_text(F.col("prob")).alias("prob_text"), EV.verdict(F.col("prob")).alias("verdict"))


# ------------------------------------------------------------------ J3 / A18 / A19
def _metrics_sql(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""{SCORES_SQL}, p AS (SELECT *, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM lg {"" if by else "WHERE model = 'main'"}),
    c AS (SELECT {sel}count(*) AS n, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
      sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
      sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM p {grp}),
    r AS (SELECT *, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall FROM c)
    SELECT {sel}tp, fp, fn, tn, coalesce((tp + tn) / NULLIF(n, 0), 0.0) AS accuracy, precision, recall,
      coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM r"""


MET_D = ("accuracy", "precision", "recall", "f1")


@register("eval_metrics", sql=_metrics_sql(""), doubles=MET_D)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).where(F.col("model") == "main").withColumn("pred", EV.threshold(F.col("prob")))
    return EV.metrics(s)


@register("eval_metrics_by_model", sql=_metrics_sql("model"), doubles=MET_D)
def eval_metrics_by_model(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).withColumn("pred", EV.threshold(F.col("prob")))
    return EV.metrics(s, by=["model"])


# ------------------------------------------------------------------ J4 / R2 / R3 / A12
@register(
    "compare_matrix",
    sql=f"{SCORES_SQL} SELECT doc_id, {', '.join(f'max(prob) FILTER (WHERE model = {S.q(m)}) AS {m}' for m in LN.MODEL_NAMES)} FROM lg GROUP BY doc_id",
    doubles=tuple(LN.MODEL_NAMES),
)
def compare_matrix(spark: SparkSession, d: str) -> DataFrame:
    # all models score in one projection, so the matrix needs no pivot (no shuffle)
    return LN.score_models_wide(score_rows(spark, d), keep=["doc_id"])


@register(
    "compare_matrix_labelled",
    sql=f"{SCORES_SQL} SELECT doc_id, label, {', '.join(f'max(prob) FILTER (WHERE model = {S.q(m)}) AS {m}' for m in LN.MODEL_NAMES)} FROM lg GROUP BY doc_id, label",
    doubles=tuple(LN.MODEL_NAMES),
)
def compare_matrix_labelled(spark: SparkSession, d: str) -> DataFrame:
    return LN.score_models_wide(score_rows(spark, d), keep=["doc_id", "label"])


_PAIRS = [(a, b) for i, a in enumerate(LN.MODEL_NAMES) for b in LN.MODEL_NAMES[i + 1 :]]
PAIRED_SQL = f"""WITH {SCORE_ROWS_SQL},
sc AS (SELECT doc_id, {', '.join(f'{_sig_sql(_dot_sql(W[m]))} AS {m}' for m in LN.MODEL_NAMES)} FROM tr),
pr AS ({' UNION ALL '.join(f"SELECT {S.q(a)} AS first, {S.q(b)} AS second, {a} - {b} AS d FROM sc" for a, b in _PAIRS)})
SELECT first, second, count(d)::BIGINT AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t,
  (count(d) - 1)::DOUBLE AS df FROM pr GROUP BY first, second"""


@register("paired_t", sql=PAIRED_SQL, doubles=("mean_diff", "t", "df"))
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return EV.paired_t(LN.score_models_wide(score_rows(spark, d), keep=["doc_id"]), LN.MODEL_NAMES)


@register(
    "paired_t_pvalues",
    sql=f"WITH pt AS ({PAIRED_SQL}) SELECT *, {S.t_two_sided('t', 'df')} AS p_value FROM pt",
    doubles=("mean_diff", "t", "df", "p_value"),
)
def paired_t_pvalues(spark: SparkSession, d: str) -> DataFrame:
    return EV.paired_t_pvalues(paired_t(spark, d))


# ------------------------------------------------------------------ A20-A23
def _asym_sql(p: str, y: str) -> str:
    pc = f"least(greatest({p}, 1e-8), 1 - 1e-8)"
    return f"-({y} * ln({pc}) * pow(1 - {pc}, 2.0) + (1 - {y}) * ln(1 - {pc}) * pow({pc}, 4.0))"


LOSS_ROWS_SQL = f"""WITH {TRAIN_ROWS_SQL},
lr AS (SELECT doc_id, {_asym_sql(_sig_sql(_dot_sql(W['main'])), 'label')} AS l0,
  pow({_dot_sql(W['aux1'])} - aux1_s, 2) AS l1, pow({_dot_sql(W['aux2'])} - aux2_s, 2) AS l2 FROM tr)"""
MT_WEIGHTS = [1.0, 0.5, 0.5]


def _loss_rows(spark: SparkSession, d: str) -> DataFrame:
    t = train_rows(spark, d)
    e = F.col("embedding")
    return t.select(
        "doc_id",
        LN.asymmetric_loss_terms(LN.score_linear(e, W["main"]), F.col("label")).alias("l0"),
        LN.squared_error(LN.dot(e, W["aux1"]), F.col("aux1_s")).alias("l1"),
        LN.squared_error(LN.dot(e, W["aux2"]), F.col("aux2_s")).alias("l2"),
    )


@register(
    "asymmetric_loss",
    sql=f"WITH {SCORE_ROWS_SQL}, lr AS (SELECT {_asym_sql(_sig_sql(_dot_sql(W['main'])), 'label')} AS l0 FROM tr) SELECT count(*)::BIGINT AS n, avg(l0) AS loss FROM lr",
    doubles=("loss",),
)
def asymmetric_loss(spark: SparkSession, d: str) -> DataFrame:
    p = LN.score_linear(F.col("embedding"), W["main"])
    rows = score_rows(spark, d).select(LN.asymmetric_loss_terms(p, F.col("label")).alias("l0"))
    return rows.agg(F.count("*").alias("n"), F.avg("l0").alias("loss"))


@register("mse_loss", sql=f"{LOSS_ROWS_SQL} SELECT avg(l1) AS mse_aux1, avg(l2) AS mse_aux2 FROM lr", doubles=("mse_aux1", "mse_aux2"))
def mse_loss(spark: SparkSession, d: str) -> DataFrame:
    return _loss_rows(spark, d).agg(F.avg("l1").alias("mse_aux1"), F.avg("l2").alias("mse_aux2"))


@register(
    "multitask_loss",
    sql=f"{LOSS_ROWS_SQL}, a AS (SELECT avg(l0) AS l0, avg(l1) AS l1, avg(l2) AS l2 FROM lr) SELECT l0, l1, l2, 1.0 * l0 + 0.5 * l1 + 0.5 * l2 AS total FROM a",
    doubles=("l0", "l1", "l2", "total"),
)
def multitask_loss(spark: SparkSession, d: str) -> DataFrame:
    a = _loss_rows(spark, d).agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"), F.avg("l2").alias("l2"))
    return a.withColumn("total", LN.weighted_total([F.col("l0"), F.col("l1"), F.col("l2")], MT_WEIGHTS))


@register(
    "epoch_loss",
    sql=f"""{LOSS_ROWS_SQL},
    bt AS (SELECT *, (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1) // 64 AS batch_id FROM lr),
    bm AS (SELECT batch_id, avg(l0) AS l0, avg(l1) AS l1, avg(l2) AS l2 FROM bt GROUP BY batch_id)
    SELECT count(*)::BIGINT AS n_batches, avg(l0) AS main, avg(l1) * 0.5 AS aux1, avg(l2) * 0.5 AS aux2,
      avg(l0) + 0.5 * avg(l1) + 0.5 * avg(l2) AS total FROM bm""",
    doubles=("main", "aux1", "aux2", "total"),
)
def epoch_loss(spark: SparkSession, d: str) -> DataFrame:
    b = prep.minibatches(_loss_rows(spark, d), 64, 0, seed=42)
    bm = b.groupBy("batch_id").agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"), F.avg("l2").alias("l2"))
    return bm.agg(
        F.count("*").alias("n_batches"),
        F.avg("l0").alias("main"),
        (F.avg("l1") * 0.5).alias("aux1"),
        (F.avg("l2") * 0.5).alias("aux2"),
        (F.avg("l0") + 0.5 * F.avg("l1") + 0.5 * F.avg("l2")).alias("total"),
    )


# ------------------------------------------------------------------ M8
@register(
    "softmax_argmax",
    sql="""WITH lg AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings)
    SELECT vec_id, (list_position(z, list_max(z)) - 1)::BIGINT AS arg,
      1.0 / list_reduce(list_transform(z, lambda v: exp(v - list_max(z))), lambda a, b: a + b) AS p_max FROM lg""",
    doubles=("p_max",),
)
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    # the whole encoder output vector is the logit vector
    e = tables.load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    arg, pmax = LN.softmax_argmax(F.col("z"))
    return e.select("vec_id", arg.alias("arg"), pmax.alias("p_max"))


# ------------------------------------------------------------------ X22-X24 encodings
def _enc_sql(max_len: int | None, table: str = "documents", key: str = "doc_id") -> str:
    sl = f"[1:{max(max_len - 2, 0)}]" if max_len is not None else ""
    return f"""vt AS (SELECT unnest({S.tokens()}) AS token FROM {table} WHERE text IS NOT NULL),
    vc AS (SELECT token, count(*) AS c FROM vt GROUP BY token),
    vocab AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) + {SEP} AS id FROM vc),
    tk AS (SELECT {key}, ({S.tokens()}){sl} AS t FROM {table} WHERE text IS NOT NULL),
    fl AS (SELECT {key}, unnest(t) AS token, unnest(generate_series(1, len(t))) AS pos FROM tk),
    sq AS (SELECT fl.{key}, list(coalesce(v.id, {UNK}) ORDER BY pos) AS s FROM fl LEFT JOIN vocab v USING (token) GROUP BY fl.{key}),
    enc AS (SELECT tk.{key}, [{CLS}] || coalesce(sq.s, []) || [{SEP}] AS ids FROM tk LEFT JOIN sq USING ({key}))"""


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """The whole document corpus (vocabulary fitted on it, every text encoded in full)."""
    return tables.load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")


@register(
    "encode_ids",
    sql=f"WITH {_enc_sql(None)} SELECT doc_id, len(ids)::BIGINT AS n_ids, array_to_string(ids, ' ') AS ids_text FROM enc",
)
def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    e = encode(_corpus(spark, d), "doc_id")
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", " ").alias("ids_text"))


@register(
    "truncate_ids",
    sql=f"WITH {_enc_sql(TRUNCATE)} SELECT doc_id, len(ids)::BIGINT AS n_ids, array_to_string(ids, ' ') AS ids_text FROM enc",
)
def truncate_ids(spark: SparkSession, d: str) -> DataFrame:
    e = encode(_corpus(spark, d), "doc_id", max_len=TRUNCATE)
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", " ").alias("ids_text"))


@register(
    "pad_mask",
    sql=f"""WITH {_enc_sql(TRUNCATE)}, m AS (SELECT max(len(ids)) AS m FROM enc)
    SELECT doc_id, array_to_string(ids || list_transform(range(m - len(ids)), lambda i: 0), ' ') AS input_ids,
      array_to_string(list_transform(range(len(ids)), lambda i: 1) || list_transform(range(m - len(ids)), lambda i: 0), ' ') AS attention_mask
    FROM enc, m""",
)
def pad_mask(spark: SparkSession, d: str) -> DataFrame:
    # short id rows are written once: the longest row and the padding read them, not the texts
    p = pad(cut(encode(_corpus(spark, d), "doc_id", max_len=TRUNCATE)), "doc_id")
    return p.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("attention_mask", " ").alias("attention_mask"))


# ------------------------------------------------------------------ glob of models: J4 / A18 / A19 / S6
MODEL_FILES = {"epoch0": 1, "epoch1": 2, "other": 3}


def _stored_models(spark: SparkSession, d: str) -> dict[str, LN.Heads]:
    """Three model folders, written and found again by two glob patterns."""
    root = scratch_path(spark, "models")
    for name, k in MODEL_FILES.items():
        folder = f"{root}/{'run' if name.startswith('epoch') else 'alone'}/{name}"
        LN.save_model(spark, LN.Heads({"main": [*LN.fixed_weights(k), 0.125 * k]}), folder)
    return LN.collect_models(tables.read_models(spark, [f"{root}/run/epoch*", f"{root}/alone/*"], root_depth=1))


_GLOB_SQL = f"""WITH {SCORE_ROWS_SQL},
sc AS (SELECT doc_id, label, {', '.join(f"{_sig_sql(_dot_sql(LN.fixed_weights(k)) + f' + {0.125 * k}')} AS {m}" for m, k in MODEL_FILES.items())} FROM tr)"""


@register(
    "score_model_glob",
    sql=f"{_GLOB_SQL} SELECT doc_id, label, {', '.join(MODEL_FILES)} FROM sc",
    doubles=tuple(MODEL_FILES),
)
def score_model_glob(spark: SparkSession, d: str) -> DataFrame:
    return LN.score_heads_wide(score_rows(spark, d), _stored_models(spark, d))


@register(
    "eval_model_glob",
    sql=_metrics_sql("model").replace(SCORES_SQL, f"{_GLOB_SQL}, lg AS (UNPIVOT sc ON {', '.join(MODEL_FILES)} INTO NAME model VALUE prob)"),
    doubles=MET_D,
)
def eval_model_glob(spark: SparkSession, d: str) -> DataFrame:
    models = _stored_models(spark, d)
    long = LN.score_heads_wide(score_rows(spark, d), models).unpivot(["doc_id", "label"], list(models), "model", "prob")
    return EV.metrics(long.withColumn("pred", EV.threshold(F.col("prob"))), by=["model"])


SCORE_BUCKETS = 8


def separate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of models that were scored by a job each, side by side."""
    rows = score_rows(spark, d)
    models = _stored_models(spark, d)
    return EV.side_by_side(spark, {m: EV.store_scores(LN.forward(rows, h), m, SCORE_BUCKETS, prob="main") for m, h in models.items()})


@register("compare_separate", sql=f"{_GLOB_SQL} SELECT doc_id, {', '.join(MODEL_FILES)} FROM sc", doubles=tuple(MODEL_FILES))
def compare_separate(spark: SparkSession, d: str) -> DataFrame:
    return separate_scores(spark, d)


_SEPARATE_PAIRS = [(a, b) for i, a in enumerate(MODEL_FILES) for b in list(MODEL_FILES)[i + 1 :]]


@register(
    "paired_t_separate",
    sql=f"""{_GLOB_SQL}, pr AS ({' UNION ALL '.join(f"SELECT '{a}' AS first, '{b}' AS second, {a} - {b} AS d FROM sc" for a, b in _SEPARATE_PAIRS)})
    SELECT first, second, count(d)::BIGINT AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, (count(d) - 1)::DOUBLE AS df FROM pr GROUP BY first, second""",
    doubles=("mean_diff", "t", "df"),
)
def paired_t_separate(spark: SparkSession, d: str) -> DataFrame:
    return EV.paired_t(separate_scores(spark, d), list(MODEL_FILES))


# ------------------------------------------------------------------ M1 / M5 / M3 / M9 / S7 / S8 / S10 / M7 / J2 / M11
def _train_table(spark: SparkSession, d: str) -> DataFrame:
    t = train_rows(spark, d)
    return cut(t.select("doc_id", "embedding", F.col("label").alias("main"), F.array("aux1_s", "aux2_s").alias("aux")))


def _fixed_heads(n: int) -> LN.Heads:
    """Fixed weights as heads, the bias a quarter of the head's number."""
    return LN.Heads({h: [*LN.fixed_weights(k), 0.25 * k] for k, h in enumerate(["main", "aux_block0", "aux_block1"][:n], start=1)})


def _head_sql(k: int) -> str:
    return f"({_dot_sql(LN.fixed_weights(k))} + {0.25 * k})"


@register(
    "multihead_forward",
    sql=f"WITH {TRAIN_ROWS_SQL} SELECT doc_id, {_sig_sql(_head_sql(1))} AS main, {_head_sql(2)} AS aux1, {_head_sql(3)} AS aux2 FROM tr",
    doubles=("main", "aux1", "aux2"),
)
def multihead_forward(spark: SparkSession, d: str) -> DataFrame:
    return LN.forward(_train_table(spark, d), _fixed_heads(3), training=True)


@register("score_table", sql=f"WITH {SCORE_ROWS_SQL} SELECT doc_id, {_sig_sql(_head_sql(1))} AS main FROM tr", doubles=("main",))
def score_table(spark: SparkSession, d: str) -> DataFrame:
    # outside training only the main head answers, and it needs no auxiliary target
    return LN.forward(score_rows(spark, d), _fixed_heads(2), training=False)


LR = 1e-3


def _train_sql(weights: list[float | None], epochs: int, batches: int, where: str = "true", accumulate: int = 1) -> str:
    """CTEs of a whole training: ``w{k}`` the heads after step k, ``l{k}`` the losses of batch k."""
    heads = [(h, w) for h, w in zip(("main", "aux_block0", "aux_block1"), weights) if w is not None]
    out = [
        TRAIN_ROWS_SQL.strip(),
        f"tt AS MATERIALIZED (SELECT * FROM tr WHERE {where})",
        "xv AS MATERIALIZED (SELECT doc_id, unnest(CAST(embedding AS DOUBLE[]) || [1.0]) AS v, unnest(range(65)) AS i FROM tt)",
        "w0 AS MATERIALIZED (SELECT h, i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM (VALUES "
        + ", ".join(f"('{h}')" for h, _ in heads)
        + ") q(h), range(65) r(i))",
    ]
    factor = "CASE h " + " ".join(f"WHEN '{h}' THEN {w}" for h, w in heads) + " END"
    p, k, step, held = "least(greatest(1 / (1 + exp(-z)), 1e-8), 1 - 1e-8)", 0, 0, []
    for e in range(epochs):
        for b in range(batches):
            k += 1
            mine = f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{e}'), 1, 8) AS BIGINT) % {batches} = {b}"
            out.append(
                f"z{k} AS MATERIALIZED (SELECT doc_id, h, sum(v * w) AS z FROM xv JOIN w{step} USING (i) WHERE {mine} GROUP BY doc_id, h)"
            )
            out.append(
                f"""d{k} AS MATERIALIZED (SELECT doc_id, h, CASE WHEN h = 'main' THEN
  label * ({GP} * p * pow(1 - p, {GP}) * ln(p) - pow(1 - p, {GP} + 1)) + (1 - label) * (pow(p, {GN} + 1) - {GN} * pow(p, {GN}) * (1 - p) * ln(1 - p))
  ELSE 2 * (z - y) END AS d, CASE WHEN h = 'main' THEN -(label * ln(p) * pow(1 - p, {GP}) + (1 - label) * ln(1 - p) * pow(p, {GN})) ELSE pow(z - y, 2) END AS l
  FROM (SELECT *, {p} AS p, CASE WHEN h = 'aux_block0' THEN aux1_s ELSE aux2_s END AS y FROM z{k} JOIN tt USING (doc_id)))"""
            )
            out.append(f"l{k} AS MATERIALIZED (SELECT h, avg(l) AS l FROM d{k} GROUP BY h)")
            out.append(f"g{k} AS MATERIALIZED (SELECT h, i, avg(d * v) AS g FROM d{k} JOIN xv USING (doc_id) GROUP BY h, i)")
            held.append(k)
            if len(held) == accumulate or b == batches - 1:
                g = " UNION ALL ".join(f"SELECT * FROM g{x}" for x in held)
                step += 1
                out.append(
                    f"""w{step} AS MATERIALIZED (SELECT h, i, w - {LR} * ((m / (1 - pow(0.9, {step}))) / (sqrt(s / (1 - pow(0.999, {step}))) + 1e-8) + 0.01 * w) AS w, m, s
  FROM (SELECT h, i, w, 0.9 * m + 0.1 * g AS m, 0.999 * s + 0.001 * g * g AS s
    FROM w{step - 1} JOIN (SELECT h, i, avg(g) * {factor} AS g FROM ({g}) GROUP BY h, i) USING (h, i)))"""
                )
                held = []
    per = " UNION ALL ".join(f"SELECT {(x - 1) // batches} AS epoch, h, l FROM l{x}" for x in range(1, k + 1))
    out.append(f"ep AS (SELECT epoch, h, avg(l) * {factor} AS loss FROM ({per}) GROUP BY epoch, h)")
    return ",\n".join(out)


GP, GN = LN.GAMMA_POS, LN.GAMMA_NEG


def _history_sql(run: str) -> str:
    name = "CASE h WHEN 'main' THEN 'main' WHEN 'aux_block0' THEN 'aux1' ELSE 'aux2' END"
    return f"""SELECT '{run}' AS run, epoch::INTEGER AS epoch, {name} AS task, loss FROM ep
    UNION ALL SELECT '{run}', epoch::INTEGER, 'total', sum(loss) FROM ep GROUP BY epoch"""


def _history_df(spark: SparkSession, hist: list[dict]) -> DataFrame:
    rows = []
    for h in hist:
        for task in ("total", "main", "aux1", "aux2", "val_total"):
            if task in h:
                rows.append((h["run"], int(h["epoch"]), task, float(h[task])))
    return spark.createDataFrame(rows, "run string, epoch int, task string, loss double")


@register("train_multitask", sql=f"WITH {_train_sql([1.0, 0.5, 0.5], 2, 2)} {_history_sql('mt')}", doubles=("loss",))
def train_multitask(spark: SparkSession, d: str) -> DataFrame:
    res = LN.train(_train_table(spark, d), LN.parse_weights("1.0,0.5,0.5"), epochs=2, batches_per_epoch=2, lr=LR, run="mt", checkpoint=False)
    return _history_df(spark, res.history)


_TEST_SQL = "(SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rn, count(*) OVER () AS n FROM tr) WHERE rn <= ceil(0.2 * n))"


def _val_sql(step: int) -> str:
    loss = _asym_sql("(1.0 / (1.0 + exp(-z0)))", "label")
    return f"""SELECT avg({loss}) + 0.5 * avg(pow(z1 - aux1_s, 2)) FROM (SELECT label, aux1_s,
      sum(v * w) FILTER (WHERE h = 'main') AS z0, sum(v * w) FILTER (WHERE h = 'aux_block0') AS z1
      FROM (SELECT doc_id, label, aux1_s, unnest(CAST(embedding AS DOUBLE[]) || [1.0]) AS v, unnest(range(65)) AS i FROM tr WHERE doc_id IN {_TEST_SQL})
      JOIN w{step} USING (i) GROUP BY doc_id, label, aux1_s)"""


@register(
    "validation_loss",
    sql=f"""WITH {_train_sql([1.0, 0.5, None], 2, 2, where=f"doc_id NOT IN {_TEST_SQL}")} {_history_sql('val')}
    UNION ALL SELECT 'val', 0, 'val_total', ({_val_sql(2)}) UNION ALL SELECT 'val', 1, 'val_total', ({_val_sql(4)})""",
    doubles=("loss",),
)
def validation_loss(spark: SparkSession, d: str) -> DataFrame:
    t = cut(prep.split_random(_train_table(spark, d), "doc_id", 0.2, 42))
    res = LN.train(
        t.where(F.col("split") == "train"), LN.parse_weights("1.0,0.5"), epochs=2, batches_per_epoch=2, lr=LR,
        run="val", val=t.where(F.col("split") == "test"), checkpoint=False,
    )
    return _history_df(spark, res.history)


def _trained_checkpoints(spark: SparkSession, d: str):
    res = LN.train(_train_table(spark, d), LN.parse_weights("1.0,,0.5"), epochs=2, batches_per_epoch=2, lr=LR, run="ck", accumulation_steps=2)
    return res, spark.read.parquet(res.checkpoint_path)


_CK_SQL = f"WITH {_train_sql([1.0, None, 0.5], 2, 2, accumulate=2)}"


@register(
    "train_checkpoints",
    sql=f"""{_CK_SQL}, a AS (SELECT 0 AS epoch, * FROM w1 UNION ALL SELECT 1, * FROM w2)
    SELECT 'ck' AS run, epoch::INTEGER AS epoch, h || CASE WHEN i < 64 THEN '.w' ELSE '.b' END AS tensor, count(*)::BIGINT AS n_values,
      sum(w) AS total, sum(w * w) AS squares FROM a GROUP BY ALL""",
    doubles=("total", "squares"),
)
def train_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    _, ck = _trained_checkpoints(spark, d)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return ck.select(
        "run", "epoch", "tensor", F.size("values").cast("bigint").alias("n_values"),
        add("values").alias("total"), add(F.transform("values", lambda x: x * x)).alias("squares"),
    )


@register(
    "checkpoint_heads",
    sql=f"{_CK_SQL} SELECT 'ck' AS run, epoch::INTEGER AS epoch, bool_or(h = 'aux_block0') AS has_aux1, bool_or(h = 'aux_block1') AS has_aux2, "
    "(2 * count(DISTINCT h))::BIGINT AS n_tensors FROM (SELECT 0 AS epoch, h FROM w1 UNION ALL SELECT 1, h FROM w2) GROUP BY epoch",
)
def checkpoint_heads(spark: SparkSession, d: str) -> DataFrame:
    _, ck = _trained_checkpoints(spark, d)
    return LN.checkpoint_heads(ck)


@register("loss_history", sql=f"WITH {_train_sql([1.0, 0.5, 0.5], 2, 2)} {_history_sql('lh')}", doubles=("loss",))
def loss_history(spark: SparkSession, d: str) -> DataFrame:
    res = LN.train(_train_table(spark, d), LN.parse_weights("1.0,0.5,0.5"), epochs=2, batches_per_epoch=2, lr=LR, run="lh", checkpoint=False)
    path = scratch_path(spark, "loss_history")
    _history_df(spark, res.history).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ the front block that all heads share
SHARED = 4  # units
_GELU_SQL = f"(0.5 * z * (1 + tanh({LN.GELU_C!r} * (z + {LN.GELU_A} * z * z * z))))"
_SLOPE_SQL = (
    f"(0.5 * (1 + tanh({LN.GELU_C!r} * (z + {LN.GELU_A} * z * z * z))) + 0.5 * z * (1 - pow(tanh({LN.GELU_C!r} * (z + {LN.GELU_A} * z * z * z)), 2))"
    f" * {LN.GELU_C!r} * (1 + {3 * LN.GELU_A!r} * z * z))"
)


def _weights_sql(heads: LN.Heads) -> str:
    rows = ", ".join(f"('{h}', {i}, {float(x)!r}::DOUBLE)" for h, v in heads.weights.items() for i, x in enumerate(v))
    return f"SELECT h, i, w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM (VALUES {rows}) q(h, i, w)"


def _forward_sql(name: str, inputs: str, w: str, where: str = "true") -> list[str]:
    """CTEs of a pass through the front block and the heads: ``{name}a`` units, ``{name}o`` outputs."""
    return [
        f"{name}a AS MATERIALIZED (SELECT doc_id, CAST(substr(h, {len(LN.FRONT) + 1}) AS INTEGER) AS r, {_GELU_SQL} AS a, {_SLOPE_SQL} AS da FROM "
        f"(SELECT doc_id, h, sum(v * w) AS z FROM {inputs} JOIN {w} USING (i) WHERE h LIKE '{LN.FRONT}%' AND {where} GROUP BY doc_id, h))",
        f"{name}h AS MATERIALIZED (SELECT doc_id, r AS i, a FROM {name}a UNION ALL SELECT DISTINCT doc_id, {SHARED}, 1.0 FROM {name}a)",
        f"{name}o AS MATERIALIZED (SELECT doc_id, h, sum(a * w) AS z FROM {name}h JOIN {w} USING (i) WHERE h NOT LIKE '{LN.FRONT}%' GROUP BY doc_id, h)",
    ]


def _shared_train_sql(weights: list[float | None], epochs: int, batches: int, run: str = "t", start: str | None = None) -> tuple[list[str], str]:
    """CTEs of a training with a front block over ``tt`` (rows) and ``xv`` (their input values), and the last weights' name.
    ``start``: weights to go on from."""
    heads = [(h, w) for h, w in zip(("main", "aux_block0", "aux_block1"), weights) if w is not None]
    aux = [w is not None for w in weights[1:]]
    first = _weights_sql(LN.Heads.init(aux, shared=SHARED)) if start is None else f"SELECT h, i, w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM {start}"
    out = [f"{run}_w0 AS MATERIALIZED ({first})"]
    factor = "CASE {} " + " ".join(f"WHEN '{h}' THEN {w}" for h, w in heads) + " ELSE 1.0 END"
    p, step = "least(greatest(1 / (1 + exp(-z)), 1e-8), 1 - 1e-8)", 0
    for e in range(epochs):
        for b in range(batches):
            k, w = f"{run}_{step + 1}", f"{run}_w{step}"
            out += _forward_sql(k, "xv", w, f"CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{e}'), 1, 8) AS BIGINT) % {batches} = {b}")
            out.append(
                f"""{k}d AS MATERIALIZED (SELECT doc_id, h, CASE WHEN h = 'main' THEN
  label * ({GP} * p * pow(1 - p, {GP}) * ln(p) - pow(1 - p, {GP} + 1)) + (1 - label) * (pow(p, {GN} + 1) - {GN} * pow(p, {GN}) * (1 - p) * ln(1 - p))
  ELSE 2 * (z - y) END AS d, CASE WHEN h = 'main' THEN -(label * ln(p) * pow(1 - p, {GP}) + (1 - label) * ln(1 - p) * pow(p, {GN})) ELSE pow(z - y, 2) END AS l
  FROM (SELECT *, {p} AS p, CASE WHEN h = 'aux_block0' THEN aux1_s ELSE aux2_s END AS y FROM {k}o JOIN tt USING (doc_id)))"""
            )
            out.append(f"{k}l AS MATERIALIZED (SELECT h, avg(l) AS l FROM {k}d GROUP BY h)")
            out.append(
                f"""{k}g AS MATERIALIZED (SELECT h, i, avg(d * a) * {factor.format('h')} AS g FROM {k}d JOIN {k}h USING (doc_id) GROUP BY h, i
  UNION ALL SELECT '{LN.FRONT}' || r, xv.i, avg(back * v) FROM
  (SELECT doc_id, r, sum({factor.format('x.h')} * x.d * w.w) * any_value(da) AS back FROM {k}a JOIN {k}d x USING (doc_id) JOIN {w} w ON w.h = x.h AND w.i = r GROUP BY doc_id, r)
  JOIN xv USING (doc_id) GROUP BY r, xv.i)"""
            )
            step += 1
            out.append(
                f"""{run}_w{step} AS MATERIALIZED (SELECT h, i, w - {LR} * ((m / (1 - pow(0.9, {step}))) / (sqrt(s / (1 - pow(0.999, {step}))) + 1e-8) + 0.01 * w) AS w, m, s
  FROM (SELECT h, i, w, 0.9 * m + 0.1 * g AS m, 0.999 * s + 0.001 * g * g AS s FROM {w} JOIN {k}g USING (h, i)))"""
            )
    per = " UNION ALL ".join(f"SELECT {x // batches} AS epoch, h, l FROM {run}_{x + 1}l" for x in range(epochs * batches))
    out.append(f"{run}_ep AS (SELECT epoch, h, avg(l) * {factor.format('h')} AS loss FROM ({per}) GROUP BY epoch, h)")
    return out, f"{run}_w{step}"


_XV = "SELECT doc_id, unnest(CAST(embedding AS DOUBLE[]) || [1.0]) AS v, unnest(range(65)) AS i FROM"


def _shared_rows_sql(where: str = "true") -> list[str]:
    return [TRAIN_ROWS_SQL.strip(), f"tt AS MATERIALIZED (SELECT * FROM tr WHERE {where})", f"xv AS MATERIALIZED ({_XV} tt)"]


def _shared_sql(weights: list[float | None], epochs: int, batches: int) -> str:
    return ",\n".join(_shared_rows_sql() + _shared_train_sql(weights, epochs, batches)[0])


_FIXED_SHARED = LN.Heads.init([True, True], shared=SHARED)


@register(
    "shared_forward",
    sql=",\n".join([f"WITH {TRAIN_ROWS_SQL.strip()}", f"xv AS ({_XV} tr)", f"w AS ({_weights_sql(_FIXED_SHARED)})", *_forward_sql("f", "xv", "w")])
    + " SELECT doc_id, 1 / (1 + exp(-max(z) FILTER (WHERE h = 'main'))) AS main, max(z) FILTER (WHERE h = 'aux_block0') AS aux1, max(z) FILTER (WHERE h = 'aux_block1') AS aux2 FROM fo GROUP BY doc_id",
    doubles=("main", "aux1", "aux2"),
)
def shared_forward(spark: SparkSession, d: str) -> DataFrame:
    """All heads over the shared front block."""
    return LN.forward(_train_table(spark, d), _FIXED_SHARED, training=True)


@register("train_shared", sql=f"WITH {_shared_sql([1.0, 0.5, 0.5], 2, 2)} {_history_sql('sh').replace('ep', 't_ep').replace('t_epoch', 'epoch')}", doubles=("loss",))
def train_shared(spark: SparkSession, d: str) -> DataFrame:
    res = LN.train(
        _train_table(spark, d), LN.parse_weights("1.0,0.5,0.5"), epochs=2, batches_per_epoch=2, lr=LR, run="sh", checkpoint=False, shared=SHARED
    )
    return _history_df(spark, res.history)


@register(
    "train_shared_weights",
    sql=f"WITH {_shared_sql([1.0, None, 0.5], 2, 2)} SELECT h || CASE WHEN i = max(i) OVER (PARTITION BY h) THEN '.b' ELSE '.w' END AS tensor, i::INTEGER AS i, w AS value FROM t_w4",
    doubles=("value",),
)
def train_shared_weights(spark: SparkSession, d: str) -> DataFrame:
    """Every weight of the last checkpoint, read back from its table."""
    weights = LN.parse_weights("1.0,,0.5")
    res = LN.train(_train_table(spark, d), weights, epochs=2, batches_per_epoch=2, lr=LR, run="sw", shared=SHARED)
    ck = spark.read.parquet(res.checkpoint_path).where("epoch = 1")
    rows = ck.select("tensor", F.posexplode("values").alias("i", "value"))
    bias = F.when(~F.col("tensor").startswith(LN.FRONT), SHARED).otherwise(LN.EMBED_DIM)
    return rows.select("tensor", F.when(F.col("tensor").endswith(".b"), bias).otherwise(F.col("i")).cast("int").alias("i"), "value")


def _resume_sql() -> str:
    first, last = _shared_train_sql([1.0, 0.5, None], 1, 2, "a")
    more, _ = _shared_train_sql([1.0, 0.5, None], 1, 2, "b", last)
    history = _history_sql("resumed").replace("FROM ep", "FROM b_ep")
    return "WITH " + ",\n".join(_shared_rows_sql() + first + more) + " " + history


@register("resume_training", sql=_resume_sql(), doubles=("loss",))
def resume_training(spark: SparkSession, d: str) -> DataFrame:
    """A model is read from its checkpoint's table, checked for the heads that the weights need, and trained further."""
    table, weights = _train_table(spark, d), LN.parse_weights("1.0,0.5")
    how = {"epochs": 1, "batches_per_epoch": 2, "lr": LR}
    ck = spark.read.parquet(LN.train(table, weights, run="first", shared=SHARED, **how).checkpoint_path)
    if LN.missing_heads(ck, weights):
        raise ValueError("the checkpoint has no head for a weighted task")
    res = LN.train(table, weights, run="resumed", heads=LN.load_checkpoint(ck, "first", 0), checkpoint=False, **how)
    return _history_df(spark, res.history)


ABLATION = {"main": "1.0", "aux1": "1.0,0.5", "aux2": "1.0,,0.5", "aux12": "1.0,0.5,0.5"}


def _ablation_sql() -> str:
    ctes = _shared_rows_sql(f"doc_id NOT IN {_TEST_SQL}") + [f"xt AS MATERIALIZED ({_XV} tr WHERE doc_id IN {_TEST_SQL})"]
    scores = []
    for name, spec in ABLATION.items():
        more, last = _shared_train_sql(LN.parse_weights(spec), 1, 2, name)
        ctes += more + _forward_sql(f"{name}_s", "xt", last)
        scores.append(f"(SELECT doc_id, 1 / (1 + exp(-z)) AS {name} FROM {name}_so WHERE h = 'main')")
    ctes.append(f"sc AS (SELECT * FROM {scores[0]}" + "".join(f" JOIN {x} USING (doc_id)" for x in scores[1:]) + ")")
    pairs = [(a, b) for i, a in enumerate(ABLATION) for b in list(ABLATION)[i + 1 :]]
    ctes.append("pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, {a} - {b} AS d FROM sc" for a, b in pairs) + ")")
    ctes.append(
        "pt AS (SELECT first, second, count(d)::BIGINT AS n, avg(d) AS mean_diff, avg(d) / NULLIF(stddev_samp(d) / sqrt(count(d)), 0) AS t, (count(d) - 1)::DOUBLE AS df FROM pr GROUP BY first, second)"
    )
    return "WITH " + ",\n".join(ctes) + f" SELECT *, {S.t_two_sided('t', 'df')} AS p_value FROM pt"


@register("model_ablation", sql=_ablation_sql(), doubles=("mean_diff", "t", "df", "p_value"))
def model_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Four trainings (main, +aux1, +aux2, +both) over a shared front block, scored on held-out rows, then paired t-tests."""
    t = cut(prep.split_random(_train_table(spark, d), "doc_id", 0.2, 42))
    train_t, test_t = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
    models = {
        name: LN.train(train_t, LN.parse_weights(spec), epochs=1, batches_per_epoch=2, lr=LR, run=name, checkpoint=False, shared=SHARED).heads
        for name, spec in ABLATION.items()
    }
    return EV.paired_t_pvalues(EV.paired_t(LN.score_heads_wide(test_t, models, keep=["doc_id"]), list(models)))


# ------------------------------------------------------------------ M7 / J2 sentiment
def _text_model_sql(label: str) -> str:
    """CTEs of the naive Bayes text classifier: ``pb``, the probability of class 1 (of classes 0 and 1), for each text."""
    return f"""nt AS MATERIALIZED (SELECT doc_id, {S.tokens()} AS t FROM documents WHERE text IS NOT NULL),
    nx AS MATERIALIZED (SELECT doc_id, unnest(t) AS token FROM nt),
    ny AS (SELECT doc_id, {label} AS y FROM labels JOIN nt USING (doc_id) WHERE {label} IS NOT NULL),
    nc AS MATERIALIZED (SELECT token, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM nx LEFT JOIN ny USING (doc_id) GROUP BY token),
    nk AS (SELECT ln(sum(n0) + count(*)) AS b0, ln(sum(n1) + count(*)) AS b1 FROM nc),
    np AS (SELECT ln(count(*) FILTER (WHERE y = 0) / count(*)) AS p0, ln(count(*) FILTER (WHERE y = 1) / count(*)) AS p1 FROM ny),
    ns AS (SELECT doc_id, sum(ln(n0 + 1)) AS s0, sum(ln(n1 + 1)) AS s1 FROM nx JOIN nc USING (token) GROUP BY doc_id),
    nl AS (SELECT doc_id, p0 - len(t) * b0 + coalesce(s0, 0) AS l0, p1 - len(t) * b1 + coalesce(s1, 0) AS l1 FROM nt LEFT JOIN ns USING (doc_id), nk, np),
    pb AS (SELECT doc_id, exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS p FROM nl),
    sn AS (SELECT doc_id, CASE WHEN p > 0.5 THEN 1 ELSE 0 END::INTEGER AS sentiment_label, greatest(p, 1 - p) AS sentiment_score FROM pb)"""


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of every text, written once: fitting and scoring read them, not the texts."""
    docs = tables.load(spark, d, "documents").where(F.col("text").isNotNull())
    return TM.written(docs.select("doc_id", X.tokens("text").alias("tokens")), "tokens")


def _sentiment_scored(spark: SparkSession, d: str) -> DataFrame:
    return TM.sentiment(token_rows(spark, d), tables.load(spark, d, "labels").select("doc_id", "toxic"), "toxic")


@register("sentiment", sql=f"WITH {_text_model_sql('toxic')} SELECT doc_id, sentiment_label, sentiment_score FROM sn", doubles=("sentiment_score",))
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _sentiment_scored(spark, d)


@register(
    "sentiment_attach",
    sql=f"WITH {S.extended_cte()}, {_text_model_sql('toxic')} SELECT {', '.join(EXT_COLS)}, sentiment_label, sentiment_score FROM x LEFT JOIN sn USING (doc_id)",
    doubles=(*EXT_D, "sentiment_score"),
)
def sentiment_attach(spark: SparkSession, d: str) -> DataFrame:
    return extended(spark, d).select(*EXT_COLS).join(_sentiment_scored(spark, d), "doc_id", "left")


# ------------------------------------------------------------------ S3: a path or a frame
def evaluate_source(spark: SparkSession, source: DataFrame | str, model: TM.TextModel) -> DataFrame:
    """Metrics of a text model on labelled texts ``(doc_id, text, label)``: a frame, or the path of CSV or Parquet files."""
    rows = tables.rows_of(spark, source).where(F.col("text").isNotNull())
    tokens = TM.written(rows.select("doc_id", "label", X.tokens("text").alias("tokens")), "source-tokens")
    prob = F.col("probabilities")[model.classes.index(1.0)]
    scored = TM.class_probabilities(tokens.select("doc_id", "tokens"), model).select("doc_id", prob.alias("prob"))
    return EV.metrics(scored.join(tokens.select("doc_id", "label"), "doc_id").withColumn("pred", EV.threshold(F.col("prob"))))


@register(
    "eval_text_source",
    sql=f"""WITH {_text_model_sql('quality')}, p AS (SELECT quality AS label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM pb JOIN labels USING (doc_id)),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
      count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM p),
    r AS (SELECT *, coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall FROM c)
    SELECT tp, fp, fn, tn, (tp + tn) / n AS accuracy, precision, recall, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM r""",
    doubles=MET_D,
)
def eval_text_source(spark: SparkSession, d: str) -> DataFrame:
    """A text model scored on a CSV file of labelled texts."""
    path = scratch_path(spark, "labelled") + ".csv"
    tables.write_csv(tables.labelled(spark, d).select("doc_id", "text", "label"), path)
    model = TM.fit_text_model(token_rows(spark, d), tables.load(spark, d, "labels").select("doc_id", "quality"), "quality")
    return evaluate_source(spark, path, model)
