"""Scoring, losses and multi-task training as native Spark jobs.

* Scores are array expressions (``zip_with`` + ``aggregate``) over literal weights, so they
  stay in JVM code and need no join.
* The model is a main head (sigmoid) and optional auxiliary heads, trained together. They read the
  encoder's output, or a front block that all heads share: a projection to a few units with a
  tanh-GELU, so that auxiliary tasks move what the main head sees. Every optimizer step is one
  aggregate over a mini-batch: residuals are columns, and the gradient of all heads, with the matrix of
  the front block, is one sum of vectors (``Summarizer``, partial sums in every task).
  The driver applies AdamW to a model-sized vector and keeps nothing else.
* An epoch's mini-batches are written once, partitioned by batch number; a step reads its own files.
* Models and checkpoints are small Parquet tables ``(tensor, values)``; scoring reads them by glob.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.session import scratch_path

EMBED_DIM = 64
NUM_AUX = 2
GAMMA_POS = 2.0
GAMMA_NEG = 4.0
CLAMP = 1e-8
MODEL_NAMES = ["main", "aux1", "aux2", "aux12"]
BETA1, BETA2, EPS, DECAY = 0.9, 0.999, 1e-8, 0.01  # AdamW


# ------------------------------------------------------------------ fixed linear models
def fixed_weights(k: int, dim: int = EMBED_DIM) -> list[float]:
    """w[i] = sin(i * k), i = 1..dim (the four comparison models use k = 1..4)."""
    return [math.sin(i * k) for i in range(1, dim + 1)]


def dot(arr: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    prods = F.zip_with(arr.cast("array<double>"), w, lambda a, b: a * b)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def score_linear(arr: Column, weights: list[float]) -> Column:
    return sigmoid(dot(arr, weights))


def score_models_wide(df: DataFrame, emb: str = "embedding", keep: list[str] = ("doc_id", "label")) -> DataFrame:
    """Scores of every fixed model side by side (one column per model) in one projection.

    This is the score matrix itself: no pivot and no shuffle. Each row is read once.
    """
    return df.select(
        *keep,
        *[score_linear(F.col(emb), fixed_weights(k)).alias(m) for k, m in enumerate(MODEL_NAMES, start=1)],
    )


def score_models(df: DataFrame, emb: str = "embedding", keep: list[str] = ("doc_id", "label")) -> DataFrame:
    """Long scores ``(keep..., model, prob)``: all models in one projection, then unpivot.

    No join: the four fixed models are literal arrays, so each row is read once.
    """
    return score_models_wide(df, emb, keep).unpivot(list(keep), MODEL_NAMES, "model", "prob")


# ------------------------------------------------------------------ losses
def asymmetric_loss_terms(p: Column, y: Column, gpos: float = GAMMA_POS, gneg: float = GAMMA_NEG) -> Column:
    """Per-row asymmetric focal loss term; the loss is the mean of this column."""
    pc = F.least(F.greatest(p, F.lit(CLAMP)), F.lit(1 - CLAMP))
    y = y.cast("double")
    return -(y * F.ln(pc) * F.pow(1 - pc, gpos) + (1 - y) * F.ln(1 - pc) * F.pow(pc, gneg))


def squared_error(pred: Column, y: Column) -> Column:
    return F.pow(pred - y.cast("double"), 2)


def weighted_total(losses: list[Column], weights: list[float | None]) -> Column:
    """Task-loss vector weighted and summed; a head with weight None is off (0)."""
    w = [0.0 if x is None else float(x) for x in weights]
    vec = F.array(*losses)
    wv = F.array(*[F.lit(x) for x in w])
    return F.aggregate(F.zip_with(vec, wv, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def parse_weights(spec: str, num_aux: int = NUM_AUX) -> list[float | None]:
    """"1.0,,0.5" -> [1.0, None, 0.5]: empty or missing entries switch a head off."""
    parts = spec.split(",") if spec else []
    out: list[float | None] = [None if p.strip() == "" else float(p) for p in parts]
    out += [None] * (1 + num_aux - len(out))
    if out[0] is None:
        out[0] = 0.0
    return out[: 1 + num_aux]


# ------------------------------------------------------------------ multi-task heads
FRONT = "front_block"
GELU_C, GELU_A = math.sqrt(2 / math.pi), 0.044715  # tanh form of the GELU


def head_names(aux: list[bool]) -> list[str]:
    return ["main"] + [f"aux_block{i}" for i, on in enumerate(aux) if on]


def gelu(z: Column) -> Column:
    return 0.5 * z * (1 + F.tanh(GELU_C * (z + GELU_A * z * z * z)))


def gelu_slope(z: Column) -> Column:
    t = F.tanh(GELU_C * (z + GELU_A * z * z * z))
    return 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * GELU_C * (1 + 3 * GELU_A * z * z)


@dataclass
class Heads:
    """One weight vector per head, the bias last: ``main`` and ``aux_block{i}`` for auxiliary task i.

    With a shared front block also one vector for each of its units, ``front_block{r}``; heads
    then have a weight for each unit instead of each value of the encoder's output.
    """

    weights: dict[str, list[float]]

    @staticmethod
    def init(aux: list[bool] | None = None, dim: int = EMBED_DIM, shared: int = 0) -> "Heads":
        """All zero without a front block: a linear model has no symmetry that other weights would have to
        break. With ``shared`` units fixed waves part the units, and the heads."""
        names = head_names(aux or [False] * NUM_AUX)
        if not shared:
            return Heads({h: [0.0] * (dim + 1) for h in names})
        w = {f"{FRONT}{r}": [math.sin((r + 1) * i) / math.sqrt(dim) for i in range(1, dim + 1)] + [0.0] for r in range(shared)}
        number = {"main": 1} | {f"aux_block{i}": i + 2 for i in range(NUM_AUX)}  # of a head, whichever others there are
        return Heads(w | {h: [math.cos(number[h] * r) / math.sqrt(shared) for r in range(1, shared + 1)] + [0.0] for h in names})

    @property
    def aux(self) -> list[bool]:
        return [f"aux_block{i}" in self.weights for i in range(NUM_AUX)]

    @property
    def names(self) -> list[str]:
        return head_names(self.aux)

    @property
    def front(self) -> list[list[float]]:
        """The front block's units in order; none if the heads read the encoder's output themselves."""
        n = sum(k.startswith(FRONT) for k in self.weights)
        return [self.weights[f"{FRONT}{r}"] for r in range(n)]

    def units(self, emb: Column) -> Column:
        """The front block's sums before the activation."""
        return F.array(*[dot(emb, w[:-1]) + F.lit(float(w[-1])) for w in self.front])

    def hidden(self, emb: Column) -> Column:
        """What the heads read."""
        return F.transform(self.units(emb), gelu) if self.front else emb

    def head(self, name: str, hidden: Column) -> Column:
        *w, b = self.weights[name]
        return dot(hidden, w) + F.lit(float(b))

    def output(self, name: str, emb: Column) -> Column:
        """Logit of ``main``, value of an auxiliary head."""
        return self.head(name, self.hidden(emb))


def forward(df: DataFrame, heads: Heads, emb: str = "embedding", key: str = "doc_id", training: bool = False) -> DataFrame:
    """``(key, main)`` and, in training, ``aux1, aux2`` of the heads that exist; one projection."""
    rows = df.select(key, heads.hidden(F.col(emb)).alias("_h"))
    cols = [sigmoid(heads.head("main", F.col("_h"))).alias("main")]
    if training:
        cols += [heads.head(f"aux_block{i}", F.col("_h")).alias(f"aux{i + 1}") for i, on in enumerate(heads.aux) if on]
    return rows.select(key, *cols)


def _task_columns(heads: Heads, hidden: Column) -> dict[str, tuple[Column, Column]]:
    """For each head its loss and the loss's derivative by the head's output."""
    y = F.col("main").cast("double")
    p = F.least(F.greatest(sigmoid(heads.head("main", hidden)), F.lit(CLAMP)), F.lit(1 - CLAMP))
    up = GAMMA_POS * p * F.pow(1 - p, GAMMA_POS) * F.ln(p) - F.pow(1 - p, GAMMA_POS + 1)
    down = F.pow(p, GAMMA_NEG + 1) - GAMMA_NEG * F.pow(p, GAMMA_NEG) * (1 - p) * F.ln(1 - p)
    out = {"main": (asymmetric_loss_terms(p, y), y * up + (1 - y) * down)}
    for i, on in enumerate(heads.aux):
        if on:
            err = heads.head(f"aux_block{i}", hidden) - F.col("aux")[i].cast("double")
            out[f"aux_block{i}"] = (err * err, 2 * err)
    return out


def gradient(
    batch: DataFrame, heads: Heads, weight: dict[str, float] | None = None
) -> tuple[dict[str, list[float]], dict[str, float], int]:
    """Mean gradient of each tensor and loss of each head over ``(embedding, main, aux)`` rows, and their count.

    One job: residuals are columns, gradients are sums of the scaled inputs, added up inside
    the tasks first. A head's gradient is that of its own loss; the front block's is that of
    the total by ``weight`` (default 1 each), carried back through the heads: the outer product of a
    row's unit residuals and its input, flattened. A model-sized row reaches the driver.
    """
    weight = weight or {h: 1.0 for h in heads.names}
    shared = len(heads.front)
    rows = batch.select(F.col("embedding").cast("array<double>").alias("_x"), "main", "aux")
    rows = rows.withColumn("_z", heads.units(F.col("_x"))) if shared else rows
    rows = rows.withColumn("_h", F.transform("_z", gelu) if shared else F.col("_x"))
    cols = _task_columns(heads, F.col("_h"))
    one = F.array(F.lit(1.0))
    rows = rows.select(
        F.concat("_x", one).alias("_x1"), F.concat("_h", one).alias("_h1"), *(["_z"] if shared else []),
        *[c.alias(f"{k}_{h}") for h, pair in cols.items() for k, c in zip("ld", pair)],
    )

    def scaled(values: str, d: Column) -> Column:
        return F.transform(values, lambda x: x * d)

    sums = []
    for h in cols:
        sums.append(Summarizer.sum(array_to_vector(scaled("_h1", F.col(f"d_{h}")))).alias(f"g_{h}"))
        sums.append(F.avg(f"l_{h}").alias(f"l_{h}"))
    if shared:
        back = [sum((F.col(f"d_{h}") * (weight[h] * heads.weights[h][r]) for h in cols), F.lit(0.0)) * gelu_slope(F.col("_z")[r]) for r in range(shared)]
        outer = F.flatten(F.array(*[scaled("_x1", b) for b in back]))
        sums.append(Summarizer.sum(array_to_vector(outer)).alias("g_front"))
    r = rows.agg(F.count("*").alias("n"), *sums)
    vectors = [f"g_{h}" for h in cols] + (["g_front"] if shared else [])
    r = r.select("n", *[vector_to_array(v).alias(v) for v in vectors], *[f"l_{h}" for h in cols]).first()
    if not r["n"]:
        return {}, {}, 0
    g = {h: [x / r["n"] for x in r[f"g_{h}"]] for h in cols}
    if shared:
        width = len(r["g_front"]) // shared
        g |= {f"{FRONT}{i}": [x / r["n"] for x in r["g_front"][i * width : (i + 1) * width]] for i in range(shared)}
    return g, {h: r[f"l_{h}"] for h in cols}, r["n"]


@dataclass
class TrainResult:
    heads: Heads
    history: list[dict]
    checkpoint_path: str | None = None


def batch_of(key: str, seed: int, epoch: int, batches: int) -> Column:
    """The mini-batch of a row in an epoch: dealt anew by a hash (equal in Spark and DuckDB)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed * 1000 + epoch}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(batches))


def write_batches(table: DataFrame, seed: int, epoch: int, batches: int, name: str = "batches") -> DataFrame:
    """An epoch's rows written once with their ``_batch``, one folder for each: a filter on it reads that folder only.

    Rows are dealt to tasks by batch and a spread of the key, so that there are about as many files as
    the input had partitions, however many batches they make.
    """
    spark = table.sparkSession
    parts = max(1, table.rdd.getNumPartitions())
    spread = max(1, parts // batches)
    rows = table.withColumn("_batch", batch_of("doc_id", seed, epoch, batches).cast("int"))
    if batches > 1:
        rows = rows.repartition(max(parts, min(batches, 10 * parts)), "_batch", F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    path = scratch_path(spark, name)
    rows.write.partitionBy("_batch").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def train(
    table: DataFrame,
    weights: list[float | None],
    epochs: int = 2,
    batches_per_epoch: int = 4,
    lr: float = 1e-3,
    seed: int = 0,
    heads: Heads | None = None,
    run: str = "run",
    val: DataFrame | None = None,
    accumulation_steps: int = 1,
    checkpoint: bool = True,
    shared: int = 0,
) -> TrainResult:
    """AdamW on a ``(doc_id, embedding, main, aux)`` table, read once for an epoch; a step reads its mini-batch.

    With ``accumulation_steps`` k the mean gradient of k batches is one step; leftover batches
    step at the end of the epoch. ``shared``: units of the front block of a new model. ``heads`` goes on from
    a model, e.g. one that ``load_checkpoint`` read; it must have a head for every weighted task.
    """
    aux_on = [w is not None for w in weights[1:]]
    heads = heads or Heads.init(aux_on, shared=shared)
    for i, on in enumerate(aux_on):
        if on and not heads.aux[i]:
            raise ValueError(f"model has no head for auxiliary task {i + 1}")
    task = {"main": weights[0] or 0.0} | {f"aux_block{i}": w or 0.0 for i, w in enumerate(weights[1:])}
    weight = {h: task.get(h, 1.0) for h in heads.weights}  # the front block's gradient is that of the weighted total
    w = {h: list(v) for h, v in heads.weights.items()}
    first = {h: [0.0] * len(v) for h, v in w.items()}
    second = {h: [0.0] * len(v) for h, v in w.items()}
    step, history = 0, []
    root = scratch_path(table.sparkSession, f"checkpoints-{run}") if checkpoint else None
    for epoch in range(epochs):
        losses, held = [], []
        rows = write_batches(table, seed, epoch, batches_per_epoch)
        for b in range(batches_per_epoch):
            g, loss, n = gradient(rows.where(F.col("_batch") == b), Heads(w), weight)
            if n:
                losses.append(loss)
                held.append(g)
            if held and (len(held) == accumulation_steps or b == batches_per_epoch - 1):
                step += 1
                for h in w:
                    for i in range(len(w[h])):
                        x = sum(g[h][i] for g in held) / len(held) * weight[h]
                        first[h][i] = BETA1 * first[h][i] + (1 - BETA1) * x
                        second[h][i] = BETA2 * second[h][i] + (1 - BETA2) * x * x
                        move = (first[h][i] / (1 - BETA1**step)) / (math.sqrt(second[h][i] / (1 - BETA2**step)) + EPS)
                        w[h][i] -= lr * (move + DECAY * w[h][i])
                held = []
        rec = {"run": run, "epoch": epoch}
        for h in heads.names:
            name = "main" if h == "main" else f"aux{int(h[-1]) + 1}"
            rec[name] = weight[h] * sum(x[h] for x in losses) / max(1, len(losses))
        rec["total"] = sum(v for k, v in rec.items() if k not in ("run", "epoch"))
        if val is not None:
            _, loss, n = gradient(val, Heads(w), weight)
            rec["val_total"] = sum(weight[h] * x for h, x in loss.items()) if n else 0.0
        history.append(rec)
        if root:
            save_model(table.sparkSession, Heads(w), f"{root}/run={run}/epoch={epoch}")
    return TrainResult(Heads(w), history, root)


def save_model(spark: SparkSession, heads: Heads, path: str) -> None:
    """A model as a table ``(tensor, values)``: ``{head}.w`` and ``{head}.b``."""
    rows = []
    for h, v in heads.weights.items():
        rows += [(f"{h}.w", [float(x) for x in v[:-1]]), (f"{h}.b", [float(v[-1])])]
    spark.createDataFrame(rows, "tensor string, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def checkpoint_heads(ckpt: DataFrame, num_aux: int = NUM_AUX) -> DataFrame:
    """Per checkpoint: which auxiliary heads it holds (tensor-name prefix ``aux_block{i}.``)."""
    aggs = [
        F.bool_or(F.col("tensor").startswith(f"aux_block{i}.")).alias(f"has_aux{i + 1}") for i in range(num_aux)
    ]
    return ckpt.groupBy("run", "epoch").agg(*aggs, F.count("*").alias("n_tensors"))


def missing_heads(ckpt: DataFrame, weights: list[float | None]) -> list[int]:
    """Auxiliary tasks that carry a weight but have no head in any checkpoint row."""
    heads = checkpoint_heads(ckpt).agg(*[F.bool_or(f"has_aux{i + 1}").alias(f"a{i}") for i in range(NUM_AUX)]).first()
    return [i + 1 for i, w in enumerate(weights[1:]) if w is not None and not heads[f"a{i}"]]


def load_checkpoint(ckpt: DataFrame, run: str, epoch: int) -> Heads:
    """One checkpoint's model (a model-sized read)."""
    rows = ckpt.where((F.col("run") == run) & (F.col("epoch") == epoch)).select("tensor", "values").collect()
    return _heads({r["tensor"]: list(r["values"]) for r in rows})


def _heads(tensors: dict[str, list[float]]) -> Heads:
    return Heads({k[:-2]: v + tensors[k[:-2] + ".b"] for k, v in tensors.items() if k.endswith(".w")})


def collect_models(models: DataFrame, limit: int = 1000) -> dict[str, Heads]:
    """Model name -> heads of a table ``(model, tensor, values)``; more than ``limit`` models are an error
    (their weights become literals of one projection)."""
    names = models.select("model").distinct().limit(limit + 1).count()
    if names > limit:
        raise ValueError(f"more than {limit} models")
    by: dict[str, dict[str, list[float]]] = {}
    for r in models.select("model", "tensor", "values").collect():
        by.setdefault(r["model"], {})[r["tensor"]] = list(r["values"])
    return {m: _heads(t) for m, t in sorted(by.items())}


def score_heads_wide(df: DataFrame, models: dict[str, Heads], emb: str = "embedding", keep: list[str] = ("doc_id", "label")) -> DataFrame:
    """Main-head scores of every model side by side: the score matrix, in one projection."""
    return df.select(*keep, *[sigmoid(m.output("main", F.col(emb))).alias(name) for name, m in models.items()])


# ------------------------------------------------------------------ M8
def softmax_argmax(logits: Column) -> tuple[Column, Column]:
    """(argmax index, max softmax probability) of a logit array."""
    mx = F.array_max(logits)
    denom = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx))
    return (F.array_position(logits, mx) - 1).cast("bigint"), 1.0 / denom
