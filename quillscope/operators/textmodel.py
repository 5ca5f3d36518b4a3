"""An exact multinomial naive Bayes text classifier over every token of a corpus (sentiment, verdicts).

The fit is one aggregate: how often a token occurs in the labelled texts of each class. A token's
weight for a class is ``ln(occurrences + 1)``; what the smoothed probability also needs,
``-ln(tokens of the class + types)``, is the same for all tokens and enters by a text's length. So
only tokens that occur in labelled texts have a row, and no two tokens share one.

Scoring joins tokens with weights in two tiers: the most frequent tokens, bounded in bytes, are
broadcast; only the others are shuffled, and none of these is frequent. The result does
not depend on the bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.session import scratch_path

HEAD_BYTES = 32 << 20  # token rows that are broadcast
ROW_BYTES = 48  # what a row costs beside its token and weights
CLASSES = 1000  # labels at most
LABEL_ROWS = 500_000  # labels that are broadcast at most: 16 bytes each
PARTS = 4  # parts of an exchange for each split of the tokens, as rows are larger there than in files


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class TextModel:
    """Classes in order, ``prior`` and ``base`` (log probabilities: of the class, and of an unseen token), and
    ``weights``: ``(token, seen, w)`` with an array of class weights."""

    classes: list[float]
    prior: list[float]
    base: list[float]
    weights: DataFrame

    def save(self, path: str) -> None:
        """A folder that ``load_text_model`` reads: token rows and one row for each class."""
        spark = self.weights.sparkSession
        self.weights.write.parquet(f"{path}/tokens")
        rows = list(zip(map(float, self.classes), self.prior, self.base))
        spark.createDataFrame(rows, "class double, prior double, base double").coalesce(1).write.parquet(f"{path}/classes")


def load_text_model(spark: SparkSession, path: str) -> TextModel:
    rows = spark.read.parquet(f"{path}/classes").orderBy("class").collect()  # CLASSES rows at most
    return TextModel([r["class"] for r in rows], [r["prior"] for r in rows], [r["base"] for r in rows], spark.read.parquet(f"{path}/tokens"))


def fit_text_model(tokens: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> TextModel:
    """``tokens``: ``(key, tokens)`` of the corpus, written data; ``labels``: ``(key, label)``, one row for some keys.

    Rows without a label (no row, or null) add to the types only. No labelled row gives a model without classes.
    """
    labelled = labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("_y"))
    classes = sorted(r["_y"] for r in labelled.join(tokens.select(key), key).select("_y").distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    if labelled.count() <= LABEL_ROWS:
        rows = tokens.join(F.broadcast(labelled), key, "left")
    else:  # the tokens move: as many parts as their size asks for
        parts = PARTS * tokens.rdd.getNumPartitions()
        rows = tokens.repartition(parts, key).join(labelled.repartition(parts, key), key, "left")
    docs = rows.groupBy("_y").agg(F.count("*").alias("n")).where("_y is not null").collect()
    n_docs = {r["_y"]: r["n"] for r in docs}
    occurs = F.array(*[F.count(F.when(F.col("_y") == y, 1)) for y in classes]) if classes else F.array().cast("array<bigint>")
    counts = written(rows.select("_y", F.explode("tokens").alias("token")).groupBy("token").agg(occurs.alias("n")), "text-model")
    r = counts.agg(F.count("*").alias("types"), *[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"c{i}") for i in range(len(classes))]).first()
    total = sum(n_docs.values())
    seen = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    weights = counts.withColumn("seen", seen).where("seen > 0").select("token", "seen", F.transform("n", lambda x: F.ln(x + F.lit(1.0))).alias("w"))
    return TextModel(
        classes, [math.log(n_docs[y] / total) for y in classes], [-math.log(r[f"c{i}"] + r["types"]) for i in range(len(classes))], weights
    )


def frequent(weights: DataFrame, classes: int, most: int) -> Column:
    """Condition on ``weights``' rows: whole bands of ``seen`` from the top, of ``most`` bytes together at most."""
    band = F.floor(F.log2("seen") * 4)
    cost = F.octet_length("token").cast("bigint") + ROW_BYTES + 8 * classes
    sizes = weights.groupBy(band.alias("band")).agg(F.sum(cost).alias("bytes")).collect()  # 4 * 63 rows at most
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["band"]):
        total += r["bytes"]
        if total > most:
            break
        least = r["band"]
    return band >= least if least is not None else F.lit(False)


def class_probabilities(tokens: DataFrame, model: TextModel, key: str = "doc_id", most: int = HEAD_BYTES) -> DataFrame:
    """``(key, probabilities)``: posterior of every class, in their order; a key is one row of ``tokens``, written data.

    A text without tokens has the priors; a model without classes gives empty arrays.
    """
    k = len(model.classes)
    if not k:
        return tokens.select(key, F.array().cast("array<double>").alias("probabilities"))
    top = frequent(model.weights, k, most)
    head = F.broadcast(model.weights.where(top).select("token", "w"))
    rest = model.weights.where(~top).select("token", "w")
    each = tokens.select(key, F.explode("tokens").alias("token"))
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)]
    # a row's tokens lie in one task, so partial sums leave one row for each key
    known = each.join(head, "token").groupBy(key).agg(*sums)
    rare = each.join(F.broadcast(model.weights.where(top).select("token")), "token", "left_anti").join(rest, "token").groupBy(key).agg(*sums)
    both = known.unionByName(rare).groupBy(key).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    rows = tokens.select(key, F.size("tokens").alias("_n")).join(both, key, "left")
    log = F.array(*[F.lit(model.prior[i]) + F.col("_n") * F.lit(model.base[i]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)])
    rows = rows.select(key, log.alias("_l")).select(key, "_l", F.array_max("_l").alias("_m"))
    rows = rows.select(key, F.transform("_l", lambda x: F.exp(x - F.col("_m"))).alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(key, "_e", total.alias("_t")).select(key, F.transform("_e", lambda x: x / F.col("_t")).alias("probabilities"))


def sentiment(tokens: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", most: int = HEAD_BYTES) -> DataFrame:
    """``(key, sentiment_label, sentiment_score)``: the likeliest class (the first of equals) by its place, and its probability."""
    out = class_probabilities(tokens, fit_text_model(tokens, labels, label, key), key, most)
    best = F.array_max("probabilities")
    return out.select(key, (F.array_position("probabilities", best) - 1).cast("int").alias("sentiment_label"), best.alias("sentiment_score"))
