"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target of words: its weight's part of ``share`` times all words, at most ``most``
times its own words; what is over the cap is shared again. A target is first met by complete epochs
(each document once), then by a fraction: documents have keys ``-ln(u) / quality`` with u from
a hash, are taken in the order of their keys, and the one that crosses the budget gives its first words.

No source is sorted. Keys fall into ordered buckets, sizes are summed by (source, bucket) and
then over the buckets of a source, and only the bucket in which the budget ends is divided again,
until it has at most ``SORT_ROWS`` rows. Only one row per source (``MAX_SOURCES``) reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.llm.common import prepare, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
BUCKETS = 4096
SORT_ROWS = 100_000
MAX_SOURCES = 100_000  # more sources than a mix can name one by one: an error
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: a text loses weight for each symbol of ``#*$%&|<>``."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return (size + 1) / (size + 1 + 5 * symbols)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words that the mix takes from each source; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        left = max(left, 0.0)
        open_ = [s for s in open_ if s not in out]
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None = None) -> DataFrame:
    """``docs`` with ``_size`` and ``_key`` behind all its columns packed as ``_in``."""
    t, i = F.col("_in").getField(text_col), F.col("_in").getField(id_col)
    w = quality_weight(t, F.col("_size")) if weight is None else F.col("_weight")
    u = (F.shiftrightunsigned(F.xxhash64(i, t, F.lit(seed)), 11) + 0.5) * 2.0**-53
    packed = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in")]
    rows = docs.select(*packed, *([] if weight is None else [weight.cast("double").alias("_weight")]))
    rows = rows.withColumn("_size", word_count(t))
    return rows.select(
        "_in", i.alias("_id"), F.col("_in").getField(source_col).cast("string").alias("_source"), "_size", (-F.log(u) / w).alias("_key")
    )


def plan(narrow: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: size, target, epochs, and the key, id and words at which its fraction ends.

    ``narrow``: written ``(_id, _source, _size, _key)``.
    """
    spark = narrow.sparkSession
    per = narrow.groupBy("_source").agg(F.sum("_size").alias("n"), (F.count("*") / F.sum("_key")).alias("rate"))
    rows = per.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["_source"]: r["n"] for r in rows}
    goal = targets(sizes, weights, share, most)
    state = {}
    for r in rows:
        s, n = r["_source"], r["n"]
        epochs = min(int(most), int(goal[s] // n)) if n else 0
        rest = int(goal[s] - epochs * n) if epochs < most else 0
        state[s] = dict(source=s, source_size=n, target=goal[s], epochs=epochs, need=rest, rate=r["rate"], lo=0.0, hi=math.inf, rows=None)
    ends = _ends(narrow, state)
    out = [
        (s, x["source_size"], float(x["target"]), x["epochs"], *ends.get(s, (None, None, 0, 1)))
        for s, x in state.items()
    ]
    kind = dict(narrow.dtypes)["_id"]
    return spark.createDataFrame(
        out,
        f"_source string, source_size long, target double, epochs int, end_key double, end_id {kind}, end_words long, end_rows long",
    )


def _ends(narrow: DataFrame, state: dict) -> dict:
    """For each source with a fraction: (key, id, words taken there, rows there) where its budget ends."""
    spark = narrow.sparkSession
    live = {s: x for s, x in state.items() if x["need"] > 0}
    first = True
    while any(x["rows"] is None or (x["rows"] > SORT_ROWS and x["lo"] < x["hi"]) for x in live.values()):
        todo = {s: x for s, x in live.items() if x["rows"] is None or (x["rows"] > SORT_ROWS and x["lo"] < x["hi"])}
        inside = _inside(narrow, todo)
        if first:  # the keys of a source are about exponential
            part = 1 - F.exp(-F.col("_key") * F.col("rate"))
        else:
            part = (F.col("_key") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bucket = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1))
        sums = inside.groupBy("_source", "need", bucket.alias("bucket")).agg(
            F.sum("_size").alias("words"), F.count("*").alias("rows"), F.min("_key").alias("lo"), F.max("_key").alias("hi")
        )
        # at most BUCKETS rows for each source
        upto = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket"))
        found = sums.withColumn("upto", upto).where("upto >= need and upto - words < need").collect()
        for r in found:
            live[r["_source"]] |= {"need": r["need"] - (r["upto"] - r["words"]), "lo": r["lo"], "hi": r["hi"], "rows": r["rows"]}
        first = False
    if not live:
        return {}
    ties = _inside(narrow, live).groupBy("_source", "need", "_key", "_id").agg(
        F.sum("_size").alias("words"), F.count("*").alias("rows")
    )
    upto = F.sum("words").over(Window.partitionBy("_source").orderBy("_key", "_id"))
    found = ties.withColumn("upto", upto).where("upto >= need and upto - words < need").collect()
    return {r["_source"]: (r["_key"], r["_id"], r["need"] - (r["upto"] - r["words"]), r["rows"]) for r in found}


def _inside(narrow: DataFrame, state: dict) -> DataFrame:
    """Rows with words whose keys lie in their source's open interval."""
    rows = [(s, x["need"], float(x["rate"]), x["lo"], x["hi"]) for s, x in state.items()]
    t = narrow.sparkSession.createDataFrame(rows, "_s string, need long, rate double, lo double, hi double")
    return narrow.where("_size > 0").join(
        F.broadcast(t), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_key") >= F.col("lo")) & (F.col("_key") <= F.col("hi"))
    )


def apply(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``size, source_size, target, taken`` by the plan; one row per source is broadcast."""
    e = ends.withColumnRenamed("_source", "_s")
    here = F.struct(F.col("_key").alias("k"), F.col("_id").alias("i"))
    end = F.struct(F.col("end_key").alias("k"), F.col("end_id").alias("i"))
    part = (
        F.when(F.col("end_key").isNull() | (F.col("_size") == 0), F.lit(0))
        .when(here < end, F.col("_size"))
        .when((F.col("_key") == F.col("end_key")) & F.col("_id").eqNullSafe(F.col("end_id")), F.expr("end_words div end_rows"))
        .otherwise(F.lit(0))
    )
    return rows.join(F.broadcast(e), F.col("_source").eqNullSafe(F.col("_s"))).withColumns(
        {"size": F.col("_size"), "taken": (F.col("epochs") * F.col("_size") + part).cast("bigint")}
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
    weight: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs``' columns ``keep`` (default all) with ``size, source_size, target, taken`` (replacing such columns).

    ``weight``: positive quality weight of a document (default ``quality_weight``). A null or empty
    text has no words and none are taken; a null source is a source, the last. Rows that repeat
    id and text have equal keys and share what is taken where the budget ends evenly. A source
    without words has target 0. An empty table gives none.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, source_col, seed, weight)
    narrow = stored(rows.select("_id", "_source", "_size", "_key"), "keyed")
    out = apply(rows if keep is None or set(keep) != {id_col} else narrow, plan(narrow, weights, share, most))
    new = ("size", "source_size", "target", "taken")
    if keep is not None and set(keep) == {id_col}:
        return out.select(F.col("_id").alias(id_col), *new)
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    return out.select(*[F.col("_in").getField(c).alias(c) for c in own], *new)
