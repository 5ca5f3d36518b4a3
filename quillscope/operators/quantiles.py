"""Exact order statistics and quantiles without collecting a group into one task.

Spark's exact ``percentile`` keeps a value->count map per group in a single
buffer, which does not survive a group holding a third of 100 TB. Here the k-th
smallest value of every group is found by iterative narrowing: each round counts
the rows of the still-open value interval per (group, bucket) with a
map-side-combined aggregate, then a tiny table of bucket counts (groups x 1,024)
locates the bucket holding rank k. The interval shrinks to that bucket's observed
[min, max]; it is exact once min == max. Buckets are of equal width inside a factor of
two, else of equal width in the signed binary logarithm, so the some 4,200 binades of a
double need at most two rounds and its 52 bits six more, whatever the distribution. A located
bucket of at most ``COLLECT_MAX`` values is sorted directly (a bounded group), so typical data
needs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.session import cut

BUCKETS = 1024
COLLECT_MAX = 50_000  # a located bucket with at most this many values is sorted in one task
BROADCAST_ROWS = 200_000  # interval tables are broadcast only when the target count is below this


def order_statistics(long: DataFrame, keys: list[str], value: str, targets: DataFrame) -> DataFrame:
    """k-th smallest non-null ``value`` per group.

    ``targets`` has ``keys`` + ``k`` (1-based rank, 1 <= k <= n). Returns ``keys, k, kth``.
    ``long`` should be persisted by the caller: it is scanned once or twice per round.
    """
    vals = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    bounds = vals.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    # per-round tables have one row per target: written to the shared checkpoint folder so
    # every round starts from a short plan and survives executor loss
    state = cut(
        targets.select(*keys, "k").distinct().join(bounds, keys).withColumn("_below", F.lit(0).cast("bigint"))
    )
    small_targets = state.count() <= BROADCAST_ROWS

    def scale(v: Column) -> Column:
        # monotone over all doubles: the binade number with the sign of the value, 0 for 0
        return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1076))

    def bucket_of(a: Column, b: Column) -> Column:
        v = F.greatest(a, F.least(b, F.col("_v")))  # infinities are at the interval's ends
        near = ((a > 0) & (b <= 2 * a)) | ((b < 0) & (a >= 2 * b))
        part = F.when(near, (v - a) / (b - a)).otherwise((scale(v) - scale(a)) / (scale(b) - scale(a)))
        return F.least(F.lit(BUCKETS - 1), F.floor(part * BUCKETS).cast("int"))

    parts: list[DataFrame] = [
        state.where(F.col("_a") == F.col("_b")).select(*keys, "k", F.col("_a").alias("kth"))
    ]
    open_ = state.where(F.col("_a") < F.col("_b"))
    while True:
        intervals = open_.select(*keys, "_a", "_b").distinct()
        if small_targets:
            intervals = F.broadcast(intervals)
        inside = vals.join(intervals, keys).where((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
        hist = inside.groupBy(*keys, "_a", "_b", bucket_of(F.col("_a"), F.col("_b")).alias("_bk")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")
        )
        # bucket tables are at most targets x 1,024 rows
        w = Window.partitionBy(*keys, "_a", "_b").orderBy("_bk")
        hist = hist.withColumn("_cum", F.sum("_c").over(w))
        # rank k lies in the bucket where below + cum - c < k <= below + cum
        located = cut(
            open_.join(hist, keys + ["_a", "_b"])
            .where(
                (F.col("_below") + F.col("_cum") - F.col("_c") < F.col("k"))
                & (F.col("k") <= F.col("_below") + F.col("_cum"))
            )
            .withColumn("_below2", F.col("_below") + F.col("_cum") - F.col("_c"))
        )
        parts.append(located.where(F.col("_mn") == F.col("_mx")).select(*keys, "k", F.col("_mn").alias("kth")))
        small = located.where((F.col("_mn") < F.col("_mx")) & (F.col("_c") <= COLLECT_MAX))
        buckets = small.select(*keys, "_a", "_b", "_bk").distinct()
        if small_targets:
            buckets = F.broadcast(buckets)
        gathered = (
            vals.join(buckets, keys)
            .where(
                (F.col("_v") >= F.col("_a"))
                & (F.col("_v") <= F.col("_b"))
                & (bucket_of(F.col("_a"), F.col("_b")) == F.col("_bk"))
            )
            .groupBy(*keys, "_a", "_b", "_bk")
            .agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
        )
        parts.append(
            small.join(gathered, keys + ["_a", "_b", "_bk"]).select(
                *keys, "k", F.element_at("_vs", (F.col("k") - F.col("_below2")).cast("int")).alias("kth")
            )
        )
        open_ = located.where((F.col("_mn") < F.col("_mx")) & (F.col("_c") > COLLECT_MAX)).select(
            *keys, "k", F.col("_mn").alias("_a"), F.col("_mx").alias("_b"), F.col("_below2").alias("_below")
        )
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantiles_type7(long: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact R type-7 (= DuckDB ``quantile_cont``) quantiles per group, one column per name."""
    vals = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    counts = vals.groupBy(*keys).agg(F.count("*").alias("_n"))
    pos = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p)) + 1
        pos.append(
            F.struct(
                F.lit(name).alias("q"),
                h.alias("h"),
                F.floor(h).cast("bigint").alias("lo"),
                F.ceil(h).cast("bigint").alias("hi"),
            )
        )
    spec = cut(counts.select(*keys, F.explode(F.array(*pos)).alias("s")).select(*keys, "s.*"))
    ends = spec.select(
        *keys, "q", "h", "lo", F.explode(F.array(F.col("lo"), F.col("hi"))).alias("k")
    )
    stats = order_statistics(vals, keys, value, ends.select(*keys, "k"))
    j = ends.join(stats, keys + ["k"]).groupBy(*keys, "q", "h", "lo").agg(
        F.min("kth").alias("x_lo"), F.max("kth").alias("x_hi")
    )
    res = j.select(
        *keys,
        "q",
        (F.col("x_lo") + (F.col("h") - F.col("lo")) * (F.col("x_hi") - F.col("x_lo"))).alias("_qv"),
    )
    return res.groupBy(*keys).pivot("q", list(probs)).agg(F.first("_qv"))
