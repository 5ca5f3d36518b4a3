"""Global order without a single-partition window.

* ``hash_key``: deterministic pseudo-random order ``md5(concat(id, ':', seed))``;
  identical in Spark and DuckDB, so splits and shuffles are reproducible.
* ``global_position``: 1-based position in hash order. Rows are bucketed on the
  first four hex digits of the hash (65,536 near-equal buckets: about 1.5 M rows per
  bucket at 1e11 rows), bucket sizes are prefix-summed on a table of at most 65,536
  rows, and ``row_number`` runs only inside a bucket.
* ``kth_hash``: the hash value at a given position, found by narrowing hash prefixes
  (three more hex digits per round) until the bucket holding the position has at most
  ``BUCKET_ROWS`` rows, then one ``row_number`` inside that bucket. Exact, and the
  sorted work per group is bounded however large the group is.
* ``average_rank``: tie-averaged rank of a value column. Ties collapse first (group by value), so
  a hot value is one row; a prefix scan over the distinct values adds up their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscope.operators import scan
from quillscope.session import cut

HASH_PREFIX = 3  # hex digits added per kth_hash round -> 4,096 sub-buckets
POSITION_PREFIX = 4  # global_position buckets: 16**4 = 65,536
HASH_LEN = 32  # hex digits of an md5
BUCKET_ROWS = 1_000_000  # most rows one window bucket (one task) is meant to sort
HEAVY = 1000  # a value with more than one in HEAVY of all rows is a hot key
BROADCAST_ROWS = 200_000  # small tables (targets, distinct-value ranks) are broadcast below this many rows


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a scalar subquery struct (evaluated once, no join)."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def hash_key(id_col: Column | str, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def _bucket(h: Column, digits: int = POSITION_PREFIX) -> Column:
    return F.substring(h, 1, digits)


def global_position(df: DataFrame, id_col: str, seed: int, out: str = "pos") -> DataFrame:
    """Adds ``out`` = 1-based position in (hash, id) order and ``_h`` the hash."""
    h = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_bk", _bucket(F.col("_h")))
    sizes = h.groupBy("_bk").agg(F.count("*").alias("_bn"))
    # at most 65,536 rows: the one-partition window here is over bucket sizes, not rows
    offsets = sizes.select(
        "_bk", (F.sum("_bn").over(Window.orderBy("_bk")) - F.col("_bn")).alias("_off")
    )
    w = Window.partitionBy("_bk").orderBy("_h", id_col)
    return (
        h.join(F.broadcast(offsets), "_bk")
        .withColumn(out, F.col("_off") + F.row_number().over(w))
        .drop("_bk", "_off")
    )


def row_number_all(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out`` = 1-based position of every row in ``order``, without a one-task window.

    The rows are range-partitioned and sorted, then written with an id that holds partition and
    place; one row count per partition reaches the driver and becomes its offset.
    """
    d = cut(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    part, place = F.shiftright("_rid", 33), F.col("_rid").bitwiseAND((1 << 33) - 1)
    sizes = d.groupBy(part.alias("_part")).agg(F.max(place).alias("_last")).orderBy("_part").collect()
    base, rows = 1, []
    for r in sizes:
        rows.append((r["_part"], base))
        base += r["_last"] + 1
    offsets = d.sparkSession.createDataFrame(rows, "_part long, _base long")
    return (
        d.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(out, F.col("_base") + place)
        .drop("_rid", "_part", "_base")
    )


def kth_hash(df: DataFrame, id_col: str, seed: int, k_col: Column, by: list[str] | tuple = ()) -> DataFrame:
    """Per group of ``by``: the (hash, id) key ``(_hk, _idk)`` at 1-based position k in hash order.

    ``k_col`` is an aggregate over the group (e.g. ``ceil(0.2 * count(*))``). Groups with
    k = 0 get no row. Each round counts the rows of the still-open hash prefix per
    (group, prefix + 3 hex digits) -- a map-side-combined aggregate of at most 4,096 rows
    per group -- and locates the sub-bucket holding position k. md5 is uniform, so a
    round divides the open rows by about 4,096: one round up to ~4e9 rows per group, two
    beyond. The last step numbers the rows of one bucket per group (``BUCKET_ROWS`` at most,
    unless one id is repeated that often).
    """
    keys = list(by) or ["_g"]
    src = df if by else df.withColumn("_g", F.lit(0))
    h = src.select(*keys, F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_h"))
    ks = src.groupBy(*keys).agg(k_col.cast("bigint").alias("_k"))
    # one row per group: the hash prefix located so far and the rank still to find inside it
    target = cut(ks.where(F.col("_k") >= 1).select(*keys, F.lit("").alias("_p"), F.col("_k").alias("_kin")))
    small = target.count() <= BROADCAST_ROWS
    plen = 0
    while True:
        tgt = F.broadcast(target) if small else target
        open_rows = h.join(tgt.select(*keys, "_p"), keys).where(F.substring("_h", 1, plen) == F.col("_p"))
        plen = min(HASH_LEN, plen + HASH_PREFIX)
        sizes = open_rows.groupBy(*keys, F.substring("_h", 1, plen).alias("_bk")).agg(F.count("*").alias("_bn"))
        # <= 4,096 sub-bucket rows per group
        cum = sizes.withColumn("_cum", F.sum("_bn").over(Window.partitionBy(*keys).orderBy("_bk")))
        located = cut(
            cum.join(tgt.select(*keys, "_kin"), keys)
            .where((F.col("_cum") - F.col("_bn") < F.col("_kin")) & (F.col("_kin") <= F.col("_cum")))
            .select(*keys, F.col("_bk").alias("_p"), (F.col("_kin") - (F.col("_cum") - F.col("_bn"))).alias("_kin"), "_bn")
        )
        biggest = located.agg(F.max("_bn")).first()[0]
        target = located.select(*keys, "_p", "_kin")
        if biggest is None or biggest <= BUCKET_ROWS or plen >= HASH_LEN:
            break
    tgt = F.broadcast(target) if small else target
    w = Window.partitionBy(*keys).orderBy("_h", "_id")
    inside = (
        h.join(tgt, keys)
        .where(F.substring("_h", 1, plen) == F.col("_p"))
        .withColumn("_rn", F.row_number().over(w))
    )
    return inside.where(F.col("_rn") == F.col("_kin")).select(
        *list(by), F.col("_h").alias("_hk"), F.col("_id").alias("_idk")
    )


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out`` = tie-averaged 1-based rank of non-null ``value`` (rows with NULL get NULL)."""
    d = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    scanned = scan.prefix_scan(d, [F.col(value)], "_c", before="_before")
    ranks = cut(scanned.select(value, "_c", (F.col("_before") + 1 + (F.col("_c") - 1) / 2.0).alias(out)))
    n_distinct = ranks.count()
    if n_distinct <= BROADCAST_ROWS:
        # one row per distinct value, proven small: no shuffle of the rows, and a value
        # holding a third of all rows cannot skew a join partition
        return df.join(F.broadcast(ranks.drop("_c")), value, "left")
    # many distinct values: the few that hold more than a thousandth of all rows each (so at most
    # a thousand) are broadcast, and only rows of the other values are shuffled
    total = ranks.agg(F.sum("_c")).first()[0]
    heavy = F.col("_c") * HEAVY > total
    hot, rest = F.broadcast(ranks.where(heavy).drop("_c")), ranks.where(~heavy).drop("_c")
    return df.join(hot, value).unionByName(df.join(hot, value, "left_anti").join(rest, value, "left"))
