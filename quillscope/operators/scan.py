"""Prefix scan over a global order that carries sums and the last value.

Rows are range-partitioned and sorted once and written. Every partition then runs its own part of the scan
(a narrow Arrow pass) and reports a summary: rows, sum, last value. The summaries are scanned in two
levels, so no window holds more than ``GROUP`` of them, or one for each ``GROUP`` partitions, and each
partition gets what came before it by a broadcast of one row a partition. No cut points and no rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.session import cut, ship_package

GROUP = 1024  # partitions whose summaries are scanned together


def prefix_scan(df: DataFrame, order: list[Column], value: str, before: str | None = None, rows: str | None = None, previous: str | None = None) -> DataFrame:
    """``df`` with, for each row in ``order``: ``before``, the sum of ``value`` over all earlier rows (0 for the first);
    ``rows``, how many there are; ``previous``, the value of the row before (null for the first).

    ``value`` is a long or double column; nulls add nothing and are carried as such. ``order`` should be unique:
    rows equal in it come in any order.
    """
    ship_package(df.sparkSession)
    d = cut(df.orderBy(*order).withColumn("_rid", F.monotonically_increasing_id()))
    part, place = F.shiftright("_rid", 33), F.col("_rid").bitwiseAND((1 << 33) - 1)
    kind = T.LongType() if isinstance(df.schema[value].dataType, (T.LongType, T.IntegerType)) else T.DoubleType()
    own = T.StructType([*d.schema.fields, T.StructField("_run", kind), T.StructField("_prev", kind)])
    local = d.mapInArrow(_local(d.columns.index(value), pa.int64() if isinstance(kind, T.LongType) else pa.float64()), own)
    add = lambda c: F.coalesce(c, F.lit(0).cast(kind))
    has = F.struct(F.col(value).cast(kind).alias("v")).alias("_v")  # a struct, so that a null last value is carried too
    sums = d.groupBy(part.alias("_part")).agg(
        (F.max(place) + 1).alias("_n"), add(F.sum(value)).cast(kind).alias("_s"), F.max_by(has, place).alias("_l")
    )
    sums = cut(sums.withColumn("_g", F.floor(F.col("_part") / GROUP)))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("_g").agg(F.sum("_n").alias("_gn"), F.sum("_s").alias("_gs"), F.max_by("_l", "_part").alias("_gl"))
    over = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each GROUP partitions
    groups = groups.select("_g", F.coalesce(F.sum("_gn").over(over), F.lit(0)).alias("_gn"), add(F.sum("_gs").over(over)).alias("_gs"), F.last("_gl", True).over(over).alias("_gl"))
    base = sums.join(F.broadcast(groups), "_g").select(
        "_part",
        (F.col("_gn") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_n0"),
        (F.col("_gs") + add(F.sum("_s").over(earlier))).alias("_s0"),
        F.coalesce(F.last("_l", True).over(earlier), F.col("_gl"))["v"].alias("_l0"),
    )
    out = local.join(F.broadcast(base), part == F.col("_part"))
    new = {before: F.col("_s0") + F.col("_run"), rows: F.col("_n0") + place, previous: F.when(place == 0, F.col("_l0")).otherwise(F.col("_prev"))}
    return out.select(*[f"`{c}`" for c in df.columns], *[c.alias(name) for name, c in new.items() if name])


def _local(at: int, kind: pa.DataType):
    """A partition's own running sums before each row, and the values of the rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, pa.nulls(1, kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(at).cast(kind)
            sums = np.cumsum(pc.fill_null(v, 0).to_numpy(zero_copy_only=False))
            before = np.concatenate([[0], sums[:-1]]).astype(sums.dtype) + total
            prev = pa.concat_arrays([last, v.slice(0, len(v) - 1)])
            total, last = total + sums[-1], v.slice(len(v) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, kind), prev], names=[*batch.schema.names, "_run", "_prev"])

    return run
