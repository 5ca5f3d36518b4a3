"""CSV with quoted line breaks, read by many tasks.

Spark's own multi-line reader gives a file to one task. Here a file is read as lines, split like any text
file. Whether a split begins inside a quoted cell follows from the number of quotes before it: every
split reports its parity, a running sum over a file's splits settles the states, and the tasks then
parse their own records. Only records that cross a border of splits are put together from their
pieces; a split has at most two of these.

Cells follow RFC 4180: a cell that holds a comma, a quote or a line break is quoted, quotes in it
are doubled. An empty cell is null, a quoted empty cell is the empty text; blanks belong to the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.session import ship_package

HEAD, WHOLE, TAIL = 0, 1, 2  # pieces of a record at the borders of a split


def cells(record: str) -> list[str | None]:
    """The cells of one record, without its line end."""
    if record.endswith("\r") and record.count('"') % 2 == 0:
        record = record[:-1]
    if '"' not in record:
        return [x or None for x in record.split(",")]
    out: list[str | None] = []
    at, n = 0, len(record)
    while True:
        if at < n and record[at] == '"':
            stop = at + 1
            while True:  # the closing quote is the first that is not doubled
                stop = record.find('"', stop)
                if stop < 0 or record[stop + 1 : stop + 2] != '"':
                    break
                stop += 2
            stop = n if stop < 0 else stop
            out.append(record[at + 1 : stop].replace('""', '"'))
            at = record.find(",", stop)
        else:
            stop = record.find(",", at)
            out.append(record[at : n if stop < 0 else stop] or None)
            at = stop
        if at < 0:
            return out
        at += 1


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], np.ndarray, bool]]:
    """Split, lines, quotes of each line, and whether it is the split's first part; a split's batches follow each other."""
    last = None
    for batch in batches:
        value, files, starts = (batch.column(i) for i in range(3))
        key = list(zip(files.to_pylist(), starts.to_pylist(), *(batch.column(i).to_pylist() for i in range(3, batch.num_columns))))
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
        edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield key[a], value.slice(a, b - a).to_pylist(), quotes[a:b], key[a] != last
                last = key[a]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in one split, without the file's header."""
    held: list[str] = []
    odd = skip = header = False
    for (_, start, opened), lines, quotes, new in _splits(batches):
        if new:
            held, odd, skip, header = [], bool(opened), bool(opened), start == 0
        out = []
        for line, n in zip(lines, quotes.tolist()):
            odd ^= n & 1 == 1
            if odd:
                held.append(line)
                continue
            if held:
                held.append(line)
                line, held = "\n".join(held), []
            if skip or header:  # the end of an earlier split's record; the header
                skip, header = False, header and skip
            elif line not in ("", "\r"):
                out.append(cells(line))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["cells"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of records that cross a border: before a split's first boundary and after its last."""

    def rows(split, parts):
        file, start, _ = split
        parts = [(p, "\n".join(x)) for p, x in parts if x]
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * len(parts), pa.string()), pa.array([start] * len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.string())],
            names=["f", "b", "part", "piece"],
        )

    split, held, odd, first = None, [], False, False
    for now, lines, quotes, new in _splits(batches):
        if new:
            if held:
                yield rows(split, [(WHOLE if first else TAIL, held)])
            split, held, odd, first = now, [], bool(now[2]), bool(now[2])
        for line, n in zip(lines, quotes.tolist()):
            odd ^= n & 1 == 1
            held.append(line)
            if not odd:
                if first:
                    yield rows(split, [(HEAD, held)])
                held, first = [], False
    if held:
        yield rows(split, [(WHOLE if first else TAIL, held)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files with a header, columns by their place in ``schema``; a missing cell, or one that is not of its type, is null.

    The file is read three times: for the parities (built-in functions only), for the pieces at the borders
    (only splits that begin or end inside a cell leave the JVM) and for the records. The states that are
    broadcast are one row for each such split: a 40-byte path and a flag, a million for 128 TB.
    Blank lines are no records. A quote that is never closed ends with its file. A record must fit in memory.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("f", "b").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    state = splits.withColumn("o", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    crossing = F.broadcast(state.where("o = 1 or (o + odd) % 2 = 1").select("f", "b", F.col("o").cast("int").alias("o")))
    own = lines.join(crossing, ["f", "b"], "left").select("value", "f", "b", F.coalesce("o", F.lit(0)).alias("o"))
    records = own.mapInArrow(_records, "cells array<string>")
    pieces = lines.join(crossing, ["f", "b"]).select("value", "f", "b", "o").mapInArrow(_pieces, "f string, b long, part int, piece string")
    order = Window.partitionBy("f").orderBy("b", "part")
    # a tail opens a record, later wholes and a head belong to it
    number = F.sum(F.when(F.col("part") == TAIL, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = pieces.withColumn("g", number).groupBy("f", "g").agg(F.array_sort(F.collect_list(F.struct("b", "part", "piece"))).alias("p"))
    crossed = joined.select(F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("value")).mapInArrow(_parse, "cells array<string>")
    return records.unionByName(crossed).select(*[F.get("cells", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([cells(x) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["cells"])
