"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

Doubles are rounded to 6 decimals on both sides (sums in a different order differ in
the last bits), counts are ``bigint`` on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.session import ship_package

DECIMALS = 6


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(doubles))
        return fn

    return deco


def round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), DECIMALS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)  # executors import this package for the Python-side operators
        return round_doubles(entry.build(spark, sf_dir))

    run.__name__ = name
    return run


def oracle(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    if not e.doubles:
        return e.sql
    repl = ", ".join(f"round(CAST({c} AS DOUBLE), {DECIMALS}) AS {c}" for c in e.doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({e.sql}) AS _r"
