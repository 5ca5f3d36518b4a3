"""Helpers shared by the operators: Arrow text passes, vectorised words, durable tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.session import checkpoint_root, cut, scratch_path, ship_package  # noqa: F401  (cut: re-exported)

CHUNK_BYTES = 1 << 21  # text handled at once by a vectorised step (a longer single text is one chunk)
BATCH_ROWS = 1000  # rows of one Arrow batch: bounds the memory of a Python worker


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and keep Arrow batches small."""
    ship_package(spark)
    checkpoint_root(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are split; no exchange."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again.

    Cuts the lineage like ``checkpoint()``, with columnar compression and column pruning
    for tables that several later steps read in part.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls (null: empty) in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` whose texts have about ``limit`` bytes in all."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < n:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield a, b
        a = b


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a chunk and the offsets of its rows (from 0), without a copy."""
    _, offs, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.default_rng(20240607)
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64)  # one random word for each byte value
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """``BASE**i`` and its inverse for i < n modulo 2**64 (kept for the usual chunk size)."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (BASE, BASE_INV):
            x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 2 * CHUNK_BYTES:
            return [x[:n] for x in made]
        _powers[:] = made
    return [x[:n] for x in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# the byte classes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
# the byte classes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[0x09:0x0E] = NOT_SPACE[0x20] = False


class Words:
    """The words of a chunk of texts: byte positions, row, and a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True):
        data, offsets = buffers(texts)
        self.offsets, self.rows = offsets, len(texts)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            bounds = offsets[1:-1]
            bounds = bounds[(bounds > 0) & (bounds < n)]
            first[bounds] = inside[bounds]  # a text's border parts words too
            last[bounds - 1] = inside[bounds - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        at = np.searchsorted(self.start, offsets)
        self.first = at  # words first[r]..first[r + 1] are row r's
        self.count = np.diff(at)
        self.row = np.repeat(np.arange(self.rows), self.count)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_MIX[self.data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def code_points(self) -> np.ndarray:
        """Code points before each byte of the chunk, one entry more than bytes."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def word_hash(word: bytes) -> int:
    """``Words.hash`` of one (lower-cased) word."""
    w = Words(pa.array([word], pa.binary()).cast(pa.string()), np.ones(256, bool), lower=False)
    return int(w.hash[0])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words; a row of fewer words, but not none, has one."""
    n, h = len(words.hash), words.hash
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pad = np.concatenate([h, np.zeros(size, np.uint64)])
    out = np.zeros(n, np.uint64)
    room = words.first[words.row + 1] - np.arange(n)  # words from here to the end of the row
    for j in range(size):
        out = np.where(j < room, out * BASE + pad[j : j + n], out)
    keep = (room >= size) | ((words.count[words.row] < size) & (np.arange(n) == words.first[words.row]))
    return words.row[keep], mix(out[keep] + np.minimum(words.count[words.row[keep]], size).astype(np.uint64))


def map_text(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    start: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str] | None = None,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` with columns computed from its text, in one narrow Arrow pass.

    ``start()`` runs once in a task and returns the function from a chunk of texts (nulls
    as they are) to the arrays of ``fields``. ``keep``: the input columns that stay (default
    all); one that has the name of a new field is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = kept + [f.name for f in fields]
    needed = kept if text_col in kept else [*kept, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(needed.index(text_col))
            own = [batch.column(needed.index(c)) for c in kept]
            for a, b in chunks(text_array(texts), limit):
                made = work(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([x.slice(a, b - a) for x in own] + made, names=names)

    return df.select(*[f"`{c}`" for c in needed]).mapInArrow(run, schema)


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """``(_in, _text)``: the other columns as a struct, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*(others or [F.lit(0).alias("_")])).alias("_in"), F.col(f"`{text_col}`").alias("_text"))


def unpacked(df: DataFrame, columns: list[str], text_col: str, text: str = "_text") -> DataFrame:
    """The columns that ``packed`` put together, in their order, with ``text`` as the text."""
    return df.select(*[F.col(text).alias(c) if c == text_col else F.col("_in").getField(c).alias(c) for c in columns])
