"""A bit table of ids (a Bloom filter with one hash), so that rows without a partner go before costly work.

The table has at most ``BITS / 64`` rows of 64 bits, whatever the number of ids, so it can always be
broadcast. A row may pass without being among the ids (more of them, the more ids there are); an exact
join on the id follows where it matters. Both steps are built-in functions: nothing is collected.

``bit_rows`` makes a table of as many bits as its caller names, in rows of 4 KB. Numbers without gaps are their own
places, so that such a table is exact; ``hashed`` gives other ids a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # 2**20 rows of 16 bytes at most; 2 million ids let 3 % of other rows pass
WORDS = 1 << 9  # words of 64 bits in a row of the tables that grow with the ids
MOST_BITS = 1 << 29


def _place(key: str):
    """Word and bit of an id."""
    h = F.xxhash64(key).bitwiseAND(F.lit(BITS - 1))
    return F.shiftrightunsigned(h, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))


def bit_table(ids: DataFrame, key: str) -> DataFrame:
    """``(_word, _bits)`` of the ids; equal ids and hashes meet in the tasks first."""
    word, bit = _place(key)
    return ids.where(F.col(key).isNotNull()).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids``' keys, and few others; null keys go. Columns as they are.

    The rows stay where they are read: no exchange of ``df``.
    """
    if df.schema[key].dataType != ids.schema[key].dataType:
        raise ValueError(f"{key!r} has different types: equal ids would have different hashes")
    word, bit = _place(key)
    rows = df.where(F.col(key).isNotNull()).withColumn("_word", word)
    out = rows.join(F.broadcast(bit_table(ids, key)), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return out.select(*[f"`{c}`" for c in df.columns])


def bit_rows(places: DataFrame, place: str, n: int) -> DataFrame:
    """``(_row, _words)``: ``n`` bits as arrays of ``WORDS`` words of 64, set at the numbers ``place`` (from 0 on, below ``n``)."""
    p = F.col(place)
    word = F.shiftrightunsigned(p, 6).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int")).alias("_bits")
    none = places.sparkSession.range(-(-n // (64 * WORDS)) * WORDS).select(F.col("id").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = places.where(p.isNotNull()).select(word, bit).unionByName(none).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    rows = words.groupBy(F.shiftrightunsigned("_word", 9).alias("_row")).agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))
    return rows.select("_row", F.col("_words._bits").alias("_words"))


def with_bit(df: DataFrame, table: DataFrame, place: Column, out: str) -> DataFrame:
    """``df`` with ``out``: whether the bit ``place`` of ``bit_rows`` is set. The rows stay where they are read."""
    rows = df.withColumn("_place", place).withColumn("_row", F.shiftrightunsigned("_place", 15))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_place").bitwiseAND(F.lit(63)).cast("int"))
    word = F.element_at("_words", (F.pmod(F.shiftrightunsigned("_place", 6), F.lit(WORDS)) + 1).cast("int"))
    made = rows.join(F.broadcast(table), "_row").withColumn(out, word.bitwiseAND(bit) != 0)
    return made.select(*[f"`{c}`" for c in df.columns], out)


def table_bits(ids: int) -> int:
    """Bits of a table for so many ids: 32 to 64 each, 64 MB in all at most."""
    return min(MOST_BITS, max(64 * WORDS, 1 << (32 * ids).bit_length()))


def hashed(key: str, bits: int) -> Column:
    """The place of an id in a table of ``bits`` (a power of two)."""
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1).cast("bigint"))
