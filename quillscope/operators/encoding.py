"""Text -> id sequences (X22-X24): vocabulary, encode, truncate, pad.

The vocabulary is a Spark job: token frequencies with map-side partial counts, then positions by
frequency, for every token of the corpus. Texts are tokenized once and the tokens written. The most frequent
tokens, ``HEAD_BYTES`` of them, are broadcast as Arrow arrays; ``mapInArrow`` looks the tokens of a batch up there (one vectorized hash lookup) and assembles
``[CLS] ids [SEP]`` with array arithmetic. Only tokens beyond the head, the rare ones, leave
their row: they are exploded with their place, joined with the rest of the vocabulary and put
back per row. The result does not depend on that bound; with a vocabulary of no more bytes
the second step has nothing to do and is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.functions import text as X
from quillscope.operators import ranking
from quillscope.operators.textmodel import written
from quillscope.session import cut

# --- fixed values: special token ids ---
PAD, UNK, CLS, SEP = 0, 1, 2, 3
# --- end of fixed values ---
HEAD_BYTES = 16 << 20  # of the most frequent tokens and their ids, broadcast
BATCH_ROWS = 1000  # rows of one Arrow batch
SLICE_TOKENS = 1 << 19  # tokens handled at once in a Python worker (a longer single row is one slice)


def slices(tokens: pa.Array, limit: int = SLICE_TOKENS) -> list[tuple[int, int]]:
    """Row ranges ``[a, b)`` of a list column with at most ``limit`` tokens in all, or of one row."""
    ends = tokens.offsets.to_numpy()[1:].astype("int64")
    out, a, before = [], 0, int(tokens.offsets[0].as_py())
    while a < len(tokens):
        b = max(a + 1, int(ends.searchsorted(before + limit, "right")))
        out.append((a, b))
        a, before = b, int(ends[b - 1])
    return out


def vocabulary(corpus_tokens: DataFrame, size: int | None = None) -> DataFrame:
    """Token -> id by descending frequency (ties by token); ids start after the special ids.

    ``size`` keeps the most frequent tokens only (the others become UNK); by default every token has an id.
    """
    counts = corpus_tokens.groupBy("token").agg(F.count("*").alias("c"))
    ids = ranking.row_number_all(counts, [F.col("c").desc(), F.col("token")], "_pos")
    ids = ids.select("token", (F.col("_pos") + SEP).cast("bigint").alias("id"))
    return ids if size is None else ids.where(F.col("id") <= size + SEP)


def _lookup(vocab_bc, key: str, missing: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, ids_arr = vocab_bc.value
        value_set = None
        for b in (whole.slice(i, j - i) for whole in batches for i, j in slices(whole.column("_t"))):
            toks = b.column("_t")
            if value_set is None:
                value_set = words.cast(toks.type.value_type)
            n = len(toks)
            lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(toks)
            found = pc.take(ids_arr, pc.index_in(flat, value_set=value_set))
            tok_ids = pc.fill_null(found, missing).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(lens + 2, out=offsets[1:])
            vals = np.empty(int(offsets[-1]), dtype=np.int64)
            vals[offsets[:-1]] = CLS
            vals[offsets[1:] - 1] = SEP
            # token j of row r lands after the r earlier [CLS]/[SEP] pairs and this row's [CLS]
            vals[np.arange(len(tok_ids)) + 2 * np.repeat(np.arange(n), lens) + 1] = tok_ids
            seq = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(vals))
            if missing == UNK:
                yield pa.RecordBatch.from_arrays([b.column(key), seq], names=[key, "ids"])
                continue
            # places (1-based, in ids) and tokens that the head doesn't have
            row = np.repeat(np.arange(n), lens)
            at = np.flatnonzero(tok_ids == missing)
            place = at + 2 * row[at] + 2 - offsets[row[at]]
            stops = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=n))]).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), flat.take(pa.array(at)).cast(pa.string())], names=["place", "token"])
            yield pa.RecordBatch.from_arrays([b.column(key), seq, pa.ListArray.from_arrays(stops, rare)], names=[key, "ids", "rare"])

    return run


def head_size(vocab: DataFrame, most: int) -> int:
    """The last id of the most frequent tokens that have ``most`` bytes together at most: whole bands of ids, an eighth of a doubling each."""
    band = F.floor(F.log2(F.col("id") - SEP) * 8)
    sizes = vocab.groupBy(band.alias("band")).agg(F.sum(F.octet_length("token") + 16).alias("bytes"), F.max("id").alias("last"))
    total, last = 0, SEP
    for r in sorted(sizes.collect(), key=lambda r: r["band"]):  # 8 * 63 rows at most
        total += r["bytes"]
        if total > most:
            break
        last = r["last"]
    return last


def encode(
    df: DataFrame, key: str, text: str = "text", max_len: int | None = None, size: int | None = None, head_bytes: int = HEAD_BYTES
) -> DataFrame:
    """``ids`` = [CLS] + token ids + [SEP], truncated to ``max_len`` in total. ``key`` is a row's unique key.

    The vocabulary is fitted on the whole, untruncated input; with ``size`` it is cut and the rest is UNK.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # bounds the memory of a Python worker
    tokens = written(df.select(key, X.tokens(text).alias("_t")), "encode-tokens")
    vocab = cut(vocabulary(tokens.select(F.explode("_t").alias("token")), size))
    kinds, last = vocab.count(), head_size(vocab, head_bytes)
    top = vocab.where(F.col("id") <= last).select("token", "id").toArrow().combine_chunks()
    bc = spark.sparkContext.broadcast(tuple(pa.concat_arrays(top[c].chunks) if top[c].chunks else pa.array([], top.schema.field(c).type) for c in ("token", "id")))
    tok = tokens
    if max_len is not None:
        tok = tok.withColumn("_t", F.slice("_t", 1, max(max_len - 2, 0)))
    fields = [df.schema[key], T.StructField("ids", T.ArrayType(T.LongType()))]
    if kinds <= last - SEP:
        return tok.mapInArrow(_lookup(bc, key, UNK), T.StructType(fields))
    pair = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("token", T.StringType())])
    known = cut(tok.mapInArrow(_lookup(bc, key, -1), T.StructType([*fields, T.StructField("rare", T.ArrayType(pair))])))
    # rare tokens by definition have no hot key; one row's places are bounded by its length
    rest = vocab.where(F.col("id") > last)
    found = known.select(key, F.explode("rare").alias("r")).select(key, "r.place", "r.token").join(rest, "token", "left")
    found = found.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.coalesce("id", F.lit(UNK).cast("bigint")).alias("id")))).alias("_m")
    )
    filled = F.transform("ids", lambda x, i: F.when(x == -1, F.element_at("_m", i + 1)).otherwise(x))
    out = known.join(found, key, "left")
    return out.select(key, F.when(F.size("rare") > 0, filled).otherwise(F.col("ids")).alias("ids"))


def pad(enc: DataFrame, key: str) -> DataFrame:
    """Pad to the longest row of the table and add the attention mask (max is a 1-row aggregate).

    ``enc`` should be written data: it is read for the longest row and again to pad.
    """
    m = enc.agg(F.max(F.size("ids"))).scalar()
    fill = m - F.size("ids")
    return enc.select(
        key,
        F.concat("ids", F.array_repeat(F.lit(PAD).cast("bigint"), fill)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
    )
