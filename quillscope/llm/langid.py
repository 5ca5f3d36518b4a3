"""Language identification by prediction by partial matching (PPM) over bytes.

Training counts, for every language, how often each byte follows each context of up to
``ORDER`` bytes, over all training texts (map-side counts, one aggregate). The counts are then
frozen into one context tree. A byte's code length in a language is minus log2 of its
frequency in the longest context that the language has; if it never followed there, an
escape (method C: distinct followers / (followers + distinct)) is paid and the next shorter context
is asked, down to a uniform byte. The language of the least code length wins; the score is its
posterior probability under equal priors.

Frozen statistics make the code length a function of (context, byte): it is computed by Spark for every
(language, context, byte) that training counted and laid out as sorted arrays by order. A chunk of
texts looks its distinct grams up there, language by language, and adds the lengths of its places. Languages
go in blocks of bounded bytes; texts pass once for each block. No count is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import LOWER, buffers, chunks, map_text, prepare, stored, text_array
from quillscope.llm.components import small

ORDER = 3  # bytes of the longest context
MAX_LANGUAGES = 1000
BLOCK_BYTES = 64 << 20  # arrays of a block of languages that are broadcast together (a language is not divided)
PAD = 0x20  # what stands before a text


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The byte at each place, those 1 to ``ORDER`` places before it, and row offsets."""
    data, offsets = buffers(texts)
    out = [LOWER[data]]
    starts = offsets[:-1][np.diff(offsets) > 0]
    for _ in range(ORDER):
        before = np.empty_like(out[-1])
        before[1:] = out[-1][:-1]
        before[starts] = PAD
        out.append(before)
    return out, offsets


def gram_counts(docs: DataFrame, text_col: str, lang_col: str, langs: list[str]) -> DataFrame:
    """``(lang, gram, n)``: language's number, ``ORDER + 1`` bytes as a number, occurrences."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64))]

    def run(batches):
        number = pa.array(langs, pa.string())
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            texts, lang = text_array(batch.column(0)), pc.index_in(batch.column(1), number)
            for a, b in chunks(texts):
                bytes_, offsets = grams(texts.slice(a, b - a))
                code = np.repeat(lang.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(offsets))
                for x in reversed(bytes_):
                    code = (code << np.uint64(8)) | x
                keys, n = np.unique(code, return_counts=True)
                parts.append((keys, n))
                held += len(keys)
                if held > 2_000_000:
                    parts = merge(parts)
                    held = len(parts[0][0])
        if parts:
            (keys, n), = merge(parts)
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k >> np.uint64(32)).astype(np.int32)), pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[i : i + 100_000])],
                    names=["lang", "gram", "n"],
                )

    found = docs.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).mapInArrow(run, "lang int, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def code_lengths(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order ``(lang, gram, bits)``, the length of a gram's last byte after its first ones, and ``(lang, gram, bits)``
    of the escapes, by context. Both written."""
    out = []
    for order in range(ORDER + 1):
        mask = (1 << (8 * (order + 1))) - 1
        g = counts if order == ORDER else stored(counts.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n")), f"order{order}")
        g = g.withColumn("ctx", F.shiftright("gram", 8))
        ctx = stored(g.groupBy("lang", "ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")), f"contexts{order}")
        both = F.col("all") + F.col("kinds")
        found = g.join(small(ctx), ["lang", "ctx"]).select("lang", "gram", F.log2(both / F.col("n")).cast("float").alias("bits"))
        escapes = ctx.select("lang", F.col("ctx").alias("gram"), F.log2(both / F.col("kinds")).cast("float").alias("bits"))
        out.append((stored(found, f"lengths{order}"), stored(escapes, f"escapes{order}")))
    return out


class Table:
    """Bits by gram for some languages: sorted grams, one stretch for each language."""

    def __init__(self, df: DataFrame, first: int, last: int):
        t = df.where(F.col("lang").between(first, last)).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
        self.gram = t.column("gram").to_numpy().astype(np.uint32)
        self.bits = t.column("bits").to_numpy()
        self.stop = np.searchsorted(t.column("lang").to_numpy(), np.arange(first, last + 2))

    def find(self, lang: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams the block's ``lang``-th language has, and their bits."""
        a, b = self.stop[lang], self.stop[lang + 1]
        if a == b:
            return np.zeros(len(gram), bool), np.zeros(len(gram), np.float32)
        at = a + np.minimum(np.searchsorted(self.gram[a:b], gram), b - a - 1)
        return self.gram[at] == gram, self.bits[at]


class Block:
    """The context trees of the languages ``first`` to ``last``."""

    def __init__(self, levels: list[tuple[DataFrame, DataFrame]], first: int, last: int):
        self.languages = last - first + 1
        self.tables = [(Table(found, first, last), Table(escape, first, last)) for found, escape in levels]

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths of (distinct) grams in each language: the longest context first, escapes on the way down."""
        out = np.zeros((len(gram), self.languages))
        for lang in range(self.languages):
            todo, left = np.arange(len(gram)), gram
            for order in range(ORDER, -1, -1):
                mine = left & np.uint32((1 << (8 * (order + 1))) - 1)
                found, escape = self.tables[order]
                hit, bits = found.find(lang, mine)
                out[todo[hit], lang] += bits[hit]
                todo, left, mine = todo[~hit], left[~hit], mine[~hit]
                known, bits = escape.find(lang, mine >> np.uint32(8))
                out[todo[known], lang] += bits[known]
            out[todo, lang] += 8.0
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text in each language."""
        bytes_, offsets = grams(texts)
        code = np.zeros(len(bytes_[0]), np.uint32)
        for x in reversed(bytes_):
            code = (code << np.uint32(8)) | x
        kinds, at = np.unique(code, return_inverse=True)
        out = np.zeros((len(texts), self.languages))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.bits(kinds)[at], offsets[full], axis=0)
        return out


class Tree:
    """Frozen context trees of all languages; written tables, read a block of languages at a time."""

    def __init__(self, langs: list[str], levels: list[tuple[DataFrame, DataFrame]], block_bytes: int = BLOCK_BYTES):
        self.langs, self.levels = langs, levels
        size = [0] * len(langs)
        for df in (x for level in levels for x in level):
            for r in df.groupBy("lang").count().collect():  # a row for each language
                size[r["lang"]] += 8 * r["count"]
        self.ranges, held = [], 0
        for i, n in enumerate(size):
            if self.ranges and held + n <= block_bytes:
                self.ranges[-1] = (self.ranges[-1][0], i)
                held += n
            else:
                self.ranges.append((i, i))
                held = n

    def block(self, k: int) -> Block:
        return Block(self.levels, *self.ranges[k])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text in each language, in this process."""
        return np.concatenate([self.block(k).lengths(texts) for k in range(len(self.ranges))], axis=1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> Tree | None:
    """The tree of all rows with a language and a text; None if there are none."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & (F.col(f"`{text_col}`") != ""))
    names = rows.select(F.col(f"`{lang_col}`").alias("lang")).distinct().limit(MAX_LANGUAGES + 1).collect()
    langs = sorted(r["lang"] for r in names)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return None
    counts = stored(gram_counts(rows, text_col, lang_col, langs), "grams")
    return Tree(langs, code_lengths(counts), block_bytes)


def predict(docs: DataFrame, tree: Tree | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default all) with ``lang_pred, score`` (replacing such columns).

    A null text, one without letters, or a tree of no language: ``und`` with score 0. Of languages with equal
    lengths the first by name wins. Only the text is looked at. Repeated rows are predicted alike; an
    empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    und = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")]
    if tree is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], *und)
    # a struct holds the kept columns, so that no name of theirs can clash
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_")])).alias("_in"), F.col(f"`{text_col}`").alias("_text"))
    for k in range(len(tree.ranges)):
        rows = map_text(rows, "_text", [T.StructField(f"_bits{k}", T.ArrayType(T.DoubleType()))], _measure(spark.sparkContext.broadcast(tree.block(k))), limit=1 << 20)
    letters = T.StructField("_letters", T.BooleanType())
    look = lambda t: [pc.match_substring_regex(text_array(t), r"\pL")]
    rows = map_text(rows, "_text", [letters], lambda: look, keep=["_in", *[f"_bits{k}" for k in range(len(tree.ranges))]])
    rows = rows.select("_in", "_letters", F.concat(*[f"_bits{k}" for k in range(len(tree.ranges))]).alias("_b"))
    rows = rows.select("_in", "_letters", "_b", F.array_min("_b").alias("_m"))
    total = F.aggregate("_b", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.greatest(F.col("_m") - x, F.lit(-1000.0))))
    name = F.element_at(F.array(*[F.lit(x) for x in tree.langs]), F.array_position("_b", F.col("_m")).cast("int"))
    return rows.select(
        *[F.col("_in").getField(c).alias(c) for c in kept],
        F.when(F.col("_letters"), name).otherwise("und").alias("lang_pred"),
        F.when(F.col("_letters"), 1 / total).otherwise(0.0).alias("score"),
    )


def _measure(model):
    """The pass of a block: bits in each of its languages."""

    def start():
        block = model.value

        def work(texts: pa.Array) -> list[pa.Array]:
            bits = block.lengths(text_array(texts))
            ends = np.arange(len(texts) + 1, dtype=np.int32) * block.languages
            return [pa.ListArray.from_arrays(ends, pa.array(bits.ravel()))]

        return work

    return start


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
