"""Cross-tokenizer alignment of two tokenizers over a corpus, by exact-text deduplication.

Texts are shuffled whole, so that equal ones meet (after partial counts in every task), and each
distinct text is tokenised by both tokenizers and aligned once. Both token sequences spell the same
bytes: offsets where tokens of both end cut them into groups, and every stretch between two
neighbouring ends of either kind is the overlap of one A and one B token, a link. Counts of linked id pairs
are sums over distinct texts, weighted by the number of documents that hold the text. A second pass over the
stored links looks the counts up, the most frequent pairs in a broadcast table (``HEAD`` pairs at most), the
others by a join; the measures then go to the documents by the text's SHA-256.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.bpe import ragged
from quillscope.llm.common import CHUNK_BYTES, buffers, chunks, prepare, stored, text_array
from quillscope.llm.tokens import model_bytes

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
HEAD = 500_000  # pairs whose counts are broadcast: 17 bytes each
HOT = 1000  # a text of more than one in HOT documents is joined by broadcast (fewer than HOT texts)
KEPT_WORDS = 1 << 18  # words whose tokens a worker keeps, and
KEPT_CHARS = 1 << 23  # their characters: some 60 MB at most
JOINED = 500  # new words encoded in one call
# printable characters up to U+02AF; a space between two of them begins a match of the byte-level pattern, whatever stands around
SHOWN = "[!-~\u00a1-\u00ac\u00ae-\u02af]"
BETWEEN = re.compile(f"(?<={SHOWN}) (?={SHOWN})")
WHOLE = re.compile(f"{SHOWN}(?:.*{SHOWN})?", re.S)
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others, in order, for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """The bytes of a vocabulary's entries, end to end."""

    def __init__(self, entries: dict[int, bytes]):
        n = max(entries) + 1
        parts = [entries.get(i, b"") for i in range(n)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.size[ids])]


class WordTokens(dict):
    """The tokens of texts by A, each word (up to a space between two of ``SHOWN``) encoded once.

    A's pattern never matches across such a space, so the words of a text have the tokens of the whole. What
    is kept is dropped when it is full.
    """

    def __init__(self, encode, size: np.ndarray):
        self.encode = encode  # texts -> their lists of ids
        self.bytes = size  # of each id
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars = 0
        self.ids, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, a space before each, and their numbers."""
        if len(self) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self._empty()
        words = [BETWEEN.split(t) for t in texts]
        per = [len(w) for w in words]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(per))
        if self.new:
            self._add()
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per)] if per else np.zeros(0, np.int64)
        return self.ids[ragged(self.start[at], size)], np.diff(ends, prepend=0)

    def _add(self) -> None:
        """Encodes the new words: many joined by spaces where those part them again, others each on its own."""
        joint = [WHOLE.fullmatch(w) is not None for w in self.new]
        several = [w for w, x in zip(self.new, joint) if x]
        alone = [w for w, x in zip(self.new, joint) if not x]
        groups = [several[i : i + JOINED] for i in range(0, len(several), JOINED)]
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for words, ids in zip(groups, self.encode(["".join([" " + w for w in g]) for g in groups])):
            ids = np.array(ids, np.int64)
            stops, ends = np.cumsum(self.bytes[ids]), np.cumsum([len(w.encode()) + 1 for w in words])
            last = np.searchsorted(stops, ends)
            if len(ids) and stops[-1] == ends[-1] and (stops[last] == ends).all():
                made.append((ids, np.diff(last + 1, prepend=0)))
            else:  # tokens that do not spell the words
                made.append(flat(self.encode([" " + w for w in words])))
        made.append(flat(self.encode([" " + w for w in alone])))
        ids, size = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        order = np.argsort(~np.array(joint), kind="stable")  # where each word of several, then of alone, stands
        start = np.empty(len(size), np.int64)
        start[order] = len(self.ids) + np.cumsum(size) - size
        of = np.empty(len(size), np.int64)
        of[order] = size
        self.ids, self.start, self.size = (np.concatenate(x) for x in ((self.ids, ids), (self.start, start), (self.size, of)))
        self.chars += sum(map(len, self.new))
        self.new = []


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists end to end, and their lengths."""
    sizes = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def by_words(model: bytes) -> bool:
    """Whether a tokenizer (JSON) parts texts by the byte-level pattern alone before it merges."""
    m = json.loads(model)
    cut = m.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    special = all(t["special"] for t in m.get("added_tokens") or [])  # they are plain text here
    return plain and special and not m.get("normalizer") and not m.get("truncation") and not m.get("padding")


class Aligner:
    """Both tokenizers in a worker."""

    def __init__(self, a: bytes, b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        # an added token is spelled by its own text, others by the byte alphabet
        self.of_a = Tokens({i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab(True).items()})
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.of_b = Tokens({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        self.words = WordTokens(self._encode, self.of_a.size) if by_words(a) else None
        self.width = len(self.of_b.size)  # a pair's key is a * width + b
        top = max(len(self.of_a.size), self.width)
        self.text = np.array([[f"{i}{s}" for i in range(top)] for s in ",|;"], object)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of tokens by A (of space and text) and by B."""
        a = self.words.tokens(texts) if self.words is not None else flat(self._encode([" " + t for t in texts]))
        return *a, *flat(self.b.encode(texts, num_threads=1))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def align(self, texts: pa.Array, groups: bool = True) -> dict[str, pa.Array]:
        """Measures, groups and linked pairs of each text (all without nulls)."""
        n = len(texts)
        a, na, b, nb = self.tokens(texts.to_pylist())
        raw, offsets = buffers(texts)
        size = np.diff(offsets) + 1
        sums = [np.bincount(np.repeat(np.arange(n), k), weights=t.size[x], minlength=n).astype(np.int64) for t, x, k in ((self.of_a, a, na), (self.of_b, b, nb))]
        good = (sums[0] == size) & (sums[1] == size) & (size > 1)
        # rows of the right length, byte for byte
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        row_of = np.flatnonzero(good)
        want = np.full(int(size[good].sum()), 0x20, np.uint8)
        ends = np.cumsum(size[good])
        want[ragged(ends - size[good] + 1, size[good] - 1)] = raw[ragged(offsets[:-1][good], size[good] - 1)]
        wrong = (self.of_a.spell(a) != want) | (self.of_b.spell(b) != want)
        if wrong.any():
            bad = np.unique(row_of[np.searchsorted(ends, np.flatnonzero(wrong), "right")])
            still = good.copy()
            still[bad] = False
            a, b = a[np.repeat(still, na)], b[np.repeat(still, nb)]
            na, nb = na * still, nb * still
            row_of = np.flatnonzero(still)
            ends = np.cumsum(size[still])
        mark = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.uint8)
        mark[np.cumsum(self.of_a.size[a])] |= 1
        mark[np.cumsum(self.of_b.size[b])] |= 2
        cuts = np.flatnonzero(mark)  # ends of stretches: each lies in one token of A and one of B
        in_a, in_b = mark[cuts] & 1 > 0, mark[cuts] & 2 > 0
        both = in_a & in_b
        row = row_of[np.searchsorted(ends, cuts)] if len(cuts) else np.zeros(0, np.int64)
        pair = a[np.cumsum(in_a) - in_a] * self.width + b[np.cumsum(in_b) - in_b] if len(cuts) else np.zeros(0, np.int64)
        area = len(self.of_a.size) * self.width
        keys, links = np.unique(row * area + pair, return_counts=True)
        per_row = np.searchsorted(keys, np.arange(n + 1) * area).astype(np.int32)
        out = {
            "n_a": pa.array(na.astype(np.int64)),
            "n_b": pa.array(nb.astype(np.int64)),
            "n_groups": pa.array(np.bincount(row[both], minlength=n)),
            "n_links": pa.array(np.bincount(row, minlength=n)),
            "pairs": pa.ListArray.from_arrays(pa.array(per_row), pa.array(keys % area)),
            "links": pa.ListArray.from_arrays(pa.array(per_row), pa.array(links.astype(np.int64))),
        }
        if groups:
            out["groups"] = pa.array(self._groups(a, b, na, nb, in_a, in_b, both), pa.string())
        return out

    def _groups(self, a, b, na, nb, in_a, in_b, both) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of every group's A and B tokens in order."""
        before = np.cumsum(both) - both  # groups that ended earlier
        ga, gb = before[in_a], before[in_b]
        total = int(both.sum())
        of_a, of_b = np.bincount(ga, minlength=total), np.bincount(gb, minlength=total)
        at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[ga] if total else np.zeros(0, np.int64)
        at_b = np.arange(len(b)) + np.cumsum(of_a)[gb] if total else np.zeros(0, np.int64)
        parts = np.empty(len(a) + len(b), object)
        parts[at_a] = self.text[np.where(both[in_a], 1, 0), a]
        parts[at_b] = self.text[np.where(both[in_b], 2, 0), b]
        stops = np.cumsum(na + nb).tolist()
        return ["".join(parts[i:j].tolist())[:-1] for i, j in zip([0, *stops[:-1]], stops)]


def align_texts(distinct: DataFrame, text_col: str, keep: list[str], a: bytes, b: bytes, groups: bool = True) -> DataFrame:
    """Columns ``keep`` of a table of texts without nulls, with each text's alignment: ``n_a, n_b, n_groups, n_links``,
    ``pairs`` (distinct linked id pairs, a * size of B + b, ascending) with ``links`` (how many), and ``groups``."""
    models = distinct.sparkSession.sparkContext.broadcast((a, b))
    new = [T.StructField(c, T.LongType()) for c in MEASURES]
    new += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "links")]
    if groups:
        new.append(T.StructField("groups", T.StringType()))
    schema = T.StructType([distinct.schema[c] for c in keep] + new)

    def run(batches):
        aligner = Aligner(*models.value)
        for batch in batches:
            texts = text_array(batch.column(len(keep)))
            for i, j in chunks(texts, CHUNK_BYTES // 2):
                made = aligner.align(texts.slice(i, j - i), groups)
                own = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(own + [made[f.name] for f in new], names=schema.names)

    return distinct.select(*keep, text_col).mapInArrow(run, schema)


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, ``most`` at most: whole bands of counts (an eighth of a doubling each) from the top."""
    band = F.floor(F.log2("count") * 8)
    sizes = counts.groupBy(band.alias("band")).count().collect()  # at most 8 * 63 rows
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["band"]):
        total += r["count"]
        if total > most:
            break
        least = r["band"]
    return counts.where(band >= least) if least is not None else counts.limit(0)


def looked_up(aligned: DataFrame, counts: DataFrame, keep: list[str], most: int) -> DataFrame:
    """``keep`` with ``n_best, count_sum``: sums over a text's links, by the broadcast head of ``counts`` and a join for the rest.

    ``key`` identifies a row of ``aligned``. The result does not depend on ``most``.
    """
    top = head_of(counts, most).select("pair", "count", "best").toArrow().sort_by("pair")
    head = aligned.sparkSession.sparkContext.broadcast(
        (top["pair"].to_numpy().astype(np.int64), top["count"].to_numpy().astype(np.int64), top["best"].to_numpy(zero_copy_only=False).astype(bool))
    )
    new = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    new += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("rare", "rare_links")]
    schema = T.StructType([aligned.schema[c] for c in keep] + new)

    def run(batches):
        pairs, count, best = head.value
        for batch in batches:
            n = batch.num_rows
            offsets = batch.column(len(keep)).offsets.to_numpy().astype(np.int64)
            mine = batch.column(len(keep)).values.to_numpy()[offsets[0] : offsets[-1]]
            begin = batch.column(len(keep) + 1).offsets[0].as_py()
            links = batch.column(len(keep) + 1).values.to_numpy()[begin : begin + len(mine)]
            row = np.repeat(np.arange(n), np.diff(offsets))
            at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
            hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            sums = []
            for value in (best, count) if len(pairs) else ():
                worth = np.where(hit, links * value[at], 0)
                total = np.concatenate([[0], np.cumsum(worth)])
                sums.append(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]])
            if not sums:
                sums = [np.zeros(n, np.int64)] * 2
            stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=n))]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(stops, pa.array(x[~hit])) for x in (mine, links)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(keep))] + [pa.array(x) for x in sums] + rare, names=schema.names)

    base = stored(aligned.select(*keep, "pairs", "links").mapInArrow(run, schema), "align-head")
    rest = base.select("key", F.expr("inline(arrays_zip(rare, rare_links))")).withColumnRenamed("rare", "pair")
    rest = rest.join(counts, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("rare_links")).otherwise(0)).alias("_best"), F.sum(F.col("rare_links") * F.col("count")).alias("_sum")
    )
    return base.join(rest, "key", "left").select(
        *keep,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair, count, best``: links that hold an id pair over all documents, and whether no pair of its B id has more."""
    one = aligned.select("copies", F.expr("inline(arrays_zip(pairs, links))"))
    counts = one.groupBy(F.col("pairs").alias("pair")).agg(F.sum(F.col("links") * F.col("copies")).alias("count"))
    counts = stored(counts, "align-counts")
    b = (F.col("pair") % width).alias("b")
    top = counts.groupBy(b).agg(F.max("count").alias("top"))  # a row for each B id at most
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    model_a: str | bytes = MODEL_A,
    model_b: str | bytes = MODEL_B,
    groups: bool = False,
    head: int = HEAD,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment measures, and the corpus' linked id pairs.

    The first has ``docs``' columns ``keep`` (default all; those with a new column's name in any case go) with
    ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and with ``groups`` also the groups' text;
    the second ``a, b, count, best``. Model B puts a space in front of a text, so A reads space and text.
    Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros and ``''``. Repeated
    rows and copies have equal measures and count as often as they occur; an empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    a, b = model_bytes(model_a), model_bytes(model_b)
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_proto=b).get_piece_size()
    made = [*MEASURES, "n_best", "count_sum", "groups_sha256"] + (["groups"] if groups else [])
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    text = F.col(f"`{text_col}`")
    # a struct holds the kept columns, so that no name of theirs can clash
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("_")])).alias("_in"), F.when(text != "", F.unhex(F.sha2(text, 256))).alias("key"))
    rows = stored(rows, "align-rows")
    distinct = docs.where(text != "").groupBy(text.alias("_text")).agg(F.count("*").alias("copies"))
    distinct = distinct.select(F.unhex(F.sha2("_text", 256)).alias("key"), "copies", "_text")
    aligned = align_texts(distinct, "_text", ["key", "copies"], a, b)
    aligned = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    aligned = stored(aligned if groups else aligned.drop("groups"), "align-texts")
    counts = stored(pair_counts(aligned, width), "align-pairs")
    own = ["key", "copies", *MEASURES, "groups_sha256"] + (["groups"] if groups else [])
    measures = stored(looked_up(aligned, counts, own, head), "align-measures")

    total = measures.agg(F.sum("copies")).scalar()
    few = F.col("copies") * HOT > total  # fewer than HOT texts, since copies sum up to total
    hot = F.broadcast(measures.where(few))
    cold = measures.where(~few)
    zero = [(F.lit("") if c.startswith("groups") else F.lit(0).cast("bigint")).alias(c) for c in made]
    out = rows.where("key is not null").join(hot, "key").select("_in", *made)
    out = out.unionByName(rows.where("key is not null").join(F.broadcast(measures.where(few).select("key")), "key", "left_anti").join(cold, "key").select("_in", *made))
    out = out.unionByName(rows.where("key is null").select("_in", *zero))
    pairs = counts.select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "count", "best")
    return out.select(*[F.col("_in").getField(c).alias(c) for c in kept], *made), pairs


def brute_force(docs: list[tuple[object, str | None]]) -> dict:
    """Reference answer for small inputs: id -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups' hash)."""
    from collections import Counter

    al = Aligner(model_bytes(MODEL_A), model_bytes(MODEL_B))
    links: dict[object, Counter] = {}
    out: dict[object, list] = {}
    for doc, text in docs:
        links[doc], out[doc] = Counter(), [0, 0, 0, 0, 0, 0, ""]
        if not text:
            continue
        ids = [al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)]
        spelled = [[bytes(t.data[t.start[i] : t.start[i] + t.size[i]]) for i in x] for t, x in zip((al.of_a, al.of_b), ids)]
        if any(b"".join(s) != b" " + text.encode() for s in spelled):
            continue
        spans = []
        for s in spelled:
            at, one = 0, []
            for token in s:
                one.append((at, at + len(token)))
                at += len(token)
            spans.append(one)
        stops = [v for _, v in spans[1]]
        for i, (s, e) in zip(ids[0], spans[0]):
            at = bisect.bisect_right(stops, s)
            while at < len(stops) and spans[1][at][0] < e:
                links[doc][i, ids[1][at]] += 1
                at += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        ends = [[v for _, v in x] for x in spans]
        parts = []
        for s, e in zip([0, *common], common):
            parts.append("|".join(",".join(map(str, x[bisect.bisect_right(v, s) : bisect.bisect_right(v, e)])) for x, v in zip(ids, ends)))
        out[doc] = [len(ids[0]), len(ids[1]), len(common), sum(links[doc].values()), 0, 0, hashlib.sha256(";".join(parts).encode()).hexdigest()]
    count: Counter = sum(links.values(), Counter())
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    for doc, own in links.items():
        out[doc][4] = sum(n for p, n in own.items() if count[p] == best[p[1]])
        out[doc][5] = sum(n * count[p] for p, n in own.items())
    return {doc: tuple(x) for doc, x in out.items()}
