"""Benchmark decontamination: an FM-index for each shard of the training texts.

A task cuts its documents into shards (about 2 MB of text) and indexes each one: the words that
occur in some test phrase become symbols, every maximal run of other words becomes one
separator, and runs shorter than the shortest test phrase, which cannot hold one, are left
out. Over this sequence it builds a suffix array, the Burrows-Wheeler transform, a wavelet
matrix for rank queries, and sampled suffix positions. All test phrases are searched backward
at once; their occurrences are located by walking to sampled positions, checked byte by byte,
and merged to spans of the document.

The documents pass by once for each block of the test set (``block_phrases`` test phrases,
the bound of what is broadcast), with no shuffle; spans and items of earlier blocks ride along.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import Words, chunks, packed, prepare, text_array, unpacked

WINDOW = 13  # words of a test phrase
SHARE = 20  # a document is contaminated if hit words are one in SHARE or more
BLOCK_PHRASES = 200_000  # of test items in one broadcast: some 25 MB, and some 180 MB on the driver while it is made
SAMPLE = 8  # every SAMPLE-th suffix position is kept

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", SPANS),  # merged spans in words, end exclusive
    T.StructField("hit_chars", SPANS),  # the same spans in code points
    T.StructField("hit_items", T.ArrayType(T.StringType())),  # sorted
]
OUT = tuple(f.name for f in FIELDS)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Phrases:
    """The distinct test phrases of a block of items and the symbols of their words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            words = WORD.findall(text.translate(UPPER))
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                owners.setdefault(tuple(words[i : i + n]), set()).add(item)
        vocab = sorted({w for p in owners for w in p})
        hashes = Words(pa.array(vocab, pa.string()), np.ones(256, bool), lower=False).hash.tolist() if vocab else []
        by_hash = sorted(zip(hashes, vocab))
        symbol = {w: k + 2 for k, (_, w) in enumerate(by_hash)}  # 0: end of the shard, 1: separator
        self.hashes = np.array([h for h, _ in by_hash], np.uint64)
        self.bytes = [w.encode() for _, w in by_hash]
        self.owners = [sorted(v) for v in owners.values()]
        self.sizes = np.array([len(p) for p in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)
        for k, p in enumerate(owners):
            self.symbols[k, : len(p)] = [symbol[w] for w in p]


class FMIndex:
    """Backward search and locate over one sequence of symbols (the last one is the only 0)."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        n = len(seq)
        self.n = n
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:  # prefix doubling: order by 2 * step symbols from the order by step
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                break
        self.suffix = order
        self.bwt = seq[order - 1]
        sigma = int(seq.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bits = max(1, (sigma - 1).bit_length())
        self.ones, self.zeros, level = [], [], self.bwt
        for b in range(self.bits - 1, -1, -1):  # wavelet matrix: one level for each bit
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.sampled = self.suffix % sample == 0

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the transform."""
        lo, hi = np.zeros_like(at), at
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def search(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that occur, and the range of suffixes that begin with each."""
        alive = np.flatnonzero((symbols < len(self.before) - 1).all(axis=1))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for step in range(symbols.shape[1]):
            at = sizes[alive] - 1 - step
            go = at >= 0
            if not go.any():
                break
            c = symbols[alive[go], at[go]]
            lo[go] = self.before[c] + self.rank(c, lo[go])
            hi[go] = self.before[c] + self.rank(c, hi[go])
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.suffix[rows[todo[done]]] + steps[todo[done]]
            todo = todo[~done]
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
        return out


def _occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase of every occurrence in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.hashes) or not len(words.hash):
        return none
    at = np.minimum(np.searchsorted(phrases.hashes, words.hash), len(phrases.hashes) - 1)
    known = phrases.hashes[at] == words.hash
    idx = np.flatnonzero(known)
    if not len(idx):
        return none
    # maximal runs of known words of one row
    new = np.concatenate([[True], (np.diff(idx) > 1) | (np.diff(words.row[idx]) > 0)])
    run = np.cumsum(new) - 1
    long_enough = np.bincount(run)[run] >= phrases.sizes.min()
    idx, run = idx[long_enough], run[long_enough]
    if not len(idx):
        return none
    gap = np.concatenate([[0], np.cumsum(np.diff(run) > 0)])  # separators before each word
    seq = np.ones(len(idx) + gap[-1] + 2, np.int64)
    where = np.full(len(seq), -1, np.int64)
    seq[np.arange(len(idx)) + gap] = at[idx] + 2
    where[np.arange(len(idx)) + gap] = idx
    seq[-1] = 0
    index = FMIndex(seq)
    found, lo, hi = index.search(phrases.symbols, phrases.sizes)
    size = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    first, phrase = where[index.locate(rows)], np.repeat(found, size)
    # exact check: the words under the occurrences are the phrases' words, byte by byte
    used = np.unique(np.concatenate([first + j for j in range(phrases.symbols.shape[1])]))
    used = used[(used < len(words.hash))]
    used = used[known[used]]
    wrong = [
        i for i in used.tolist() if words.data[words.start[i] : words.end[i]].tobytes() != phrases.bytes[at[i]]
    ]
    if wrong:
        bad = np.concatenate([[0], np.cumsum(np.isin(np.arange(len(words.hash)), wrong))])
        good = bad[first + phrases.sizes[phrase]] == bad[first]
        first, phrase = first[good], phrase[good]
    return first, phrase


def _spans(rows: int, marked: np.ndarray, words: Words, by_char: bool) -> pa.Array:
    """Maximal marked runs of words for each row."""
    out: list[list[dict]] = [[] for _ in range(rows)]
    idx = np.flatnonzero(marked)
    if len(idx):
        new = np.concatenate([[True], (np.diff(idx) > 1) | (np.diff(words.row[idx]) > 0)])
        a, b = idx[new], idx[np.concatenate([new[1:], [True]])]
        row = words.row[a]
        if by_char:
            cp = words.code_points()
            base = cp[words.offsets[row]]
            s, e = cp[words.start[a]] - base, cp[words.end[b]] - base
        else:
            s, e = a - words.first[row], b + 1 - words.first[row]
        for r, x, y in zip(row.tolist(), s.tolist(), e.tolist()):
            out[r].append({"start": x, "end": y})
    return pa.array(out, _SPAN)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_phrases: int = BLOCK_PHRASES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, merged ``hit_words`` / ``hit_chars`` spans, ``hit_items`` and
    ``contaminated`` (columns of these names are replaced).

    A test phrase is ``window`` consecutive words of an item (all its words if it has fewer).
    Null and empty texts have no words: no hits, not contaminated; items without words or with a
    null text match nothing, an item of null id is reported as the empty string. Repeated items
    or rows are each handled alike; an empty benchmark hits nothing.
    """
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(item_text_col, F.lit("")).alias("text")
    ).where("text != ''")
    # an item has at most one phrase for each word
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_phrases))
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {*OUT, "contaminated"}]
    out = docs
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == k) if blocks > 1 else items
        phrases = sc.broadcast(Phrases([tuple(r) for r in part.collect()], window))  # one block: bounded
        kept = own if k == blocks - 1 or text_col in own else [*own, text_col]
        out = _pass(out, text_col, kept, phrases, earlier=k > 0)
    hit = F.aggregate("hit_words", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return out.withColumn("contaminated", (hit > 0) & (hit * share >= F.col("n_words")))


def _pass(df: DataFrame, text_col: str, kept: list[str], phrases, earlier: bool) -> DataFrame:
    """One block of phrases against all texts; with ``earlier``, merged with the hits so far."""
    fed = [*kept, *([] if text_col in kept else [text_col]), *(["hit_words", "hit_items"] if earlier else [])]
    schema = T.StructType([df.schema[c] for c in kept] + FIELDS)

    def work(texts: pa.Array, p: Phrases, spans: list, names: list) -> list[pa.Array]:
        words = Words(texts)
        first, phrase = _occurrences(words, p)
        step = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + p.sizes[phrase], -1)
        marked = np.cumsum(step)[:-1] > 0
        items: list[set[str]] = [set(x) for x in names]
        if len(first):
            for r, k in np.unique(np.stack([words.row[first], phrase], axis=1), axis=0).tolist():
                items[r].update(p.owners[k])
        for r, old in enumerate(spans):
            for s in old:
                marked[words.first[r] + s["start"] : words.first[r] + s["end"]] = True
        return [
            pa.array(words.count, pa.int64()),
            _spans(words.rows, marked, words, False),
            _spans(words.rows, marked, words, True),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]

    def run(batches):
        p: Phrases = phrases.value
        for batch in batches:
            texts = text_array(batch.column(fed.index(text_col)))
            n = len(texts)
            spans = batch.column(fed.index("hit_words")).to_pylist() if earlier else []
            names = batch.column(fed.index("hit_items")).to_pylist() if earlier else [()] * n
            for a, b in chunks(texts):
                made = work(texts.slice(a, b - a), p, spans[a:b], names[a:b])
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + made, names=schema.names)

    return df.select(*[f"`{c}`" for c in fed]).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, in its columns; others stay as they are."""
    found = decontaminate(packed(docs, text_col), benchmark, text_col="_text", **how)
    return unpacked(found.where(~F.col("contaminated")), docs.columns, text_col)


def digest(df: DataFrame) -> DataFrame:
    """The contract's digest columns of ``decontaminate``'s result."""
    hit = F.aggregate("hit_words", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return df.select(
        "doc_id",
        "n_words",
        hit.cast("bigint").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        "contaminated",
    )


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict:
    """Reference answer for small inputs: doc -> (n_words, n_hit, items, contaminated)."""
    phrases: dict[tuple[str, ...], set[str]] = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = {}
    sizes = sorted({len(p) for p in phrases})
    for doc, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := phrases.get(tuple(w[i : i + n]))) is not None:
                    names |= own
                    hit.update(range(i, i + n))
        digest_ = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(names), digest_, bool(hit) and 20 * len(hit) >= len(w))
    return out


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH iw AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark),
ph AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0),
pg AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ph),
ns AS (SELECT DISTINCT n FROM pg),
dw AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, p, n, item FROM dg JOIN pg USING (n, g)),
hw AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM m),
hc AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hc USING (doc_id) LEFT JOIN it USING (doc_id)
"""
