"""Ranked lexical search over all documents, by bag deduplication.

The items (queries) come in blocks of bounded vocabulary. One Arrow pass restricts every document to a
block's vocabulary: a bag of (term, frequency) pairs, next to the number of all its terms. With the corpus'
totals a document's length becomes the small integer ``m`` of the score, and documents of equal bag and
``m`` have equal scores for every item. They are brought together by a hash of both, compared whole, and
each class is scored once, against the items' postings; a class is expanded again by its least ids,
as many as a ranking has rows. Only a task's best classes of each item leave it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.bpe import ragged
from quillscope.llm.common import Words, map_text, prepare, stored

TOP = 10  # rows of an item's ranking
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLOCK_TERMS = 100_000  # different terms of a block of items, and at most ...
BLOCK_ITEMS = 2000  # ... so many items; a single item may have more terms
CELLS = 4_000_000  # scores held at once by a task: classes times items
LAST = np.iinfo(np.int64).max  # where a null id sorts


class Vocabulary:
    """A block's terms: sorted hashes, and the bytes behind them."""

    def __init__(self, terms: list[str]):
        words = Words(pa.array(terms, pa.string()), np.ones(256, bool), lower=False)
        order = np.argsort(words.hash, kind="stable")
        if len(np.unique(words.hash)) != len(terms):
            raise ValueError("two terms have one hash")
        self.hash, self.term = words.hash[order], order
        self.data, self.start, self.size = words.data, words.start, words.end - words.start

    def find(self, words: Words) -> np.ndarray:
        """The term of each word, -1 for words of other texts."""
        out = np.full(len(words.hash), -1, np.int64)
        if not len(self.hash) or not len(out):
            return out
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == words.hash)
        term = self.term[at[hit]]
        size = words.end[hit] - words.start[hit]
        fit = self.size[term] == size
        hit, term, size = hit[fit], term[fit], size[fit]
        if len(hit):
            same = self.data[ragged(self.start[term], size)] == words.data[ragged(words.start[hit], size)]
            right = np.add.reduceat(~same, np.cumsum(size) - size, dtype=np.int64) == 0
            out[hit[right]] = term[right]
        return out


def blocks(items: DataFrame, text_col: str, item_col: str) -> Iterator[list[tuple[object, Counter]]]:
    """The items' ids and terms with their repeats, a block of items at a time; items without terms are left out.

    The driver holds one block: ``BLOCK_ITEMS`` items of ``BLOCK_TERMS`` different terms (more only if one item has more).
    """
    block: list[tuple[object, Counter]] = []
    seen: set[str] = set()
    for item, text in items.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        terms = Counter(TERM.findall((text or "").translate(UPPER)))
        if not terms:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(seen | terms.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((item, terms))
        seen |= terms.keys()
    if block:
        yield block


def bags(docs: DataFrame, text_col: str, id_col: str, terms: list[str]) -> DataFrame:
    """``doc_id, n`` (all terms) and ``bag``: pairs of 32-bit integers, a block's term and its frequency, by term."""
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(Vocabulary(terms))
    width = max(len(terms), 1)

    def start():
        known = vocabulary.value

        def work(texts: pa.Array) -> list[pa.Array]:
            words = Words(texts)
            term = known.find(words)
            at = term >= 0
            keys, tf = np.unique(words.row[at] * width + term[at], return_counts=True)
            pairs = np.stack([keys % width, tf], 1).astype("<i4")
            stops = np.searchsorted(keys, np.arange(len(texts) + 1) * width) * 8
            bag = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(pairs.tobytes())])
            return [pa.array(words.count.astype(np.int64)), bag]

        return work

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return map_text(rows, "_text", [T.StructField("n", T.LongType()), T.StructField("bag", T.BinaryType())], start, keep=["doc_id"])


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of every pair of a column of bags."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, "<i4", (offsets[-1] - offsets[0]) // 4, int(offsets[0])).reshape(-1, 2) if offsets[-1] > offsets[0] else np.zeros((0, 2), np.int32)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def document_frequency(bagged: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of a block's ``size`` terms: sums of the tasks' counts, a row for each term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in bagged.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


class Scorer:
    """Scores classes against a block's items and keeps each item's best ones.

    A class outside an item's ``top`` classes by score and least id has ``top`` rows before each of its own,
    so no more are kept.
    """

    def __init__(self, weight: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int, top: int):
        self.weight, self.items, self.top = weight, items, top
        self.first, self.item, self.times = postings  # a term's items and the repeats there
        self.many = np.diff(self.first)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, least id, number of the class
        self.least = np.ones(items, np.int64)  # a score that still counts
        self.members: dict[int, list] = {}
        self.seen = 0

    def add(self, m: np.ndarray, bag: pa.Array, ids: list[list]) -> None:
        """Score classes: their ``m``, bags and least ids in order (null last)."""
        row, term, tf = _pairs(bag)
        value = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        many = self.many[term]
        at = ragged(self.first[term], many)
        worth = np.repeat(value, many) * self.times[at]
        # sums of integers below 2**53, so exact as doubles
        cells = np.bincount(np.repeat(row, many) * self.items + self.item[at], weights=worth, minlength=len(m) * self.items)
        cells = cells.astype(np.int64).reshape(len(m), self.items)
        r, i = np.nonzero(cells >= self.least)
        least = np.array([LAST if own[0] is None else own[0] for own in ids], np.int64)
        item, score, first, number = (np.concatenate(x) for x in zip(self.kept, (i, cells[r, i], least[r], r + self.seen)))
        order = np.lexsort((first, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.top]
        self.kept = [x[order] for x in (item, score, first, number)]
        full = np.flatnonzero(place[place < self.top] == self.top - 1)
        self.least[self.kept[0][full]] = self.kept[1][full]  # an equal score can still win by its id
        alive = np.unique(self.kept[3]).tolist()
        self.members = {n: ids[n - self.seen] if n >= self.seen else self.members[n] for n in alive}
        self.seen += len(m)

    def rows(self) -> list[pa.Array]:
        """Item, document and score of the members of the kept classes."""
        item, score, _, number = (x.tolist() for x in self.kept)
        out = [(i, d, s) for i, s, n in zip(item, score, number) for d in self.members[n]]
        return [pa.array([x[c] for x in out], pa.int64()) for c in range(3)]


def _best(df: DataFrame, top: int) -> DataFrame:
    """``df`` with ``rank``: each item's first rows. Tasks cut their own rows before the exchange (window group limit)."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def classes(bagged: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """Documents of equal bag and ``m`` as one row: ``m, bag, ids``, the least ids, ``top`` of them.

    The hash brings candidates together, the bag itself is part of the key. Every task keeps a class's
    ``top`` least ids before the exchange, so a class of a third of all documents is small there.
    """
    m = F.expr(f"100 - 75 + ((75 * cast(n as decimal(19,0))) * cast({documents} as decimal(18,0))) div {terms}L").cast("bigint")
    rows = bagged.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    place = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last()))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= top)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_place", "doc_id"))), lambda x: x["doc_id"])
    return rows.groupBy("h", "m", "bag").agg(ids.alias("ids")).select("m", "bag", "ids")


def search_block(docs: DataFrame, block: list[tuple[object, Counter]], text_col: str, id_col: str, top: int) -> DataFrame | None:
    """``item`` (its place in the block), ``rank, doc_id, score``; None where no document has a term."""
    terms = sorted(set().union(*(c for _, c in block)))
    bagged = stored(bags(docs, text_col, id_col, terms), "search-bags")
    documents, total = bagged.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if not total:
        return None
    df = document_frequency(bagged, len(terms)).tolist()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df], np.int64)
    place = {t: i for i, t in enumerate(terms)}
    posts = sorted((place[t], i, n) for i, (_, own) in enumerate(block) for t, n in own.items())
    term, item, times = (np.array(x, np.int64) for x in zip(*posts))
    postings = (np.searchsorted(term, np.arange(len(terms) + 1)), item, times)
    shared = docs.sparkSession.sparkContext.broadcast((weight, postings, len(block)))

    def run(batches):
        weight, postings, items = shared.value
        scorer = Scorer(weight, postings, items, top)
        step = max(1, CELLS // items)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                scorer.add(part.column(0).to_numpy(), part.column(1), part.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(scorer.rows(), names=["item", "doc_id", "score"])

    found = classes(bagged, documents, total, top).mapInArrow(run, "item long, doc_id long, score long")
    return _best(found, top).withColumn("rank", F.col("rank").cast("int"))


def search(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """Each item's ``top`` documents: ``item_id, rank, doc_id, score``, scores above 0, equal scores by ascending id (null last).

    Ids of documents are integers, those of items of any type; every row of ``items`` is an item of its own, also
    a repeated one, and every row of ``docs`` a document. Null and empty texts have no terms; a document
    without an item's terms is not ranked for it. Empty tables give none. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema[item_col].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)])
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for block in blocks(items, item_text, item_col):
        found = search_block(docs, block, text_col, id_col, top)
        if found is not None:
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], schema)
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def brute_force(docs: list[tuple[int | None, str | None]], items: list[tuple[object, str | None]], top: int = TOP) -> list[tuple]:
    """Reference answer for small inputs: rows ``(item_id, rank, doc_id, score)``."""
    counts = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        own = Counter(TERM.findall((text or "").translate(UPPER)))
        rows = []
        for d, c in counts:
            if c:
                m = 25 + 75 * sum(c.values()) * n // total
                score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in own.items() if t in c)
                if score > 0:
                    rows.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM s),
m AS (SELECT r, doc_id, 25 + (75 * n * n_docs) // n_all AS m FROM s, c),
q AS (SELECT i, term, count(*) AS k FROM (SELECT row_number() OVER () AS i, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term),
o AS (SELECT i, m.doc_id, r, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM t JOIN q USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM o WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM k JOIN (SELECT row_number() OVER () AS i, item_id FROM benchmark) USING (i) WHERE rank <= 10
"""
