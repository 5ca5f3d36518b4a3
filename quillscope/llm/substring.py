"""Substring dedup: passages that repeat across documents, by bottom-k MinHash sketches of paragraphs.

Repeated passages seldom begin where a line does, so paragraphs are cut by content: in every
stretch of ``WINDOW`` consecutive five-word shingles the one of least hash begins a paragraph of
``UNIT`` words (paragraphs may overlap). Equal passages of ``WINDOW + UNIT`` words or more thus
share a whole paragraph wherever they stand. Equal paragraphs collapse first: the earliest document's
stays, and only one row of each content goes on. All contents have as many shingles, so two that meet
the threshold share one of their few least shingle hashes (bottom-k MinHash) and differ in few
shingles, hence in few bits of a sketch of parities. Both tests lose no pair; what passes them is
compared by exact Jaccard similarity. In buckets of very frequent shingles the rarest shingles
take the place of those of least hash. A paragraph linked to one of an earlier document is removed and
spans of removed paragraphs are merged; documents that share passages are clustered by components.

Exact copies of a text collapse first: all later copies are removed where the text holds paragraphs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import Words, chunks, map_text, mix, prepare, stored, text_array
from quillscope.llm.components import BROADCAST_ROWS, connected_components
from quillscope.llm.neardup import multisets, prefixes, verified, with_component
from quillscope.operators.idfilter import bit_rows, hashed, maybe_in, table_bits, with_bit

SHINGLE = 5
WINDOW = 20  # shingles of which one begins a paragraph
UNIT = 30  # words of a paragraph
COUNT = UNIT - SHINGLE + 1  # shingles of a paragraph
WIDE = 256  # contents of a bucket that is joined as it is, and of a block of wider ones
THRESHOLD = 0.8
MORE = [f"sketch{i}" for i in range(1, 6)]  # further sketches of contents that have one like them
SMALL_ROWS = 2_000  # rows of a table that goes to all tasks at most: larger inputs exchange what smaller ones do
ROUNDS = 4  # leaders that a bucket has, one after the other
SHIFT = 25  # bits of a paragraph's number in its document: a string can't hold more words
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first words (in the chunk) of all paragraphs; ordered."""
    n = len(words.hash)
    if n < WINDOW + SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = shingle_hashes(words)
    # the least shingle of each window, by doubling; the low bits hold its place
    least = (mix(h) & ~np.uint64(0xFFFFFFF)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
    begin = np.arange(len(least))
    ends = words.first[words.row[begin] + 1]
    least = least[begin + WINDOW + SHINGLE - 1 <= ends]  # windows inside one document
    at = np.unique((least & np.uint64(0xFFFFFFF)).astype(np.int64))
    at = at[at + UNIT <= words.first[words.row[at] + 1]]
    return words.row[at], at


def shingle_hashes(words: Words) -> np.ndarray:
    """A hash of the ``SHINGLE`` words from each word of the chunk on."""
    n = len(words.hash)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h[: n - j] = h[: n - j] * _GOLD + words.hash[j:]
    return h


def elements(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``(len(at), COUNT)`` hashes of the shingles of each paragraph, ascending before they are mixed; further
    occurrences of a shingle are elements of their own."""
    m = np.sort(h[at[:, None] + np.arange(COUNT)], axis=1)
    if (m[:, 1:] == m[:, :-1]).any():
        nth = np.zeros(m.shape, np.uint64)
        for j in range(1, COUNT):
            nth[:, j] = np.where(m[:, j] == m[:, j - 1], nth[:, j - 1] + np.uint64(1), np.uint64(0))
        m = m + nth * (_GOLD ^ np.uint64(0x5555))
    return mix(m + _GOLD)


def min_hashes(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least hashes of the shingles of each paragraph."""
    return np.sort(elements(shingle_hashes(words), at), axis=1)[:, :k]


def differing(threshold: float) -> int:
    """How many shingles of a paragraph may be missing in another one of this similarity."""
    return min(COUNT - int(np.ceil(threshold / (1 + threshold) * 2 * COUNT - 1e-9)), COUNT - 1)


def content_fields(k: int) -> list[T.StructField]:
    names = ["whole", "sketch", *[f"least{i}" for i in range(k)]]
    return [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),  # first word of each paragraph
        T.StructField("keys", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in names]))),
    ]


def paragraph_keys(texts: pa.Array, k: int) -> list[pa.Array]:
    """For each paragraph a key of the whole, the parities of its shingles' hashes by their low bits, and the ``k`` least hashes."""
    words = Words(texts)
    row, at = paragraphs(words)
    per = np.bincount(row, minlength=len(texts))
    offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    starts = pa.ListArray.from_arrays(offsets, pa.array((at - words.first[row]).astype(np.int32)))
    keys = np.zeros((len(at), 2 + k), np.uint64)
    h = shingle_hashes(words)
    for j in range(UNIT):
        keys[:, 0] = keys[:, 0] * _GOLD + words.hash[at + j]
    keys[:, 0] = mix(keys[:, 0])
    for a in range(0, len(at), 1 << 14):
        m = elements(h, at[a : a + (1 << 14)])
        keys[a : a + len(m), 1] = np.bitwise_xor.reduce(np.uint64(1) << (m & np.uint64(63)), axis=1)
        keys[a : a + len(m), 2:] = np.partition(m, k - 1, axis=1)[:, :k]
    names = [f.name for f in content_fields(k)[2].dataType.elementType]
    units = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in range(2 + k)], names=names)
    return [pa.array(words.count, pa.int64()), starts, pa.ListArray.from_arrays(offsets, units)]


def paragraph_texts(docs: DataFrame) -> DataFrame:
    """``(node, text)`` of the paragraphs named by ``units`` of the documents ``(doc, units, text)``; of a document's further rows
    in a task none."""

    def run(batches):
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array([not (d in seen or seen.add(d)) for d in batch.column(0).to_pylist()], pa.bool_()))
            texts = text_array(batch.column(2))
            docs_, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                words = Words(texts.slice(a, b - a))
                row, at = paragraphs(words)
                first = np.searchsorted(row, np.arange(b - a))
                raw, nodes, out = words.data, [], []
                for r in range(b - a):
                    for u in units[a + r]:
                        w = at[first[r] + u]
                        nodes.append((docs_[a + r] << SHIFT) + u)
                        out.append(b" ".join(raw[s:e].tobytes() for s, e in zip(words.start[w : w + UNIT], words.end[w : w + UNIT])))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["node", "text"])

    return docs.select("doc", "units", "text").mapInArrow(run, "node long, text string")


def small(df: DataFrame) -> DataFrame:
    """``df`` (written data) with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def id_bits(ids: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """A written table of bits for the written ``ids`` that grows with them, and how many bits it has."""
    bits = table_bits(ids.count())
    return stored(bit_rows(ids.select(hashed(key, bits).alias("place")), "place", bits), name), bits


def among(rows: DataFrame, table: tuple[DataFrame, int], columns: list[str]) -> DataFrame:
    """The ``rows`` that have one of the ids of ``id_bits`` in one of the ``columns``, and few others; they stay where they are read."""
    flags = [f"_in{i}" for i in range(len(columns))]
    out = rows
    for c, flag in zip(columns, flags):
        out = with_bit(out, table[0], hashed(c, table[1]), flag)
    return out.where(reduce(or_, map(F.col, flags))).select(*rows.columns)


def matched(rows: DataFrame, table: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` joined with the written ``table``; few rows without a partner leave their task."""
    if table.count() > SMALL_ROWS:
        rows = among(rows, id_bits(table, key[0], name), key[:1])
    return rows.join(small(table), key)


def alike(errors: int, columns: list[str]) -> Column:
    """Whether the sketches ``columns`` of two contents (names end in ``_a`` and ``_b``) allow the threshold."""
    return reduce(and_, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) <= 2 * errors for c in columns])


def side(rows: DataFrame, suffix: str) -> DataFrame:
    """``rows`` with ``suffix`` behind the names."""
    return rows.select(*[F.col(c).alias(c + suffix) for c in rows.columns])


def in_company(rows: DataFrame, errors: int) -> DataFrame:
    """The rows ``(key, node, sketch)`` of the buckets ``rows`` with a row of another document like them; of wide buckets all."""
    few = rows.where("not wide").drop("wide")
    apart = F.shiftright("node_a", SHIFT) != F.shiftright("node_b", SHIFT)
    paired = side(few, "_a").join(side(few, "_b"), (F.col("key_a") == F.col("key_b")) & apart & alike(errors, ["sketch"]), "left_semi")
    return paired.toDF(*few.columns).unionByName(rows.where("wide").drop("wide"))


def led(rows: DataFrame, errors: int) -> DataFrame:
    """Pairs ``(a, b)`` of contents like by the sketch in the written buckets ``rows``, a's document earlier; one for a row at most.

    In each round a bucket has a leader drawn at random, mostly from many like ones; the first of the contents like it is
    compared with them. Those like both leave the bucket, the others go on.
    """
    doc, one, out = F.shiftright("node", SHIFT), F.struct("node", "sketch"), []
    near = lambda other: F.bit_count(F.col("sketch").bitwiseXOR(F.col(other))) <= 2 * errors
    for t in range(ROUNDS):
        leaders = rows.groupBy("key").agg(F.max_by(one, F.xxhash64("node", "key", F.lit(t))).alias("lead"), F.count("*").alias("n")).where("n > 1")
        leaders = small(stored(leaders.select("key", F.col("lead.sketch").alias("lead")), "leaders"))
        # rows that are alone in their bucket go
        close = rows.join(leaders, "key").withColumn("near", near("lead")).drop("lead")
        heads = close.where("near").groupBy("key").agg(F.min(one).alias("head"))
        heads = small(stored(heads.select("key", F.col("head.node").alias("head"), F.col("head.sketch").alias("head_sketch")), "heads"))
        close = stored(close.join(heads, "key").withColumn("near", F.col("near") & near("head_sketch")).drop("head_sketch"), "led")
        out.append(close.where("near").where(F.shiftright("head", SHIFT) < doc).select(F.col("head").alias("a"), F.col("node").alias("b")))
        rows = close.where("not near").select("key", "node", "sketch")
    return reduce(DataFrame.union, out).distinct()


def opened(rows: DataFrame, name: str) -> DataFrame:
    """The rows of buckets in which links may be missing (``due``: to an earlier document, or between two ``root``), with their
    number ``n`` and the component ``main`` of most; written."""
    per = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.max("due").alias("due")).groupBy("key")
    per = per.agg(F.max_by("root", "n").alias("main"), F.sum("n").alias("n"), F.max("due").alias("due"), F.count("*").alias("roots"))
    per = per.where("n > 1 and (due or roots > 1)").select("key", "main", "n")
    return stored(rows.join(small(stored(per, f"{name}-keys")), "key"), name)


def like(rows: DataFrame, errors: int, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Two sides of the buckets ``rows`` of ``opened`` and the condition of the pairs of them that may be missing links, like by the
    sketches ``columns``. Rows that have a link and the component of most are on the second side only; a wide bucket is dealt over blocks.
    """
    blocks = F.ceil(F.col("n") / WIDE).cast("int")
    x = rows.where("due or root != main").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    y = rows.withColumn("block", F.pmod(F.hash("node"), blocks))
    x, y = side(x.drop("n", "main"), "_a"), side(y.drop("n", "main"), "_b")
    doc_a, doc_b = F.shiftright("node_a", SHIFT), F.shiftright("node_b", SHIFT)
    missing = (F.col("root_a") != F.col("root_b")) | F.when(doc_a < doc_b, F.col("due_b")).otherwise(F.col("due_a"))
    same = (F.col("key_a") == F.col("key_b")) & (F.col("block_a") == F.col("block_b"))
    return x, y, same & (doc_a != doc_b) & missing & alike(errors, columns)


def counted(rows: DataFrame, name: str) -> DataFrame:
    """The written rows ``(key, node, ..)`` of the buckets of several documents, and few others, with whether theirs is ``wide``;
    written. The rows stay where they are read as long as the wide buckets are few."""
    doc = F.shiftright("node", SHIFT)
    several = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(doc).alias("x"), F.max(doc).alias("y")).where("x != y")
    several = stored(several.select("key", "n"), "several")
    wide = stored(several.where(F.col("n") > WIDE).select("key", F.lit(True).alias("wide")), "wide-keys")
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
    members = among(rows, id_bits(several, "key", "several-bits"), ["key"]).join(wide, "key", "left")
    return stored(members.withColumn("wide", F.coalesce("wide", F.lit(False))), name)


def content_buckets(contents: DataFrame, shared: tuple[DataFrame, int], k: int, texts_of, threshold: float) -> DataFrame:
    """Buckets ``(key, node, sketch, wide)`` of contents, two of which share one if they meet the threshold.

    ``shared``: the bits of the keys that several texts hold; others lead nowhere.
    """
    keyed = contents.select("node", "sketch", F.explode(F.array(*[f"least{i}" for i in range(k)])).alias("key"))
    members = counted(stored(among(keyed, shared, ["key"]).select("key", "node", "sketch"), "keyed"), "members")
    wide = stored(members.where("wide").select("node", "sketch").distinct(), "wide")
    if wide.isEmpty():
        return members
    rarest = counted(prefixes(texts_of(wide), threshold, SHINGLE).select("key", "node"), "rare-members")
    return members.where("not wide").unionByName(stored(rarest.join(small(wide), "node").select(*members.columns), "rarest"))


def unit_links(rows: DataFrame, errors: int, texts_of, threshold: float, components) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` of contents in the buckets ``rows``, a's document earlier, and the documents' components ``(node, root)``.

    Each content that has a link to an earlier document is the ``b`` of one, and all links between documents count in the
    components, though not all stand among the links. Large groups of like contents are compared with one of theirs
    first (``led``), as their pairs grow with their square. Of the others, and those whose documents are still apart, the
    contents that have one like them by the sketch get further sketches, which hardly any pair below the threshold passes
    (and each pair above it), and are compared with all like them.
    """
    doc = F.shiftright("node", SHIFT)
    rows = stored(in_company(rows, errors), "company")
    first = stored(led(rows, errors), "first")
    named = stored(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    links = stored(verified(first, texts_of(named), threshold, SHINGLE), "links")
    parts = components(links)
    found = small(stored(links.select(F.col("b").alias("node"), F.lit(False).alias("due")).distinct(), "found"))
    nodes = rows.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("due", F.lit(True)).alias("due"), doc.alias("doc"))
    nodes = stored(with_component(nodes, parts, "doc").drop("doc"), "rooted")
    rows = opened(stored(rows.join(small(nodes), "node"), "rooted-rows"), "open")
    x, y, pair = like(rows, errors, ["sketch"])
    near = x.join(y, pair, "left_semi").select(F.col("node_a").alias("node")).union(y.join(x, pair, "left_semi").select("node_b"))
    near = stored(near.distinct(), "near")
    if near.isEmpty():
        return links, parts
    texts = texts_of(near)
    rows = stored(rows.join(small(stored(more_sketches(texts), "sketches")), "node"), "near-rows")
    x, y, pair = like(rows, errors, ["sketch", *MORE])
    pairs = x.join(y, pair).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return links, parts
    more = stored(verified(pairs, texts, threshold, SHINGLE), "more-links")
    return (links, parts) if more.isEmpty() else (links.union(more), components(more, parts))


def more_sketches(texts: DataFrame) -> DataFrame:
    """``node`` with further sketches (columns ``MORE``) of the paragraphs ``(node, text)``: parities by other bits of the hashes."""

    def sketches(t: pa.Array) -> list[pa.Array]:
        keys = multisets(t, SHINGLE)
        h, starts = keys.values.to_numpy().view(np.uint64), keys.offsets.to_numpy()[:-1]  # no paragraph is without shingles
        bits = [np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63)) for i in range(len(MORE))]
        return [pa.array(np.bitwise_xor.reduceat(x, starts).view(np.int64)) for x in bits]

    return map_text(texts, "text", [T.StructField(c, T.LongType()) for c in MORE], lambda: sketches, keep=["node"])


def dense(df: DataFrame, out: str) -> DataFrame:
    """``df`` (written data with the column ``rid``, a monotonically increasing id) with numbers from 0
    without gaps. The rows of each partition are counted; one number a partition reaches the driver."""
    part = F.shiftright("rid", 33)
    counts = df.groupBy(part.alias("part")).agg(F.max(F.col("rid").bitwiseAND((1 << 33) - 1)).alias("most")).orderBy("part").collect()
    rows, base = [], 0
    for r in counts:
        rows.append((r["part"], base))
        base += r["most"] + 1
    t = df.sparkSession.createDataFrame(rows, "_part long, _base long")
    return df.join(F.broadcast(t), part == F.col("_part")).withColumn(out, F.col("_base") + F.col("rid").bitwiseAND((1 << 33) - 1)).drop("_part", "_base")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: ``(id, n_words, n_units, n_removed, class_id, spans)``.

    n_units: paragraphs; n_removed: words in removed spans; class_id: least id of the documents
    that share passages with it, directly or through others (its own id if it shares none); spans:
    removed spans in words (those of ``common.Words``), end exclusive.

    Null texts and texts too short for a paragraph share nothing. Repeated rows are copies: the first
    in storage order stays. An empty table gives none. Other columns are not read.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").alias("text"))
    errors = differing(threshold)
    k = errors + 1
    signed = map_text(own, "text", content_fields(k), lambda: lambda t: paragraph_keys(t, k), keep=["id", "digest"])
    signed = stored(signed.withColumn("rid", F.monotonically_increasing_id()), "paragraphs")
    rows = dense(signed, "doc")
    narrow = stored(rows.where("size(starts) > 0").select("doc", "digest", "id"), "documents")
    firsts = narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    copies = stored(narrow.join(small(stored(firsts.where("n > 1"), "copied")), "digest").where("doc != first").select("doc", "first"), "copies")
    # paragraphs of the first document of each text; documents are numbered without gaps, so a bit for each tells the copies
    copied = stored(bit_rows(copies.select("doc"), "doc", signed.count() + 1), "copy-bits")
    whole = with_bit(rows.where("size(starts) > 0"), copied, F.col("doc"), "copy").where("not copy").select("doc", "keys")
    least = [f"least{i}" for i in range(k)]
    every = F.flatten(F.transform("keys", lambda x: F.array(*[x[c] for c in least])))  # once a text: its paragraphs overlap
    shared = whole.select(F.explode(F.array_distinct(every)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    shared = id_bits(stored(shared.where("n > 1").select("key"), "shared-keys"), "key", "shared-bits")
    each = whole.select("doc", F.posexplode("keys").alias("unit", "k")).select((F.shiftleft("doc", SHIFT) + F.col("unit")).alias("node"), "k.*")
    key = ["whole", "sketch"]  # 128 bits: equal ones are the same paragraph
    # equal and like paragraphs share a least hash, so of those with hashes of one text only none goes on
    contents = among(each, shared, least).groupBy(*key).agg(
        F.min("node").alias("node"), F.shiftright(F.max("node"), SHIFT).alias("last"), *[F.any_value(c).alias(c) for c in least]
    )
    contents = stored(contents, "contents")
    repeated = stored(contents.where(F.shiftright("node", SHIFT) != F.col("last")).select(*key, F.shiftright("node", SHIFT).alias("lead")), "repeated")
    doc, unit = F.shiftright("node", SHIFT), F.col("node").bitwiseAND((1 << SHIFT) - 1).cast("int")
    places = each.select(*key, doc.alias("doc"), unit.alias("unit"))
    equal = stored(matched(places, repeated, key, "repeated-bits").where("doc != lead").select("doc", "unit", "lead"), "equal")
    edges = stored(equal.select("lead", "doc").union(copies.select("first", "doc")).distinct().toDF("a", "b"), "equal-docs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``(node, text)`` of the paragraphs of the written ``nodes``."""
        units = nodes.groupBy(doc.alias("doc")).agg(F.collect_list(unit).alias("units")).join(narrow.select("doc", "digest"), "doc")
        units = stored(units, "needed")
        text = own.select("digest", "text")
        if units.count() > BROADCAST_ROWS:  # few other texts leave their task
            text = maybe_in(text, units.select("digest"), "digest")
        # equal texts are copies: any one row of each digest serves; paragraphs are shuffled, not texts
        units = F.broadcast(units) if units.count() <= BROADCAST_ROWS else units
        pieces = paragraph_texts(text.join(units, "digest"))
        return stored(pieces.groupBy("node").agg(F.any_value("text").alias("text")), "pieces")

    def components(links: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        own_edges = links.select(F.shiftright("a", SHIFT).alias("a"), F.shiftright("b", SHIFT).alias("b")).distinct()
        known = edges if parts is None else parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return stored(connected_components(stored(own_edges.union(known), "doc-links"), "a", "b"), "doc-parts")

    buckets = content_buckets(contents, shared, k, texts_of, threshold)
    links, parts = unit_links(buckets, errors, texts_of, threshold, components)
    later = stored(links.select(F.col("b").alias("node")).distinct(), "later")
    linked = stored(matched(contents, later, ["node"], "later-bits").select(*key), "gone-contents")
    gone = equal.select("doc", "unit")
    if not linked.isEmpty():
        gone = gone.union(matched(places, linked, key, "gone-bits").select("doc", "unit"))
    gone = gone.groupBy("doc").agg(F.collect_set("unit").alias("gone"))
    named = with_component(narrow.select("id", F.col("doc").alias("node")), parts)
    heads = named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    classes = stored(named.join(small(stored(heads, "heads")), "root").select(F.col("node").alias("doc"), "class_id"), "classes")
    out = (
        rows.drop("keys")
        .join(stored(gone, "gone"), "doc", "left")
        .join(small(copies), "doc", "left")
        .join(small(classes.withColumn("_in", F.lit(True))), "doc", "left")
    )
    one = F.sort_array(F.transform("gone", lambda u: F.element_at("starts", u + 1)))
    merged = F.aggregate(
        one,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), (s + UNIT).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s.alias("start"), (s + UNIT).alias("end"))))),
    )
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    spans = F.when(F.col("first").isNotNull(), all_words).when(F.col("gone").isNotNull(), merged).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )
    out = out.withColumn("spans", spans)
    return out.select(
        "id",
        "n_words",
        F.size("starts").cast("bigint").alias("n_units"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, x: t + x["end"] - x["start"]).alias("n_removed"),
        F.when(F.col("_in"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        "spans",
    )
