"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

A document is a weighted set: its five-word shingles, each weighted by its count. Every unit
of weight of a shingle is a column of a plane; darts fall on the columns as a Poisson process in
rank, placed by hashes of (shingle, column, number of the dart) alone, so two documents see the
same darts where their weights overlap. Each dart has one of ``k`` coordinates; a document keeps
the earliest dart of each. Long documents test one hash per shingle, as hardly any has a dart
below their rank limit. Two signatures agree in a coordinate with the probability of the
weighted Jaccard similarity.

Exact copies collapse first (MD5 of the text). Bands of the signatures give buckets, and links make
components. In each draw every open bucket, one whose members are in more than one component, has a
leader that is compared with the members outside its component: the member with most company
in all its buckets. In a second draw a bucket's members are parted by a further band
first, a leader for each part, so that a few like texts find each other among many unlike ones. A draw
compares a member with one leader, so pairs grow with the rows, not with the square of a bucket. Buckets that
are still open are settled exactly at the end: those of few members pair by pair, the members of wide ones by a
prefix join that loses no pair at the threshold (a text's rarest shingles, of which two like texts share one, with
bounds by size and place). A link stands if the exact weighted Jaccard
similarity is at least the threshold; classes are the connected components of the links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import Words, chunks, map_text, mix, prepare, shingles, stored, text_array
from quillscope.llm.components import BROADCAST_ROWS, connected_components, small

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5  # a pair of similarity 0.8 shares no band with probability 5e-5
ROUNDS = ((0, 1),)  # draws of each round: further bands that part a bucket
FEW = 32  # members of an open bucket that is settled pair by pair: at most 16 pairs a member
SLOTS = 1 << 20  # counters of shingles that order them from rare to frequent: 8 MB
SLOT_BLOCK = 1 << 14  # counters in one row
BLOCK = 1000  # rows of a prefix's key in one block of the join
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 2.0**-53


def dart_signature(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, k)`` earliest darts of weighted sets, and which rows have any weight.

    ``row, element, weight``: one entry for each element of each set; weights are positive and may
    be fractions (a dart beside the part of the last column that is covered misses).
    """
    sig = np.zeros((rows, k), np.uint64)
    total = np.bincount(row, weight, minlength=rows)
    todo = np.flatnonzero(total > 0)
    columns = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(row)), columns)
    col = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
    part = np.minimum(1.0, weight[at] - col)
    seed = mix(element[at] + col.astype(np.uint64) * _GOLD)
    owner = row[at]
    limit = np.zeros(rows)
    darts = k * math.log(k) + 4 * k  # on average, in the first try
    while len(todo):
        limit[:] = -1.0
        limit[todo] = darts / total[todo]
        use = np.flatnonzero(limit[owner] > 0)
        s, o, p = seed[use], owner[use], part[use]
        rank, n = np.zeros(len(use)), 0
        hit_row, hit_rank, hit_id = [], [], []
        while len(s):
            n += 1
            h = mix(s + np.uint64(n * int(_GOLD) % 2**64))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT)
            live = rank <= limit[o]
            s, o, p, rank, h = s[live], o[live], p[live], rank[live], h[live]
            full = p >= 1.0
            if full.all():
                hit = slice(None)
            else:
                y = (mix(h + np.uint64(1)) >> np.uint64(11)).astype(np.float64) * _UNIT
                hit = full | (y < p)
            hit_row.append(o[hit]), hit_rank.append(rank[hit]), hit_id.append(mix(h[hit] ^ _GOLD))
        r, q, d = map(np.concatenate, (hit_row, hit_rank, hit_id))
        coordinate = (mix(d) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-q, kind="stable")  # the earliest is written last
        filled = np.zeros((rows, k), bool)
        sig[r[order], coordinate[order]] = d[order]
        filled[r, coordinate] = True
        todo = todo[~filled[todo].all(axis=1)]
        darts *= 2
    return sig, total > 0


def weighted_set(row: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) and how often each occurs."""
    key = mix(element + mix(row.astype(np.uint64) + _GOLD))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return row[first], element[first], count


def band_keys(texts: pa.Array, bands: int, rows: int, size: int) -> pa.Array:
    """A hash for each band of each text; no words: an empty list."""
    words = Words(texts)
    r, h = shingles(words, size)
    r, h, n = weighted_set(r, h)
    sig, some = dart_signature(r, h, n.astype(np.float64), len(texts), bands * rows)
    out = np.zeros((len(texts), bands), np.uint64)
    for j in range(rows):
        out = out * _GOLD + sig[:, j::rows][:, :bands]
    out = mix(out + np.arange(bands, dtype=np.uint64))
    offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(out[some].ravel().view(np.int64)))


def similarity(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts (0 if neither has words)."""
    sides = []
    for texts in (a, b):
        r, h = shingles(Words(text_array(texts)), size)
        key = mix(h + mix(r.astype(np.uint64) + _GOLD))
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        sides.append((key, r[first], n, np.bincount(r, minlength=len(texts))))
    (ka, ra, na, ta), (kb, _, nb, tb) = sides
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(ra[i], np.minimum(na[i], nb[j]), minlength=len(a))
    return both / np.maximum(ta + tb - both, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose texts ``(node, text)`` are similar enough.

    ``a`` is a leader and may stand in very many pairs; its text joins last, from an exchange
    that adaptive execution can split.
    """
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    if pairs.count() <= BROADCAST_ROWS:  # few pairs go to the texts; only the texts that they name are shuffled
        tb = tb.join(F.broadcast(pairs), "b")
        ta = ta.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
        rows = tb.join(ta, "a").select("a", "b", "_ta", "_tb")
    else:
        rows = pairs.join(tb, "b").join(ta, "a").select("a", "b", "_ta", "_tb")

    def run(batches):
        for batch in batches:
            x, y = text_array(batch.column(2)), text_array(batch.column(3))
            for i, j in chunks(x):
                keep = similarity(x.slice(i, j - i), y.slice(i, j - i), size) >= threshold
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i).filter(pa.array(keep)) for c in (0, 1)], names=["a", "b"]
                )

    return rows.mapInArrow(run, "a long, b long")


def linked(members: DataFrame, bands: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame | None:
    """Components ``(node, root)`` over the verified links of the written buckets ``(key, node, n)``.

    ``bands``: ``(node, keys)``, the hashes of all bands of each node. Nodes without a link have no row; None: no links at all.
    """
    company = stored(members.groupBy("node").agg(F.sum("n").alias("_company")), "company")
    rows = members.join(small(company), "node").select("key", "node", "_company")
    parts = None
    for t, levels in enumerate(ROUNDS):
        rows = open_buckets(rows, parts)
        if rows.isEmpty():
            return parts
        parted = (rows.join(bands, "node") if max(levels) else rows).select("node", "root", "_company", F.explode(F.array(*draws(t, levels))).alias("d"))
        parted = parted.select("node", "root", F.col("d.sub").alias("sub"), F.struct(F.when(F.lit(t) == 0, F.col("_company")).alias("c"), "d.order").alias("_order"))
        parted = stored(parted, "parted")
        leaders = parted.groupBy("sub").agg(F.max_by(F.struct("node", "root"), "_order").alias("lead"), F.min("root").alias("x"), F.max("root").alias("y"))
        leaders = small(stored(leaders.where("x != y").select("sub", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root")), "leaders"))
        parts = with_links(parts, parted.join(leaders, "sub").where("root != lead_root"), texts, threshold, size)
    rows = open_buckets(rows, parts)
    if rows.isEmpty():
        return parts
    few = small(stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= FEW).select("key"), "few"))
    pairs = rows.join(few, "key").select("key", "node", "root")
    other = pairs.select("key", F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    parts = with_links(parts, pairs.join(other, "key").where("node < lead and root != lead_root"), texts, threshold, size)
    wide = open_buckets(rows.join(few, "key", "left_anti"), parts).select("node").distinct()
    return settled(wide, parts, texts, threshold, size)


def multisets(texts: pa.Array, size: int) -> pa.Array:
    """The shingles of each text as a set of hashes: further occurrences of a shingle are elements of their own."""
    r, h = shingles(Words(text_array(texts)), size)
    key = mix(h + mix(r.astype(np.uint64) + _GOLD))
    order = np.argsort(key, kind="stable")
    place = np.arange(len(key))
    again = np.zeros(len(key), bool)
    again[1:] = key[order[1:]] == key[order[:-1]]
    nth = np.empty(len(key), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(again, 0, place))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(mix(h + nth * _GOLD).view(np.int64)))


def slot_counts(elements: DataFrame, total: int) -> np.ndarray:
    """How many elements of the written rows ``(node, keys)`` fall in each of ``total`` slots: counts that are never too low.

    Each task counts its own and hands on a row for each block of slots, which holds those that it has met; the counts
    of a block are added as they come in. What reaches the driver is one count a slot.
    """
    types = np.dtype(np.int32), np.dtype(np.int64)

    def run(batches):
        own = np.zeros(total, np.int64)
        for batch in batches:
            slot, n = np.unique(slots(flat_keys(batch.column(0))[0], total), return_counts=True)
            own[slot] += n
        for a in range(0, total, SLOT_BLOCK):
            some = np.flatnonzero(own[a : a + SLOT_BLOCK])
            if len(some):
                made = [x.astype(t).tobytes() for x, t in zip((some, own[a + some]), types)]
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), *[pa.array([x], pa.binary()) for x in made]], names=["first", "slots", "n"])

    def add(batches):
        sums = {}
        for batch in batches:
            for a, *packed in zip(*[c.to_pylist() for c in batch.columns]):
                slot, n = map(np.frombuffer, packed, types)
                sums.setdefault(a, np.zeros(min(SLOT_BLOCK, total - a), np.int64))[slot] += n
        for a, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([n.tobytes()], pa.binary())], names=["first", "n"])

    each = elements.select("keys").mapInArrow(run, "first long, slots binary, n binary")
    table = each.repartition("first").mapInArrow(add, "first long, n binary").toArrow()
    out = np.zeros(total, np.int64)
    for a, n in zip(table["first"].to_pylist(), table["n"].to_pylist()):
        out[a : a + SLOT_BLOCK] = np.frombuffer(n, np.int64)
    return out


def slots(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(n)).astype(np.int64)


def flat_keys(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a list column end to end, and how many each row has."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def prefixes(texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """``(key, node, at, size)``: the rarest shingles of each of the texts ``(node, text)``, so many that any two
    texts of the threshold's similarity share one; those known to be of one text only are left out. ``at``: the place in
    the order from rare to frequent, ``size``: the text's shingles. Written.

    Any one order of all shingles loses no pair; this one is by the counts of their slots, then by their hashes.
    """
    field = T.StructField("keys", T.ArrayType(T.LongType()))
    own = stored(map_text(texts, "text", [field], lambda: lambda t: [multisets(t, size)], keep=["node"]), "elements")
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(own, SLOTS))

    def run(batches):
        often = counts.value
        for batch in batches:
            keys, sizes = flat_keys(batch.column(1))
            row = np.repeat(np.arange(len(sizes)), sizes)
            n = often[slots(keys, len(often))]
            order = np.lexsort((keys, n, row))
            at = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[row]
            first = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1  # an overlap has size * threshold elements
            keep = (at < first[row]) & (n[order] > 1)
            made = [keys[order][keep], batch.column(0).to_numpy()[row[keep]], at[keep].astype(np.int32), sizes[row[keep]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "node", "at", "size"])

    return stored(own.mapInArrow(run, "key long, node long, at int, size int"), "prefixes")


def settled(nodes: DataFrame, parts: DataFrame | None, texts: DataFrame, threshold: float, size: int) -> DataFrame | None:
    """The components with all links between the nodes that are in different ones.

    A key's rows of the component that has most of them are never compared with each other, and the rows
    are dealt over blocks. First each text is compared with one text of each other component, then with all that are
    still in another.
    """
    nodes = stored(nodes, "wide")
    if nodes.isEmpty():
        return parts
    rows = prefixes(texts.join(small(nodes), "node", "left_semi"), threshold, size)
    for one in (True, False):
        rooted = stored(rows.withColumn("root", F.col("node")) if parts is None else with_component(rows, parts), "prefix-roots")
        per = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(
            F.max_by("root", "n").alias("main"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("x"), F.max("root").alias("y")
        )
        per = stored(per.where("x != y").select("key", "main", "blocks"), "prefix-keys")
        open_ = stored(rooted.join(small(per), "key"), "prefix-open")
        x = open_.where("root != main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "root", "at", "size", "main")
        y = open_.select(
            "key", F.pmod(F.hash("node"), F.col("blocks")).alias("block"),
            F.col("node").alias("lead"), F.col("root").alias("lead_root"), F.col("at").alias("lead_at"), F.col("size").alias("lead_size"),
        )
        # the first shingle that two texts share bounds what they can share in all
        most = F.least(F.col("size") - F.col("at"), F.col("lead_size") - F.col("lead_at"))
        enough = most >= F.ceil((F.col("size") + F.col("lead_size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
        pairs = x.join(y, ["key", "block"]).where("root != lead_root and (lead_root = main or node < lead)").where(enough)
        if one:
            pairs = pairs.groupBy("node", "lead_root").agg(F.min("lead").alias("lead"))
        parts = with_links(parts, pairs.select("node", "lead"), texts, threshold, size)
    return parts


def draws(t: int, levels: tuple[int, ...]) -> list:
    """For each draw of round ``t`` the part of the bucket that a row is in, and its order among the leaders to be.

    Which bands part a bucket is the bucket's own draw. The first draw of a round has one order of nodes for all buckets.
    """
    out = []
    for i, level in enumerate(levels):
        bands = [F.element_at("keys", (F.pmod(F.xxhash64("key", F.lit(100 * t + 10 * i + j)), F.size("keys")) + 1).cast("int")) for j in range(level)]
        order = F.xxhash64("node", F.lit(t)) if i == 0 else F.xxhash64("node", "key", F.lit(10 * t + i))
        out.append(F.struct(F.xxhash64("key", F.lit(i), *bands).alias("sub"), order.alias("order")))
    return out


def open_buckets(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The rows of buckets with members of more than one component, with each one's ``root``; written."""
    rows = rows.drop("root")
    rows = rows.withColumn("root", F.col("node")) if parts is None else with_component(rows, parts)
    rows = stored(rows, "rooted")
    several = rows.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least != _most")
    return stored(rows.join(small(stored(several.select("key"), "open-keys")), "key"), "open")


def with_links(parts: DataFrame | None, pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame | None:
    """The components with the links that stand among the pairs ``(node, lead)``."""
    pairs = stored(pairs.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), "pairs")
    found = stored(verified(pairs, texts, threshold, size), "links")
    if found.isEmpty():
        return parts
    if parts is not None:
        found = found.union(parts.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return stored(connected_components(found, "a", "b"), "parts")


def with_component(df: DataFrame, parts: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    p = small(parts.select(F.col("node").alias(node), F.col("root").alias("_root")))
    return df.join(p, node, "left").withColumn(root, F.coalesce("_root", F.col(node))).drop("_root")


def buckets(rows: DataFrame, shift: int = 0) -> DataFrame:
    """The rows ``(key, node)`` of the buckets that hold two documents or more, and rows ``n`` there; written."""
    doc = F.shiftright("node", shift) if shift else F.col("node")
    several = rows.groupBy("key").agg(F.min(doc).alias("_least"), F.max(doc).alias("_most"), F.count("*").alias("n"))
    several = several.where("_least != _most").select("key", "n")
    return stored(rows.join(small(stored(several, "several")), "key"), "members")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    size: int = SHINGLE,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, classes)``.

    documents: ``(id, digest, class_id, class_docs, class_texts, is_rep)`` for each row of ``docs``;
    classes: ``(digest, class_id, rep_digest)`` of the texts that more rows than one have or that are
    linked to another text. ``class_id`` is the least id of the class (nulls last), ``rep_digest``
    the text of that row.

    A null text is in a class of its own. Texts without words (also empty ones) are copies of
    equal texts only; a text of fewer words than ``size`` is one shingle. Repeated rows share a
    class. An empty table gives none. Other columns are not read.
    """
    prepare(docs.sparkSession)
    own = docs.select(
        F.col(id_col).alias("id"), F.md5(text_col).alias("digest"), F.col(text_col).alias("text")
    )
    field = T.StructField("keys", T.ArrayType(T.LongType()))
    signed = stored(
        map_text(own, "text", [field], lambda: lambda t: [band_keys(t, bands, rows, size)], keep=["id", "digest"]), "signed"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    texts = signed.where("digest is not null").groupBy("digest").agg(
        first.alias("_first"), F.count("*").alias("n"), F.any_value("keys").alias("keys")
    )
    nodes = stored(
        texts.select("digest", F.col("_first.id").alias("id"), "n", "keys", F.monotonically_increasing_id().alias("node")),
        "nodes",
    )
    members = buckets(
        nodes.select(F.posexplode("keys").alias("_band", "_hash"), "node").select(F.xxhash64("_band", "_hash").alias("key"), "node")
    )
    needed = stored(
        nodes.select("digest", "node").join(small(stored(members.select("node").distinct(), "needed")), "node", "left_semi"),
        "needed",
    )
    whole = stored(
        own.join(small(needed), "digest").groupBy("node").agg(F.any_value("text").alias("text")), "texts"
    )
    parts = linked(members, nodes.select("node", "keys"), whole, threshold, size)
    of = nodes.select("digest", "id", "n", "node")
    of = of.withColumn("root", F.col("node")) if parts is None else with_component(of, parts)
    head = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest"))
    per = of.groupBy("root").agg(head.alias("_head"), F.sum("n").alias("class_docs"), F.count("*").alias("class_texts"))
    per = stored(per.where("class_docs > 1"), "classes")
    classes = stored(
        of.join(small(per), "root").select(
            "digest", F.col("_head.id").alias("class_id"), F.col("_head.digest").alias("rep_digest"), "class_docs", "class_texts"
        ),
        "class-texts",
    )
    documents = signed.select("id", "digest").join(small(classes), "digest", "left").select(
        "id",
        "digest",
        F.when(F.col("class_docs").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1)).cast("bigint").alias("class_docs"),
        F.coalesce("class_texts", F.lit(1)).cast("bigint").alias("class_texts"),
        (F.col("class_docs").isNull() | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("rep_digest")))).alias("is_rep"),
    )
    return documents, classes


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class of near copies (its representative); same columns.

    Only rows of texts in a class are looked up; a class's rows that repeat the representative's
    id and text are reduced to one of them.
    """
    documents, classes = near_duplicates(docs, id_col, text_col, **how)
    again = stored(
        documents.where("is_rep and class_docs > 1").groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"),
        "again",
    )
    c = classes.select(F.col("digest").alias("_digest"), F.col("class_id").alias("_class"), F.col("rep_digest").alias("_rep"))
    rows = docs.select(F.struct("*").alias("_in"), F.col(f"`{id_col}`").alias("_id"), F.md5(f"`{text_col}`").alias("_md5"))
    rows = rows.join(small(c), F.col("_md5") == F.col("_digest"), "left").where(
        F.col("_digest").isNull() | (F.col("_id").eqNullSafe(F.col("_class")) & (F.col("_md5") == F.col("_rep")))
    )
    twice = small(again.select(F.col("digest").alias("_md5")).distinct())
    once = rows.join(twice, "_md5", "left_anti").select("_in.*")
    if again.isEmpty():
        return once
    return once.union(rows.join(twice, "_md5", "left_semi").dropDuplicates(["_md5"]).select("_in.*"))
