"""Byte-level BPE encoding and decoding by a two-tier lookup.

Text is cut by a pattern into pre-tokens. A minimal perfect hash over the vocabulary (hash, displace:
one displacement for each small bucket, one slot for each token) resolves at once every pre-token that is
a token itself; the bytes behind the slot are compared, so a stranger never passes. The others are
merged by rank with a heap over linked bytes, once for each distinct pre-token of a chunk, and kept in a
bounded cache of the worker. One narrow Arrow pass, no shuffle; decoding is another.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import BASE_INV, BYTE_MIX, buffers, chunks, map_text, mix, powers, prepare, text_array

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 1 << 20  # characters of a text that are cut into pre-tokens at once
FLUSH = 250_000  # pre-tokens resolved at once
CACHE = 200_000  # merged pre-tokens that a worker remembers
SPREAD = 4  # tokens in a bucket of the perfect hash, on average


def read_ranks(name: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a name among the public tokenizers, or a path."""
    import os

    import public_tokenizers

    path = name if os.path.exists(name) else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_MIX[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * BASE_INV)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start[i] .. start[i] + size[i] - 1`` of all spans in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class PerfectHash:
    """A minimal perfect hash of byte strings; ``find`` gives a string's position or -1."""

    def __init__(self, keys: list[bytes]):
        self.size = np.array([len(k) for k in keys], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(keys), np.uint8)
        n = len(keys)
        hashes = span_hash(self.data, self.start, self.start + self.size)
        if len(np.unique(hashes)) != n:
            raise ValueError("repeated keys")
        self.buckets = n // SPREAD + 1
        home = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)  # displacement; below 0: -1 - slot, for a bucket of one
        self.key = np.full(n, -1, np.int64)  # slot -> key
        for b in np.argsort(-sizes, kind="stable"):  # the largest first
            members = order[first[b] : first[b] + sizes[b]]
            if len(members) < 2:
                break
            at, tries = 0, 64
            while True:  # displacements, more and more at a time, until all members find slots of their own
                slots = np.sort(self._slots(hashes[members], np.arange(at, at + tries, dtype=np.uint64)[:, None]), axis=1)
                good = (self.key[slots] < 0).all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if good.any():
                    break
                at, tries = at + tries, min(2 * tries, 1 << 15)
            self.shift[b] = at + int(np.argmax(good))
            self.key[self._slots(hashes[members], np.uint64([self.shift[b]]))] = members
        empty = np.flatnonzero(self.key < 0)
        alone = np.flatnonzero(sizes == 1)
        self.key[empty] = order[first[alone]]
        self.shift[alone] = -1 - empty

    def _slots(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(hashes + d * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(self.key))).astype(np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start) or not len(self.key):
            return np.full(len(start), -1, np.int64)
        h = span_hash(data, start, end)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slots(h, np.maximum(d, 0).astype(np.uint64)))
        key = self.key[slot]
        size = end - start
        at = np.flatnonzero((self.size[key] == size) & (size > 0))
        same = self.data[ragged(self.start[key[at]], size[at])] == data[ragged(start[at], size[at])]
        wrong = np.add.reduceat(~same, np.cumsum(size[at]) - size[at], dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        out = np.full(len(start), -1, np.int64)
        out[at[wrong == 0]] = key[at[wrong == 0]]
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, the leftmost of equals, is joined until none has a rank.

    Parts are linked by their first bytes: ``after[i]`` is where the part at i ends, 0 once it is
    joined to the one before. An entry of the heap, (rank, begin, border, end), counts only if its pair still stands.
    """
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, j, k = pop(heap)
        if after[i] != j or after[j] != k:
            continue
        after[i], after[j] = k, 0
        if k < n:
            before[k] = i
            end = after[k]
            if (r := rank(piece[i:end])) is not None:
                push(heap, (r, i, k, end))
        if i:
            p = before[i]
            if (r := rank(piece[p:k])) is not None:
                push(heap, (r, p, i, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def newer_letters(pattern: str, ranks: dict[bytes, int]) -> dict[str, str]:
    """Characters that this Python's ``regex`` counts as letters or numbers, and the encoding library, whose
    Unicode may be older, as neither: by property, as ranges of a character class.

    Asked of the library itself with two-byte ranks that join a probe to a following character of the same
    kind; only characters without a category in ``unicodedata`` can differ.
    """
    import tiktoken

    found = {}
    singles = {bytes([i]): i for i in range(256)}
    for name, probe in (("L", b"a"), ("N", b"1")):
        enc = tiktoken.Encoding(
            "probe", pat_str=pattern, special_tokens={}, mergeable_ranks=singles | {probe + bytes([i]): 256 + i for i in range(256)}
        )
        kind = regex.compile(rf"\p{{{name}}}")
        spans: list[list[int]] = []
        for c in range(0x80, 0x110000):
            ch = chr(c)
            if unicodedata.category(ch) == "Cn" and kind.match(ch):
                if len(enc.encode_ordinary(probe.decode() + ch)) != len(ch.encode()):
                    if spans and spans[-1][1] == c - 1:
                        spans[-1][1] = c
                    else:
                        spans.append([c, c])
        found[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return found


class Splitter:
    """Cuts texts into pre-tokens as the encoding library's pattern does."""

    def __init__(self, pattern: str, newer: dict[str, str]):
        self.plain = regex.compile(pattern)
        self.newer = None
        if any(newer.values()):
            exact = pattern
            every = ""
            for name, ranges in newer.items():
                if ranges:
                    every += ranges
                    # inside a negated class a newer character is added back, elsewhere it is taken out
                    exact = exact.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "@@").replace(f"\\p{{{name}}}", f"[\\p{{{name}}}--[{ranges}]]").replace("@@", "[^\\s\\p{L}\\p{N}]")
            exact = exact.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{every}]]")
            self.newer, self.exact = regex.compile(f"[{every}]"), regex.compile("(?V1)" + exact)

    def blocks(self, text: str, rare: bool, block: int = BLOCK) -> Iterator[list[str]]:
        """The pre-tokens of a text, some at a time. Only the last match of a cut can change with what follows
        it (every character is in some match), so it is taken again with the next block."""
        find = (self.exact if rare and self.newer and self.newer.search(text) else self.plain).findall
        at, n, step = 0, len(text), block
        while n - at > step:
            found = find(text, at, at + step)
            if len(found) == 1:
                step *= 2
                continue
            at += step - len(found.pop())
            step = block
            yield found
        if at < n:
            yield find(text, at, n)


class Coder:
    """A vocabulary in a worker: the perfect hash, the ranks, and a cache of merged pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, splitter: Splitter, cache: int = CACHE):
        self.ranks, self.table, self.splitter, self.limit = ranks, table, splitter, cache
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.cache: dict[bytes, list[int]] = {}

    def resolve(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a row, and how many each one has."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        kinds = coded.dictionary
        data, offsets = buffers(kinds)
        start, end = offsets[:-1], offsets[1:]
        key = self.table.find(data, start, end)
        size = np.ones(len(kinds), np.int64)
        raw = data.tobytes()
        misses = np.flatnonzero(key < 0)
        lists = []
        for i in misses.tolist():
            piece = raw[start[i] : end[i]]
            ids = self.cache.get(piece)
            if ids is None:
                ids = merged(piece, self.ranks)
                if len(self.cache) >= self.limit:
                    self.cache.clear()
                if len(piece) <= 256:
                    self.cache[piece] = ids
            size[i] = len(ids)
            lists.extend(ids)
        at = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int64)
        hit = key >= 0
        flat[at[hit]] = self.ids[key[hit]]
        flat[ragged(at[misses], size[misses])] = lists
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return flat[ragged(at[codes], size[codes])].astype(np.int32), size[codes]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        data, _ = buffers(texts)
        rare = bool((data >= 0xD5).any())  # the first byte of U+0558, the least that Unicode versions may dispute
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        pieces: list[str] = []
        counts: list[tuple[int, int]] = []

        def flush() -> None:
            if pieces:
                ids, size = self.resolve(pieces)
                ends = np.concatenate([[0], np.cumsum(size)])
                a = 0
                for row, n in counts:
                    out[row].append(ids[ends[a] : ends[a + n]])
                    a += n
                pieces.clear()
                counts.clear()

        for row, text in enumerate(texts.to_pylist()):
            for found in self.splitter.blocks(text, rare):
                pieces.extend(found)
                counts.append((row, len(found)))
                if len(pieces) >= FLUSH:
                    flush()
        flush()
        empty = np.zeros(0, np.int32)
        return [np.concatenate(x) if x else empty for x in out]


def encode(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: str | dict[bytes, int] = VOCABULARY,
    pattern: str | None = None,
    keep: list[str] | None = None,
    packed: bool = False,
) -> DataFrame:
    """``docs``' columns ``keep`` (default all) and ``ids``, the token ids of the whole text.

    ``ids`` is an array of ints, or with ``packed`` the same as little-endian unsigned 32-bit integers
    (binary). A column that has this name in any case is replaced. Null and empty texts have no ids;
    special strings in a text are ordinary text; repeated rows are coded alike; an empty table gives
    none. A very long text is cut into pre-tokens a block at a time; a single pre-token must fit in memory.
    """
    import public_tokenizers

    prepare(docs.sparkSession)
    ranks = vocabulary if isinstance(vocabulary, dict) else read_ranks(vocabulary)
    made = docs.sparkSession.sparkContext.broadcast(_parts(ranks, pattern or public_tokenizers.PATTERN))
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())

    def start():
        parts, table, newer, cut = made.value
        coder = Coder(parts, table, Splitter(cut, newer))

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = coder.encode(text_array(texts))
            if packed:
                return [pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))]

        return work

    return map_text(docs, text_col, [T.StructField("ids", kind)], start, keep=keep)


def _parts(ranks: dict[bytes, int], pattern: str) -> tuple:
    """What workers need of a vocabulary: bounded by its size."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"a byte-level vocabulary holds all single bytes; missing: {missing[:5]}")
    return ranks, PerfectHash(list(ranks)), newer_letters(pattern, ranks), pattern


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | dict[bytes, int] = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default all) and ``decoded``, the bytes of the ids (cast to string for text).

    ``ids_col`` is an array of ints or the packed form. Null ids decode to no bytes; an id that the
    vocabulary does not have is an error. A column that has the new name in any case is replaced.
    """
    prepare(df.sparkSession)
    ranks = vocabulary if isinstance(vocabulary, dict) else read_ranks(vocabulary)
    table = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded"]
    needed = kept if ids_col in kept else [*kept, ids_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])
    is_packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)

    def run(batches):
        by_id = {i: t for t, i in table.value.items()}
        size = np.zeros(max(by_id) + 2, np.int64)
        for i, t in by_id.items():
            size[i] = len(t)
        start = np.cumsum(size) - size
        arena = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(size))), np.uint8)
        for batch in batches:
            column = batch.column(needed.index(ids_col))
            own = [batch.column(needed.index(c)) for c in kept]
            if is_packed:
                rows = [(a, b, *buffers(pc.fill_null(column.slice(a, b - a), b""))) for a, b in chunks(pc.fill_null(column, b""))]
                rows = [(a, b, raw.view("<u4").astype(np.int64), ends // 4) for a, b, raw, ends in rows]
            else:
                lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                rows = [(0, len(column), pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lens)]))]
            for a, b, ids, ends in rows:
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] == 0).any()):
                    raise ValueError("an id without a token")
                raw = arena[ragged(start[ids], size[ids])].tobytes()
                at = np.concatenate([[0], np.cumsum(size[ids])])[ends].tolist()
                made = pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([x.slice(a, b - a) for x in own] + [made], names=[*kept, "decoded"])

    return df.select(*[f"`{c}`" for c in needed]).mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """The contract's digest columns of packed ids that were decoded again."""
    return df.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
