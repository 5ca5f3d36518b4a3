"""Secret scans through nested encodings.

Every text is scanned by three patterns. Then what looks encoded in it is decoded, and each decoded layer joins
a worklist: it is scanned and unwrapped in turn until nothing new comes up. A layer seen before at its place
(by digest) is not entered again, which ends cycles. The decoders:

* percent escapes, and backslash escapes and character references, undone over the whole layer;
* base64, plain or URL-safe, also broken over lines, and from each of the four positions in a group, as a
  path or a prefix may be glued to it. Decoded bytes are read as UTF-8, else Latin-1, and as UTF-16;
* gzip (all members), zlib and bzip2 data anywhere in decoded bytes, and in one another.

A layer keeps where its pieces come from, as few numbers as it has escapes, so spans of findings are mapped back to
code points of the original text: exactly through escapes, to the whole encoded part through base64.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import map_text, packed, prepare, text_array, unpacked

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as [0-9a-f]+ of 24 or more
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: what holds every hex run of 24, key of 20 or base64 part of 16 characters or more
LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&(quot|amp|apos|lt|gt|equals|colon);"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: the shortest finding has 12 characters, all of ASCII, as have the encodings; other bytes hold nothing
ASCII = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")
UTF16 = (("utf-16-le", re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}")), ("utf-16-be", re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){12,}")))
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
LAYER_BYTES = 64 << 20  # compressed data that unfold further are scanned up to here and counted in n_bombs
NESTED = 64  # compressed data in one another, likewise

FIELD = T.StructField(
    "secrets",
    T.StructType(
        [
            T.StructField("base", T.ArrayType(T.StringType())),  # kind:start:end of the text itself
            T.StructField("all", T.ArrayType(T.StringType())),  # with those of decoded layers
            T.StructField("via", T.ArrayType(T.StringType())),  # the way to each of all: "", "url", "base64>gzip"
            T.StructField("n_layers", T.LongType()),
            T.StructField("n_bombs", T.LongType()),
        ]
    ),
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns in one layer, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in LONG.finditer(text):
        part, at = run[0], run.start()
        if "AKIA" in part:
            out += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= 20]
        out += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part)]
    return sorted(out)


class Layer:
    """A decoded text and where it comes from in the layer above.

    Piece i begins at character ``at[i]``; it is a copy of the characters from ``start[i]`` on, or
    (``end[i]`` > 0) what ``start[i]`` to ``end[i]`` decode to as a whole. The original text has no layer above.
    """

    __slots__ = ("text", "above", "at", "start", "end", "via")

    def __init__(self, text: str, above: Layer | None = None, pieces: list[tuple[int, int, int]] = (), how: tuple[str, ...] = ()):
        self.text, self.above = text, above
        self.at, self.start, self.end = (np.array(x, np.int64) for x in zip(*pieces)) if pieces else (None, None, None)
        self.via = how if above is None else (*above.via, *how)

    def place(self, start: int, end: int) -> tuple[int, int]:
        """Characters ``start`` to ``end`` in the original text."""
        layer = self
        while layer.above is not None:
            i, j = np.searchsorted(layer.at, [start, end - 1], "right") - 1
            start = int(layer.start[i] + (0 if layer.end[i] else start - layer.at[i]))
            end = int(layer.end[j] or layer.start[j] + end - layer.at[j])
            layer = layer.above
        return start, end


def _percent(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with percent escapes undone, and its pieces."""
    out, pieces, at, n = [], [], 0, 0
    for m in PERCENT.finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
            pieces.append((n, at, 0))
            n += m.start() - at
        k = 0
        for c in unquote_to_bytes(m[0]).decode("utf-8", "replace"):
            size = len(c.encode()) if c != "\ufffd" else 1
            pieces.append((n, min(m.start() + 3 * k, m.end() - 3), min(m.start() + 3 * (k + size), m.end())))
            out.append(c)
            n, k = n + 1, k + size
        at = m.end()
    if at < len(text):
        out.append(text[at:])
        pieces.append((n, at, 0))
    return "".join(out), pieces


def _escapes(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with backslash escapes and character references undone, and its pieces."""
    out, pieces, at, n = [], [], 0, 0
    for m in ESCAPE.finditer(text):
        code = next((int(g, 10 if k == 4 else 16) for k, g in enumerate(m.groups()[:6]) if g), None)
        if code is None:
            c = html.unescape(m[0])
        elif code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        else:
            c = chr(code)
        if m.start() > at:
            out.append(text[at : m.start()])
            pieces.append((n, at, 0))
            n += m.start() - at
        out.append(c)
        pieces.append((n, m.start(), m.end()))
        n, at = n + len(c), m.end()
    if at < len(text):
        out.append(text[at:])
        pieces.append((n, at, 0))
    return "".join(out), pieces


def _unpack(data: bytes | memoryview) -> tuple[str, bytes, bool] | None:
    """(kind, content, whether more would follow) of gzip (all members), zlib or bzip2 data at the start of ``data``."""
    kind = "gzip" if data[:2] == b"\x1f\x8b" else "bzip2" if data[:3] == b"BZh" else "zlib"
    out, room = [], LAYER_BYTES
    while data and room > 0:
        d = bz2.BZ2Decompressor() if kind == "bzip2" else zlib.decompressobj(31 if kind == "gzip" else 15)
        try:
            part = d.decompress(data, room)
        except (zlib.error, OSError, ValueError, EOFError):
            break
        out.append(part)
        room -= len(part)
        if not d.eof:  # cut off, or no room
            return kind, b"".join(out), room <= 0
        data = d.unused_data
        if kind == "zlib" or data[:2] not in (b"\x1f\x8b", b"BZ"):
            break
        if room <= 0:
            return kind, b"".join(out), True
    return (kind, b"".join(out), False) if out else None


def _contents(data: bytes) -> Iterator[tuple[tuple[str, ...], str]]:
    """The texts that decoded bytes may be, with what they are encoded by beside UTF-8."""
    if ASCII.search(data):
        try:
            yield (), data.decode("utf-8")
        except UnicodeDecodeError:
            yield (), data.decode("latin-1")
    if b"\x00" in data:
        for name, pattern in UTF16:
            for m in pattern.finditer(data):
                yield ("utf-16",), m[0].decode(name)


def _unfolded(data: bytes, bombs: list[int], depth: int = 0, known: set[bytes] | None = None) -> Iterator[tuple[tuple[str, ...], str]]:
    """The texts in decoded bytes and in compressed data anywhere in them; ``bombs`` counts what is cut.

    The same content by two ways (stored data show through their container) is unfolded once.
    """
    known = set() if known is None else known
    yield from _contents(data)
    for m in PACKED.finditer(data):
        found = _unpack(memoryview(data)[m.start() :])
        if found is None:
            continue
        kind, content, cut = found
        key = hashlib.sha256(content).digest()
        if key in known:
            continue
        known.add(key)
        bombs[0] += cut or depth + 1 >= NESTED
        if depth + 1 < NESTED:
            for how, text in _unfolded(content, bombs, depth + 1, known):
                yield (kind, *how), text


def _parts(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 parts with their places. Of those over several lines also without the last one and two, which may be words."""
    for m in BASE64.finditer(text):
        yield m.start(), m.end(), m[0].rstrip("=")
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = list(LINE.finditer(m[0]))
            for n in range(len(lines), max(len(lines) - 3, 1), -1):
                end = m.end() if n == len(lines) else m.start() + lines[n - 1].end()
                yield m.start(), end, "".join(x[0] for x in lines[:n])


def unwrap(layer: Layer, bombs: list[int]) -> Iterator[Layer]:
    """The layers directly under one layer, one at a time; ``bombs`` counts what is cut at ``LAYER_BYTES`` or ``NESTED``."""
    text = layer.text
    if "%" in text and PERCENT.search(text):
        plain, pieces = _percent(text)
        yield Layer(plain, layer, pieces, ("url",))
    if ("\\" in text or "&" in text) and ESCAPE.search(text):
        plain, pieces = _escapes(text)
        if plain and plain != text:
            yield Layer(plain, layer, pieces, ("unicode",))
    for start, end, part in _parts(text):
        body = part.replace("-", "+").replace("_", "/")
        for k in range(4):
            n = len(body) - k
            n -= n % 4 == 1
            data = binascii.a2b_base64(body[k : k + n] + "=" * (-n % 4))
            for how, plain in _unfolded(data, bombs):
                yield Layer(plain, layer, [(0, start + k, end)], ("base64", *how))
            if k == 0 and ASCII.fullmatch(data):
                break  # text from the first to the last character


def find_secrets(text: str) -> tuple[list[str], list[str], list[str], int, int]:
    """Base findings, all findings, their ways, layers and cut layers of one text."""
    base = scan(text)
    found = {(s, k, e): "" for s, k, e in base}
    layers, bombs = 0, [0]
    if _encoded(text):
        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
        seen = {digest(text)}
        todo = [unwrap(Layer(text), bombs)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                continue
            plain = digest(x.text)
            key = (plain, x.place(0, 1)[0])
            if key in seen or plain in seen:
                continue
            seen.add(key)
            layers += 1
            for s, k, e in scan(x.text):
                a, b = x.place(s, e)
                found.setdefault((a, k, b), ">".join(x.via))
            if _encoded(x.text):
                todo.append(unwrap(x, bombs))
    every = sorted(found)
    name = lambda x: f"{KINDS[x[1]]}:{x[0]}:{x[2]}"
    return [name(x) for x in base], [name(x) for x in every], [found[x] for x in every], layers, bombs[0]


def _encoded(text: str) -> bool:
    """Whether any decoder could find a part of its kind."""
    return bool(("%" in text and PERCENT.search(text)) or (("\\" in text or "&" in text) and ESCAPE.search(text)) or BASE64.search(text))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default all) with the struct ``secrets`` (replacing such a column).

    One narrow pass; null and empty texts hold none, repeated rows are scanned alike, an empty table
    gives none. Texts of any length are scanned whole, but compressed data that unfold to more than
    ``LAYER_BYTES``, or ``NESTED`` times, only so far (counted in ``n_bombs``).
    """
    prepare(docs.sparkSession)

    def start():
        kind = pa.struct(
            [("base", pa.list_(pa.string())), ("all", pa.list_(pa.string())), ("via", pa.list_(pa.string())), ("n_layers", pa.int64()), ("n_bombs", pa.int64())]
        )

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [find_secrets(t) for t in text_array(texts).to_pylist()]
            return [pa.array([dict(zip(("base", "all", "via", "n_layers", "n_bombs"), r)) for r in rows], kind)]

        return work

    return map_text(docs, text_col, [FIELD], start, keep=keep)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` (same columns) with every finding's span of the text replaced by ``mark``; overlapping
    spans are one. Null texts stay null."""
    prepare(docs.sparkSession)

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for t in text_array(texts).to_pylist():
                spans = sorted(tuple(map(int, x.split(":")[1:])) for x in find_secrets(t)[1])
                parts, at = [], 0
                for s, e in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]))
            return [pa.array(out, pa.string())]

        return work

    done = map_text(packed(docs, text_col), "_text", [T.StructField("_clean", T.StringType())], start)
    done = done.withColumn("_clean", F.when(F.col("_text").isNotNull(), F.col("_clean")))
    return unpacked(done, docs.columns, text_col, "_clean")


def digest(df: DataFrame) -> DataFrame:
    """The contract's digest columns of ``scan_secrets``' result."""
    base = F.col("secrets.base")
    count = lambda k: F.size(F.filter(base, lambda x: F.startswith(x, F.lit(k + ":")))).cast("bigint")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", "secrets.all").alias("spans"),
        F.col("secrets.n_layers").alias("n_layers"),
        F.col("secrets.n_bombs").alias("n_bombs"),
    )
