"""Token counts by a two-tier lookup on the map side.

A sentencepiece BPE whose pieces never join a character to a following space mark can be counted by
pre-token: a run of spaces and the characters up to the next space. A first pass sums
each task's heavy hitters (Misra-Gries summaries of all its pre-tokens, at most ``SUMMARY``
rows a task); the ``FREQUENT`` most frequent ones are encoded once and broadcast with their
lengths. The counting pass looks pre-tokens up there, then in a bounded cache of the worker,
and encodes what neither has. Texts are never shuffled, only these summaries are, and the tables only save work:
the counts don't depend on them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscope.llm.common import map_text, prepare, text_array

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
FREQUENT = 32_768  # pre-tokens broadcast
SUMMARY = 4096  # counters of a task's summary
CACHE = 250_000  # pre-tokens in a worker's cache
LONGEST = 64  # characters of a pre-token that is worth a place in a table
MARK = "▁"
_RUNS = re.compile(r" +[^ ]*")


def model_bytes(model: str | bytes = MODEL) -> bytes:
    """A model's content; a name is looked up among the public tokenizers."""
    if isinstance(model, bytes):
        return model
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as f:
        return f.read()


def processor(proto: bytes):
    """The library's encoder, if its pre-tokens can be counted apart."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    probe = " ﬁ  Å 　x\n y "
    same = "".join(x for x in sp.encode(probe, out_type=str) if not x.startswith("<0x"))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or same.count(MARK) != probe.count(" ") + 1 or "ﬁ" not in same:
        raise ValueError("this model's tokens can't be counted by pre-token")
    return sp


def pre_tokens(text: str) -> list[str]:
    """Parts of a text that are encoded apart, without the space that the encoder puts in front."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ") if text else []


class Lengths(dict):
    """Tokens of a pre-token: the frequent ones, and a bounded cache of others."""

    def __init__(self, proto: bytes, frequent: dict[str, int], limit: int = CACHE):
        super().__init__(frequent)
        self.encode = processor(proto).encode
        self.base, self.limit = frequent, limit + len(frequent)
        self[""] = 1  # a lone space at the end

    def __missing__(self, key: str) -> int:
        n = len(self.encode(key))
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.base)
                self[""] = 1
            self[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


class Summary:
    """Misra-Gries counters: every pre-token of more than 1/size of all is among them."""

    def __init__(self, size: int = SUMMARY):
        self.size, self.counts = size, Counter()

    def add(self, items: list[str]) -> None:
        self.counts.update(items)
        if len(self.counts) > 16 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - cut for k, n in self.counts.items() if n > cut})


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, by the tasks' summaries."""

    def run(batches):
        s = Summary()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    s.add([x for x in pre_tokens(text) if len(x) <= LONGEST])
        s.shrink()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(s.counts), pa.string()), pa.array(list(s.counts.values()), pa.int64())], names=["t", "n"]
        )

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(run, "t string, n long")
    top = found.groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(most)
    return [r["t"] for r in top.collect()]


_workers: dict[str, Lengths] = {}


def count_tokens(
    docs: DataFrame, text_col: str = "text", model: str | bytes = MODEL, limit: int = LIMIT, keep: list[str] | None = None
) -> DataFrame:
    """``docs``' columns ``keep`` (default all) with ``n_bytes, n_tokens, over_limit`` (replacing such columns).

    Null and empty texts have no tokens. Special strings in a text are ordinary text, as the
    library treats them. Repeated rows are counted alike; an empty table gives none.
    """
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    proto = model_bytes(model)
    sp = processor(proto)
    words = frequent_pre_tokens(docs, text_col)
    name = uuid.uuid4().hex  # a worker keeps its cache from task to task of this count
    table = sc.broadcast((proto, {w: len(x) for w, x in zip(words, sp.encode(words))} if words else {}))

    def start():
        lengths = _workers.get(name)
        if lengths is None:
            _workers.clear()
            lengths = _workers[name] = Lengths(*table.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([lengths.count(t) for t in text_array(texts).to_pylist()], pa.int64())]

        return work

    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*[f"`{c}`" for c in {**dict.fromkeys(own), text_col: 0}], F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = map_text(rows, text_col, [T.StructField("n_tokens", T.LongType())], start, keep=[*own, "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
