"""Benchmark decontamination against brute force, and the index against plain search."""

import numpy as np
import pyarrow as pa

from quillscope.llm import decontaminate as DC
from quillscope.llm.common import Words, shingles
from tests.conftest import SF001

ROWS = [
    (1, None), (2, ""), (3, "  ,.; "), (4, "Alpha beta gamma"), (5, "x alpha BETA gamma y é ü z"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (7, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3),
    (8, "solo"), (9, "ß " * 3000 + "solo"), (None, "alpha beta gamma"), (10, "a b a b a b a b a b a b a b a b a b"),
]
ITEMS = [
    ("i1", "alpha beta gamma"), ("i2", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    ("i3", "a b a b a b a b a b a b a"), ("i4", None), ("i5", "..."), ("i6", "solo"), ("i6", "solo"),
    (None, "alpha beta gamma"),
]


def _result(df):
    return sorted(map(tuple, DC.digest(df).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def _expected(rows, items):
    out = []
    for d, t in rows:
        out.append((d, *DC.brute_force([(d, t)], items)[d]))
    return sorted(out, key=str)


def test_edge_rows_one_and_many_blocks(spark):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in ROWS], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert _result(DC.decontaminate(docs, bench)) == _expected(ROWS, ITEMS)
    assert _result(DC.decontaminate(docs, bench, block_phrases=5, keep=["doc_id"])) == _expected(ROWS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert DC.decontaminate(docs.limit(0), bench).count() == 0
    assert _result(DC.decontaminate(docs, bench.limit(0))) == _expected(ROWS, [])


def test_char_spans_hold_the_phrase(spark):
    docs = spark.createDataFrame([(1, "é Ü. alpha, Beta gamma! rest")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    r = DC.decontaminate(docs, bench).first()
    (s,) = r["hit_chars"]
    assert r["text"][s["start"] : s["end"]] == "alpha, Beta gamma"


def test_sf0001_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    rows, items = [tuple(r) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()]
    assert _result(DC.decontaminate(docs, bench, keep=["doc_id"])) == _expected(rows, items)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    seq = np.concatenate([rng.integers(1, 5, 400), [0]])
    index = DC.FMIndex(seq)
    pats = [seq[i : i + n] for i, n in zip(rng.integers(0, 380, 40), rng.integers(1, 9, 40))] + [np.array([4, 4, 4, 4, 4, 4, 4])]
    sizes = np.array([len(p) for p in pats])
    grid = np.zeros((len(pats), 9), np.int64)
    for k, p in enumerate(pats):
        grid[k, : len(p)] = p
    alive, lo, hi = index.search(grid, sizes)
    got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(alive, lo, hi)}
    for k, p in enumerate(pats):
        want = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
        assert got.get(k, []) == want


def test_words_and_shingles():
    texts = pa.array(["Ab c", "", "c", "ab C d e f g"])
    w = Words(texts)
    assert w.count.tolist() == [2, 0, 1, 6]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] == w.hash[4]
    row, h = shingles(w, 5)
    assert row.tolist() == [0, 2, 3, 3] and len(set(h.tolist())) == 4
