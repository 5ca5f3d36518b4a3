"""Ranked search against a plain scan of all documents."""

import pyarrow as pa

from quillscope.llm import ranked as RS

DOCS = [
    (1, "red Fox jumps"), (2, "RED fox jumps"), (3, "fox fox red jumps over"), (4, None), (5, ""), (6, "..."), (7, "été fox"), (None, "red fox jumps"),
    (9, "nothing here"), (10, "red fox jumps"), (10, "red fox jumps"), (11, "red " * 30_000 + "end"), *((i, "jumps red fox") for i in range(100, 160)),
    (12, "a-b_c d1 1d"), (13, "É été"), (0, "red fox jumps"), (-5, "fox"),
]
ITEMS = [("x", "red fox"), ("x", "red fox"), (None, "fox red red"), ("n", None), ("e", ""), ("q", "été B 1d"), ("z", "unknownterm"), ("y", "over the fox")]


def _rows(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, Score string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
    out = RS.search(d, q, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_brute_force(spark):
    for top in (10, 3, 100):
        assert _rows(spark, DOCS, ITEMS, top=top) == sorted(RS.brute_force(DOCS, ITEMS, top), key=repr)


def test_blocks_and_steps_do_not_change_the_result(spark, monkeypatch):
    whole = _rows(spark, DOCS, ITEMS)
    monkeypatch.setattr(RS, "BLOCK_ITEMS", 2)
    assert _rows(spark, DOCS, ITEMS) == whole
    monkeypatch.setattr(RS, "BLOCK_TERMS", 1)
    assert _rows(spark, DOCS, ITEMS) == whole


def test_empty_tables(spark):
    assert _rows(spark, [], ITEMS) == [] and _rows(spark, DOCS, []) == [] and _rows(spark, [(1, None)], ITEMS) == []


def test_copies_are_scored_once_and_keep_their_least_ids(spark):
    bag = spark.createDataFrame([(i, 3, bytearray(8)) for i in [*range(500, 0, -1), None]] + [(900, 4, bytearray(8)), (901, 3, bytearray())], "doc_id long, n long, bag binary")
    got = RS.classes(bag.repartition(7), 502, 1507, 10).orderBy("m").collect()
    assert [r["ids"] for r in got] == [list(range(1, 11)), [900]]


def test_steps_of_a_task_keep_the_best():
    import numpy as np

    weight, postings = np.array([5]), (np.array([0, 1]), np.array([0]), np.array([1]))
    one = [(m, d) for m, d in [(30, 9), (25, 8), (25, 3), (40, 1), (25, None), (25, 7)]]
    bag = pa.array([np.array([[0, 1]], "<i4").tobytes()] * len(one), pa.binary())
    for step in (1, 2, 6):
        s = RS.Scorer(weight, postings, 1, 2)
        for a in range(0, len(one), step):
            s.add(np.array([m for m, _ in one[a : a + step]]), bag.slice(a, step), [[d] for _, d in one[a : a + step]])
        assert s.rows()[1].to_pylist() == [3, 7]
