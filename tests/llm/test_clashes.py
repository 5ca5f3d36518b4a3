"""Extra columns whose names differ from an operator's own in case only; the mix against a plain computation."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillscope.llm import decontaminate as DC
from quillscope.llm import mixture as MX
from quillscope.llm import quality as QR
from quillscope.llm import tokens as TC
from tests.conftest import SF001

ROWS = [(1, "one two three", "s", 7), (1, "one two three", "s", 7), (2, None, None, 8), (None, "", "s", None)]


@pytest.mark.parametrize(
    "run, clash",
    [
        (TC.count_tokens, "N_Bytes"),
        (MX.mix, "Size"),
        (QR.quality, "N_Words"),
        (lambda d: DC.decontaminate(d, d.sparkSession.createDataFrame([(1, "one two")], "item_id long, text string")), "N_Words"),
        (lambda d: DC.decontaminate(d, d.sparkSession.createDataFrame([], "item_id long, text string")), "Hit_Items"),
    ],
)
def test_names_that_differ_in_case_are_replaced(spark, run, clash):
    docs = spark.createDataFrame(ROWS, f"doc_id long, text string, source string, {clash} int")
    out = run(docs)
    assert clash not in out.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    assert len(out.collect()) == len(ROWS) and run(docs.limit(0)).count() == 0


def _targets(sizes, weights, share, most):
    """The level at which the capped parts add up, by halving."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(w[s] * mid, most * sizes[s]) for s in order) < share * sum(sizes.values()):
            lo = mid
        else:
            hi = mid
    return {s: min(w[s] * hi, most * sizes[s]) for s in order}


def test_mix_equals_a_plain_computation(spark):
    """Keys, their order, the prefix sums and the epochs, row by row."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "source", "text")
    hot = spark.range(5000, 5400).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.concat_ws(" ", F.lit("x #"), F.col("id")).alias("text"))
    docs = docs.union(hot).repartition(4)
    hashed = docs.select("*", F.xxhash64("doc_id", "text", F.lit(MX.SEED)).alias("h")).collect()
    sources = defaultdict(list)
    for r in hashed:
        text = r["text"] or ""
        size = len([x for x in re.split(r"[\x20\x09-\x0D]+", text) if x])
        quality = (size + 1) / (size + 1 + 5 * sum(c in "#*$%&|<>" for c in text))
        u = (((r["h"] % 2**64) >> 11) + 0.5) * 2.0**-53
        sources[r["source"]].append((-math.log(u) / quality, r["doc_id"], size))
    sizes = {s: sum(x[2] for x in rows) for s, rows in sources.items()}
    goal = _targets(sizes, (5, 2, 1), 1.5, 2)
    want = {}
    for s, rows in sources.items():
        epochs = min(2, int((goal[s] + 1e-6) // sizes[s])) if sizes[s] else 0
        rest = int(goal[s] + 1e-6 - epochs * sizes[s]) if epochs < 2 else 0
        for _, doc, size in sorted(rows):
            take = min(size, rest)
            want[doc] = (size, sizes[s], epochs * size + take)
            rest -= take
    got = {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in MX.mix(docs).collect()}
    assert got.keys() == want.keys()
    wrong = [d for d in want if got[d] != want[d]]
    assert not wrong, [(d, got[d], want[d]) for d in wrong[:3]]
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-3 for r in MX.mix(docs).select("source", "target").distinct().collect())
