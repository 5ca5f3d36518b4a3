"""The pipeline stage by stage against plain Python on the smallest fixture."""

import re
from collections import Counter

import corpus_pipeline as P
from quillscope.llm import decontaminate as DC
from quillscope.llm import mixture as MX
from quillscope.llm import secrets as SS
from tests.conftest import SF001
from tests.llm.test_neardup import _components, _plain_similarity
from tests.llm.test_quality_mix_urls import _measures


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = sorted(_rows(docs), key=lambda r: r["doc_id"])
    columns, out = docs.columns, docs
    # quality: no host of the fixture is bad enough to be rejected
    out = P.quality_rules(spark, out, SF001)
    rows = [r for r in rows if not _measures(r["text"])[-1]]
    assert out.columns == columns and sorted(_rows(out), key=lambda r: r["doc_id"]) == rows
    # near copies
    out = P.minhash_near_dedup(spark, out, SF001)
    n = len(rows)
    words = [set(re.findall(r"\w+", r["text"].lower())) for r in rows]
    pairs = [(i, i) for i in range(n)]
    for i in range(n):
        for j in range(i):
            if len(words[i] & words[j]) * 2 > max(len(words[i]), len(words[j])) and _plain_similarity(rows[i]["text"], rows[j]["text"]) >= 0.8:
                pairs.append((i, j))
    root = _components(pairs)
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    assert out.columns == columns and sorted(_rows(out), key=lambda r: r["doc_id"]) == rows and len(rows) < n
    # benchmark
    out = P.benchmark_decontamination(spark, out, SF001)
    hit = DC.brute_force([(r["doc_id"], r["text"]) for r in rows], items)
    assert any(v[-1] for v in hit.values())
    rows = [r for r in rows if not hit[r["doc_id"]][-1]]
    assert out.columns == columns and sorted(_rows(out), key=lambda r: r["doc_id"]) == rows
    # secrets
    out = P.secret_scan(spark, out, SF001)
    for r in rows:
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in SS.find_secrets(r["text"])[1])
        for s, e in reversed([x for k, x in enumerate(spans) if all(x[0] >= y[1] for y in spans[:k])]):
            r["text"] = r["text"][:s] + "[secret]" + r["text"][e:]
    got = sorted(_rows(out), key=lambda r: r["doc_id"])
    assert out.columns == columns and got == rows
    # mix
    out = _rows(P.mix_sources(spark, out, SF001))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    goal, taken = MX.targets(dict(sizes)), Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    assert all(goal[s] - 2 < taken[s] <= goal[s] for s in sizes)


def test_run_and_empty_table(spark, tmp_path):
    got = P.run(spark, SF001)
    assert got.columns[-4:] == ["size", "source_size", "target", "taken"] and got.count() > 50
    spark.read.parquet(f"{SF001}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF001}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 1, "a", "b"), (2, "one two " * 3, "s", 2, "a", "b"), (None, " ".join(f"w{i}" for i in range(40)), None, 3, None, None),
         (3, " ".join(f"x{i}" for i in range(40)), "s", 4, "k", "")],
        "doc_id long, text string, source string, n_words int, kept string, hit_words string",
    )
    out = docs
    for name, stage in P.STAGES[:4]:
        out = stage(spark, out, SF001)
        assert out.columns == docs.columns, name
    assert sorted((r["n_words"] for r in out.collect())) == [3, 4]
