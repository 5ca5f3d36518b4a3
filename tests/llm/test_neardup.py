"""DartMinHash near-duplicates: estimates, links and classes against brute force."""

import random

import numpy as np
import pyarrow as pa

from quillscope.llm import neardup as ND
from quillscope.llm.components import connected_components


def _components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    pairs += [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(50)] + [(7000, 600 + i) for i in range(50)]
    pairs += [(900, 900), (None, 3), (901, 902), (902, 901), (901, 902)]
    df = spark.createDataFrame(pairs, "x long, y long")
    got = {r["node"]: r["root"] for r in connected_components(df, "x", "y").collect()}
    assert got == _components(pairs)
    assert connected_components(df.limit(0), "x", "y").count() == 0


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    el = rng.integers(1, 2**62, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 3, 300), rng.uniform(0.1, 3, 300)
    wb[:150] = wa[:150]
    row = np.repeat([0, 1], 300)
    sig, some = ND.dart_signature(row, np.concatenate([el, el]), np.concatenate([wa, wb]), 3, 2000)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    assert some.tolist() == [True, True, False]


def _plain_similarity(a, b):
    import re
    from collections import Counter

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = grams(a), grams(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def _corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(2000)]
    rows, k = [], 0
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 200, 900]))]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(t) // 60])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
    line = " ".join(rng.choice(vocab) for _ in range(12))
    rows += [(k, ". ".join([line] * 30)), (k + 1, ". ".join([line] * 29)), (k + 2, ". ".join([line] * 3))]
    rows += [(k + 3, None), (k + 4, None), (k + 5, ""), (k + 6, ""), (k + 7, " ., "), (k + 8, "one two"), (k + 9, "One, two!")]
    rows += [(k + 10, "same id again and again here"), (k + 10, "same id again and again here"), (None, "same id again and again here")]
    rows += [(None, "x " * 5000)]
    return rows


def test_classes_match_brute_force(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, id string, node int").repartition(5)
    documents, _ = ND.near_duplicates(docs)
    got = documents.collect()
    assert len(got) == len(rows)
    texts = sorted({t for _, t in rows if t is not None})
    assert np.allclose(
        ND.similarity(pa.array([a for a in texts for _ in texts]), pa.array(texts * len(texts))),
        [_plain_similarity(a, b) for a in texts for b in texts],
    )
    pairs = [(i, i) for i in range(len(texts))]
    pairs += [(i, j) for i in range(len(texts)) for j in range(i) if _plain_similarity(texts[i], texts[j]) >= 0.8]
    root = _components(pairs)
    cls = {}
    for d, t in rows:
        if t is not None:
            cls.setdefault(root[texts.index(t)], []).append(d)
    want = sorted((d, min((x for x in cls[root[texts.index(t)]] if x is not None), default=None) if t is not None else d) for d, t in rows if d is not None)
    assert sorted((r["id"], r["class_id"]) for r in got if r["id"] is not None) == want
    kept = ND.keep_one(docs)
    assert kept.columns == docs.columns
    out = [r["doc_id"] for r in kept.collect()]
    reps = [min((x for x in v if x is not None), default=None) for v in cls.values()] + [d for d, t in rows if t is None]
    assert sorted(out, key=str) == sorted(reps, key=str)
    assert ND.keep_one(docs.limit(0)).count() == 0


def test_shuffled_joins_give_the_same_classes(spark, monkeypatch):
    from quillscope.llm import components

    rows = _corpus()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((r["id"], r["class_id"]) for r in ND.near_duplicates(docs)[0].collect())
    monkeypatch.setattr(components, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(ND, "BROADCAST_ROWS", -1)
    assert sorted((r["id"], r["class_id"]) for r in ND.near_duplicates(docs)[0].collect()) == want
    assert len({c for _, c in want}) < len(want)


def _bands(spark, texts):
    keys = ND.band_keys(pa.array(texts), ND.BANDS, ND.ROWS, 5).to_pylist()
    return spark.createDataFrame(list(enumerate(keys)), "node long, keys array<long>")


def _groups(parts):
    groups = {}
    for r in parts.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    return sorted(map(sorted, groups.values()))


def test_small_buckets_are_settled(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    text = lambda: [word() for _ in range(100)]
    lead, unlike, other = text(), text(), text()
    near = lead[:90] + [word() for _ in range(10)]  # like the leader
    far = [word() for _ in range(10)] + near[10:]  # like ``near`` only
    x = text()
    y = x[:90] + [word() for _ in range(10)]
    texts = [" ".join(t) for t in (unlike, other, x, y, lead, near, far)]
    assert _plain_similarity(texts[4], texts[6]) < 0.8 <= min(_plain_similarity(texts[2], texts[3]), _plain_similarity(texts[5], texts[6]))
    # 0 and 1 have most company in the bucket of 2 and 3, 4 in that of 5 and 6
    rows = [(1, [0, 1, 2, 3])] + [(k, [0, 1]) for k in (2, 3, 4)]
    far_rows = [(10, [4, 5, 6])] + [(11, [4, 0])]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = spark.createDataFrame([(k, v, len(b)) for k, b in rows + far_rows for v in b], "key long, node long, n long")
    assert _groups(ND.linked(members, _bands(spark, texts), nodes, 0.8, 5)) == [[2, 3], [4, 5, 6]]
    assert ND.linked(members.where("key = 2"), _bands(spark, texts), nodes, 0.8, 5) is None


def test_pairs_of_a_wide_bucket_grow_with_its_rows(spark, monkeypatch):
    """2,000 unlike texts in one bucket, and like ones among them: no square of pairs, and the like ones are found."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = [[word() for _ in range(60)] for _ in range(2000)]
    texts += [t[:57] + ["end"] * 3 for t in texts[::40]]
    texts = [" ".join(t) for t in texts]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    members = spark.createDataFrame([(1, i, len(texts)) for i in range(len(texts))], "key long, node long, n long")
    seen, check = [], ND.verified

    def counting(pairs, *how):
        seen.append(pairs.count())
        return check(pairs, *how)

    monkeypatch.setattr(ND, "verified", counting)
    got = _groups(ND.linked(members, _bands(spark, texts), nodes, 0.8, 5))
    assert sum(seen) <= sum(map(len, ND.ROUNDS)) * len(texts)
    want = [[40 * j, 2000 + j] for j in range(50)]
    assert all(g in want for g in got) and len(got) >= 40  # one bucket only; in the operator a pair shares eight on average


def test_near_copies_of_a_large_group_come_together(spark):
    """400 texts with random edits of one: half of their pairs lie below the threshold."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    texts = [t for _, t in rows]
    sim = ND.similarity(pa.array([a for a in texts for _ in texts]), pa.array(texts * len(texts))).reshape(400, 400)
    root = _components([(i, j) for i in range(400) for j in range(i + 1) if sim[i, j] >= 0.8])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in ND.near_duplicates(docs)[0].collect()}
    assert sum(got[i] != root[i] for i in range(400)) <= 1 and (sim >= 0.8).mean() < 0.9


def test_wide_buckets_are_settled_exactly(spark):
    """Pairs of like texts among many unlike ones in one bucket: all are found, also where only one text of a pair's component fits."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [word() for _ in range(40)]  # unlike texts share a third of their words
    texts = [[word() for _ in range(80)] + common for _ in range(900)]
    texts += [t[:77] + ["end"] * 3 + t[80:] for t in texts[:300]]
    texts += [[word() for _ in range(12)] + t[12:] for t in texts[900:950]]  # like the edited text only
    texts = [" ".join(t) for t in texts]
    assert _plain_similarity(texts[900], texts[1200]) >= 0.8 > _plain_similarity(texts[0], texts[1200])
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    members = spark.createDataFrame([(1, i, len(texts)) for i in range(len(texts))], "key long, node long, n long")
    want = [[i, 900 + i, 1200 + i] if i < 50 else [i, 900 + i] for i in range(300)]
    assert _groups(ND.linked(members, _bands(spark, texts), nodes, 0.8, 5)) == want


def test_prefixes_make_few_rows_and_lose_no_pair(spark, monkeypatch):
    """One large group of edited texts: no pass makes a row of each shingle, and like texts share a key, however few the counters."""
    rng = random.Random(26)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(400)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").coalesce(2)
    sim = ND.similarity(pa.array([a for a in texts for _ in texts]), pa.array(texts * len(texts))).reshape(120, 120)
    written, write = [], ND.stored
    monkeypatch.setattr(ND, "stored", lambda df, name: written.append((name, write(df, name))) or written[-1][1])
    for few in (None, 7):
        if few:
            monkeypatch.setattr(ND, "SLOTS", few)
        keys = {}
        for r in ND.prefixes(docs, 0.8, 5).collect():
            assert r["size"] == 146 and r["at"] <= 29
            keys.setdefault(r["node"], {})[r["key"]] = r["at"]
        for i in range(120):
            for j in range(i):
                if sim[i, j] >= 0.8 and texts[i] != texts[j]:
                    both = set(keys[i]) & set(keys[j])
                    assert both and min(max(keys[i][k], keys[j][k]) for k in both) <= 29
    assert all(t.count() <= 30 * 120 for _, t in written)


def test_settling_takes_few_tables(spark, monkeypatch):
    """Unlike texts in a wide bucket: the buckets are drawn over once, then settled."""
    rng = random.Random(27)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(100)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").coalesce(2)
    members = spark.createDataFrame([(1, i, 100) for i in range(100)], "key long, node long, n long").coalesce(2)
    written, write = [], ND.stored
    monkeypatch.setattr(ND, "stored", lambda df, name: written.append(name) or write(df, name))
    assert ND.linked(members, _bands(spark, texts), nodes, 0.8, 5) is None
    assert written.count("parted") == 1 and len(written) < 32


def test_slot_counts_hand_on_few_rows(spark, monkeypatch):
    """Counts of many tasks with many slots each: a row a task and block leaves the tasks, and the counts are right."""
    rng = np.random.default_rng(28)
    keys = rng.integers(-(2**62), 2**62, (80, 500))
    keys[:, :200] = keys[0, :200]  # shared by all
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys.tolist())], "node long, keys array<long>").repartition(40)
    made, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    for total in (ND.SLOTS, 3 * ND.SLOT_BLOCK + 5, 7):
        want = np.bincount(ND.slots(keys.ravel(), total), minlength=total)
        assert (ND.slot_counts(df, total) == want).all()
    blocks = ND.SLOTS // ND.SLOT_BLOCK
    assert made[0].count() <= 40 * blocks < keys.size / 10 and made[1].count() <= blocks
    assert not ND.slot_counts(df.limit(0), 7).any()
