"""Quality rules, the mix of sources and URL filters on edge rows."""

import math
import random
import re
from collections import Counter

import pytest

from quillscope.llm import mixture as MX
from quillscope.llm import quality as QR
from quillscope.llm import urls as UF


def _measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit),
            n < 10 or 100 * len(hit) > 20 * n)


TEXTS = [
    None, "", " \t\n ", "a b c", "a\n\n \nb\na\nb", "\u00a0 é \u3000x " * 6, "a b c d e " * 40, "one two three four five six # $ |\r\n" * 3,
    "w x y z q " + " ".join(f"k{i}" for i in range(60)) + " w x y z q", " ".join(f"u{i % 977}v{i}" for i in range(20000)),
    " lead " + " ".join(f"m{i}" for i in range(12)), "x x x x x x", " ".join("ab" for _ in range(9)),
]


def test_measures(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}" if i % 4 else None, t, 5) for i, t in enumerate(TEXTS)] + [(3, None, TEXTS[3], 5)],
                                 "doc_id long, source string, text string, n_words int")
    got = QR.quality(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r[c] for c in QR.MEASURES) == _measures(r["text"]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"])
    assert QR.quality(docs.limit(0)).count() == 0
    kept = QR.filter_rejected(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in enumerate(TEXTS) if not _measures(t)[-1])


def test_bad_host_loses_its_good_documents_and_small_hosts_are_shrunk(spark):
    good = lambda i: " ".join(f"g{i}w{k}" for k in range(20))
    rows = [(i, "bad", "too short" if i % 20 else good(i)) for i in range(200)]
    rows += [(1000 + i, f"h{i % 10}", good(i)) for i in range(400)] + [(2000, "tiny", "short"), (2001, "tiny2", good(1))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in QR.quality(docs).collect()}
    assert not any(got[i]["kept"] for i in range(200)) and not got[20]["base_failed"]
    assert got[2001]["kept"] and all(got[1000 + i]["kept"] for i in range(400))


def test_targets_cap_and_share():
    t = MX.targets({"a": 10, "b": 1000, "c": 1000, None: 0})
    assert t["a"] == 20 and t[None] == 0
    assert math.isclose(sum(t.values()), 1.5 * 2010) and math.isclose(t["b"], 2 * t["c"])
    assert MX.targets({}) == {} and MX.targets({"a": 0}) == {"a": 0.0}


@pytest.mark.parametrize("sort_rows", [100_000, 3])
def test_mix_takes_the_targets(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(MX, "SORT_ROWS", sort_rows)
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", "y", "z", None, "ü"]), " ".join("w" for _ in range(rng.randrange(0, 60)))) for i in range(900)]
    rows += [(5000, "x", "dup row " * 5)] * 7 + [(None, "y", "no id here")] * 3 + [(6000, "one", "a b c d"), (6001, "none", None), (6002, "none", " ")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, source string, text string, target double").repartition(6)
    got = MX.mix(docs).collect()
    assert len(got) == len(rows) and got == MX.mix(docs).collect()
    sizes = Counter()
    for d, s, t in rows:
        sizes[s] += len((t or "").split())
    goal = MX.targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], goal[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert goal[s] - 8 < taken[s] <= goal[s], s
    # a fraction comes after complete epochs, in the order of the keys
    epochs = {s: min(2, int(goal[s] // sizes[s])) for s in sizes if sizes[s]}
    assert all(r["taken"] >= epochs[r["source"]] * r["size"] for r in got if r["size"])
    assert MX.mix(docs.limit(0)).count() == 0
    narrow = MX.mix(docs, keep=["doc_id"]).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in narrow) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "s" if i < 4000 else "t", "a b c d e" if i % 2 else "# b $ d |") for i in range(8000)],
                                 "doc_id long, source string, text string")
    got = [r for r in MX.mix(docs, weights=(1, 1), share=0.5).collect()]
    clean = sum(r["taken"] for r in got if r["doc_id"] % 2)
    assert clean > 2 * sum(r["taken"] for r in got if not r["doc_id"] % 2)


PAGES = [
    (1, "http://A.Example.COM/en/x?q#f", None, "example.com/en/", "block"),
    (2, "https://www.example.com/en/", "", "www.example.com/en/", "allow"),
    (3, "https://x.www.example.com/en/a", "", "www.example.com/en/", "allow"),
    (4, "https://notexample.com/en/", "", "com/", "allow"),
    (5, "http://example.com", "", None, "allow"),
    (6, "http://foo.net/es/1", "", "net/es/", "block"),
    (7, None, "<link rel=canonical href=http://foo.net/es/1>", None, "allow"),
    (8, "no scheme", "", None, "allow"),
    (9, "http://foo.org/a", '<LINK href="http://foo.net/es/1" rel="canonical">', None, "block"),
    (10, "http://foo.org/b/c", "<link rel='canonical' href='../x'><meta http-equiv=refresh content='0; url=//foo.org/a'>", None, "block"),
    (11, "http://foo.org/d", "<link rel=canonical href=/e>", None, "allow"),
    (12, "http://foo.org/e", "", None, "allow"),
    (13, "http://bar.org/1", "<link rel=canonical href='http://foo.net/fr/2'>", None, "allow"),
    (14, "http://www.example.com/en/ok", "<link rel=canonical href='http://bar.org/1'>", "www.example.com/en/", "allow"),
    (15, "http://foo.net/fr/2", "", "net/fr/", "block"),
    (15, "http://foo.net/fr/2", "", "net/fr/", "block"),
    (16, "x://h://y/z", "", None, "allow"),
    (17, "http://r.org/z", "", None, "block"),
    (None, "http://É.NET/es/" + "a" * 50000, "x" * 100000, "net/es/", "block"),
]


def test_url_rules_and_aliases(spark):
    df = spark.createDataFrame([(*p[:3], "clash") for p in PAGES], "page_id long, url string, html string, host string").repartition(3)
    red = spark.createDataFrame([("http://r.org/z", "http://foo.org/a"), (None, "http://a.b/c"), ("http://a.b/c", None)], "from_url string, to_url string")
    got = sorted(((r["id"], r["rule"], r["verdict"]) for r in UF.url_filter(df, redirects=red).collect()), key=str)
    assert got == sorted(((p[0], p[3], p[4]) for p in PAGES), key=str)
    by = {r["id"]: r for r in UF.url_filter(df).collect()}
    assert (by[1]["host"], by[1]["path"]) == ("a.example.com", "/en/x") and (by[7]["host"], by[8]["path"]) == ("", "")
    assert by[16]["host"] == "h:" and by[17]["verdict"] == "allow"
    assert UF.url_filter(df.limit(0)).count() == 0


def test_url_sql_agrees_on_edge_rows(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    pages = pd.DataFrame([p[:3] for p in PAGES if p[0] is not None], columns=["page_id", "url", "html"])  # noqa: F841
    con.register("pages", pages)
    want = sorted(con.execute(UF.SQL).fetchall(), key=str)
    df = spark.createDataFrame([p[:3] for p in PAGES if p[0] is not None], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in UF.url_filter(df).collect()), key=str)
    assert got == want
