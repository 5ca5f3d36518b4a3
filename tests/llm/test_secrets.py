"""Secret scans: base spans against the plain patterns, layers against built examples."""

import base64
import bz2
import gzip
import hashlib
import re
import zlib

from quillscope.llm import secrets as SS
from quillscope.llm.queries import QUERIES
from tests.conftest import SF001

KEY = "AKIA" + "ABCD1234EFGH5678"
SECRET = 'password = "hunter2secretvalue"'
HEXES = "0123456789abcdef" * 2


def _plain(t):
    pats = [(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]
    out = []
    for k, (p, least, g) in enumerate(pats):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= least]
    return [f"{SS.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def _b64(b):
    return base64.b64encode(b).decode()


def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op1_secret_scan"](spark, SF001).collect():
        want = _plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in want) for k in SS.KINDS]
        assert set(want) <= set(r["spans"].split(",")) or not want


def test_base_edges():
    for t in ["token=short", "TOKEN : 'abcdef'", "token token=abcdefg secret:abc password=abcdef.gh=-", "xAKIA" + "A" * 15, "AKIAAKIA" + "A" * 16,
              "a" * 23, "a" * 24 + "G" + "f" * 30, "api-key=abcdefg apikey='zzzzzz api_key: yyyyyy", "pa\u017f\u017fword=abcdefgh", "to\u212aen=abcdefgh", "token" + " " * 5000 + "= abcdef"]:
        assert SS.find_secrets(t)[0] == _plain(t), t


def test_layers_are_unwrapped_and_mapped():
    once = _b64(f"x {SECRET} y".encode())
    cases = {
        f"é go {once} end": (once, "base64"),
        "q " + _b64(gzip.compress(f"some text {KEY} here".encode())): (None, "base64>gzip"),
        "q " + _b64(zlib.compress(f"some text {KEY} here".encode())): (None, "base64>zlib"),
        "q " + _b64(bz2.compress(f"some text {KEY} here".encode())): (None, "base64>bzip2"),
        "u " + "".join(f"%{b:02X}" for b in _b64(_b64(f"{HEXES} is hex".encode()).encode()).encode()) : (None, "url>base64>base64"),
    }
    for text, (part, via) in cases.items():
        base, every, ways, layers, bombs = SS.find_secrets(text)
        extra = [x for x in every if x not in base]
        assert extra and via in ways and layers and not bombs, text
        if part:
            a, b = map(int, extra[0].split(":")[1:])
            assert text[a:b] == part


def test_escapes_map_exactly():
    text = "see p%61ssword%3Dabcdefgh%C3%A9 ok"
    _, every, ways, *_ = SS.find_secrets(text)
    (x,) = every
    a, b = map(int, x.split(":")[1:])
    assert text[a:b] == "p%61ssword%3Dabcdefgh" and ways == ["url"]
    text = "é \\u0074oken\\x3dabc&#100;efgh &quot;"
    _, every, ways, *_ = SS.find_secrets(text)
    (x,) = every
    a, b = map(int, x.split(":")[1:])
    assert text[a:b] == "\\u0074oken\\x3dabc&#100;efgh" and ways == ["unicode"]
    assert SS.find_secrets("bad %zz %ff%fe \\ud800 &#99999999; %")[1] == []


def _ways(text):
    base, every, ways, _, bombs = SS.find_secrets(text)
    return [(w, *map(int, x.split(":")[1:])) for x, w in zip(every, ways) if x not in base]


def test_layers_across_blanks_lines_and_prefixes():
    long = f"some words before {SECRET} and after, {KEY} too. " * 3
    wrap = lambda b, end="\n": end.join(_b64(b)[i : i + 76] for i in range(0, len(_b64(b)), 76))
    cases = {
        "password%3A hunter2secret": ["url"],
        "token = %61bcdefgh": ["url"],
        f"GET /cb/{_b64(SECRET.encode())}": ["base64"],
        f"data-{_b64(SECRET.encode())} x": ["base64"],
        f"a/b/{_b64(SECRET.encode()).rstrip('=')}": ["base64"],
        f"see\n{wrap(gzip.compress(long.encode(), mtime=0))}\nThanks and bye": ["base64>gzip"],
        f"see\r\n  {wrap(long.encode(), chr(13) + chr(10) + '  ')}\r\n": ["base64"],
        "q " + _b64(gzip.compress(b"nothing", mtime=0) + gzip.compress(SECRET.encode(), mtime=0)): ["base64>gzip"],
        "q " + _b64(bz2.compress(b"nothing") + bz2.compress(SECRET.encode())): ["base64>bzip2"],
        "q " + _b64(b"\x00\x01head" + zlib.compress(SECRET.encode())): ["base64>zlib"],
        "q " + _b64(f"café à {SECRET}".encode("latin-1")): ["base64"],
        "q " + _b64(SECRET.encode("utf-16")): ["base64>utf-16"],
        "q " + _b64(gzip.compress(SECRET.encode("utf-16-be"), mtime=0)): ["base64>gzip>utf-16"],
        "q " + _b64(gzip.compress(bz2.compress(_b64(SECRET.encode()).encode()), mtime=0)): ["base64>gzip>bzip2>base64"],
    }
    for text, ways in cases.items():
        got = _ways(text)
        assert set(ways) <= {w for w, *_ in got}, (text, got)
        for w, a, b in got:
            assert 0 <= a < b <= len(text) and (w != "url" or text[a:b] in ("password%3A hunter2secret", "token = %61bcdefgh"))


def test_every_place_and_alignment_is_found():
    """Brute force: a secret under any two encodings, behind any prefix, is found and its span covers the encoded part."""
    coders = {
        "base64": lambda t: _b64(t.encode()),
        "url": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "html": lambda t: "".join(f"&#x{ord(c):x};" for c in t),
        "gzip": lambda t: _b64(gzip.compress(t.encode(), mtime=0)),
        "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    }
    for first in coders.values():
        for second in coders.values():
            part = second(first(f"~~~ {SECRET} ???"))
            for prefix in ("", "x", "ab/", "é-_", "k=", "12345 "):
                text = f"{prefix}{part} tail"
                spans = [(a, b) for _, a, b in _ways(text)]
                assert spans, (prefix, part)
                assert all(b <= len(prefix) + len(part) and b > len(prefix) for a, b in spans)


def test_long_texts_take_bounded_memory():
    import tracemalloc

    text = "lorem ipsum dolor " * 60_000 + "\\u0070assword=abcdefgh" + " %20" * 1000
    tracemalloc.start()
    got = _ways(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(text[a:b] == "\\u0070assword=abcdefgh" for _, a, b in got) and peak < 40 * len(text)


def test_cycles_and_bombs_end(monkeypatch):
    monkeypatch.setattr(SS, "LAYER_BYTES", 1000)
    bomb = _b64(gzip.compress(b"a " * 100_000))
    assert SS.find_secrets(bomb)[4] == 1
    nested = SECRET.encode()
    for _ in range(6):
        nested = gzip.compress(nested, mtime=0)
    assert SS.find_secrets(_b64(nested))[2][0].count("gzip") >= 1
    monkeypatch.setattr(SS, "NESTED", 4)
    assert SS.find_secrets(_b64(nested))[2:4] == ([], 0) and SS.find_secrets(_b64(nested))[4] >= 1
    monkeypatch.setattr(SS, "NESTED", 64)
    for _ in range(60):  # stored data show through every container: one way is enough
        nested = gzip.compress(nested, 0, mtime=0)
    assert SS.find_secrets(_b64(nested))[4] >= 1
    deep = SECRET
    for _ in range(12):
        deep = _b64(deep.encode())
    assert any(w.count("base64") == 12 for w in SS.find_secrets(deep)[2])


def test_table_edges(spark):
    rows = [(1, None), (2, ""), (3, SECRET), (3, SECRET), (None, "z " * 30000 + KEY), (4, f"{SECRET} and {_b64(SECRET.encode())}")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, secrets string")
    got = SS.digest(SS.scan_secrets(docs)).collect()
    assert len(got) == 6 and {r["doc_id"]: r["n_assign"] for r in got} == {1: 0, 2: 0, 3: 1, None: 0, 4: 1}
    assert [r["spans"] for r in got if r["doc_id"] in (1, 2)] == ["", ""]
    clean = {r["doc_id"]: r["text"] for r in SS.redact(docs).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "[secret]\"" and clean[4] == '[secret]" and [secret]'
    assert SS.redact(docs).columns == docs.columns and SS.redact(docs.limit(0)).count() == 0
