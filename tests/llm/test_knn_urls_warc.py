"""Exact search, url rules and WARC derivatives against brute force and round trips."""

import base64
import gzip
import hashlib
import math
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tamis.llm import knn, urlfilter, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ints):
        if q % every == 0:
            found = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(ints) if b != a)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1024])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "CHUNK", 60)
    monkeypatch.setattr(knn, "PIVOTS", 6)
    draw = random.Random(5)
    centres = [[draw.uniform(-2, 2) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.2) for x in draw.choice(centres)], 0) for i in range(200)]
    rows += [(i, list(rows[0][1]), 1) for i in range(200, 240)]  # ties
    rows += [(300, None, 0), (350, [1.0, None] + [0.0] * 6, 0), (400, [math.nan] * 8, 0), (450, [math.inf] * 8, 0), (500, [0.5] * 3, 0), (550, [], 0), (None, [1.0] * 8, 0)]
    got = knn.top_k(spark.createDataFrame(rows, VECTORS), every=10, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_only_open_cells_are_sent(spark, monkeypatch):
    """In far-apart groups of vectors, queries and vectors go to few of the tasks that could be; the answer is that of all pairs."""
    monkeypatch.setattr(knn, "CHUNK", 50)
    draw = random.Random(3)
    centres = [[100.0 * (i == j) for j in range(16)] for i in range(16)]
    rows = [(i, [x + draw.gauss(0, 0.5) for x in centres[i % 16]], 0) for i in range(1600)]
    df = spark.createDataFrame(rows, VECTORS)
    asked, data, _, chunks = knn.dealt(df, 10, 5, 256)
    queries = 160
    assert chunks >= 16 and asked.count() <= queries * chunks / 4 and data.count() <= 1600 * 4
    assert sorted(map(tuple, knn.top_k(df, 10, 5).collect())) == brute(rows, 10, 5)


def test_top_k_edges(spark):
    few = [(0, [1.0, 2.0], 0), (50, [0.5, 0.0], 0), (7, [1.0, 1.0], 0)]
    assert sorted(map(tuple, knn.top_k(spark.createDataFrame(few, VECTORS), 50, 5).collect())) == brute(few, 50, 5)
    twice = [(0, [1.0], 0), (0, [1.0], 0), (1, [2.0], 0)]
    assert sorted(map(tuple, knn.top_k(spark.createDataFrame(twice, VECTORS), 50, 5).collect())) == brute(twice, 50, 5)
    for none in ([], [(0, [1.0], 0)], [(1, [1.0], 0), (2, [1.0], 0)]):
        assert knn.top_k(spark.createDataFrame(none, VECTORS), 50, 5).count() == 0
    large = [(0, [3e9, 1.0], 0), (1, [2e9, 5.0], 0), (2, [-3e9, 1.0], 0)]
    assert [(r["vec_id"], r["rank"]) for r in knn.top_k(spark.createDataFrame(large, VECTORS), 50, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def judged(url, rules):
    """The longest of the fitting rules: most labels, then the longest path."""
    host, path = urlfilter.parts(url)
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((h.count("."), len(slash + p), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else (None, "allow")


def test_urls(spark):
    draw = random.Random(6)
    urls = [None, "", "x", "://", "http://", "http:///en/", "https://a.b.example.com", "HTTP://WWW.EXAMPLE.COM/en/", "http://example.com/en", "http://a.net/es/?q", "http://net/fr/#x", "http://com?x/y", "http://a://b.com/", "http://u@example.com:80/en/", "http://É.com/en/"]
    urls += [f"http://{draw.choice(['', 'www.', 'm.', 'a.www.'])}{draw.choice(['example.com', 'x.net', 'net', 'y.org', 'Example.COM'])}{draw.choice(['', '/', '/en/', '/es/1', '/fr/x/y', '/en'])}{draw.choice(['', '?a=/en/', '#/es/'])}" for _ in range(150)]
    more = [*RULES, ("block", "y.org"), ("allow", "y.org/es"), ("block", "x.net/fr/x/"), ("allow", "y.org")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.com/", "")], "page_id long, url string, host string")
    for rules in (RULES, more):
        got = urlfilter.judge(df, rules).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            if r["page_id"] is not None:
                assert (r["rule"], r["verdict"]) == judged(urls[r["page_id"]], rules), urls[r["page_id"]]
    assert urlfilter.parts("http://A.Com/x?y#z") == ("a.com", "/x") and urlfilter.parts("http://a?b/c") == ("a", "")
    assert urlfilter.judge(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(df, RULES * (urlfilter.MOST_RULES // 5 + 1))


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.out, self.links = 0, [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        self.links += tag == "a" and "href" in dict(attrs)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


PAGES = [
    (1, "http://a.example/x?y", "<html><head><title>T &amp; x</title><style>p{}</style></head><body><p>Hello <b>bold</b></p><script>var a = '<p>no</p>';</script><div>caf&eacute; &lt;ok&gt;</div><a href='/l1'>one</a> <a class=x href=\"http://b/\">two</a></body></html>"),
    (2, None, None), (3, "http://b/", ""), (None, "http://c/", "plain only"), (4, "http://d/", "<p>unclosed <!-- never"), (5, "http://e/", "x" * 200_000 + "<br>y"), (1, "http://a.example/x?y", "<p>same id</p>"),
]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, block string")
    records = warc.derive(df)
    got = records.collect()
    assert len(got) == 2 * len(PAGES)
    by_source = {}
    for r in got:
        by_source.setdefault((r["refers_to"]), {})[r["warc_type"]] = r
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
    for i, url, page in PAGES:
        data = (page or "").encode()
        payload = warc.digest(data)
        both = next(b for b in by_source.values() if b["conversion"]["source_payload_digest"] == payload and b["conversion"]["page_id"] == i)
        assert both["metadata"]["source_block_digest"] is None and both["conversion"]["source_headers"] is None
        assert f"conversion: {both['conversion']['record_id']}\r\n" in both["metadata"]["block"] and both["metadata"]["target_uri"] == (url or "")
    first = next(b for b in by_source.values() if "title: T & x\r\n" in b["metadata"]["block"])
    assert first["conversion"]["block"] == "Hello bold\ncafé <ok>\none two" and "outlink: /l1\r\noutlink: http://b/\r\n" in first["metadata"]["block"]
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w" / "*.txt")).collect()
    assert sorted((r["fields"]["WARC-Record-ID"], r["fields"]["WARC-Refers-To"], bytes(r["block"]).decode()) for r in back) == sorted((r["record_id"], r["refers_to"], r["block"]) for r in got)
    assert not any("WARC-Source-Headers" in r["fields"] for r in back)
    assert warc.derive(df.limit(0)).count() == 0
    own = warc.derive(spark.createDataFrame([(1, "http://x/", "<p>a", "2024-01-01T00:00:00Z", "HTTP/1.1 404 Gone\r\n\r\n")], "page_id long, url string, html string, date string, http_headers string"))
    warc.write(own, str(tmp_path / "own"))
    assert {base64.b64decode(r["fields"]["WARC-Source-Headers"]).decode() for r in warc.read(spark, str(tmp_path / "own" / "*.txt")).collect()} == {"HTTP/1.1 404 Gone\r\n\r\n"}
    own = own.first()
    assert own["source_block_digest"] == warc.digest(b"HTTP/1.1 404 Gone\r\n\r\n<p>a") and own["date"] == "2024-01-01T00:00:00Z" and own["source_headers"] == "HTTP/1.1 404 Gone\r\n\r\n"


def test_text_like_a_parser(spark):
    """The words of the test pages are those that an HTML parser sees."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30).collect()
    for p in pages:
        parser = Text()
        parser.feed(p["html"])
        assert "".join(warc.plain_text(p["html"]).split()) == "".join("".join(parser.out).split())


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>Hello</p>", "Hello"), ("<head><title>T</title><link rel=x><p>Hello</p><div>more</div>", "Hello\nmore"),
    ("<head><title>T</title>Hello", "Hello"), ("<title>T</title><p>Hello", "Hello"), ("<head><title>T <b></title></head><p>Hello", "Hello"), ("<head><style>p{}</style></head>Hello", "Hello"),
    ("one <svg width=1 /> two", "one two"), ("one <svg><path/> two", "one two"), ("one <svg><svg><text>no</text></svg>no</svg> two", "one two"), ("one <svg>two <svg>no</svg> three", "one two three"),
    ("one <noscript>two", "one two"), ("one <template/>two<template>no</template> three", "one two three"), ("<svg>one <noscript></svg>two</noscript>", "two"),
    ("one <script>no", "one"), ("one <style>no", "one"), ("one <!-- no", "one"), ("<header>one</header>", "one"),
])
def test_tags_left_open(page, text):
    assert warc.plain_text(page) == text


RECORD = b"WARC/1.0\r\nWARC-Type: response\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"


def test_records_as_they_come():
    """Lower-case names, cut-off records, lines without a colon, line feeds alone, gzip by record and as a whole, and no record at all."""
    want = [({"WARC-Type": "response", "content-length": "5"}, b"hello")]
    assert warc.parse(RECORD) == want and warc.parse(RECORD * 3) == want * 3 and warc.parse(RECORD.replace(b"\r", b"")) == want
    assert warc.parse(gzip.compress(RECORD) * 2) == want * 2 and warc.parse(gzip.compress(RECORD * 2)) == want * 2
    assert warc.parse(gzip.compress(RECORD) + gzip.compress(RECORD)[:-12])[0] == want[0]
    assert warc.parse(RECORD + RECORD[:-7]) == [*want, (want[0][0], b"he")]
    assert warc.parse(b"WARC/1.0\r\nno colon\r\nA: b\r\n c\r\nContent-Length: x\r\n\r\nbody\r\n" + RECORD)[0] == ({"A": "b c", "Content-Length": "x"}, b"body\r")
    assert warc.parse(b"WARC/1.0\r\nWARC-Type: x")[0] == ({"WARC-Type": "x"}, b"") and warc.parse(b"") == [] and warc.parse(b"nothing") == [] and warc.parse(b"\x1f\x8bbad") == []


@pytest.mark.parametrize("part", ["<a ", "<p ", "<script ", "<title>", "<head ", "<svg ", "<svg>", "<noscript", "<!--", "</", "<a href=", "<a href='x' "])
def test_pages_of_one_sign(part):
    """A megabyte of the same open tag takes about a second."""
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    warc.derive_one(1, "http://x/", page, None, None)
    assert time.process_time() - start < 8


def test_registered_warc(spark):
    """Each page of the table gets its two records, with the text and links that its html holds."""
    from tamis.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {(r["page_id"], r["warc_type"]): r for r in queries.op8_warc(spark, sf_dir).collect()}
    assert set(got) == {(i, kind) for i in pages for kind in ("metadata", "conversion")}
    for i, p in pages.items():
        text, about = got[i, "conversion"], got[i, "metadata"]
        parser = Text()
        parser.feed(p["html"])
        assert "".join(text["block"].split()) == "".join("".join(parser.out).split()) and text["refers_to"] == about["refers_to"] != text["record_id"] != about["record_id"]
        assert text["target_uri"] == p["url"] and text["source_payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(p["html"].encode()).digest()).decode()
        assert about["block"].count("outlink: ") == parser.links
