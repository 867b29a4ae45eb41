"""Token counts and packing against the tokenizer library and plain best-fit decreasing."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tamis.llm import packing, tokens

ODD = ["", " ", "it's we'RE '' don't!'s 're", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "école Å ﬁ Straße İstanbul ΑΣ 12345 中文字符没有空格 😀😀á", "\x1c\x1d a\x85b\u3000c\xa0d", "x" * 500, "aaaa" * 50, "!!!!????....", "ß ÿ × ÷ µ ª º", "'", "''s", "\u0301 \u0301a", "ñandú'll"]


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


def every_prefix(library, text):
    return [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]


def test_counts_at_every_prefix(word_bpe, library):
    """At every code point of the text as it is: special strings, composed and decomposed letters, blanks of all kinds."""
    c = tokens.counter(word_bpe)
    odd = [*ODD, "a !!<|endoftext|>'s x<|startoftext|>", "e\u0301te\u0301 q\u0303u\u0303 a\u0327\u0301b", "각 \u1100\u1161\u11a8x", "don\u0301't \u0301's", "İİ'S Ǆ ΑΣ. 　a\u0301 b", "  two  blanks\n\n\tlines \n", "İ\u0301e\u0302\u0301'll"]
    for text in odd:
        counts = every_prefix(library, text)
        assert c.prefix_counts(text) == counts, text
        assert c.count(text.encode()) == counts[-1]
        for budget in (0, 1, 3, 10):
            assert c.fitting(text, budget) == max(k for k, n in enumerate(counts) if n <= budget)
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("aeqn'sS!<|İ\u0301\u0303\u0327 \u3000\u00c5ﬁ1\u1100\u1161\u11a8" ) for _ in range(draw.randint(1, 14)))
        assert c.prefix_counts(text) == every_prefix(library, text), ascii(text)


def test_registered_prefixes(spark, word_bpe, library):
    """The registered query's table gives the library's count at every prefix of every text up to 3000 code points, and samples of longer ones."""
    from tamis.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    draw = random.Random(1)
    for r in queries.op9_token_counts(spark, sf_dir).collect():
        text, counts = texts[r["doc_id"]], tokens.counts_of(bytes(r["prefix_steps"])).tolist()
        places = range(len(text) + 1) if len(text) <= 300 else [0, len(text), *draw.sample(range(len(text)), 40)]
        assert len(counts) == len(text) + 1 and [counts[p] for p in places] == [len(e.ids) for e in library.encode_batch([text[:p] for p in places], add_special_tokens=False)]
        assert r["n_tokens"] == counts[-1] and r["n_bytes"] == len(text.encode()) and r["over_limit"] == (counts[-1] > 2048)
        assert r["fits_chars"] == max(p for p, n in enumerate(counts) if n <= 2048)


def test_joins_like_the_library(word_bpe, library):
    """Random strings of few letters meet many merges; every count must agree."""
    c, draw = tokens.counter(word_bpe), random.Random(3)
    for _ in range(400):
        word = "".join(draw.choice("thersin") for _ in range(draw.randint(1, 25)))
        assert c.whole(word) == len(library.encode(word, add_special_tokens=False).ids), word


def test_token_counts(docs, rows, empty_docs, clashing, word_bpe, library):
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    for table in (docs, clashing):
        got = tokens.token_counts(table, word_bpe, 100).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert tokens.token_counts(empty_docs, word_bpe).count() == 0
    r = tokens.token_counts(docs.filter("doc_id = 3"), word_bpe, 2).first()
    counts = tokens.counts_of(bytes(r["prefix_steps"]))
    assert counts[-1] == r["n_tokens"] and counts[r["fits_chars"]] <= 2
    assert "prefix_steps" not in tokens.token_counts(docs, word_bpe, prefixes=False).columns


def plain_best_fit(items, limit):
    rooms = []
    for n in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(limit - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    limit = draw.choice([5, 16, 37, 100])
    items = [draw.randint(1, limit) for _ in range(draw.randint(0, 120))]
    histogram = {n: items.count(n) for n in set(items)}
    sequences = {}
    for n, runs in packing.plan(histogram, limit).items():
        assert sum(r[1] for r in runs) == histogram[n] and [r[0] for r in runs] == list(np.cumsum([0, *(r[1] for r in runs)])[:-1])
        for _, count, first, offset in runs:
            for k in range(count):
                sequences.setdefault(first + k, []).append((offset, n))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
    assert sorted(limit - sum(n for _, n in p) for p in sequences.values()) == plain_best_fit(items, limit)


def test_pack(docs, rows, empty_docs, clashing, word_bpe, library):
    limit = 64
    for table in (docs, clashing):
        got = packing.pack(table, word_bpe, limit, 0).collect()
        want = []
        for i, t, *_ in rows:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            want += [(-1 if i is None else i, k, at, len(ids[at : at + limit]), zlib.crc32(np.array(ids[at : at + limit], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), limit))]
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= limit
        assert len(sequences) == len(plain_best_fit([w[3] for w in want], limit))
    assert packing.pack(empty_docs, word_bpe).count() == 0
    assert packing.pack(docs.filter("doc_id = 3"), word_bpe, with_ids=True).first()["ids"][-1] == 0
