"""Winnowing against a plain reading of it, and the neighbours of every row."""

import hashlib
import random

import pytest

from tamis.llm import fingerprints as fp


def plain(hashes, window):
    """Positions of each window's least hash, the rightmost on ties."""
    if not hashes:
        return []
    width = min(window, len(hashes))
    return sorted({max(k for k in range(i, i + width) if hashes[k] == min(hashes[i : i + width])) for i in range(len(hashes) - width + 1)})


def rolled(text):
    """The rolling hash of every k-gram: the first code point leaves, the next one enters."""
    codes = [ord(c) for c in text]
    codes += [0] * (fp.GRAM - len(codes))
    top, h, found = pow(fp.BASE, fp.GRAM - 1, fp.PRIME), 0, []
    for i, c in enumerate(codes):
        if i >= fp.GRAM:
            h = (h - codes[i - fp.GRAM] * top) % fp.PRIME
        h = (h * fp.BASE + c) % fp.PRIME
        if i >= fp.GRAM - 1:
            found.append(h)
    return found


def prints(text):
    """(hash, position) of each chosen k-gram."""
    hashes = rolled(text) if text else []
    return [(hashes[i], i) for i in plain(hashes, fp.WINDOW)]


def alike(a, b):
    x, y = ({h for h, _ in prints(t)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def as_text(text):
    return ",".join(f"{h:x}@{i}" for h, i in prints(text))


def test_chosen_positions(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab") for _ in range(n)) for n in (0, 1, 4, 7, 8, 9, 22, 23, 24, 60, 300, 5000)]
    texts += ["😀é中 x" * 9, "\n" * 40, "a\u0301" * 20, "one two three " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    assert found == {i: as_text(t) for i, t in enumerate(texts)}


def test_shared_runs_share_a_hash(spark):
    draw = random.Random(4)
    letters = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    run = letters(fp.GRAM + fp.WINDOW - 1)
    rows = [(i, letters(draw.randrange(300)) + run + letters(draw.randrange(300))) for i in range(20)]
    found = [{v >> 31 for v in r["grams"]} for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & b for a in found for b in found)


def held(got, text, after):
    """Whether a row is what plain reading makes of a text and the one after it."""
    third = len(text) // 3
    edit = text[: len(text) - third] + after[:third]
    want = (len(text), hashlib.sha256(edit.encode()).hexdigest(), as_text(text), as_text(edit))
    return want == tuple(got[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) and abs(got["near_edited"] - alike(text, edit)) < 1e-9 and abs(got["near_next"] - alike(text, after)) < 1e-9


@pytest.mark.parametrize("rows_a_bucket", [7, 500])
def test_edited(docs, rows, clashing, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(fp, "ROWS", rows_a_bucket)
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append(t or "")
    order = [i for i in sorted((i for i in by_id if i is not None), reverse=True) for _ in by_id[i]]
    for table in (docs, clashing):
        got = fp.edited(table).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["doc_id"]
            if i is not None and len(by_id[i]) == 1:
                after = order[order.index(i) + 1] if order.index(i) + 1 < len(order) else None
                assert any(held(r, by_id[i][0], t) for t in by_id[after]), i


def test_registered_query(spark):
    from tamis.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id", ascending=False).collect()]
    got = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows) and all(held(got[i], t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows) if len(t) < 5000)


def test_crowded_ids_and_nulls(spark, monkeypatch):
    """One id on most rows, and many rows without one: every row still has one follower, in a ring."""
    monkeypatch.setattr(fp, "ROWS", 5)
    draw = random.Random(9)
    letters = lambda: "".join(draw.choice("abcdefgh ") for _ in range(90))
    rows = [(7, letters()) for _ in range(60)] + [(None, letters()) for _ in range(20)] + [(i, letters()) for i in range(20, 30)]
    got = fp.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = [t for _, t in rows]
    by_print = {as_text(t): t for t in texts}
    assert len(by_print) == len(texts)
    follows = {}
    for r in got:
        own = by_print[r["fingerprint"]]
        fits = [t for t in texts if held(r, own, t)]
        assert fits
        follows[own] = fits
    # Crowd, nameless and others follow one another: some choice of followers is one ring, so each text follows some other.
    assert {t for fits in follows.values() for t in fits} == set(texts) and len(follows) == len(texts)
    assert fp.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fp.edited(spark.createDataFrame([(1, "alone in here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("letters", ["天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_long_texts_without_blanks(spark, letters):
    """Texts of several thousand code points and no blank are near their edits, and far from each other."""
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice(letters) for _ in range(4000))) for i in range(3)]
    for r in fp.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.3 < r["near_edited"] < 1 and r["near_next"] < 0.1


def test_edits_at_every_length(spark):
    """Texts and neighbours of 0 to 3 windows: a seam at the start, over a whole text, or before an empty neighbour."""
    draw = random.Random(12)
    letters = lambda n: "".join(draw.choice("abc") for _ in range(n))
    lengths = [n for a in (0, 1, 2, 3, 22, 23, 32, 33, 34, 35, 45, 66, 67, 68, 69, 70, 120, 250) for b in (0, 1, 7, 22, 23, 24, 90) for n in (a, b)]
    texts = [letters(n) for n in lengths]
    got = {r["doc_id"]: r for r in fp.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = [(lengths[i], lengths[i - 1]) for i in range(len(texts)) if not held(got[i], texts[i], texts[i - 1])]
    assert wrong == []
