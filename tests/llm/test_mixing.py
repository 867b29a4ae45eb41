"""Mixing against plain water filling, and what a mix may take."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamis.llm import common, mixing


def targets(sizes, weights, most):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, found, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(found.values())) / sum(weight[n] for n in open_)
        capped = [n for n in open_ if level * weight[n] >= most * sizes[n]]
        if not capped:
            return found | {n: level * weight[n] for n in open_}
        for n in capped:
            found[n] = most * sizes[n]
            open_.discard(n)
    return found


def check(got, rows, weights=(5.0, 2.0, 1.0), most=3):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    want = targets(sizes, weights, most)
    by_id = {i: (t, s) for i, t, _, s, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            text, source = by_id[r["doc_id"]]
            assert r["size"] == len(re.findall("[^\\x20\\x09-\\x0D]+", text or "")) and r["source_size"] == sizes[source]
            assert abs(r["target"] - want[source]) < 1e-6
            taken[source] += r["taken"]
        assert 0 <= r["taken"] <= most * r["size"] and r["taken"] == r["times"] * r["size"]
    return want, taken


def test_mix(docs, rows, empty_docs, clashing, monkeypatch):
    got = mixing.mix(docs).collect()
    want, taken = check(got, rows)
    assert all(0 <= want[s] - taken[s] < max(r["size"] for r in got) for s in ("b", "c"))
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert sorted(map(tuple, mixing.mix(clashing).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty_docs).count() == 0
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 17), "en", f"s{i % 4}", 0) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), weights=(7.0, 3.0, 1.0, 2.0)).collect()
    want, taken = check(got, rows, (7.0, 3.0, 1.0, 2.0))
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)


def drawn(rows, want, most=3, seed=11):
    """times of each document by plain reading: complete epochs, then documents in the order of their keys, each one that still fits."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    times = {}
    for s, own in by_source.items():
        total = sum(r["size"] for r in own)
        epochs = min(most, int(want[s] // total)) if total else 0
        left = want[s] - epochs * total
        for r in sorted(own, key=lambda r: (r["key"], r["draw"])):
            fits = 0 < r["size"] <= left
            left -= r["size"] * fits
            times[r["doc_id"]] = epochs + fits
    return times


@pytest.mark.parametrize(("slices", "some"), [(4096, 512), (64, 3)])
def test_chosen_set(spark, monkeypatch, slices, some):
    """The documents that the mix takes are those that the keys and budgets name, also over few slices and short rounds; low weights spread like others."""
    monkeypatch.setattr(mixing, "SLICES", slices)
    monkeypatch.setattr(mixing, "ROUND", some)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for quality in (None, F.lit(0.01)):
        weight = mixing.text_quality(F.col("text")) if quality is None else quality
        draw = F.xxhash64(F.lit(11), "doc_id", "source", F.xxhash64("text"))
        keys = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), draw.alias("draw"), (-F.log((F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / float(1 << 53)) / weight).alias("key")).collect()
        got = mixing.mix(docs, quality=quality, carry=("source",)).collect()
        want = {r["source"]: r["target"] for r in got}
        times = drawn(keys, want)
        assert {r["doc_id"]: r["times"] for r in got if r["size"]} == {i: times[i] for i in times if any(k["doc_id"] == i and k["size"] for k in keys)}
        for s in want:
            own = [r for r in got if r["source"] == s]
            gap, rest = want[s] - sum(r["taken"] for r in own), [r["size"] for r in own if r["times"] == min(x["times"] for x in own) and r["size"]]
            assert 0 <= gap < min(rest) or not rest


def test_registered_query(spark):
    from tamis.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [r for r in queries.op10_mixing(spark, "/root/testdata/sf0.001").collect()]
    rows = [(r["doc_id"], r["text"], None, r["source"], 0) for r in docs.collect()]
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
    want = targets(sizes, (5.0, 2.0, 1.0), 3)
    assert all(abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and r["source_size"] == sizes[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)


def test_weighted_draws(spark):
    """Documents of high quality come first more often."""
    rows = [(i, "w w w w", "en", "abc"[i % 3], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df, weights=(1.0, 1.0, 4.0), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).filter("source_size > target").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("times").alias("t")).collect()
    t = {r["odd"]: r["t"] for r in got}
    assert t[0] > 1.5 * t[1]


def test_complete_epochs_come_first(spark):
    rows = [(i, "w w", "en", "small" if i < 10 else "zlarge", 0) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    small = [r["times"] for r in got if r["doc_id"] < 10]
    assert small == [3] * 10 and set(r["times"] for r in got if r["doc_id"] >= 10) <= {0, 1}


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["size"], r["taken"]) for r in mixing.mix(df).collect()] == [(0, 0), (0, 0)]
