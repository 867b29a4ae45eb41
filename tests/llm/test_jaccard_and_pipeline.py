"""The Jaccard join against every pair, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamis.llm import components, jaccard, mixing


def brute(rows, n=5, t=(4, 5)):
    """doc_id -> (set size, component) by comparing every pair."""
    sets = []
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and t[1] * len(x & y) >= t[0] * len(x | y):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return sorted((i if i is not None else -1, len(x), find(i) if i is not None else -1) for i, x in sets)


def shown(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_join(docs, rows, clashing, empty_docs):
    want = brute(rows)
    assert shown(jaccard.join(docs)) == want
    assert shown(jaccard.join(clashing)) == want
    assert jaccard.join(empty_docs).count() == 0


def chain(draw, n, words=60):
    """Each text differs from the one before in one word, so that links run along a chain."""
    text = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(text)
        text[(7 * i) % words] = f"c{i}"
        out.append(" ".join(text))
    return out


def test_hard_shapes(spark):
    """Chains, a star of near copies, common passages, short texts that are one shingle, and one text on a third of the rows."""
    draw = random.Random(9)
    texts = chain(draw, 40)
    centre = [f"s{draw.randrange(10**6)}" for _ in range(120)]
    for i in range(40):
        copy = list(centre)
        for k in draw.sample(range(120), 2):
            copy[k] = f"x{i}{k}"
        texts.append(" ".join(copy))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"u{i}_{k}" for k in range(draw.choice([3, 8, 12, 40]))) for i in range(60)]
    texts += ["Same Words", "same words", "same", "SAME\twords", "a b c d", "a b c d e", "a b c d e f"]
    texts += ["the one text that is everywhere in this table"] * 100
    rows = [(i, t) for i, t in enumerate(draw.sample(texts, len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shown(jaccard.join(df)) == brute(rows)
    assert shown(jaccard.join(df, 2, (1, 2))) == brute(rows, 2, (1, 2))


def test_bounds():
    for x in range(1, 60):
        for y in range(x, 60):
            least = jaccard.least_overlap(x, y, (4, 5))
            assert 100 * least >= 80 * (x + y - least) and (least == 0 or 100 * (least - 1) < 80 * (x + y - least + 1))
    assert [jaccard.prefix(n, (4, 5)) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 3]
    assert len(jaccard.shingles([b"a"] * 9, 5)) == 1 and len(jaccard.shingles([], 5)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 50)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, tables = docs.columns, {}, {"": docs}
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, corpus_pipeline.written(stage(spark, table, sf_dir), "test")
        kept[name] = (before, table)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    for name in ("toxicity", "quality classifier"):
        before, after = kept[name]
        assert after.count() <= before.count() and after.exceptAll(before).count() == 0
    assert kept["toxicity"][1].count() >= docs.count() - 2 * len(toxic) - 5
    before, after = kept["n-gram Jaccard join"]
    want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()])}
    assert {r["doc_id"] for r in after.collect()} == want and after.count() == len(want)
    before, after = kept["mixing sources to target weights"]
    sizes, want, taken = {}, {}, {}
    for r in mixing.mix(before, carry=("source",)).collect():
        sizes.setdefault(r["source"], []).append(r["size"])
        want[r["source"]] = r["target"]
    for r in after.select("source", mixing.words(F.col("text")).alias("size")).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"]
    assert all(0 <= want[s] - taken.get(s, 0) < max(sizes[s]) for s in want)
    assert after.groupBy(*columns).count().join(before.groupBy(*columns).count().withColumnRenamed("count", "own"), columns, "left").filter("own is null or count > 3 * own").isEmpty()
    before, after = kept["best-fit packing"]
    assert after.filter("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0


def test_orders_remove_pairs():
    """Each further order removes pairs that share a token under the others, and never one that is similar."""
    draw, t = random.Random(4), (4, 5)
    sets = []
    for i in range(300):
        own = {draw.randrange(2**64) for _ in range(60)} | {draw.randrange(40) * 0x9E3779B97F4A7C15 % 2**64 for _ in range(3)}
        sets.append(np.array(sorted(own), "uint64"))
        if i % 10 == 0:
            sets.append(np.array(sorted(set(own) - {min(own)} | {draw.randrange(2**64)}), "uint64"))
    prefixes = [jaccard.signatures(x, t) for x in sets]
    share, both, similar = [0, 0], 0, 0
    for a in range(len(sets)):
        for b in range(a):
            found = jaccard.orders_allow(prefixes[a], prefixes[b])
            k = len(np.intersect1d(sets[a], sets[b]))
            if k >= jaccard.least_overlap(len(sets[a]), len(sets[b]), t):
                similar += 1
                assert all(found)
            elif k:
                share = [n + f for n, f in zip(share, found, strict=True)]
                both += all(found)
    pairs = len(sets) * (len(sets) - 1) // 2
    assert similar >= 30 and all(n < pairs / 4 for n in share) and both < min(share)


def test_orders_come_before_sets(spark, monkeypatch):
    """Pairs that share a rare token but fail an order never have their sets read, and holders of one token meet in blocks."""
    monkeypatch.setattr(jaccard, "HOLDERS", 7)
    draw = random.Random(11)
    rows = [(i, "one two three four five " + " ".join(f"w{draw.randrange(10**6)}" for _ in range(25))) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(20)]
    read = []
    whole = jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda docs, n, wanted: (read.append(wanted.count()), whole(docs, n, wanted))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(jaccard.join(df)) == brute(rows) and sum(read) <= 2 * 40 + 60


def test_equal_ids_tie_their_texts(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text of its own"), (7, "quite another text of its own"), (9, "alone"), (9, None), (None, "alone")]
    assert shown(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted([(3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 3), (9, 1, 9), (9, 0, 9), (-1, 1, -1)])


def test_stages_with_holes(spark, docs, empty_docs, clashing, tmp_path):
    """Nulls, empty texts, repeated rows, no rows and clashing columns, in every stage."""
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        found = [stage(spark, table, str(tmp_path)) for table in (docs, clashing)]
        assert found[0].columns == found[1].columns and sorted(map(repr, found[0].collect())) == sorted(map(repr, found[1].collect())), name
        assert stage(spark, empty_docs, str(tmp_path)).count() == 0


def test_one_of_each_group_stays(spark, docs, rows):
    """Rows of a group keep one, whatever their ids; the same id on another text is another document."""
    kept = corpus_pipeline.distinct(spark, docs, "").collect()
    numbered = [(i, t) for i, (_, t, *_) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    assert len(kept) == len({c for _, _, c in brute(numbered)})
    few = spark.createDataFrame([(5, "a b c d e f", "en", "s", 1), (5, "other words", "en", "s", 1), (None, "A b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)], docs.schema)
    assert sorted(map(repr, (tuple(r)[:2] for r in corpus_pipeline.distinct(spark, few, "").collect()))) == sorted(map(repr, [(3, "a b c d e f"), (5, "other words"), (None, None), (None, None)]))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert np.array_equal([n for n, _ in corpus_pipeline.STAGES], ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"])
