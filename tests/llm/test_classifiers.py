"""Toxicity and quality: exact neighbours, held-out accuracy, and tables with holes."""

import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tamis.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def as_index(rows, terms):
    """An index of rows (label, {term: count}), and their dense unit vectors."""
    sizes = np.array([len(c) for _, c in rows])
    terms_, counts = (np.array([x for _, c in rows for x in f(c)], "int64") for f in (dict.keys, dict.values))
    index = toxicity.Index.of(np.arange(len(rows)), np.array([r[0] for r in rows], "float64"), sizes, terms_, counts, np.ones(terms)).ready()
    dense = np.zeros((len(rows), terms))
    for i, (_, c) in enumerate(rows):
        own, w = unit(c, index.idf)
        dense[i, own] = w
    return index, dense


def unit(counts, idf):
    own = np.array(sorted(counts), "int64")
    w = np.array([1 + np.log(counts[t]) for t in own]) * idf[own]
    return own, w / np.sqrt(w @ w)


@pytest.mark.parametrize("common", [0, 12, 512])
def test_search_is_exact(monkeypatch, common):
    """Block-max search finds what comparing with every example finds, whatever lies in lists and what in rows."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    draw = random.Random(8)
    word = lambda: min(59, int(draw.expovariate(0.1)))
    rows = [(draw.randrange(2), {word() + 60 * (i % 3): draw.randint(1, 3) for _ in range(draw.randint(1, 9))}) for i in range(700)]
    index, dense = as_index(rows, 180)
    queries = [{word() + 60 * (i % 3): draw.randint(1, 3) for _ in range(draw.randint(1, 6))} for i in range(200)]
    found = [x for i in range(0, 200, 40) for x in index.search([unit(c, index.idf) for c in queries[i : i + 40]], 15)]
    for counts, (at, cosines) in zip(queries, found, strict=True):
        q = np.zeros(180)
        own, w = unit(counts, index.idf)
        q[own] = w
        want = dense @ q
        assert np.allclose(cosines, np.sort(want[want > 1e-9])[::-1][:15], atol=2e-5) and np.allclose(want[index.ids[at]], cosines, atol=2e-5)
    index = pickle.loads(pickle.dumps(index)).ready()
    (at, _), (others, _) = index.search([unit(rows[5][1], index.idf)] * 2, 15, [None, [5]])
    assert 5 in at and 5 not in others


def test_scores_of_the_query(spark, monkeypatch):
    """The registered query's scores follow from every labelled text's cosine with every text, by brute force."""
    from tamis.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, quality.learns(5, 0))
    texts = {r["doc_id"]: toxicity.words((r["text"] or "").encode()) for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    assert set(model.index.ids) == set(known)
    n, df = len(known), {}
    for i in known:
        for w in set(texts[i]):
            df[w] = df.get(w, 0) + 1
    model.index.ready()
    lean = {w: model.index.idf[at] / (np.log((1 + n) / (1 + df[w])) + 1) for w in df for at in model._find([toxicity.hashed(w)])}

    def vector(own):
        count = {w: own.count(w) for w in set(own)}
        v = {w: (1 + np.log(c)) * (np.log((1 + n) / (1 + df.get(w, 0))) + 1) * lean.get(w, 1.0) for w, c in count.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in texts}
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    for i in texts:
        cosines = sorted(((round(sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()), 5), -j) for j in known), reverse=True)[: toxicity.NEIGHBOURS]
        near = np.array([c for c, _ in cosines if c > 0])
        if not model.leaning and len(near) == toxicity.NEIGHBOURS and len(set(near[-2:])) == 2:
            assert np.allclose(got[i]["example_cosines"], near[: toxicity.SHOWN], atol=5e-5)
            v = sum(known[-j] / (1.1 - c) for c, j in cosines) / sum(1 / (1.1 - c) for c, _ in cosines)
            assert abs(got[i]["score"] - quality.sigmoid(np.array(toxicity.curve_inputs(v, near[0]) @ model.curve))) < 0.02
    assert not model.leaning


def accuracy(spark, module, column, divisor, held, sf_dir=SF):
    """Share of held-out labels that are right, recall and precision of label 1, the model and the scored rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels, quality.learns(divisor, held))
    got = {r["doc_id"]: r for r in module.score(docs, model).collect()}
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    tested = [i for i in truth if zlib.crc32(str(i).encode()) % divisor == held and i in got]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    right = sum(got[i]["predicted"] == 1 == truth[i] for i in tested)
    recall, precision = right / sum(truth[i] for i in tested), right / max(1, sum(got[i]["predicted"] for i in tested))
    return sum(got[i]["predicted"] == truth[i] for i in tested) / len(tested), recall, precision, model, got


def test_toxicity_held_out(spark):
    share, recall, precision, _, got = accuracy(spark, toxicity, "toxic", 5, 0, "/root/testdata/sf0.1")
    assert share > 0.97 and recall > 0.88 and precision > 0.88
    shown = [r for r in got.values() if r["example_ids"]]
    assert len(shown) > 0.99 * len(got) and all(len(r["example_ids"]) == len(r["example_cosines"]) == len(r["example_labels"]) for r in shown)


def test_quality_held_out(spark):
    share, recall, precision, model, _ = accuracy(spark, quality, "quality", 3, 1)
    assert share > 0.97 and recall > 0.95 and precision > 0.95 and 0 < model.quantile < 1


def test_preferences_are_learnt():
    draw = np.random.default_rng(1)
    found = draw.normal(size=(400, 15))
    good = found[:, 2] - found[:, 5] > -0.6
    model = quality.fit(found, good)
    assert ((model.scores(found) >= 0.5) == good).mean() > 0.97


def test_fit_is_the_least_loss():
    """Over all pairs of a few documents, plain gradient descent on the logistic loss of feature differences ends at the same weights; quantiles cut where they say."""
    draw = np.random.default_rng(2)
    found = draw.normal(size=(24, 4))
    good = found[:, 0] + draw.normal(size=24) > 0
    mean, spread = found.mean(0), found.std(0) + 1e-6
    x = (found - mean) / spread
    seed = np.random.default_rng(5)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = len(better) * len(worse)
    d = x[seed.choice(better, pairs)] - x[seed.choice(worse, pairs)]
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.2 * (d.T @ (1 / (1 + np.exp(d @ w))) / pairs - quality.PENALTY * w)
    assert np.allclose(quality.fit(found, good).weights, w, atol=1e-4)
    for q in (0.0, 0.25, 0.5, 1.0):
        model = quality.fit(found, good, q)
        assert model.quantile == q and (model.scores(found) < 0.5).mean() == q
    far = found * 1e6
    assert np.allclose(quality.fit(found, good).scores(far), quality.fit(found, good).scores(np.clip(far, mean - 8 * spread, mean + 8 * spread)))


def test_fit_holds_few_differences():
    """The differences of all pairs are never there at once: a driver of a few hundred MB fits the largest sample."""
    found = np.random.default_rng(3).normal(size=(4000, len(quality.NAMES)))
    tracemalloc.start()
    quality.fit(found, found[:, 2] > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.6 * quality.PAIRS * found.shape[1] * 8


def test_sample_comes_in_parts(spark, docs, monkeypatch):
    """The model is the same in however many parts the labelled documents' words come."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(130)], "doc_id long, toxic int")
    models = []
    for part in (1000, 7, 1):
        monkeypatch.setattr(toxicity, "PART", part)
        models.append(toxicity.train(docs, labels, quality.learns(5, 0)))
    assert len(models[0].index.ids) > 90
    for model in models[1:]:
        assert (model.hashes == models[0].hashes).all() and (model.curve == models[0].curve).all()
        assert all((x == model.index.__getstate__()[k]).all() for k, x in models[0].index.__getstate__().items())


def test_words_tell_quality(spark):
    """Texts alike in every ratio, told apart by their words alone."""
    draw = random.Random(4)
    good, bad = ([f"{a}{i}xyz" for i in range(10)] for a in "gb")
    rows = [(i, " ".join(draw.choice(good if i % 2 else bad) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels, quality.learns(3, 1))).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got) > 390


@pytest.mark.parametrize("module", [toxicity, quality])
def test_holes(spark, docs, rows, clashing, empty_docs, module):
    column = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(0, 40)] + [(1, 0, 0), (None, 1, 1), (50, None, None), (51, 7, 7), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, quality.learns(5, 0))
    got = module.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    same = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 9)) for r in df.collect())
    assert same(module.score(clashing, model)) == same(module.score(docs, model))
    assert module.score(empty_docs, model).count() == 0
    for none in (labels.limit(0), labels.filter("doc_id = 2"), labels.filter(f"{column} = 1")):
        some = module.train(docs, none, quality.learns(5, 0))
        assert all(0 <= r["score"] <= 1 for r in module.score(docs, some).collect())
    assert module.train(empty_docs, labels, quality.learns(5, 0)) is not None


def test_every_word_is_searched(spark):
    """One toxic passage copied into many documents, and labelled texts without any toxic-leaning word, are found by their own words."""
    draw = random.Random(3)
    prose = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    passage = "these very words are one passage that somebody copied about"
    rows = [(i, passage if i % 4 == 0 else prose(30)) for i in range(400)] + [(1000, passage), (1001, "unseen words alone"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels, quality.learns(5, 0))).collect()}
    assert got[1000]["predicted"] == 1 and np.allclose(got[1000]["example_cosines"], 1) and set(got[1000]["example_labels"]) == {1}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    learnt = [i for i in range(400) if i % 4 and zlib.crc32(str(i).encode()) % 5]
    assert all(got[i]["example_ids"][0] == i and got[i]["example_cosines"][0] > 0.999 for i in learnt)
    assert not got[1001]["example_ids"] or got[1001]["example_cosines"][0] < 0.9
