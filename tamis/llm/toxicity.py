"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Fitting (on at most SAMPLE labelled documents):

* Every word of a labelled document is a term. Words and word starts ("idio*") that stand out among toxic examples by
  the log-likelihood ratio lean toxic and weigh BOOST times as much; such starts are terms too. What counts for leaning
  is how many different surroundings a term has there, so that a passage copied into many documents counts once; a
  word start must begin several different words.
* Labelled documents become unit TF-IDF vectors over all terms, ordered so that alike ones (by language and length)
  lie in one block of BLOCK. The index has inverted lists of the rarer terms, and for the COMMON most frequent ones,
  whose lists would be nearly full, rows of weights with their largest weight in each block.

Scoring: the rarer terms' lists are summed; with the block maxima of the frequent terms they bound every block. The
blocks with the highest bounds give a first k-th cosine, and only blocks whose bound reaches it are ranked, so the
neighbours are exact. Words that no example holds count in a document's length. Neighbours vote by label, weighted
by nearness; a logistic curve fitted on the labelled documents' own leave-one-out votes turns vote and nearness into a
probability. Documents that share no term with an example score the share of toxic ones among examples without words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import Scratch, give_back, only
from tamis.llm.quality import labelled, sigmoid

#: Labelled documents that the model is fitted on at most; all words of all of them count.
SAMPLE = 20_000
#: Labelled documents whose words come to the driver at once.
PART = 2500
#: Neighbours that vote, documents of a block, neighbours shown as evidence.
NEIGHBOURS, BLOCK, SHOWN = 15, 64, 5
#: Frequent terms that are kept in rows, groups of alike documents, documents searched at once, weight of terms that lean toxic.
COMMON, ALIKE, AT_ONCE, BOOST = 512, 8, 64, 6.0
#: Blocks whose documents give the first k-th cosine, and room for single precision in the bounds.
FIRST, ROOM = 3, 1e-4
#: Least log-likelihood ratio of a term (a chance of one in 10^6), least words that a word start begins, least surroundings.
LEAST_RATIO, LEAST_WORDS, LEAST_SEEN = 24.0, 4, 3
STARTS = (4, 5, 6)
#: Words that a worker remembers the terms of.
KNOWN = 400_000
#: Words are runs of ASCII letters, digits and all other letters beyond ASCII, in lower case.
_BLANK = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.decode().lower().encode().translate(_BLANK).split()


def starts(word: bytes) -> list[str]:
    """The word's starts, with a star."""
    s = word.decode()
    return [s[:n] + "*" for n in STARTS if len(s) > n]


def ratio(toxic: float, clean: float, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio of a term that toxic and clean documents hold so often."""
    n, held, total = all_toxic + all_clean, toxic + clean, 0.0
    for seen, share in ((toxic, all_toxic), (clean, all_clean)):
        for count, expected in ((seen, held * share / n), (share - seen, (n - held) * share / n)):
            if count > 0:
                total += count * math.log(count / expected)
    return 2 * total


class Index:
    """Unit vectors over numbered terms, in blocks of BLOCK alike documents.

    What travels is each term's documents and counts; weights, rows and block maxima are made where it is searched.
    """

    idf = None

    @staticmethod
    def of(ids, labels, sizes, terms_, counts, boost) -> Index:
        """The terms and counts of all documents, one after the other, sizes of each; boost: a weight for each term."""
        made, small = Index(), lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        made.ids, made.labels, made.sizes, made.boost = ids, labels, sizes, boost.astype("float32")
        made.df = small(np.bincount(terms_, minlength=len(boost)))
        by_term = np.argsort(terms_, kind="stable")
        made.counts, made.number = small(counts)[by_term], np.repeat(small(np.arange(len(ids))), sizes)[by_term]
        return made

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ids", "labels", "sizes", "boost", "df", "number", "counts")}

    def ready(self) -> Index:
        if self.idf is None:
            self._weigh()
        return self

    def _weigh(self) -> None:
        # Each worker does this, so the arrays of all postings are few: numbers stay small and weights change in place.
        n, df, number = len(self.ids), self.df.astype("int64"), self.number
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * self.boost
        w = self.counts.astype("float64")
        np.log(w, out=w)
        w += 1
        w *= np.repeat(self.idf, df)
        w /= np.sqrt(np.bincount(number, w * w, n))[number]
        blocks = max(1, -(-n // BLOCK))
        often = np.argsort(-df, kind="stable")[:COMMON]
        often = often[df[often] * BLOCK > n]
        #: [term]: its row among the frequent terms, or -1
        self.row = np.full(len(df), -1, "int32")
        self.row[often] = np.arange(len(often))
        row = np.repeat(self.row, df)
        dense = row >= 0
        common = np.zeros((blocks * BLOCK, len(often)), "float32")
        common[number[dense], row[dense]] = w[dense]
        self.centres = _centres(common[:n])  # [group of alike documents, frequent term]
        #: [place]: the document's number, by which ties go
        self.order = np.lexsort((self.sizes, _nearest(common[:n], self.centres)))
        place = np.empty(n, "int32")
        place[self.order] = np.arange(n)
        common[:n] = common[self.order]
        self.common = common  # [place, frequent term]
        self.most = common.reshape(blocks, BLOCK, -1).max(1)  # [block, frequent term]: the largest weight
        #: [term]: where its list starts; lists of frequent terms are empty
        self.starts = np.concatenate([[0], np.cumsum(np.where(self.row >= 0, 0, df))])
        self.docs, self.weights = place[number[~dense]], w[~dense]

    def groups(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The group of alike documents that each query is nearest to."""
        self.ready()
        return _nearest(self._rows(queries), self.centres)

    def _rows(self, queries) -> np.ndarray:
        q = np.zeros((len(queries), self.common.shape[1]), "float32")
        for i, (own, weights) in enumerate(queries):
            rows = self.row[own]
            q[i, rows[rows >= 0]] = weights[rows >= 0]
        return q

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of each unit vector's k nearest documents with a cosine above 0; ties go to the smaller number.

        without: for each query, numbers that are left out, or None. Cosines are sums in single precision, to five places.
        """
        self.ready()
        q, size, blocks = self._rows(queries), len(self.common), len(self.most)
        sums = np.stack([self._rare(*query, size) for query in queries])
        bounds = q @ self.most.T + sums.reshape(len(q), blocks, BLOCK).max(2)
        first = min(FIRST, blocks)
        begin = np.argpartition(-bounds, first - 1, axis=1)[:, :first]
        open_ = np.zeros(blocks, bool)
        for i, own in enumerate(begin):
            places = (own[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = self.common.reshape(blocks, BLOCK, -1)[own].reshape(len(places), -1) @ q[i] + sums[i, places]
            if without is not None and without[i] is not None:
                found[np.isin(self._numbers(places), without[i])] = 0.0
            least = np.partition(found, -k)[-k] if len(found) > k else 0.0
            open_ |= bounds[i] >= max(least - ROOM, 1e-9)
        # The blocks that a query of the batch needs, as runs of neighbours.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view("int8"), [0]]))) * BLOCK
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        places = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, "int64")
        exact = np.concatenate([q @ self.common[a:b].T + sums[:, a:b] for a, b in spans], axis=1) if spans else np.zeros((len(q), 0), "float32")
        return [self._best(exact[i], places, k, without and without[i]) for i in range(len(q))]

    def _numbers(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < len(self.order), self.order[np.minimum(places, len(self.order) - 1)], -1)

    def _rare(self, own, weights, size) -> np.ndarray:
        begin, end = self.starts[own], self.starts[own + 1]
        some = end > begin
        if not some.any():
            return np.zeros(size, "float32")
        begin, end = begin[some], end[some]
        spans = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        add = np.repeat(weights[some], end - begin)
        add *= np.concatenate([self.weights[x] for x in spans])
        return np.bincount(np.concatenate([self.docs[x] for x in spans]), add, size).astype("float32")

    def _best(self, found, places, k, without) -> tuple[np.ndarray, np.ndarray]:
        if without is not None and len(without):
            found = np.where(np.isin(self._numbers(places), without), 0.0, found)
        least = max(np.partition(found, -k)[-k] - ROOM, 1e-9) if len(found) > k else 1e-9
        at = np.flatnonzero(found >= least)
        cosines, at = np.round(np.minimum(found[at].astype("float64"), 1.0), 5), places[at]
        best = np.lexsort((self.order[at], -cosines))[:k]
        best = best[cosines[best] > 0]
        return self.order[at[best]], cosines[best]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T).argmax(1) if len(centres) else np.zeros(len(rows), "int64")


def _centres(rows: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; it only steers which blocks are alike."""
    centres = rows[np.linspace(0, len(rows) - 1, min(ALIKE, len(rows))).astype(int)].copy() if len(rows) else rows
    for _ in range(rounds):
        near = _nearest(rows, centres)
        for g in range(len(centres)):
            if (own := near == g).any():
                mean = rows[own].mean(0)
                centres[g] = mean / (np.sqrt(mean @ mean) + 1e-9)
    return centres


def vote(labels: np.ndarray, cosines: np.ndarray) -> tuple[float, float]:
    """Share of votes for toxic, each weighted by 1 / (distance + 0.1), and the nearest cosine."""
    weights = 1 / (1.1 - cosines)
    return float(weights @ labels / weights.sum()), float(cosines[0])


@dataclass
class Model:
    index: Index
    hashes: np.ndarray  # sorted hashes of the terms; a term's number is its place
    leaning: dict[str, int]  # word starts that lean toxic, with their hashes
    curve: np.ndarray
    without: float  # score of documents that share no term with an example
    _places: dict | None = None
    _more: dict | None = None

    def __getstate__(self):
        return {**self.__dict__, "_places": None, "_more": None}

    def vector(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of the text's unit vector, without the words that no example holds."""
        if self._places is None or len(self._places) > KNOWN:
            self._places, self._more = {}, {}
        places, more, counts = self._places, self._more, Counter(words(data))
        if new := [w for w in counts if w not in places]:
            for w, at in zip(new, self._find([hashed(w) for w in new]), strict=True):
                places[w] = at
                if self.leaning and (own := [self.leaning[t] for t in starts(w) if t in self.leaning]):
                    more[w] = self._find(own)
        own = np.fromiter(map(places.__getitem__, counts), "int64", len(counts))
        n = np.fromiter(counts.values(), "int64", len(counts))
        tf = 1 + np.log(n)
        rare = float(np.square(tf[own < 0]).sum())
        own, n, tf = own[own >= 0], n[own >= 0], tf[own >= 0]
        if more and (others := counts.keys() & more.keys()):
            extra: dict[int, int] = {}
            for w in others:
                for at in more[w]:
                    extra[at] = extra.get(at, 0) + counts[w]
            own = np.concatenate([own, np.array(list(extra), "int64")])
            tf = np.concatenate([tf, 1 + np.log(np.array(list(extra.values()), "int64"))])
        weights = tf * self.index.ready().idf[own]
        return own, weights / math.sqrt(float(weights @ weights) + rare * (math.log(1 + len(self.index.ids)) + 1) ** 2 or 1.0)

    def _find(self, hashes: list[int]) -> list[int]:
        """Numbers of terms, -1 for those that no example holds."""
        if not hashes or not len(self.hashes):
            return [-1] * len(hashes)
        wanted = np.array(hashes, "int64")
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1).tolist()

    def votes(self, texts: list[bytes], without=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of each text's neighbours; without: numbers that are left out, for each text.

        Texts near the same group of examples are searched together, since they need the same blocks.
        """
        out: list = [None] * len(texts)
        for first in range(0, len(texts), 16 * AT_ONCE):
            vectors = [self.vector(x) for x in texts[first : first + 16 * AT_ONCE]]
            order = np.argsort(self.index.groups(vectors), kind="stable")
            for i in range(0, len(order), AT_ONCE):
                own = order[i : i + AT_ONCE]
                found = self.index.search([vectors[j] for j in own], NEIGHBOURS, without and [without[first + j] for j in own])
                for j, x in zip(own, found, strict=True):
                    out[first + j] = x
        return out

    def scores(self, texts: list[bytes]) -> list[tuple[float, tuple[list[int], list[float], list[int]]]]:
        """Probability of toxic, and the nearest examples: ids, cosines, labels."""
        return [self._score(at, cosines) for at, cosines in self.votes(texts)]

    def _score(self, at, cosines):
        if not len(at):
            return self.without, ([], [], [])
        p = float(sigmoid(curve_inputs(*vote(self.index.labels[at], cosines)) @ self.curve))
        return p, (self.index.ids[at[:SHOWN]].tolist(), cosines[:SHOWN].tolist(), self.index.labels[at[:SHOWN]].astype(int).tolist())


def curve_inputs(v: float, top: float) -> np.ndarray:
    return np.array([1.0, 2 * v - 1, (2 * v - 1) * top])


def calibrate(votes: list[tuple[float, float, float]]) -> np.ndarray:
    """Logistic curve over the indexed documents' leave-one-out votes: vote, nearest cosine, label."""
    curve = np.array([0.0, 2.0, 2.0])
    if not votes:
        return curve
    x, y, prior = np.array([curve_inputs(v, top) for v, top, _ in votes]), np.array([label for *_, label in votes], "float64"), curve.copy()
    for _ in range(25):
        p = sigmoid(x @ curve)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * (curve - prior))
        curve = curve + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return curve


def hashed(*parts: bytes) -> int:
    return xxhash.xxh64_intdigest(b"\0".join(parts)) - 2**63


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> Model:
    rows = Scratch(labelled(docs, labels, "toxic", learn, most), "labelled")
    sample = rows.df()
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    leaning = _leaning(sample, n_toxic, n_clean)
    begun = {t: hashed(t.encode()) for t in leaning if t.endswith("*")}

    def vectors(batches):
        for batch in batches:
            found = []
            for x in batch.column("text").cast(pa.binary()):
                counts: dict[int, int] = {}
                for w, n in Counter(words(x.as_py() or b"")).items():
                    for h in (hashed(w), *(begun[t] for t in starts(w) if t in begun)) if begun else (hashed(w),):
                        counts[h] = counts.get(h, 0) + n
                found.append((np.array(list(counts), "int64").tobytes(), np.array(list(counts.values()), "int32").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([f[i] for f in found], pa.binary()) for i in (0, 1))], names=["doc_id", "label", "terms", "counts"])

    # At most SAMPLE rows, with the counts of their own words. They come in parts, by ranges of ids, since the driver is small.
    every = np.sort(sample.select("doc_id").toArrow().column("doc_id").to_numpy())
    edges = sorted({int(x) for x in every[PART::PART]})
    part = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    found = Scratch(sample.mapInArrow(vectors, "doc_id bigint, label int, terms binary, counts binary").withColumn("part", part), "vectors", ["part"])
    hashes, parts = np.zeros(0, "int64"), []
    for i in range(len(edges) + 1):
        table = found.df().filter(F.col("part") == i).select("doc_id", "label", "terms", "counts").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
        lengths = np.array([len(x.as_buffer()) // 8 for x in table.column("terms")], "int64")
        own, counts = (np.frombuffer(b"".join(x.as_buffer() for x in table.column(c)), kind) for c, kind in (("terms", "int64"), ("counts", "int32")))
        hashes = np.union1d(hashes, own)
        parts.append((table.column("doc_id").to_numpy(), table.column("label").to_numpy(), lengths, own, counts.astype(np.min_scalar_type(int(counts.max(initial=0))))))
        del table, own, counts
    found.drop()
    for i, x in enumerate(parts):
        parts[i] = (*x[:3], np.searchsorted(hashes, x[3]).astype("int32"), x[4])
    del x
    ids, labels_, lengths, numbers, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    give_back()
    boost = np.where(np.isin(hashes, [hashed(t.encode()) for t in leaning]), BOOST, 1.0)
    some, bare = lengths > 0, labels_[lengths == 0]
    index = Index.of(ids[some].astype("int64"), labels_[some].astype("float64"), lengths[some], numbers, counts, boost)
    del numbers, counts
    without = (bare.sum() + 0.5) / (len(bare) + 1) if len(bare) else min(0.49, (n_toxic + 0.5) / (n_toxic + n_clean + 1))
    model = Model(index, hashes, begun, np.zeros(3), float(without))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches):
        for batch in batches:
            own, labels_ = shared.value, batch.column("label").to_pylist()
            found = own.votes([x.as_py() or b"" for x in batch.column("text").cast(pa.binary())], [np.flatnonzero(own.index.ids == i) for i in batch.column("doc_id").to_pylist()])
            out = [(*vote(own.index.labels[at], cosines), float(label)) for (at, cosines), label in zip(found, labels_, strict=True) if len(at)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in range(3)], names=["vote", "top", "label"])

    votes = sample.repartition(24).mapInArrow(left_out, "vote double, top double, label double").collect() if len(index.ids) else []
    rows.drop()
    model.curve = calibrate(sorted(tuple(r) for r in votes))
    shared.destroy()
    del votes
    give_back()
    return model


def _leaning(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The words and word starts of the sample that lean toxic; all of its words are looked at.

    The ratio grows with the number of toxic documents, so only terms that pass on it have their surroundings counted.
    """
    toxic = _documents_with(sample.filter("label = 1"), None).filter(F.col("docs") >= LEAST_SEEN)
    toxic = _counts(toxic)
    if not toxic:
        return []
    clean = _counts(_documents_with(sample.filter("label = 0"), set(toxic)))

    def leans(t: str, n: int) -> bool:
        other = clean.get(t, 0)
        return n * max(1, n_clean) > 2 * other * n_toxic and ratio(min(n, n_toxic), other, n_toxic, n_clean) >= LEAST_RATIO

    able = {t for t, n in toxic.items() if leans(t, n)}
    shared = sample.sparkSession.sparkContext.broadcast(able)

    def surroundings(batches):
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for text in batch.column("text").cast(pa.binary()):
                own = words(text.as_py() or b"")
                for i, w in enumerate(own):
                    for t in (w.decode(), *starts(w)):
                        if t in shared.value:
                            found.add((t, 0, hashed(own[i - 1] if i else b"", own[i + 1] if i + 1 < len(own) else b"")))
                            found.add((t, 1, hashed(w)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["term", "kind", "value"])

    # One row for each term and surrounding, then one for each term: a frequent word is no single group.
    seen = sample.filter("label = 1").mapInArrow(surroundings, "term string, kind int, value bigint").distinct()
    seen = seen.groupBy("term").agg(F.count_if(F.col("kind") == 0).alias("around"), F.count_if(F.col("kind") == 1).alias("forms")).collect()
    shared.unpersist()
    kept = {r["term"]: min(toxic[r["term"]], r["around"]) for r in seen if not r["term"].endswith("*") or r["forms"] >= LEAST_WORDS}
    return sorted(t for t, n in kept.items() if n >= LEAST_SEEN and leans(t, n))


def _counts(found: DataFrame) -> dict[str, int]:
    table = found.toArrow()
    return dict(zip(table.column("term").to_pylist(), table.column("docs").to_pylist(), strict=True))


def _documents_with(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """term, docs: how many texts hold each (wanted) word and word start."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches):
        known: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column("text").cast(pa.binary()):
                held: set[str] = set()
                for w in set(words(text.as_py() or b"")):
                    if (own := known.get(w)) is None:
                        own = known[w] = tuple(t for t in (w.decode(), *starts(w)) if shared.value is None or t in shared.value)
                    held.update(own)
                counts.update(held)
                if len(known) > KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "docs"])

    return texts.mapInArrow(counted, "term string, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), evidence: bool = True) -> DataFrame:
    """doc_id, the kept columns, score, predicted (and the nearest examples: ids, cosines, labels) of every row.

    Narrow, with no shuffle. Null and empty texts hold no term and score like any such document; every other one is searched. Null ids and
    repeated rows come back as they are; whole texts of any length count.
    """
    kinds = dict(docs.dtypes)
    rows = only(docs, ("doc_id", "bigint"), ("text", "string"), *[(c, kinds[c]) for c in keep if c not in ("doc_id", "text")])
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]
    # The model holds at most SAMPLE vectors.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            found = shared.value.scores([x.as_py() or b"" for x in batch.column("text").cast(pa.binary())])
            scores = [p for p, _ in found]
            out = [*(batch.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32())]
            names = [*columns, "score", "predicted"]
            if evidence:
                kinds = (("example_ids", pa.int64()), ("example_cosines", pa.float64()), ("example_labels", pa.int32()))
                out += [pa.array([e[i] for _, e in found], pa.list_(kind)) for i, (_, kind) in enumerate(kinds)]
                names += [n for n, _ in kinds]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = rows.select(*columns).schema.add("score", "double").add("predicted", "integer")
    if evidence:
        schema = schema.add("example_ids", T.ArrayType(T.LongType())).add("example_cosines", T.ArrayType(T.DoubleType())).add("example_labels", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(scored, schema)
