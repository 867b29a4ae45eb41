"""Quality classifier by Bradley-Terry pairwise ranking.

Labels give preferences: a document labelled good is preferred to one labelled bad. The model holds that the better
of two wins with probability sigmoid(w . (f(better) - f(worse))); w minimises the logistic loss over feature
differences, by Newton's method. A document's strength is w . f(text), and a quantile of the strengths of labelled
documents is the threshold at which its score is one half: a given one, or the one with the fewest errors on them.

Features are shares and ratios of the whole text and, hashed to LEXICAL places, the shares of its words and word pairs;
never its language, source or id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import give_back, only

#: Labelled documents that the model is fitted on at most (by hash of the id), and preference pairs drawn of theirs at most.
SAMPLE, PAIRS = 20_000, 40_000
#: Places of hashed words and word pairs, and how far a standardised feature counts.
LEXICAL, FAR = 128, 8.0
#: Weight of the quadratic penalty, Newton steps, and pairs whose differences are held at once.
PENALTY, STEPS, AT_ONCE = 1e-3, 25, 2048
NAMES = ("upper", "signs", "signs_any", "bars", "bars_any", "digits", "blank", "repeats", "repeats_any", "fresh", "fresh_lines", "word_length", "log_words", "sentences", "loud", *(f"words_{i}" for i in range(LEXICAL)))

_KINDS = np.zeros(256, "uint8")
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("a") : ord("z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\n\x0b\x0c\r":
    _KINDS[_c] = 4
for _c in b"#$%&*!@^~=+<>{}[]\\/_`":
    _KINDS[_c] = 5
_KINDS[ord("|")] = 6
_KINDS[128:] = 7


def features(data: bytes) -> np.ndarray:
    """The features of a whole text in UTF-8, in the order of NAMES; zeros for a text without words."""
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    raw = np.frombuffer(data, "uint8")
    n = np.bincount(_KINDS[raw], minlength=8)
    accents = np.flatnonzero(raw[:-1] == 0xC3)
    capital = int((raw[accents + 1] < 0x9F).sum())
    upper, lower = int(n[1]) + capital, int(n[2]) + len(accents) - capital
    size, m = len(data), len(words)
    low = data.lower().split()
    repeats = sum(map(bytes.__eq__, low, low[1:])) / max(1, m - 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    fresh = len(set(low)) / m
    signs, bars = n[5] / size, n[6] / m
    shares = [
        upper / max(1, upper + lower), signs, min(1.0, 25 * signs), bars, min(1.0, 10 * bars), n[3] / size, n[4] / size, repeats, min(1.0, 10 * repeats),
        fresh * min(1.0, np.log1p(m) / 6), len(set(lines)) / max(1, len(lines)), min(2.0, (size - n[4]) / m / 10), np.log1p(m) / 10, min(1.0, data.count(b".") * 10 / m), data.count(b"!") / m,
    ]
    if len(_hashes) > 400_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, low), "uint64", m)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    at = np.concatenate([h, pairs ^ pairs >> np.uint64(29)]) % np.uint64(LEXICAL)
    return np.concatenate([shares, np.sqrt(np.bincount(at.astype("int64"), minlength=LEXICAL) / (2 * m))])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def vectors(texts: pa.Array) -> np.ndarray:
    return np.array([features(x.as_py() or b"") for x in texts.cast(pa.binary())], "float64").reshape(-1, len(NAMES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass(frozen=True)
class BradleyTerry:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    quantile: float
    threshold: float

    def scores(self, found: np.ndarray) -> np.ndarray:
        """From 0 to 1; one half at the threshold."""
        return sigmoid(standard(found, self.mean, self.spread) @ self.weights - self.threshold)


def standard(found: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((found - mean) / spread, -FAR, FAR)


def fit(found: np.ndarray, good: np.ndarray, quantile: float | None = None, seed: int = 5) -> BradleyTerry:
    """The model of labelled features; with only one label, or none, every score lies on that label's side.

    quantile: share of the labelled documents that are to lie below the threshold; the one with the fewest errors unless given.
    """
    width = found.shape[1]
    if not good.any() or good.all():
        side = 1.0 if good.any() or not len(good) else -1.0
        return BradleyTerry(np.zeros(width), np.zeros(width), np.ones(width), 0.0, -side)
    mean, spread = found.mean(0), found.std(0) + 1e-6
    x = standard(found, mean, spread)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    draw = np.random.default_rng(seed)
    pairs = min(PAIRS, len(better) * len(worse))
    won, lost = draw.choice(better, pairs), draw.choice(worse, pairs)
    w = np.zeros(width)
    for _ in range(STEPS):
        gradient, curve = -PENALTY * w, PENALTY * np.eye(width)
        for i in range(0, pairs, AT_ONCE):  # the differences of all pairs would be the largest array of a small driver
            d = x[won[i : i + AT_ONCE]] - x[lost[i : i + AT_ONCE]]
            p = sigmoid(-(d @ w))
            gradient += d.T @ p / pairs
            curve += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    strength = x @ w
    order = np.argsort(strength, kind="stable")
    # Errors if the k weakest count as bad, for every k; the threshold is the quantile with the fewest.
    bad_below = np.concatenate([[0], np.cumsum(~good[order])])
    good_below = np.concatenate([[0], np.cumsum(good[order])])
    errors = good_below + (bad_below[-1] - bad_below)
    best = np.flatnonzero(errors == errors.min())
    s = strength[order]
    gaps = [(s[k] if k < len(s) else s[-1] + 1) - (s[k - 1] if k else s[0] - 1) for k in best]
    k = int(best[int(np.argmax(gaps))]) if quantile is None else min(len(s), max(0, round(quantile * len(s))))
    threshold = ((s[k] if k < len(s) else s[-1] + 1) + (s[k - 1] if k else s[0] - 1)) / 2
    return BradleyTerry(w, mean, spread, k / len(s), float(threshold))


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, most: int) -> DataFrame:
    """doc_id, text, label of at most ``most`` documents with a label from rows where learn holds, by hash of the id.

    Ids without a label of 0 or 1, or with several that differ, are left out; so are null ids.
    """
    known = only(labels, ("doc_id", "bigint"), (column, "int")).filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).filter("label = other").select("doc_id", "label")
    known = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    return only(docs, ("doc_id", "bigint"), ("text", "string")).join(F.broadcast(known), "doc_id")  # at most ``most`` rows


def learns(divisor: int, held: int) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo divisor, is not held."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor != held


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE, quantile: float | None = None) -> BradleyTerry:
    def measured(batches):
        for batch in batches:
            found = vectors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "found"])

    table = labelled(docs, labels, "quality", learn, most).mapInArrow(measured, "doc_id bigint, label int, found binary").toArrow().sort_by([("doc_id", "ascending"), ("found", "ascending")])
    found, good = np.empty((len(table), len(NAMES))), table.column("label").to_numpy() == 1
    for i, x in enumerate(table.column("found")):
        found[i] = np.frombuffer(x.as_buffer())
    del table
    give_back()
    model = fit(found, good, quantile)
    del found
    give_back()
    return model


def score(docs: DataFrame, model: BradleyTerry, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, score and predicted of every row; narrow, with no shuffle.

    Null texts count as empty; a text without words has all features zero and is scored like any other. Null ids
    and repeated rows come back as they are.
    """
    kinds = dict(docs.dtypes)
    rows = only(docs, ("doc_id", "bigint"), ("text", "string"), *[(c, kinds[c]) for c in keep if c not in ("doc_id", "text")])
    columns = ["doc_id", *[c for c in keep if c != "doc_id"]]

    def scored(batches):
        for batch in batches:
            found = model.scores(vectors(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found), pa.array((found >= 0.5).astype("int32"))], names=[*columns, "score", "predicted"])

    schema = rows.select(*columns).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(scored, schema)
