"""Exact n-gram Jaccard self-join by filters under several global token orders.

A document's set holds its distinct word shingles. If two sets of sizes x, y have a Jaccard similarity of at least t,
then under ANY order of all tokens the first x - ceil(t x) + 1 tokens of one and the first y - ceil(t y) + 1 of the
other share a token. The first order puts rare tokens first (by levels of a count over the whole corpus), the others
follow a hash each; a pair must share a prefix token under every one of them before its sets are read.

1. Documents with equal word sequences form a class; only one document of a class goes on in a task.
2. A count sketch of all shingles gives each token its level. It is summed by segments and is broadcast as at most
   2^MOST_BITS bytes.
3. Prefix tokens under the first order are dealt by token. What remains are tokens that several classes hold.
4. Each class is first paired with the most central class among those it shares a token with. Verified pairs
   contract; then the pairs of classes in different components that still share a token are verified too, and no
   others are made. So a group of thousands of near copies costs about one pair each, and no component is missed.
   A token that many classes hold is split into blocks of classes, and each two blocks meet in a task of their own.
5. The prefixes under the further orders travel with each class (16 bits a token); pairs whose prefixes share none
   under one of the orders go, and so do pairs that fail an exact bound on the sets' difference, told by a bit for
   each token. Only then are sets read and compared.
6. Components of the links, by stars.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import Scratch, only, written
from tamis.llm.components import components

#: log2 of the sketch's counters, least and most, and counters for each document between them.
LEAST_BITS, MOST_BITS, COUNTERS = 16, 24, 64
#: log2 of a segment of the sketch: what a task sends at once, and what is summed in one place.
SEGMENT = 14
#: Prefix tokens that a bucket of the index holds, roughly; and prefix tokens of a document, for the number of buckets.
BUCKET, PREFIX = 400_000, 110
#: log2 of the bits that tell which classes are candidates.
MOST_FLAGS = 26
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Classes of a block of a token that many hold.
HOLDERS = 2000
#: Odd multipliers, each of which makes an order of its own.
ORDERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(data: bytes) -> list[bytes]:
    """Runs of other bytes than ASCII white space, A-Z in lower case."""
    return data.lower().split()


def shingles(own: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, none none."""
    if not own:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), "uint64", len(own))
    m = max(1, len(own) - n + 1)
    k = min(n, len(own))
    out = np.full(m, k, "uint64")
    for j in range(k):
        out = (out + h[j : j + m]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(x: int, y: int, t: tuple[int, int]) -> int:
    """Smallest intersection of sets of sizes x and y with a similarity of at least t = a / b."""
    a, b = t
    return -(-a * (x + y) // (a + b))


def prefix(n: int, t: tuple[int, int]) -> int:
    return n + (-t[0] * n // t[1]) + 1 if n else 0


def keys(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The place of each token in the first order: its level, then its hash."""
    level = levels[tokens & np.uint64(len(levels) - 1)].astype("uint64")
    return (level << np.uint64(56)) | (tokens >> np.uint64(8))


def signatures(tokens: np.ndarray, t: tuple[int, int]) -> bytes:
    """The prefixes under the further orders: for each the sorted last 16 bits of its tokens' hashes."""
    p, found = prefix(len(tokens), t), []
    for order in ORDERS:
        key = tokens * order
        key ^= key >> np.uint64(32)
        first = tokens[np.argpartition(key, p - 1)[:p]] if p < len(tokens) else tokens
        found.append(np.sort((first >> np.uint64(20)).astype("uint16")))
    return np.concatenate(found).tobytes()


def orders_allow(a: bytes, b: bytes) -> list[bool]:
    """For each further order, whether the two prefixes may share a token; False is certain."""
    x, y = (np.frombuffer(s, "uint16").reshape(len(ORDERS), -1) for s in (a, b))
    return [bool(np.isin(p, q).any()) for p, q in zip(x, y, strict=True)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _class(own: list[bytes]) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(own), 7))


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each place that an odd number of tokens fall on; as many places as tokens, up to a power of two."""
    size = 64
    while size < len(tokens) and size < 1 << 16:
        size *= 2
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype("int64"), minlength=size).astype("uint8") & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, x: int, y: int, t: tuple[int, int]) -> bool:
    """False only where two sets of sizes x and y differ too much: their bitmaps differ in no more places than they in tokens."""
    a, b = np.frombuffer(a, "uint8"), np.frombuffer(b, "uint8")
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= x + y - 2 * least_overlap(x, y, t)


def _scan(docs: DataFrame, n: int, t: tuple[int, int], bits: int) -> Scratch:
    """kind 0: doc_id, class, set size of every row, bitmap and prefixes under the further orders of its class where this task
    met that first. kind 1: this task's part of the sketch, by segments."""
    size, part = 1 << bits, 1 << SEGMENT
    names = ["kind", "doc_id", "cls", "n", "segment", "bits", "prefixes"]

    def scanned(batches):
        counts, any_row, seen = np.zeros(size, "uint32"), False, set()
        for batch in batches:
            ids, classes, sizes, bits_of, prefixes, tokens, waiting = batch.column(0), [], [], [], [], [], 0
            for x in batch.column(1).cast(pa.binary()):
                own = words(x.as_py() or b"")
                found = shingles(own, n)
                tokens.append(found)
                classes.append(_class(own))
                sizes.append(len(found))
                first = classes[-1] not in seen
                if first and len(seen) < 500_000:
                    seen.add(classes[-1])
                bits_of.append(bitmap(found) if first else None)
                prefixes.append(signatures(found, t) if first else None)
                waiting += len(found)
                if waiting > 1 << 20:
                    _add(counts, tokens)
                    waiting = 0
            _add(counts, tokens)
            any_row = any_row or bool(sizes)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, "int32")), ids, pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(m, pa.int32()), pa.array(bits_of, pa.binary()), pa.array(prefixes, pa.binary())], names=names)
        if any_row:
            for first in range(0, size // part, 64):
                places = list(range(first, min(first + 64, size // part)))
                own = [zlib.compress(np.minimum(counts[s * part : (s + 1) * part], 65535).astype("uint16").tobytes(), 1) for s in places]
                m = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, "int32")), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(places, pa.int32()), pa.array(own, pa.binary()), pa.nulls(m, pa.binary())], names=names)

    rows = only(docs, ("doc_id", "bigint"), ("text", "string"))
    return Scratch(rows.mapInArrow(scanned, "kind int, doc_id bigint, cls bigint, n bigint, segment int, bits binary, prefixes binary"), "shingled", ["kind"])


def _add(counts: np.ndarray, tokens: list[np.ndarray]) -> None:
    if tokens:
        at, n = np.unique(np.concatenate(tokens) & np.uint64(len(counts) - 1), return_counts=True)
        counts[at] += n.astype("uint32")
        tokens.clear()


def _levels(parts: DataFrame, bits: int) -> np.ndarray:
    """A byte for each counter: twice the log2 of its sum over all tasks."""

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(zlib.decompress(c.as_py()), "uint16")
                if s in held:
                    held[s] += own
                else:
                    held[s] = own.astype("uint64")
        rows = [(s, np.floor(2 * np.log2(1.0 + c)).astype("uint8").tobytes()) for s, c in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["segment", "levels"])

    segments = max(1, (1 << bits) >> SEGMENT)
    found = parts.select("segment", "bits").repartition(min(segments, 64), "segment").mapInArrow(summed, "segment int, levels binary").toArrow()
    out, part = np.zeros(1 << bits, "uint8"), 1 << SEGMENT
    for s, c in zip(found.column("segment").to_pylist(), found.column("levels"), strict=True):
        out[s * part : (s + 1) * part] = np.frombuffer(c.as_py(), "uint8")
    return out


def _shared_tokens(docs: DataFrame, n: int, t: tuple[int, int], levels, buckets: int) -> DataFrame:
    """tok, cls, n, pos, held: the prefix tokens under the first order that several classes hold, and how many."""

    def indexed(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, classes, sizes, places = [], [], [], []
            for x in batch.column(1).cast(pa.binary()):
                own = words(x.as_py() or b"")
                if not own or (cls := _class(own)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(cls)
                found = shingles(own, n)
                p = prefix(len(found), t)
                order = keys(found, levels.value)
                first = np.argpartition(order, p - 1)[:p] if p < len(found) else np.arange(len(found))
                first = first[np.argsort(order[first])]
                tokens.append(found[first])
                classes.append(np.full(p, cls, "int64"))
                sizes.append(np.full(p, len(found), "int32"))
                places.append(np.arange(p, dtype="int32"))
            if not tokens:
                continue
            tok, cls, size, pos = map(np.concatenate, (tokens, classes, sizes, places))
            bucket = ((tok >> np.uint64(32)) % np.uint64(buckets)).astype("int32")
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for own in np.split(order, cuts):
                cell = np.zeros(len(own), [("tok", "<u4"), ("cls", "<i8"), ("n", "<i4"), ("pos", "<i4")])
                cell["tok"], cell["cls"], cell["n"], cell["pos"] = tok[own] & np.uint64(0xFFFFFFFF), cls[own], size[own], pos[own]
                blob = b"".join(cell[f].tobytes() for f in ("tok", "cls", "n", "pos"))
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "m", "entries"])

    dealt = only(docs, ("doc_id", "bigint"), ("text", "string")).filter("doc_id is not null").mapInArrow(indexed, "bucket int, m int, entries binary")

    def joined(table: pa.Table) -> pa.Table:
        cells = []
        for m, e in zip(table.column("m").to_pylist(), table.column("entries"), strict=True):
            raw = e.as_py()
            cells.append((np.frombuffer(raw, "<u4", m), np.frombuffer(raw, "<i8", m, 4 * m), np.frombuffer(raw, "<i4", m, 12 * m), np.frombuffer(raw, "<i4", m, 16 * m)))
        tok, cls, size, pos = (np.concatenate(c) for c in zip(*cells, strict=True))
        order = np.lexsort((cls, tok))
        tok, cls, size, pos = tok[order], cls[order], size[order], pos[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
        tok, cls, size, pos = tok[new], cls[new], size[new], pos[new]
        start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        held = np.diff(np.concatenate([start, [len(tok)]]))
        keep = np.repeat(held > 1, held)
        many = np.repeat(held, held)[keep]
        bucket = int(table.column("bucket")[0].as_py())
        full = (np.int64(bucket) << np.int64(32)) | tok[keep].astype("int64")
        return pa.table([pa.array(full), pa.array(cls[keep]), pa.array(size[keep]), pa.array(pos[keep]), pa.array(many.astype("int64"))], names=["tok", "cls", "n", "pos", "held"])

    return dealt.groupBy("bucket").applyInArrow(joined, "tok bigint, cls bigint, n int, pos int, held bigint")


def _sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """cls, tokens (binary): the sets of the wanted classes, one row each.

    Which documents they are is told by a bit for each hash of a class, up to 2^MOST_FLAGS bits; where these fill
    up, more sets than needed are read, and none is missed.
    """
    wanted = written(wanted, "wanted")
    count = wanted.count()
    bits = 10
    while bits < MOST_FLAGS and 1 << bits < 16 * count:
        bits += 1
    flag = F.col("cls").bitwiseAND(F.lit((1 << bits) - 1))
    cells = wanted.select(F.shiftright(flag, 5).alias("at"), F.expr("shiftleft(1L, cast(cls & 31 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    flags = np.zeros(1 << max(0, bits - 5), "uint32")
    flags[cells.column("at").to_numpy()] = cells.column("bits").to_numpy().astype("uint32")
    flags = docs.sparkSession.sparkContext.broadcast(flags)
    low = (1 << bits) - 1

    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            classes, tokens = [], []
            for x in batch.column(1).cast(pa.binary()):
                own = words(x.as_py() or b"")
                if not own:
                    continue
                cls = _class(own)
                at = cls & low
                if cls in seen or not int(flags.value[at >> 5]) >> (at & 31) & 1:
                    continue
                seen.add(cls)
                classes.append(cls)
                tokens.append(shingles(own, n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(tokens, pa.binary())], names=["cls", "tokens"])

    rows = only(docs, ("doc_id", "bigint"), ("text", "string")).filter("doc_id is not null").mapInArrow(read, "cls bigint, tokens binary")
    return rows.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def _plausible(pairs: DataFrame, classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs a, b that share a prefix token under each further order and whose bitmaps allow them."""
    side = lambda c: classes.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "bits", "prefixes")])
    found = pairs.join(side("b"), "b").join(side("a"), "a")

    def kept(batches):
        for batch in batches:
            x, y, p, q, u, v = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b", "prefixes_a", "prefixes_b"))
            keep = [i for i in range(len(x)) if all(orders_allow(u[i], v[i])) and may_be_similar(p[i], q[i], x[i], y[i], t)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return found.select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "prefixes_a", "prefixes_b").mapInArrow(kept, "a bigint, b bigint")


def _verify(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    """The pairs a, b whose sets are similar."""
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("right")), "b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("left")), "a")

    def verified(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
                x, y = np.frombuffer(x.as_py(), "uint64"), np.frombuffer(y.as_py(), "uint64")
                if len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x), len(y), t):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "left", "right").mapInArrow(verified, "a bigint, b bigint")


def _linked(docs: DataFrame, n: int, t: tuple[int, int], pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, written; only the sets of pairs that all orders and the bitmaps allow are read."""
    likely = written(_plausible(pairs, classes, t), "likely")
    wanted = likely.select(F.col("a").alias("cls")).unionByName(likely.select(F.col("b").alias("cls"))).distinct()
    sets = written(_sets(docs, n, wanted), "sets")
    return written(_verify(likely, sets, t), "linked")


def _fits(t: tuple[int, int], a: str, b: str) -> str:
    """SQL: the sizes allow the similarity, and so do the places of the shared token if it is the first one."""
    p, q = t
    return (
        f"{q} * least({a}.n, {b}.n) >= {p} * greatest({a}.n, {b}.n) and "
        f"{p + q} * (1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1) >= {p} * ({a}.n + {b}.n)"
    )


def join(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and links: how many verified links its class has kept.

    Two documents link where their sets of n-word shingles have a Jaccard similarity of at least similarity (a, b),
    as a / b. component_id is the smallest doc_id that links reach, the document's own included. links counts the
    links that were verified to settle the components, not all that hold within one.

    Null texts and texts without words have an empty set and link with nothing. Rows without an id get no
    component and link with nothing. Rows with equal ids are one document: what one of them reaches, all do. Whole
    texts of any length count. Other columns take no part. An empty table gives no rows. Sets hold 64-bit hashes of
    shingles: two different shingles of one pair of documents fall together with a chance of about size^2 / 2^64.
    """
    t = similarity
    context = docs.sparkSession.sparkContext
    count = docs.count()
    bits = LEAST_BITS
    while bits < MOST_BITS and 1 << bits < COUNTERS * count:
        bits += 1
    scan = _scan(docs, n, t, bits)
    rows = scan.df()
    levels = context.broadcast(_levels(rows.filter("kind = 1"), bits))
    of_docs = rows.filter("kind = 0").select("doc_id", "cls", "n")
    # cls is a hash of the words; with the set's size it names the class.
    classes = written(rows.filter("kind = 0 and n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits"), F.min("prefixes").alias("prefixes")).filter("rep is not null"), "classes")

    buckets = max(8, -(-count * PREFIX // BUCKET))
    shared = written(_shared_tokens(docs, n, t, levels, buckets), "shared")
    active = shared.groupBy("cls").agg(F.sum("held").alias("weight"))

    # First pairs: each class and the most central one that it shares a fitting token with.
    weighed = shared.join(active, "cls")
    heads = weighed.groupBy("tok").agg(F.max(F.struct("weight", "cls", "n", "pos")).alias("h")).select("tok", "h.*")
    w, h = weighed.alias("w"), heads.alias("h")
    first = w.join(h, F.col("w.tok") == F.col("h.tok")).filter("w.cls <> h.cls and " + _fits(t, "w", "h")).groupBy(F.col("w.cls").alias("cls")).agg(F.max(F.struct(F.col("h.weight"), F.col("h.cls"))).alias("h"))
    first = written(first.select(F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct(), "first")
    links = _linked(docs, n, t, first, classes)

    # Then the pairs across components that share a fitting token.
    parts = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    placed = shared.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    open_ = placed.groupBy("tok").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("tok")
    placed = written(placed.join(open_, "tok", "left_semi").select("tok", "cls", "n", "pos", "component", "held"), "open")
    # Each two blocks of a token's classes meet under a key of their own; few tokens have more than one block.
    blocks = F.ceil(F.col("held") / HOLDERS).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a, b = placed.withColumn("left", F.col("block")).withColumn("right", every).alias("a"), placed.withColumn("right", F.col("block")).withColumn("left", every).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("tok", "left", "right")]
    more = a.join(b, same[0] & same[1] & same[2] & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.component") != F.col("b.component"))).filter(_fits(t, "a", "b"))
    more = more.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = written(links.unionByName(_linked(docs, n, t, more, classes)), "linked")

    # From classes to documents; an id on several rows with different words ties their classes together.
    name = classes.groupBy("cls").agg(F.min("rep").alias("rep"))
    u, v = name.select(F.col("cls").alias("a"), F.col("rep").alias("u")), name.select(F.col("cls").alias("b"), F.col("rep").alias("v"))
    named = written(links.join(u, "a").join(v, "b").select("u", "v"), "named")
    repeated = of_docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id")
    repeated = written(repeated, "repeated")
    tied = of_docs.join(repeated, "doc_id", "left_semi").join(classes.select("cls", "rep"), "cls").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    parts = written(components(named.unionByName(tied)), "parts")
    degrees = named.select(F.col("u").alias("rep")).unionByName(named.select(F.col("v").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(degrees, "rep", "left").select("cls", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = of_docs.join(of_class, ["cls", "n"], "left")
    if not repeated.isEmpty():
        own = repeated.join(parts, repeated["doc_id"] == parts["node"]).select("doc_id", F.col("component").alias("own"))
        out = out.join(own, "doc_id", "left").withColumn("component", F.coalesce("own", "component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("bigint").alias("links"))
