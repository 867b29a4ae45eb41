"""Document fingerprints by winnowing, in DataFrame functions only.

Every k-gram of code points gets its polynomial (Rabin-Karp) hash; in each window of w neighbouring k-grams the smallest
hash is chosen, the rightmost one on ties, and its position kept. Two texts that share a run of w + k - 1 code points
share a chosen hash. One grain serves texts of every length and script.

SQL functions keep no state from one element to the next, so the values of the rolling hash are made by joining
instead: the hash of a pair is the first times BASE plus the second, and four pairs join by powers of BASE. Likewise the
least of sixteen k-grams is the least of four leasts of four. So a place takes few steps, not one for each of its k
code points and w k-grams. Of an edited text only the windows over its seam are hashed; the others are those of its two texts.

A chosen k-gram is one long: 31 bits of hash, then the position counted downward, so that the least long is the
least hash with the rightmost position. A text of fewer than k code points is one k-gram (zeros follow); an empty text
has none. A text of fewer than w k-grams is one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import only

#: Fixed by how they are joined: code points of a k-gram (four pairs), and k-grams of a window (four fours).
GRAM, WINDOW = 8, 16
#: Code points that a window of k-grams covers.
REACH = GRAM + WINDOW - 1
#: The hash's base and its modulus, a prime.
BASE, PRIME = 1_103_515_245, (1 << 31) - 1
#: Rows of a bucket of neighbouring ids, and buckets at most (their edges are broadcast, 1.6 MB).
ROWS, BUCKETS = 500, 200_000
#: Parts that the rows of one crowded id are spread over.
SPREAD = 256
_LAST = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def codes(text: Column) -> Column:
    """The code points of a text; an empty pattern cuts fast, but would cut the pairs that Java holds rare ones in."""
    cut = F.when(F.rlike(text, F.lit("[\\x{10000}-\\x{10FFFF}]")), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).otherwise(F.split(text, ""))
    return F.transform(F.slice(cut, F.lit(1), F.length(text)), lambda c: F.ascii(c).cast("bigint"))


def window_leasts(text: Column, offset: Column) -> Column:
    """array<bigint>: the least k-gram of each window of a text of at least one code point, which begins at position offset of the whole text."""

    def padded(x: Column, least: int, by: int) -> Column:
        return let(x, lambda v: F.when(F.size(v) < least, F.concat(v, F.array_repeat(F.lit(by).cast("bigint"), F.lit(least) - F.size(v)))).otherwise(v))

    def over(x: Column, reach: int, made: Callable[[Callable[[int], Column], Column], Column]) -> Column:
        """made(at, i) for every place i whose places up to i + reach are there; at(j) is the element at i + j."""
        return let(x, lambda v: F.transform(F.slice(v, F.lit(1), F.size(v) - reach), lambda own, i: made(lambda j: F.get(v, i + j) if j else own, i)))

    power = lambda m: F.lit(pow(BASE, m, PRIME)).cast("bigint")
    prime = F.lit(PRIME).cast("bigint")
    pairs = over(padded(codes(text), GRAM, 0), 1, lambda at, i: at(0) * power(1) + at(1))
    joined = lambda at: ((((at(0) % prime) * power(2) + at(2)) % prime * power(2) + at(4)) % prime * power(2) + at(6)) % prime
    # The place of the first k-gram is found once, not for each one.
    grams = let(F.lit(_LAST).cast("bigint") - offset, lambda first: over(pairs, GRAM - 2, lambda at, i: F.shiftleft(joined(at), 31) + (first - i)))
    fours = over(padded(grams, WINDOW, (1 << 62) + _LAST), 3, lambda at, i: F.least(at(0), at(1), at(2), at(3)))
    return over(fours, WINDOW - 4, lambda at, i: F.least(at(0), at(4), at(8), at(12)))


def chosen(text: Column) -> Column:
    """array<bigint>: the chosen k-grams of a text, in order of position."""
    return F.when(F.length(text) > 0, F.array_distinct(window_leasts(text, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def first_chosen(found: Column, windows: Column) -> Column:
    """The chosen k-grams of a text's first windows, out of all its chosen ones; these windows are whole."""
    at = lambda v: F.lit(_LAST).cast("bigint") - v.bitwiseAND(F.lit(_LAST).cast("bigint"))
    # The last window's choice is the least of all that were chosen in its reach; later ones are of later windows.
    reach = lambda m: F.filter(found, lambda v: (at(v) >= m - 1) & (at(v) < m + (WINDOW - 1)))
    upto = lambda m: let(at(F.array_min(reach(m))), lambda last: F.filter(found, lambda v: at(v) <= last))
    return let(windows, lambda m: F.when(m > 0, upto(m)).otherwise(F.array().cast("array<bigint>")))


def spliced(own: Column, after: Column, seam: Column, same: Column, taken: Column) -> Column:
    """The chosen k-grams of ``same`` code points of one text and the first ``taken`` of another, from those of both.

    Only the windows over the seam are hashed anew: ``seam`` holds the code points of all windows that lie in neither.
    """
    before = F.greatest(F.lit(0), same - (REACH - 1))
    # A seam shorter than a window is a whole short text, or lies in the first text's last window.
    over = F.when((F.length(seam) >= REACH) | ((before == 0) & (F.length(seam) > 0)), window_leasts(seam, before)).otherwise(F.array().cast("array<bigint>"))
    moved = F.transform(first_chosen(after, taken - (REACH - 1)), lambda v: v - same)
    return F.array_distinct(F.concat(first_chosen(own, before), over, moved))


def shown(found: Column) -> Column:
    """The fingerprint as text: hash@position of each chosen k-gram in order of position."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 31))), F.lit("@"), (F.lit(_LAST).cast("bigint") - v.bitwiseAND(F.lit(_LAST).cast("bigint"))).cast("string"))
    return F.array_join(F.transform(found, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the chosen hashes, 0 to 1; two empty fingerprints are alike."""
    bare = lambda f: F.array_distinct(F.transform(f, lambda v: F.shiftright(v, 31)))
    share = lambda p, q, n: F.when(F.size(p) + F.size(q) == 0, F.lit(1.0)).otherwise(n / (F.size(p) + F.size(q) - n))
    return let(bare(a), lambda p: let(bare(b), lambda q: let(F.size(F.array_intersect(p, q)), lambda n: share(p, q, n)))).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint of every row's whole text (null: empty) and its chosen k-grams; no shuffle."""
    rows = only(docs, ("doc_id", "bigint"), ("text", "string"))
    return rows.select("doc_id", chosen(F.coalesce("text", F.lit(""))).alias("grams")).select("doc_id", shown(F.col("grams")).alias("fingerprint"), "grams")


def edited(docs: DataFrame) -> DataFrame:
    """Every text against its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit replaces the last floor(n / 3) code points by the first as many (or all) of the next document's, in
    descending order of ids; after the last comes the first. Rows with equal ids follow one another by text, null
    ids come last, and a table of one row is its own neighbour. Null texts count as empty; the fingerprint of an
    empty text has no k-grams. Other columns take no part.

    Neighbours are found in one shuffle of the texts into buckets of neighbouring ids, at quantiles of the ids;
    a bucket's first rows also go to the bucket before it, as the neighbours of its last ones. One id repeated
    without end is spread over buckets of its own by a hash of the text, which sets the order of its rows.
    """
    rows = only(docs, ("doc_id", "bigint"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    ids = only(docs, ("doc_id", "bigint"))
    shape = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    n, named = shape["n"], shape["named"]
    wanted = max(1, min(BUCKETS, n // ROWS))
    edges: list[int] = []
    if named and wanted > 1:
        cuts = [k / wanted for k in range(1, wanted)]
        found = ids.filter("doc_id is not null").agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * wanted)).alias("q")).first()["q"]
        edges = sorted(set(found))
    # Order: ids descending, nulls last; among equal ids the hash of the text, then the text. A bucket is the number
    # of edges at or above the id; an id that is itself an edge more than once would fill a bucket alone, so the
    # rows of an edge id are spread by the hash over up to SPREAD parts that keep the order.
    place = _place(F.col("doc_id"), edges)
    tie = F.xxhash64("text")
    spot = rows.select("doc_id", "text", place.alias("bucket"), tie.alias("tie"))
    crowded = {r["doc_id"] for r in ids.filter(F.col("doc_id").isin(edges) if len(edges) <= BUCKETS else F.lit(True)).groupBy("doc_id").count().filter(F.col("count") > ROWS).collect()} if edges else set()
    nulls = n - named > ROWS
    parts = F.lit(0)
    if crowded or nulls:
        split = F.floor((F.shiftright(F.col("tie"), 32) + F.lit(1 << 31)) / F.lit((1 << 32) / SPREAD)).cast("int")
        busy = F.col("doc_id").isin(sorted(crowded)) if crowded else F.lit(False)
        parts = F.when(F.coalesce(busy, F.lit(nulls)), split).otherwise(0)
    spot = spot.withColumn("part", parts)
    key = ["bucket", "part"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("text")]
    # One row for each bucket that holds rows, in order; at most BUCKETS * a few of them, so the driver may link them.
    if crowded or nulls:
        heads = spot.groupBy(*key).agg(F.max("doc_id").alias("top")).collect()
    else:
        heads = ids.select(place.alias("bucket"), F.lit(0).alias("part"), "doc_id").groupBy(*key).agg(F.max("doc_id").alias("top")).collect()
    heads.sort(key=lambda r: (r["bucket"], -r["top"] if r["top"] is not None else float("inf"), r["part"]))
    links = [(h["bucket"], h["part"], h["top"], heads[i - 1]["bucket"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    spark = docs.sparkSession
    if not links:
        return _result(spot.withColumn("ghost", F.lit(False)).withColumn("next_text", F.lit("")), key, order)
    linked = spark.createDataFrame(links, "bucket int, part int, top bigint, to_bucket int, to_part int")
    # The first row of a bucket, among those with its top id: few rows for each bucket.
    tops = spot.join(F.broadcast(linked), key).filter(F.col("doc_id").eqNullSafe(F.col("top")))
    first = tops.groupBy("to_bucket", "to_part").agg(F.min_by(F.struct("doc_id", "text", "tie"), F.struct("tie", "text")).alias("r"))
    ghosts = first.select("r.doc_id", "r.text", F.col("to_bucket").alias("bucket"), "r.tie", F.col("to_part").alias("part"), F.lit(True).alias("ghost"))
    every = spot.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    every = every.withColumn("next_text", F.lead("text").over(Window.partitionBy(*key).orderBy("ghost", *order)))
    return _result(every, key, order)


def _place(doc_id: Column, edges: list[int]) -> Column:
    """Buckets in descending order of ids; nulls come last. Two steps of about the root of the edges' number."""
    if not edges:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    step = max(1, int(len(edges) ** 0.5))
    coarse, fine = edges[::step], [edges[i : i + step] for i in range(0, len(edges), step)]
    above = F.size(F.filter(F.lit(coarse), lambda e: e <= doc_id))
    row = F.get(F.lit([[*r, *[2**63 - 1] * (step - len(r))] for r in fine]), above - 1)
    low = F.when(above == 0, 0).otherwise((above - 1) * step + F.size(F.filter(row, lambda e: e <= doc_id)))
    return F.when(doc_id.isNull(), len(edges) + 1).otherwise(F.lit(len(edges)) - low).cast("int")


def _result(every: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    n, next_text = F.length("text"), F.coalesce("next_text", F.lit(""))
    third = F.floor(n / 3).cast("int")
    made = every.select("doc_id", "ghost", *key, "tie", "text", n.alias("n"), (n - third).alias("same"), F.substring(next_text, F.lit(1), third).alias("new"))
    same, new = F.col("same"), F.col("new")
    # From the first window that leaves the text to the last that enters the next one's part, or to the end where no window fits in it.
    before = F.greatest(F.lit(0), same - (REACH - 1))
    seam = F.concat(F.substring("text", before + 1, same - before), F.substring(new, F.lit(1), F.when(F.length(new) >= REACH, F.lit(REACH - 1)).otherwise(F.length(new))))
    sha = F.sha2(F.concat(F.substring("text", F.lit(1), same), new).cast("binary"), 256)
    made = made.select(
        "doc_id", "ghost", *key, "tie", "text", F.col("n").cast("bigint").alias("n_chars"), sha.alias("edited_sha256"),
        "same", F.length(new).alias("taken"), seam.alias("seam"), chosen(F.col("text")).alias("own"),
    )
    made = made.withColumn("after", F.lead("own").over(Window.partitionBy(*key).orderBy("ghost", *order))).filter(~F.col("ghost"))
    changed = spliced(F.col("own"), F.coalesce("after", F.array().cast("array<bigint>")), F.col("seam"), F.col("same"), F.col("taken"))
    made = made.select("doc_id", "n_chars", "edited_sha256", "own", "after", changed.alias("changed"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
