"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: sources share all words by weight; a target stops at ``most`` times its source's size and the excess is
shared again by weight. So target = min(most * size, level * weight) for one common level.

Order: each document draws a key ``-ln(u) / quality`` from a hash of its own content; in ascending order of keys
this is weighted sampling without replacement. A target's complete epochs take every document, then documents in key
order fill what is left: first as far as prefix sums stay within the budget, then, past the first document that does
not fit, each further one that still fits. So a source ends less than its smallest remaining document below its target.

A source may hold a third of all rows, so no step sorts a whole source. Keys fall into ``SLICES`` slices by their
logarithm, which spreads them alike whatever the weights; the sums of slices (pre-aggregated) tell in which one the
budget ends, the sums of that slice's own ``SLICES`` parts tell in which part, and only that part is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import Scratch, join_small, only

#: Slices of a source's key range, and parts of a slice; of 10^10 documents a part holds some 10^4.
SLICES = 4096
#: Documents of a source that are looked at in one round for what still fits.
ROUND = 512
#: A word is a run of other characters than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Signs whose share lowers a document's default quality weight.
SIGNS = "!#$%&*|<>{}[]\\^~`=+_@"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_quality(text: Column) -> Column:
    """Default quality weight, from 0.1 to 1: one less the share of signs, four times over."""
    clean = F.length(F.translate(text, SIGNS, ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.lit(1.0) - 4.0 * (1.0 - F.try_divide(clean, F.length(text))), F.lit(1.0)))


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """source, source_size, target: sources by code point, null last, take the weights in turn.

    sources: one row per source with its size. Only sums of at most len(weights) groups reach the driver. Each
    round caps the sources that stand above their cap at the current level; capped ones stay capped, since the
    level only rises. The order by name is one sort of the table of sources by range.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    placed = sources.repartitionByRange(max(1, sources.sparkSession.sparkContext.defaultParallelism), *by_name).withColumn("part", F.spark_partition_id())
    placed = Scratch(placed, "sources").df()
    before, total = {}, 0
    for row in sorted(placed.groupBy("part").count().collect(), key=lambda r: r["part"]):
        before[row["part"]] = total
        total += row["count"]
    if not before:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    place = offset + F.row_number().over(Window.partitionBy("part").orderBy(*by_name)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = Scratch(placed.select("source", "source_size", weight.alias("weight")), "weights").df()
    every = weighed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    cap = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        row = weighed.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (every - row["held"]) / row["open"]
    return weighed.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, quality: Column | None = None, carry: tuple[str, ...] = (), seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes), times (copies) and the carried columns.

    quality: weight of a document, above 0, as a column of docs; text_quality() of its text unless given. A document
    is taken whole, ``times`` times over: the complete epochs of its source and one more if it is drawn for the rest.

    Null texts and texts without words have size 0 and are taken 0 words. Null sources form one source, the
    last. Null ids take part; a null quality counts as 1. Repeated rows count each; rows alike in every column draw
    the same key and follow one another. An empty table gives no rows. Reruns agree, since every draw is a hash of
    the row.
    """
    kinds = dict(docs.dtypes)
    columns = [(c, kinds.get(c, "string")) for c in carry if c not in ("doc_id", "text", "source")]
    if quality is not None:
        docs = docs.select("*", quality.cast("double").alias("_quality"))
    rows = only(docs, ("doc_id", "bigint"), ("text", "string"), ("source", "string"), ("_quality", "double"), *columns)
    draw = F.xxhash64(F.lit(seed), "doc_id", "source", F.xxhash64("text"))
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.coalesce("_quality", F.lit(1.0)) if quality is not None else text_quality(F.col("text"))
    key = -F.log(u) / F.least(F.lit(1e6), F.greatest(F.lit(1e-6), weight))
    kept = rows.select(
        "doc_id", "source", *[c for c in carry if c not in ("doc_id", "source")], words(F.col("text")).alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("row"), key.alias("key"),
    )
    # Logarithms of keys lie between -64 and 64.
    place = (F.log("key") + 64.0) * F.lit(SLICES / 128)
    kept = kept.withColumn("slice", F.floor(place).cast("int")).withColumn("part", F.floor((place - F.floor(place)) * SLICES).cast("int"))
    kept = Scratch(kept, "draws").df()
    sums = Scratch(kept.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices").df()
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    named = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]
    aims = targets.withColumn("epochs", epochs).select(*named, "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    aims = Scratch(_ends(aims, sums.select(*named, "slice", "words"), "slice", "rest", "last", "left"), "aims").df()
    on, n = ["none", "name"], aims.count()
    kept = kept.select("*", *named)

    # The slice on which each budget ends, then the part of it.
    here = join_small(kept.select(*on, "slice", "part", "size", "draw"), aims.select(*on, "last"), on, n, spread=F.col("draw")).filter(F.col("slice") == F.col("last"))
    parts = here.groupBy(*on, "part").agg(F.sum("size").alias("words"))
    plan = Scratch(_ends(aims.withColumnRenamed("left", "in_slice"), parts, "part", "in_slice", "last_part", "left"), "plan").df()
    joined = join_small(kept, plan, on, n, spread=F.col("draw"))
    at = F.struct("slice", "part")
    end = F.struct(F.col("last").alias("slice"), F.col("last_part").alias("part"))
    ordered = Window.partitionBy(*on).orderBy("key", "draw", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.filter(at == end).withColumn("fits", F.sum("size").over(ordered) <= F.col("left"))
    edge = Scratch(edge, "edge").df()
    every = joined.filter(at != end).withColumn("fits", at < end).unionByName(edge)

    # Past the first document that does not fit, those that still do.
    used = edge.filter("fits").groupBy(*on).agg(F.sum("size").alias("used"))
    gaps = Scratch(plan.filter("last >= 0").join(used, on, "left").select(*on, (F.col("left") - F.coalesce("used", F.lit(0))).alias("gap"), F.lit(-1.0).alias("after")), "gaps").df()
    drawn = []
    others = every.filter(~F.col("fits") & (F.col("size") > 0)).select(*on, "size", "key", "draw", "row")
    while True:
        able = join_small(others, gaps, on, n, spread=F.col("row")).filter((F.col("size") <= F.col("gap")) & (F.col("key") > F.col("after")))
        able = able.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy("key", "draw", "row"))).filter(F.col("k") <= ROUND)
        # At most ROUND rows of a source, taken in order as long as they fit.
        able = able.groupBy(*on).agg(F.first("gap").alias("gap"), F.max("key").alias("after"), F.sort_array(F.collect_list(F.struct("k", "size", "row"))).alias("rows"))
        none = F.array().cast("array<bigint>")
        took = F.aggregate(
            "rows", F.struct(F.col("gap").alias("gap"), none.alias("rows")),
            lambda a, r: F.when(r["size"] <= a["gap"], F.struct((a["gap"] - r["size"]).alias("gap"), F.array_append(a["rows"], r["row"]).alias("rows"))).otherwise(a),
        )
        step = Scratch(able.select(*on, "after", took.alias("took")).select(*on, "after", "took.gap", F.col("took.rows").alias("rows")), "step").df()
        if step.isEmpty():
            break
        drawn.append(step.select(F.explode("rows").alias("row")))
        gaps = step.select(*on, "gap", "after")
    extra = drawn[0] if drawn else kept.select("row").limit(0)
    for more in drawn[1:]:
        extra = extra.unionByName(more)
    extra = Scratch(extra.withColumn("more", F.lit(True)), "extra").df()
    found = join_small(every, extra, ["row"], extra.count(), "left", spread=F.col("draw"))
    times = F.least(F.lit(most), F.col("epochs") + (F.col("fits") | F.coalesce("more", F.lit(False))).cast("int"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *[c for c in carry if c != "doc_id"])


def _ends(aims: DataFrame, sums: DataFrame, by: str, budget: str, last: str, left: str) -> DataFrame:
    """aims with the slice on which each budget ends (-1: none) and what it may still take there; sums: words of each slice, at most SLICES a source."""
    on = ["none", "name"]
    run = Window.partitionBy(*on).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = sums.withColumn("until", F.sum("words").over(run)).join(aims.select(*on, F.col(budget).alias("budget")), on)
    ends = until.filter("until >= budget and until - words < budget and budget > 0").groupBy(*on).agg(F.min(by).alias(last), F.min_by(F.expr("budget - (until - words)"), F.col(by)).alias(left))
    return aims.join(ends, on, "left").withColumn(last, F.coalesce(last, F.lit(-1))).withColumn(left, F.coalesce(left, F.lit(0.0)))
