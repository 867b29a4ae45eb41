"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v. Each node's larger (or smaller) neighbours are linked to the least of the node and its neighbours.

    The least is a pre-aggregated minimum, joined back; a node with very many neighbours is a skewed join key that
    adaptive execution splits.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        made = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that links reach, for every node with a link other than to itself.

    links: u, v (bigint). Each round is written to the shared folder; the last two are compared by count and hash sums.
    """
    now = Scratch(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = now.df().agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        after = Scratch(_star(_star(now.df(), True), False), "links")
        now.drop()
        now = after
    else:
        raise RuntimeError("components did not settle")
    # Settled: every node points at the least one of its component.
    found = now.df()
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
