"""Exact top-k search by inner product as a Voronoi kNN join.

1. Pivots come from a bounded sample (they set speed, never results); each vector joins its nearest pivot's cell.
2. Per cell a summary: its radius, and its k + 1 vectors nearest to the pivot with their distances.
3. Queries are grouped by cells: one group for each cell, or neighbouring cells together where the bounds of many
   small groups would send nearly every vector to each of them (the cheapest of a few groupings, by the share of the
   sample that each would send). With centre p and radius r of a group, every query q of it has |q - p| <= r, so for
   a vector x: x.p - r|x| <= q.x <= x.p + r|x|. The (k + 1)-th best lower bound over the summaries is a floor theta of
   the k-th best score of every query in the group (one more, as a query's own row may be among them).
4. A vector goes to a group only if its upper bound reaches theta; a cell as a whole is left out by the same bound
   on its summary. What goes there is dealt by (group, block of queries, chunk of a cell) and solved locally; a query
   goes only to the chunks of cells that are open to its group.

Scores are exact integers: products run in float64 while they fit 2^53, else in Python's integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import Scratch, only

#: Vectors that the pivots are fitted on, and least and most pivots (between them a quarter of the root of all vectors); they only steer speed.
SAMPLE, PIVOTS, MOST_PIVOTS = 20_000, 16, 2048
#: Queries of a block, and vectors of a chunk (rough mean) that one task meets at once.
BLOCK, CHUNK = 1024, 8192
#: Room for float64 rounding in the bounds, as a share of the product of the norms.
SLACK = 1e-9
#: What sending a vector to a group costs, in products with a query.
SEND = 400


def as_matrix(vectors, width: int) -> np.ndarray:
    """Vectors of possibly different lengths as rows, padded with zeros, as int64 where they fit."""
    big = any(max(v, default=0) >= 2**62 or min(v, default=0) <= -(2**62) for v in vectors)
    out = np.zeros((len(vectors), width), object if big else "int64")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products; rows are vectors. Values beyond 64 bits are clipped to the range of a long."""
    width = max(1, queries.shape[1])
    if queries.dtype != object and data.dtype != object:
        top = int(np.abs(queries).max(initial=0)) * int(np.abs(data).max(initial=0)) * width
        if top < 2**53:
            return (queries.astype("float64") @ data.astype("float64").T).astype("int64")
        if top < 2**63:
            return queries @ data.T
    exact = queries.astype(object) @ data.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype("int64")


def scaled(vector, scale: int) -> list[int] | None:
    """floor(scale * x) for each component, or None for a null vector or one with a null or non-finite component."""
    if vector is None:
        return None
    v = np.array([np.nan if x is None else x for x in vector], "float64")
    if not np.isfinite(v).all():
        return None
    low = np.floor(v * scale)
    if not np.isfinite(low).all():
        return None
    return [max(-(2**63), min(2**63 - 1, int(x))) for x in low]


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """A few rounds of k-means from rows that are each the farthest from those before."""
    n = min(n, len(sample))
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, np.square(sample - sample[chosen[-1]]).sum(1))
        chosen.append(int(far.argmax()))
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        near = nearest(sample, pivots)
        for k in range(n):
            if (own := near == k).any():
                pivots[k] = sample[own].mean(0)
    return pivots


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (np.square(pivots).sum(1) - 2.0 * (vectors @ pivots.T)).argmin(1)


def dealt(vectors: DataFrame, every: int, k: int, scale: int) -> tuple[DataFrame, DataFrame, int, int] | None:
    """The queries and the vectors with the (group, block, chunk) they go to, the width of all vectors and the number of chunks; None without a query or a candidate."""
    spark = vectors.sparkSession
    def whole(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = [(i, v) for i, x in zip(ids, rows, strict=True) if i is not None and (v := scaled(x, scale)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array([v for _, v in kept], pa.list_(pa.int64()))], names=["vec_id", "vec"])

    base = only(vectors, ("vec_id", "bigint"), ("embedding", "array<double>")).mapInArrow(whole, "vec_id bigint, vec array<bigint>")
    base = Scratch(base.withColumn("row", F.monotonically_increasing_id()), "vectors").df()
    shape = base.agg(F.max(F.size("vec")).alias("width"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    if not shape["queries"] or shape["n"] < 2:
        return None
    width, n = max(1, shape["width"]), shape["n"]

    sample = base.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vec").collect()
    some = as_matrix([r["vec"] for r in sample], width).astype("float64")
    pivots = fit_pivots(some, max(PIVOTS, min(MOST_PIVOTS, math.isqrt(n) // 4)))

    def celled(batches):
        for batch in batches:
            x = as_matrix(batch.column("vec").to_pylist(), width).astype("float64")
            cell = nearest(x, pivots) if len(x) else np.zeros(0, int)
            away = np.sqrt(np.square(x - pivots[cell]).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("int32")), pa.array(away)], names=["vec_id", "vec", "row", "cell", "away"])

    cells = Scratch(base.mapInArrow(celled, "vec_id bigint, vec array<bigint>, row bigint, cell int, away double"), "cells").df()
    # At most MOST_PIVOTS radii and sizes, and MOST_PIVOTS * (k + 1) vectors.
    per = cells.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    radius, held = {r["cell"]: r["radius"] for r in per}, {r["cell"]: r["n"] for r in per}
    summary = _closest(cells, k + 1, width)

    is_query = F.col("vec_id") % every == 0
    asked = cells.filter(is_query)
    per_cell = {r["cell"]: (r["n"], r["radius"]) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    groups, centre, reach, floor = _grouped(per_cell, pivots, summary, some, k)
    blocks = [-(-sum(per_cell[c][0] for c in own) // BLOCK) for own in groups]
    # A cell as a whole: x.p <= c.p + radius|p| and |x| <= |c| + radius for its pivot c.
    wide = np.array([radius.get(c, 0.0) for c in range(len(pivots))])
    size_c, size_p = np.sqrt(np.square(pivots).sum(1)), np.sqrt(np.square(centre).sum(1))
    over = centre @ pivots.T + wide * size_p[:, None] + reach[:, None] * (size_c + wide)
    open_cells = over + SLACK * (1 + (size_c + wide) * (size_p + reach)[:, None]) >= floor[:, None]
    # Cells of more than CHUNK vectors are cut; smaller ones share a chunk with their neighbours in number.
    parts, first, at, room = np.ones(len(pivots), "int64"), np.zeros(len(pivots), "int64"), -1, 0
    for c in range(len(pivots)):
        size = held.get(c, 0)
        parts[c] = max(1, -(-size // CHUNK))
        if at < 0 or parts[c] > 1 or size > room:
            at, room = at + 1, CHUNK
        first[c], room = at, 0 if parts[c] > 1 else room - size
        at += int(parts[c]) - 1
    chunks = at + 1
    goes_to = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(own)])) if own.any() else np.zeros(0, "int64") for own in open_cells]

    def sent(batches):
        for batch in batches:
            x = as_matrix(batch.column("vec").to_pylist(), width).astype("float64")
            if not len(x):
                continue
            cell = batch.column("cell").to_numpy()
            norm = np.sqrt(np.square(x).sum(1))[:, None]
            bound = x @ centre.T + norm * reach + SLACK * (1 + norm * (size_p + reach))
            goes = (bound >= floor) & open_cells[:, cell].T
            at, group = np.nonzero(goes)
            chunk = (first[cell] + (batch.column("row").to_numpy() * 0x9E3779B1 % 2**32 >> 7) % parts[cell])[at]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(group.astype("int32")), pa.array(chunk.astype("int32")), taken.column("vec_id"), taken.column("row"), taken.column("vec")], names=["group", "chunk", "vec_id", "row", "vec"])

    data = cells.select("vec_id", "vec", "row", "cell").mapInArrow(sent, "`group` int, chunk int, vec_id bigint, row bigint, vec array<bigint>")
    number = F.create_map(*[F.lit(x) for i, own in enumerate(groups) for c in own for x in (c, i)])
    count = F.create_map(*[F.lit(x) for i, own in enumerate(groups) for c in own for x in (c, blocks[i])])
    block = F.pmod(F.xxhash64("row"), F.element_at(count, F.col("cell"))).cast("int")
    asked = asked.select(F.element_at(number, F.col("cell")).alias("group"), block.alias("block"), "vec_id", "row", "vec")
    # Each block meets each chunk of its group's vectors; the vectors go to every block of their group.
    most = max(blocks)
    if most > 1:
        many = F.element_at(F.array(*[F.lit(n) for n in blocks]), F.col("group") + 1)
        data = data.withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    else:
        data = data.withColumn("block", F.lit(0))

    def sent_queries(batches):
        for batch in batches:
            own = [goes_to[g] for g in batch.column("group").to_pylist()]
            many = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(many)).columns, pa.array((np.concatenate(own) if own else many).astype("int32"))], names=[*batch.schema.names, "chunk"])

    asked = asked.mapInArrow(sent_queries, "`group` int, block int, vec_id bigint, row bigint, vec array<bigint>, chunk int")
    return asked, data, width, chunks


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by every; ties go to the smaller
    vec_id. Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part. Shorter vectors count as padded with zeros; an empty vector scores 0.
    Repeated ids are rows of their own: each may be a candidate of the other, and each query row is answered.
    Fewer candidates than k give fewer rows; an empty table none. Other columns take no part.
    """
    found = dealt(vectors, every, k, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    asked, data, width, _ = found

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []}, dtype="int64")
        if not len(q) or not len(x):
            return empty
        scores = products(as_matrix(list(q["vec"]), width), as_matrix(list(x["vec"]), width))
        ids, rows = x["vec_id"].to_numpy(), x["row"].to_numpy()
        found = []
        for i, (query, own) in enumerate(zip(q["vec_id"], q["row"], strict=True)):
            s = scores[i]
            if len(s) > 4 * k + 8:
                edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                at = np.flatnonzero(s >= edge)
            else:
                at = np.arange(len(s))
            at = at[rows[at] != own]
            best = at[np.lexsort((rows[at], ids[at], -s[at]))[:k]] if s.min() > -(2**63) else np.array(sorted(at, key=lambda j: (-int(s[j]), ids[j], rows[j]))[:k], int)  # noqa: B023
            found += [(query, own, ids[j], rows[j], s[j]) for j in best]
        return pd.DataFrame(found, columns=list(empty.columns)).astype("int64") if found else empty

    keys = ["group", "block", "chunk"]
    local = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint")
    # At most k rows for each query and chunk meet here.
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _grouped(per_cell: dict[int, tuple[int, float]], pivots: np.ndarray, summary: np.ndarray, sample: np.ndarray, k: int) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Cells of each group of queries, with the groups' centres, radii and floors: the cheapest of a few groupings."""
    asked, best = sorted(per_cell), None
    own, sizes = pivots[asked], np.array([per_cell[c][0] for c in asked])
    far, norms, sizes_of = np.array([per_cell[c][1] for c in asked]), np.sqrt(np.square(summary).sum(1)), np.sqrt(np.square(sample).sum(1))
    count = len(asked)
    while count:
        near = nearest(own, fit_pivots(own, count)) if count < len(asked) else np.arange(len(asked))
        members = [np.flatnonzero(near == g) for g in range(count)]
        members = [m for m in members if len(m)]
        centre = np.array([np.average(own[m], axis=0, weights=sizes[m]) for m in members])
        reach = np.array([(np.sqrt(np.square(own[m] - c).sum(1)) + far[m]).max() for m, c in zip(members, centre, strict=True)]) * (1 + SLACK)
        lower = centre @ summary.T - reach[:, None] * norms
        lower -= SLACK * (1 + norms * (np.sqrt(np.square(centre).sum(1)) + reach)[:, None])
        floor = np.sort(lower, 1)[:, -(k + 1)] if lower.shape[1] > k else np.full(len(members), -np.inf)
        share = (sample @ centre.T + sizes_of[:, None] * reach >= floor).mean(0)
        asks = np.array([sizes[m].sum() for m in members])
        cost = float((share * (SEND * -(-asks // BLOCK) + asks)).sum())
        if best is None or cost < best[0]:
            best = cost, [[asked[i] for i in m] for m in members], centre, reach, floor
        count //= 2
    return best[1:]


def _closest(cells: DataFrame, m: int, width: int) -> np.ndarray:
    """The m vectors of each cell nearest to its pivot, as rows: each task sends at most m per cell."""

    def local(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for cell, away, vec in zip(batch.column("cell").to_pylist(), batch.column("away").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                own = kept.setdefault(cell, [])
                if len(own) < m or away < own[-1][0]:
                    own.append((away, vec))
                    own.sort()
                    del own[m:]
        rows = [(c, a, v) for c, own in kept.items() for a, v in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["cell", "away", "vec"])

    some = cells.select("cell", "away", "vec").mapInArrow(local, "cell int, away double, vec array<bigint>")
    # Tasks * PIVOTS * m rows meet by cell and part, then PIVOTS * m by cell.
    order = Window.partitionBy("cell").orderBy("away", "vec")
    rows = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= m).select("vec").collect()
    return as_matrix([r["vec"] for r in rows], width).astype("float64")
