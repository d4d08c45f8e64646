"""Operator 12: exact top-k search by inner product as a Voronoi kNN join.

Vectors are scaled to integers. Largest inner product becomes nearest Euclidean neighbour by one more coordinate: a
row x gets ``sqrt(M^2 - |x|^2)`` (M: the largest norm), a query gets 0; then distance^2 is
``M^2 + |q|^2 - 2 q.x``. ``n_pivots`` rows, taken by the order of a hash, are the pivots. Queries and rows are
grouped with the pivot nearest to them (Voronoi cells).

- **Summaries.** Of every cell: queries and their largest distance to the pivot (U); rows and their largest distance;
  the ``k + 1`` smallest distances of different ids. These are at most ``n_pivots (k + 4)`` numbers, on the driver.
- **Bounds.** For query cell i, ``U_i + |p_i p_j| + |p_j s|`` bounds the distance of any of its queries to a summary
  row s of cell j; the (k+1)-th smallest over all cells is theta_i (one may be the query itself). A row of cell j
  nearer than ``|p_i p_j| - U_i - theta_i`` to its pivot cannot be among the k best of any query of cell i.
- **Replication.** Query cells are merged (next to each other first) or split into groups of about ``group_rows``
  queries. A row is copied only to the groups whose bound it meets, and there to one chunk of about
  ``chunk_rows`` rows by a hash, so a hot cell or a hot group spreads; a group's queries meet all its chunks.
- **Local solution.** A chunk goes through its cells, for each only with the queries whose k-th best so far can be
  beaten there: the distance of a query to a cell is at least its distance to the pivot less the cell's reach, and
  at least its distance to the plane between that pivot and its own. Integer products are exact in doubles.
  The k best per query and chunk are ranked once more by Spark.

Defined cases: vectors that are null or hold null or non-finite components take no part, rows without an id neither;
a zero vector does; shorter vectors count as filled up with zeros; scaled components beyond +-2^20 are held there;
rows equal in id and vector count once; rows that share an id with different vectors are queries and
candidates of their own, but never of a query with that id; ties go to the smaller id; with fewer candidates than
k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship_package
from .vectors import best, finite, kth_largest, matrix, padded, scaled

#: Roots of differences lose half of a double's digits; bounds are widened by this share of the largest norm.
SLACK = 1e-6


class Pivots:
    """The pivots in the lifted space: ``at`` (integer vectors), ``lift``, and the distances between them."""

    def __init__(self, vectors: np.ndarray, top_square: float) -> None:
        self.top = top_square
        self.slack = SLACK * (top_square**0.5 + 1)
        self.at = vectors
        self.lift = np.sqrt(np.maximum(top_square - (vectors**2).sum(axis=1), 0))
        self.between = np.sqrt(np.maximum(2 * (top_square - vectors @ vectors.T - np.outer(self.lift, self.lift)), 0))
        np.fill_diagonal(self.between, 0)

    def from_rows(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        lift = np.sqrt(np.maximum(self.top - (rows**2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * (self.top - rows @ self.at.T - np.outer(lift, self.lift)), 0))

    def from_queries(self, queries: np.ndarray) -> np.ndarray:
        square = (queries**2).sum(axis=1, keepdims=True)
        return np.sqrt(np.maximum(self.top + square - 2 * (queries @ self.at.T), 0))


def _celled(rows: DataFrame, pivots, queries: bool) -> DataFrame:
    """``rows`` with the nearest pivot ``cell`` and the distance ``gap`` to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            d = pivots.value.from_queries(v) if queries else pivots.value.from_rows(v)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "gap"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<int>, cell int, gap double")


def join_bounds(between: np.ndarray, reach: np.ndarray, summary: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """``least[i, j]``: a row of cell j nearer to its pivot than this is needed by no query of cell i.

    ``reach``: the largest distance of cell i's queries to its pivot (NaN: it has none); ``summary``: (cell, distance, id) rows.
    """
    least = np.full(between.shape, np.inf)
    for i in np.flatnonzero(~np.isnan(reach)):
        theta, met = np.inf, set()
        for bound, who in sorted((reach[i] + between[i, j] + d, who) for j, d, who in summary):
            met.add(who)
            if len(met) > k:
                theta = bound
                break
        least[i] = between[i] - reach[i] - theta
    return least


def group_cells(between: np.ndarray, sizes: np.ndarray, group_rows: int) -> list[tuple[list[int], int]]:
    """Query cells as (cells, parts): near cells merged up to ``group_rows`` queries, larger ones in parts."""
    left = set(np.flatnonzero(sizes).tolist())
    groups = []
    while left:
        first = max(left, key=lambda c: (sizes[c], -c))
        cells, total = [], 0
        for c in sorted(left, key=lambda c: (between[first, c], c)):
            if cells and total + sizes[c] > group_rows:
                break
            cells.append(c)
            total += sizes[c]
        left -= set(cells)
        groups.append((cells, int(max(1, -(-total // group_rows)))))
    return groups


def _solve(queries: pa.Table, rows: pa.Table, pivots: Pivots, k: int) -> pa.Table:
    """The k best rows of one chunk for every query of one group."""
    out = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
    if queries.num_rows and rows.num_rows:
        rows = rows.sort_by([("cell", "ascending"), ("id", "ascending")])
        q, qid = matrix(queries.column("v")), queries.column("id").to_numpy()
        qrow, own = queries.column("row").to_numpy(), queries.column("cell").to_numpy()
        v, vid = matrix(rows.column("v")), rows.column("id").to_numpy()
        cell, gap = rows.column("cell").to_numpy(), rows.column("gap").to_numpy()
        far = pivots.from_queries(q)
        far_own = far[np.arange(len(q)), own]
        square = (q**2).sum(axis=1)
        cells, starts = np.unique(cell, return_index=True)
        ends = [*starts[1:], len(cell)]
        kth = np.full(len(q), -np.inf)
        top = np.full((len(q), k), -np.inf)
        for at in np.argsort(far[:, cells].mean(axis=0), kind="stable"):
            c, lo, hi = cells[at], starts[at], ends[at]
            inside = np.maximum(far[:, c] - gap[lo:hi].max(), gap[lo:hi].min() - far[:, c])
            wall = np.where(own == c, 0, (far[:, c] ** 2 - far_own**2) / (2 * np.maximum(pivots.between[own, c], 1e-300)))
            away = np.maximum(np.maximum(inside, wall) - pivots.slack, 0)
            need = np.flatnonzero((pivots.top + square - away**2) / 2 + 0.5 >= kth)  # scores are integers
            if not len(need):
                continue
            for part in np.array_split(need, max(1, len(need) * (hi - lo) >> 21)):
                s = q[part] @ v[lo:hi].T
                s[qid[part][:, None] == vid[None, lo:hi]] = -np.inf
                s[s < kth[part][:, None]] = -np.inf
                r, p = best(s, k)
                out["query_id"].append(qid[part[r]])
                out["query_row"].append(qrow[part[r]])
                out["vec_id"].append(vid[lo + p])
                out["score"].append(s[r, p])
                both = np.hstack([top[part], s])
                top[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[part] = kth_largest(top[part], k)
    kinds = {"query_id": np.int64, "query_row": np.int64, "vec_id": np.int64, "score": np.int64}
    flat = {n: np.concatenate(x).astype(kinds[n]) if x else np.zeros(0, np.int64) for n, x in out.items()}
    order = np.lexsort((flat["vec_id"], -flat["score"], flat["query_row"], flat["query_id"]))
    who = np.stack([flat["query_id"], flat["query_row"]])[:, order]
    new = np.concatenate(([True], (who[:, 1:] != who[:, :-1]).any(axis=0))) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return pa.table({n: x[order][place < k] for n, x in flat.items()})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, n_pivots: int = 64, group_rows: int = 4096,
          chunk_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest integer inner product with every row that ``is_query``
    holds for."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(finite(F.col("v")) & F.col("id").isNotNull()).withColumn("v", scaled(F.col("v"), scale))
    rows = cut(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")), "integers")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    dims, top = rows.agg(F.max(F.size("v")), F.max(square)).first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = padded(rows, dims)
    picked = rows.orderBy(F.xxhash64("id", "v", F.lit("pivot")), "id").limit(n_pivots).select("v").distinct().toArrow()  # n_pivots rows
    pivots = Pivots(matrix(picked.column("v")), float(top))
    sent = spark.sparkContext.broadcast(pivots)  # n_pivots vectors
    data = cut(_celled(rows, sent, False), "cells")
    asking = cut(_celled(rows.where("asks"), sent, True).withColumn("row", F.monotonically_increasing_id()), "queries")

    # summaries and bounds: a few numbers per cell
    n = len(pivots.at)
    reach, asked, held, radius = np.full(n, np.nan), np.zeros(n, int), np.zeros(n, int), np.zeros(n)
    for r in asking.groupBy("cell").agg(F.max("gap").alias("reach"), F.count("*").alias("n")).collect():
        reach[r.cell], asked[r.cell] = r.reach, r.n
    for r in data.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], held[r.cell] = r.radius, r.n
    nearest = Window.partitionBy("cell").orderBy("gap", "id")
    ids = data.groupBy("cell", "id").agg(F.min("gap").alias("gap")).withColumn("nr", F.row_number().over(nearest)).where(F.col("nr") <= k + 1)
    summary = [(r.cell, r.gap, r.id) for r in ids.select("cell", "gap", "id").collect()]  # n_pivots (k + 1) rows
    least = join_bounds(pivots.between, reach, summary, k) - pivots.slack

    # groups of query cells; the bound of a group is its cells' least
    groups = group_cells(pivots.between, asked, group_rows)
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    need = np.stack([least[cells].min(axis=0) for cells, _ in groups])  # group x cell
    chunks = [max(1, -(-int(held[radius >= need[g]].sum()) // chunk_rows)) for g in range(len(groups))]
    of_cell = {c: g for g, (cells, _) in enumerate(groups) for c in cells}
    plan = spark.createDataFrame(
        [(int(c), g, groups[g][1], chunks[g]) for c, g in of_cell.items()], "cell int, grp int, parts int, chunks int")  # n_pivots rows
    copies = spark.createDataFrame(
        [(int(c), g, groups[g][1], chunks[g], float(need[g, c])) for g in range(len(groups)) for c in np.flatnonzero(radius >= need[g])],
        "cell int, grp int, parts int, chunks int, least double")  # at most n_pivots^2 rows
    spread = F.xxhash64("id", "v")
    left = asking.join(F.broadcast(plan), "cell").withColumn("part", F.pmod(spread, F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = data.join(F.broadcast(copies), "cell").where(F.col("gap") >= F.col("least")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("chunk", F.pmod(F.xxhash64("id", "v", F.lit("chunk")), F.col("chunks")).cast("int"))
    keys = ["grp", "part", "chunk"]
    found = left.select(*keys, "id", "row", "v", "cell").groupBy(*keys).cogroup(right.select(*keys, "id", "v", "cell", "gap").groupBy(*keys)).applyInArrow(
        lambda a, b: _solve(a, b, sent.value, k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
